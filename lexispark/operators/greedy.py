"""Greedy choices whose outcome depends on what was chosen before: quotas over several groups, segments of a recording."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .sequences import stored


def contrast_fill(rows: DataFrame, key: str, order: str, pair: str, needs: str, groups: str, most: int) -> DataFrame:
    """(key, decision) of rows made for a pair: those with all groups that it needs, up to ``most`` for each pair."""
    whole = F.size(F.array_except(needs, groups)) == 0
    place = F.row_number().over(W.partitionBy(pair, whole).orderBy(order))
    return rows.select(key, F.when(~whole, "missing_member").when(place > most, "contrast_full").otherwise("selected").alias("decision"))


def quota_fill(rows: DataFrame, quotas: DataFrame, key: str, order: str, target: str, groups: str, counted: DataFrame | None = None) -> DataFrame:
    """(key, decision) of rows in order: selected while the target's count is below its quota; a selected row counts for
    every group it holds, so targets depend on each other.

    ``quotas`` and ``counted`` (what is there already) are (group, n). Rows are decided in rounds from two running counts of
    a row's target: of what is selected before it and of what may yet be. The first undecided row is decided by each round.
    A group without a quota has 0. Keys and orders are distinct.
    """
    have = quotas.select(F.col("group").alias("target"), F.col("n").alias("quota"))
    start = (counted if counted is not None else quotas.limit(0)).select(F.col("group").alias("target"), F.col("n").alias("base"))
    asked = rows.select(F.col(key).alias("key"), F.col(order).alias("order"), F.col(target).alias("target"), F.array_distinct(groups).alias("groups"))
    asked = asked.withColumn("holds", F.coalesce(F.array_contains("groups", F.col("target")), F.lit(False)))
    room = asked.where("holds").join(have, "target", "left").join(start, "target", "left")
    left = stored(room.select("key", "order", "target", "groups", (F.coalesce("quota", F.lit(0)) - F.coalesce("base", F.lit(0))).alias("room"), F.lit(None).cast("boolean").alias("chosen")))
    before = W.partitionBy("group").orderBy("order").rowsBetween(W.unboundedPreceding, -1)
    while not left.where("chosen is null").isEmpty():
        held = left.select("key", "order", "target", "room", "chosen", F.explode("groups").alias("group"))
        sums = held.withColumn("most", F.count("*").over(before)).withColumn("least", F.coalesce(F.sum(F.when(F.col("chosen"), 1).otherwise(0)).over(before), F.lit(0)))
        told = sums.where("group = target and chosen is null").select("key", F.when(F.col("most") < F.col("room"), True).when(F.col("least") >= F.col("room"), False).alias("now"))
        merged = left.join(told, "key", "left").withColumn("chosen", F.coalesce("chosen", "now")).drop("now")
        left = stored(merged.where("chosen is null or chosen"))
    chosen = left.select("key", F.lit(True).alias("chosen"))
    decision = F.when(~F.col("holds"), "missing_target").when(F.col("chosen"), "selected").otherwise("over_target")
    return asked.join(chosen, "key", "left").select(F.col("key").alias(key), decision.alias("decision"))


def cut_segments(start: np.ndarray, end: np.ndarray, target: float, limit: float, least: float) -> list[tuple[int, int]]:
    """Ranges of units: what spans more than ``limit`` is split at its largest pause (the most central of equal ones, then the
    first); neighbours are packed up to ``target``; a range below ``least`` joins its nearer neighbour that leaves it within
    ``limit`` (the one before, of equal ones)."""
    span = lambda a, b: end[b - 1] - start[a]
    pause = start[1:] - end[:-1]
    todo, edges = [(0, len(start))], [0]
    while todo:
        a, b = todo.pop()
        if b - a < 2 or span(a, b) <= limit:
            edges.append(b)
            continue
        cuts = np.arange(a + 1, b)
        at = int(cuts[np.lexsort((cuts, np.abs(2 * cuts - a - b), -pause[a : b - 1]))[0]])
        todo += [(at, b), (a, at)]
    packed = [edges[0]]
    for a, b in zip(edges, edges[1:], strict=False):
        if len(packed) > 1 and span(packed[-2], b) <= target:
            packed[-1] = b
        else:
            packed.append(b)
    k = 0
    while k < len(packed) - 1 and len(packed) > 2:
        if span(packed[k], packed[k + 1]) >= least:
            k += 1
            continue
        sides = [(pause[packed[k] - 1], 0, k)] if k else []  # the edge that goes if the two beside it join
        sides += [(pause[packed[k + 1] - 1], 1, k + 1)] if k + 2 < len(packed) else []
        gone = next((e for _, _, e in sorted(sides) if span(packed[e - 1], packed[e + 1]) <= limit), None)
        if gone is None:
            k += 1
        else:
            del packed[gone]
            k = gone - 1
    return list(zip(packed, packed[1:], strict=False))


def segments(units: DataFrame, by: list[str], start: str, end: str, target: float, limit: float, least: float) -> DataFrame:
    """(by, segment, first, units, start, end) of each recording's units in order of time; a recording is a bounded number
    of units by its making."""

    def cut(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([start, end], kind="stable")
        s, e = pdf[start].to_numpy(float), pdf[end].to_numpy(float)
        rows = [(*keys, n, a, b - a, s[a], e[b - 1]) for n, (a, b) in enumerate(cut_segments(s, e, target, limit, least))]
        return pd.DataFrame(rows, columns=[*by, "segment", "first", "units", "start", "end"])

    kinds = ", ".join(f"`{c}` {units.schema[c].dataType.simpleString()}" for c in by)
    return units.groupBy(*by).applyInPandas(cut, f"{kinds}, segment long, first long, units long, start double, end double")
