"""Ordered and stateful selections: first occurrences, splits, samples, greedy cuts, capped picks.

What depends on one key only is a window; what carries state from row to row runs once per group in Arrow batches.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import salted


def first_flag(df: DataFrame, key: str, *order: str) -> DataFrame:
    return df.withColumn("first", F.row_number().over(W.partitionBy(key).orderBy(*order)) == 1)


def conflicts(df: DataFrame, key: str, content: str, *order: str) -> DataFrame:
    """Later rows of a key whose content isn't that of its first."""
    w = W.partitionBy(key).orderBy(*order)
    return df.withColumn("__first", F.first(content).over(w)).where(F.col("__first") != F.col(content)).drop("__first")


def numbered(df: DataFrame, block: Column, *order, by: list[str], name: str) -> DataFrame:
    """``df`` with places from 0 in ``order`` within each group of ``by`` (nulls are a group), counted by blocks.

    ``block`` cuts a group along its order, so that no task sees a whole group; the places before a block are the sum of the
    sizes of the blocks before it, a row for each block.
    """
    cut = df.withColumn("__block", block)
    keys = [*by, "__block"]
    sizes = cut.groupBy(*keys).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*by).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], before.alias("__before"))
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    inner = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
    out = cut.withColumn("__inner", inner).join(sizes, reduce(lambda a, b: a & b, same))
    return out.withColumn(name, F.col("__inner") + F.col("__before")).drop("__block", "__inner", "__before", *(f"__k{i}" for i in range(len(keys))))


def hash_shuffle(df: DataFrame, salt: str, key: str, *by: str) -> DataFrame:
    """A seeded order within each group, ``place`` from 1: the order of salted hashes, whatever the partitioning."""
    rows = df.withColumn("__hash", salted(salt, *by, key))
    return numbered(rows, F.substring("__hash", 1, 3), "__hash", key, by=list(by), name="place").withColumn("place", F.col("place") + 1).drop("__hash")


def hash_sample(df: DataFrame, k: int, salt: str, key: str) -> DataFrame:
    """k rows by salted hash: a distributed top-k."""
    return df.orderBy(salted(salt, key), key).limit(k)


def hash_split(df: DataFrame, share: float, salt: str, key: str, by: str) -> DataFrame:
    """``side``: of each group the first round(share * n) keys by salted rank are ``selection``."""
    w = W.partitionBy(by)
    rank = F.row_number().over(w.orderBy(salted(salt, by, key), key))
    return df.withColumn("side", F.when(rank <= F.bround(F.count("*").over(w) * share), "selection").otherwise("test"))


def hash_side(share: float, salt: str, key: str) -> Column:
    """Whether the first 16 digits of the salted hash lie below ``share`` of their range: no shuffle."""
    limit = format(min(int(share * 2**64), 2**64 - 1), "016x")
    return F.substring(salted(salt, key), 1, 16) < limit


def running(df: DataFrame, value: str, name: str, *order) -> DataFrame:
    """``df`` with ``name``: the sum of a number over all rows before one in a total order.

    Sums run within range parts of the order, which are stored once, and start from the sums of the parts before.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = stored(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    upto = lambda w: F.coalesce(F.sum(value).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    before = cut.groupBy("__part").agg(F.sum(value).alias(value)).select("__part", upto(W.orderBy("__part")).alias("__before"))  # a row for each part
    inner = cut.withColumn(name, upto(W.partitionBy("__part").orderBy(*order)))
    return inner.join(F.broadcast(before), "__part").withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__before")


def until_target(df: DataFrame, target: int, size: str, *order) -> DataFrame:
    """Rows in order until their sizes reach the target, the one that crosses it included."""
    return running(df, size, "__sum", *order).where(F.col("__sum") < target).drop("__sum")


def every_kth(df: DataFrame, n: int, *order: str) -> DataFrame:
    """n rows, evenly spaced in order: ranks by range partitions, so no task sees all rows."""
    spark, step = df.sparkSession, max(df.count() // n, 1)
    numbered = ranked(df, *order)
    return numbered.where((F.col("rank") % step == 0) & (F.col("rank") < step * n)).drop("rank")


def ranked(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with a global ``rank`` from 0: ranks within the parts of a total order, after the sizes of the parts before.

    The parts are stored once: their bounds are sampled, so to cut twice could give other parts.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = stored(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    sizes = cut.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inner = F.row_number().over(W.partitionBy("__part").orderBy(*order)) - 1
    return cut.withColumn("rank", inner.cast("long")).join(F.broadcast(before), "__part").withColumn("rank", F.col("rank") + F.col("__before")).drop("__part", "__before")


def greedy_cut(df: DataFrame, budget: float, size: str, key: str, pool: str) -> DataFrame:
    """``batch`` and ``pos``: in each pool by (size, key), a new batch begins where one more would pad beyond the budget.

    A pool is a bounded number of rows by its making (``floor(batch / P)``); its state goes from row to row.
    """

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([size, key], kind="stable")
        batch, n, batches, places = 0, 0, [], []
        for s in pdf[size].to_numpy():
            if n and (n + 1) * s > budget:
                batch, n = batch + 1, 0
            batches.append(batch)
            places.append(n)
            n += 1
        return pdf.assign(batch=np.array(batches, "int64"), pos=np.array(places, "int64"))

    return df.groupBy(pool).applyInPandas(cut, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", batch long, pos long")


def duration_batches(df: DataFrame, most_rows: int, most_size: float, size: str, key: str, pool: str) -> DataFrame:
    """Longest first; a batch ends at ``most_rows`` rows or where its sizes would exceed ``most_size``."""

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([size, key], ascending=[False, True], kind="stable")
        batch, n, total, out = 0, 0, 0.0, []
        for s in pdf[size].to_numpy():
            if n and (n == most_rows or total + s > most_size):
                batch, n, total = batch + 1, 0, 0.0
            out.append(batch)
            n, total = n + 1, total + s
        return pdf.assign(batch=np.array(out, "int64"))

    return df.groupBy(pool).applyInPandas(cut, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", batch long")


def diffused_draw(clips: DataFrame, real: DataFrame, share: float, size: str, order: str) -> DataFrame:
    """(pool, order, size): clips in order for each pool so that their size follows ``share`` of the pool's real size.

    A clip is taken while got + d / 2 <= target; what is over or short is carried to the next pool. As the carry only
    moves the target to the running sum of targets, a clip's pool follows from running sums of both sides. Clips without a
    size and pools without a real size are left out; a null pool and a null order come last. Sizes may be negative: a
    clip's pool is the smallest whose running target isn't less, wherever that target lies.
    """
    at = running(clips.select(order, size), size, "v", F.col(order).asc_nulls_last())
    at = at.select(order, size, (F.col("v") + F.col(size) / 2).alias("v"), F.lit(None).alias("pool"), F.lit(0).alias("last")).where("v is not null")
    goals = running(real.select("pool", (F.col("real") * share).alias("goal")).where("goal is not null"), "goal", "v", F.col("pool").asc_nulls_last())
    named = F.struct(F.col("pool").isNull().alias("none"), "pool")
    pools = goals.select(F.lit(None).alias(order), F.lit(None).alias(size), (F.col("v") + F.col("goal")).alias("v"), named.alias("pool"), F.lit(1).alias("last"))
    # the smallest pool of those behind a clip in its range part, and in the parts after. Parts are read backwards: a frame
    # that grows is carried on from row to row, one that shrinks is gone through anew for each
    both = at.unionByName(pools)
    parts = int(clips.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = stored(both.repartitionByRange(parts, "v", "last").withColumn("__part", F.spark_partition_id()))
    firsts = cut.groupBy("__part").agg(F.min("pool").alias("__first"))
    after = firsts.select("__part", F.min("__first").over(W.orderBy(F.desc("__part")).rowsBetween(W.unboundedPreceding, -1)).alias("__after"))  # a row for each part
    backwards = W.partitionBy("__part").orderBy(F.desc("v"), F.desc("last"))
    inside = F.min("pool").over(backwards.rowsBetween(W.unboundedPreceding, W.currentRow))
    dealt = cut.withColumn("__inside", inside).where("last = 0").join(F.broadcast(after), "__part")
    return dealt.withColumn("__of", F.least("__inside", "__after")).where("__of is not null").select("__of.pool", order, size)


def capped(df: DataFrame, caps: dict[str, int], *order: str, group: str | None = None) -> DataFrame:
    """Rows in order of which each key of each capped column keeps at most so many; only kept rows count.

    Caps on several columns depend on each other, within a ``group`` if there is one, so rows are decided in rounds. A row
    that is among the first ``cap`` of each of its keys that aren't rejected is kept whatever becomes of the others; a key
    with ``cap`` such rows rejects all others, which are later. Each round decides at least the first undecided row.
    """
    by = [group] if group else []
    turn = lambda *keys: F.row_number().over(W.partitionBy(*by, *keys).orderBy(*order, "__id"))
    _shared_folder(df)
    # A combination of keys keeps the first of its rows and then no more.
    rows = df.withColumn("__id", F.monotonically_increasing_id()).withColumn("__turn", turn(*caps))
    alive = rows.where(F.col("__turn") <= min(caps.values())).drop("__turn").checkpoint()
    while True:
        kept = alive
        for c, cap in caps.items():
            first = alive.select(*by, c, *order, "__id").withColumn("__turn", turn(c)).where(F.col("__turn") <= cap)
            kept = kept.join(first.select("__id"), "__id", "left_semi")
        kept = kept.checkpoint()
        left = alive.join(kept.select("__id"), "__id", "left_anti")
        for c, cap in caps.items():
            keys = [*by, c]
            full = kept.groupBy(*keys).count().where(F.col("count") >= cap).select(*(F.col(k).alias(f"__{k}") for k in keys))
            same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
            left = left.join(full, same, "left_anti")
        left = left.checkpoint()
        if left.isEmpty():
            return kept.drop("__id")
        alive = kept.unionByName(left)


def alerts(df: DataFrame, over: float, cooldown: float, value: str, ts: str, by: str) -> DataFrame:
    """Readings above a threshold, at most one in each cool-down; only kept ones restart the clock."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf[value] > over].sort_values(ts)
        last, keep = None, []
        for t in pdf[ts]:
            ok = last is None or t - last >= cooldown
            last = t if ok else last
            keep.append(ok)
        return pdf[np.array(keep, bool)]

    return df.groupBy(by).applyInPandas(pick, df.schema)


def _shared_folder(df: DataFrame) -> None:
    """Sees that there is a folder for checkpoints; only a local session that has none gets a temporary one."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        import tempfile

        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lexispark-"))


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the checkpoint folder, for what several plans read."""
    _shared_folder(df)
    return df.checkpoint()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node of each connected component, by min labels that also jump along labels."""
    _shared_folder(edges)
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct().checkpoint()
    now = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")).checkpoint()
    while True:
        near = both.join(now, both.v == now.node).groupBy("u").agg(F.min("label").alias("m")).withColumnRenamed("u", "node")
        step = now.join(near, "node").select("node", F.least("label", "m").alias("label"))
        jump = step.alias("s").join(step.select(F.col("node").alias("n2"), F.col("label").alias("l2")), F.col("s.label") == F.col("n2")).select("node", F.least("label", "l2").alias("label"), "label").toDF("node", "label", "was")
        new = jump.select("node", "label").checkpoint()
        if not new.exceptAll(now).limit(1).count():
            return new
        now = new
