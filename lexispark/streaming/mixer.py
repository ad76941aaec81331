"""Mixed, shuffled and pooled streams of several sources, and runs that go on exactly where they stopped."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import salted
from ..operators import gates
from ..operators.sequences import numbered


def mixed(items: DataFrame, shares: DataFrame, source: str, key: str, n: int, salt: str = "mix", block: int = 65_536) -> DataFrame:
    """(draw, source, pass, key) of ``n`` draws: a source by its share, then the source's next item in its pass's order.

    A source's items go round without end, each pass in a seeded order of its own. ``shares`` is (source, share), a row for
    each source, of any sum; a draw's hash falls into the running sum of shares in order of the sources' names, so that each
    draw has a source. Keys are distinct in a source, and each source has items.
    """
    spark = items.sparkSession
    until = lambda last: F.coalesce(F.sum("share").over(W.orderBy(source).rowsBetween(W.unboundedPreceding, last)), F.lit(0))
    whole = F.sum("share").over(W.partitionBy())
    bounds = shares.select(source, (until(-1) / whole).alias("lo"), (until(0) / whole).alias("hi"))  # a row for each source
    unit = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(salt), F.col("draw"))), 1, 7), 16, 10).cast("long") / F.lit(1 << 28)
    draws = spark.range(n).select(F.col("id").alias("draw"), unit.alias("u"))
    chosen = draws.join(F.broadcast(bounds), F.expr("u >= lo and u < hi")).select("draw", source)
    counted = items.groupBy(source).agg(F.count("*").alias("__size"))
    turns = numbered(chosen, F.expr(f"draw div {block}"), "draw", by=[source], name="__turn").join(F.broadcast(counted), source)
    turns = turns.select("draw", source, F.expr("__turn div __size").alias("pass"), F.expr("__turn % __size").alias("__place"))
    passes = turns.groupBy(source).agg(F.max("pass").alias("__last"))
    each = items.select(source, key).join(F.broadcast(passes), source).withColumn("pass", F.explode(F.expr("sequence(0L, __last)"))).drop("__last")
    each = each.withColumn("__hash", salted(salt, "pass", source, key))
    placed = numbered(each, F.substring("__hash", 1, 3), "__hash", key, by=[source, "pass"], name="__place")
    return turns.join(placed, [source, "pass", "__place"]).select("draw", source, "pass", key)


def slot_shuffled(df: DataFrame, file: str, key: str, slots: int, salt: str = "slot") -> DataFrame:
    """``turn`` and ``place``: files in seeded order, ``slots`` open at a time, the rows of one turn in seeded order."""
    files = df.select(file).distinct().withColumn("turn", F.expr(f"(row_number() over (order by sha2(concat_ws('|', '{salt}', cast(`{file}` as string)), 256), `{file}`) - 1) div {slots}"))
    rows = df.join(files, file).withColumn("__hash", salted(salt, "turn", key))
    return numbered(rows, F.substring("__hash", 1, 3), "__hash", key, by=["turn"], name="place").drop("__hash")


class ResumeMismatch(ValueError):
    """A run is continued under another configuration, or its last epoch isn't what its input gives."""


def bind(spark: SparkSession, folder: str, config: dict) -> str:
    """The hash of a run's configuration, stored in its folder at first; a run is only continued under the same."""
    digest = hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    path = f"{folder}/configuration"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        held = [r[0] for r in spark.read.text(path).limit(2).collect()]
        if held != [digest]:
            raise ResumeMismatch(f"{folder} belongs to another configuration")
    else:
        spark.createDataFrame([(digest,)], "value string").coalesce(1).write.text(path)
    return digest


def restarting(start: Callable, most: int = 5) -> int:
    """Runs the query that ``start`` begins; one that fails begins anew from its checkpoint, ``most`` times. The number of restarts."""
    for n in range(most + 1):
        try:
            start().awaitTermination()
            return n
        except StreamingQueryException:
            if n == most:
                raise
    raise AssertionError


def verify_epoch(rows: DataFrame, stored: DataFrame, epoch: int) -> None:
    """What an epoch of the sink holds must be what its input gives again."""
    try:
        gates.expect_empty(gates.same_rows(stored.where(F.col("epoch") == epoch).drop("epoch"), rows), f"epoch {epoch}")
    except gates.GateError as e:
        raise ResumeMismatch(str(e)) from e


def pooled(stream: DataFrame, worker: str, key: str, size: str, budget: float, pool_batches: int = 8, lo: float = 1.0, hi: float = 30.0, seed: int = 0) -> DataFrame:
    """(worker, pool, batch, pos, key) of each worker's stream.

    A pool is full once its items, those outside [lo, hi] left out, reach ``pool_batches`` times ``budget``; then it is cut by
    size into batches that pad to no more than ``budget`` and these are put in a seeded order. Items of a pool that isn't
    full wait in the state, which is thus bounded; rows come in order of their key within a micro-batch.
    """
    kinds = {c: stream.schema[c].dataType.simpleString() for c in (worker, key)}

    def cut(pool: int, items: list[tuple]) -> list[tuple]:
        items = sorted(items, key=lambda x: (x[1], x[0]))
        batches: list[list] = [[]]
        for item, s in items:
            if batches[-1] and (len(batches[-1]) + 1) * s > budget:
                batches.append([])
            batches[-1].append(item)
        order = np.random.default_rng([seed, 2, pool]).permutation(len(batches))
        return [(pool, b, p, item) for b, j in enumerate(order) for p, item in enumerate(batches[j])]

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pool, keys, sizes = state.get if state.exists else (0, [], [])
        held, out = list(zip(keys, sizes, strict=True)), []
        total = sum(sizes)
        for item, s in sorted(pd.concat(list(frames))[[key, size]].itertuples(index=False)):
            if not lo <= s <= hi:
                continue
            held.append((item, float(s)))
            total += s
            if total >= pool_batches * budget:
                out += cut(pool, held)
                pool, held, total = pool + 1, [], 0.0
        state.update((pool, [k for k, _ in held], [s for _, s in held]))
        yield pd.DataFrame([(group[0], *x) for x in out], columns=[worker, "pool", "batch", "pos", key])

    shape = f"`{worker}` {kinds[worker]}, pool long, batch long, pos long, `{key}` {kinds[key]}"
    return stream.groupBy(worker).applyInPandasWithState(step, shape, f"pool long, keys array<{kinds[key]}>, sizes array<double>", "append", GroupStateTimeout.NoTimeout)
