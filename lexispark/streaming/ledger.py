"""Streams that remember: first contents of ids, a ledger that can be taken back to a step, groups of committed shards."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _FirstContent(StatefulProcessor):
    """The content of an id's first occurrence as its state; rows are told apart by it."""

    def __init__(self, order: list[str]):
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("first", T.StructType([T.StructField("content", T.StringType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known, content = self.state.exists(), None
        if known:
            content = self.state.get()[0]
        else:  # an id that is new: its earliest row of this micro-batch is the first
            rows = iter([pd.concat(list(rows)).sort_values(self.order, ignore_index=True)])
        for frame in rows:
            frame = frame.reset_index(drop=True)
            fresh = not known and len(frame) > 0
            if fresh:
                content, known = frame["content"].iloc[0], True
                self.state.update((content,))
            same = frame["content"].isna() if content is None else frame["content"] == content
            frame["first"] = [fresh and i == 0 for i in range(len(frame))]
            yield frame.assign(conflict=~same)

    def close(self) -> None:
        pass


def replayed(stream: DataFrame, key: str, content: str, *order: str) -> DataFrame:
    """(key, *order, content, first, conflict) of each occurrence of a stream whose micro-batches follow ``order``.

    ``first`` marks an id's first occurrence, ``conflict`` later ones of another content (null is a content of its own). State
    is the first content of each id, held by Spark and restored from the checkpoint. A task reads the rows of a known id as a
    stream; those of an id that is new are held together once, so a micro-batch bounds what is held.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kinds = {f.name: f.dataType for f in stream.schema}
    out = T.StructType([T.StructField(c, kinds[c]) for c in (key, *order)] + [T.StructField("content", T.StringType()), T.StructField("first", T.BooleanType()), T.StructField("conflict", T.BooleanType())])
    rows = stream.select(key, *order, F.col(content).cast("string").alias("content"))
    return rows.groupBy(key).transformWithStateInPandas(_FirstContent(list(order)), outputStructType=out, outputMode="Append", timeMode="None")


def sightings(stream: DataFrame, key: str, size: str, step: str) -> DataFrame:
    """The ledger as a streaming aggregate: each key with the step and size of its first sighting, the least size of a step."""
    return stream.groupBy(F.col(key).alias("key")).agg(F.min(F.struct(F.col(step).alias("first_step"), F.col(size).alias("size"))).alias("seen"))


def keep_ledger(ledger: DataFrame, path: str, checkpoint: str):
    """Writes the entries that each micro-batch adds or changes to ``path``; an epoch that is run again replaces its own part."""

    def write(df: DataFrame, epoch: int) -> None:
        df.select("key", "seen.*").withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(path)

    return ledger.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ledger_at(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """(key, first_step, size): the ledger's state as it was after a micro-batch (the last one by default), read from its versions."""
    read = spark.read.format("statestore")
    state = (read if batch is None else read.option("batchId", batch)).load(checkpoint)
    name, value = (state.schema[c].dataType.fieldNames()[0] for c in ("key", "value"))
    return state.select(F.col("key")[name].alias("key"), F.col("value")[value]["first_step"].alias("first_step"), F.col("value")[value]["size"].alias("size"))


def rolled_back(spark: SparkSession, checkpoint: str, step: int, batch: int | None = None) -> DataFrame:
    """The ledger without what was first seen after ``step``."""
    return ledger_at(spark, checkpoint, batch).where(F.col("first_step") <= step)


def resumed(stream: DataFrame, base: DataFrame, key: str, size: str, step: str, after: int) -> DataFrame:
    """Sightings after a step of keys that the ledger taken back, ``base``, doesn't hold."""
    return sightings(stream.where(F.col(step) > after).join(base.select(F.col("key").alias(key)), key, "left_anti"), key, size, step)


def ready_groups(markers: DataFrame, shard: str, group: int, complete: bool) -> DataFrame:
    """(group, shard) of the groups of ``group`` shards that may be worked on: shards 0, 1, ... without a gap; a shorter last group
    only if the pool is ``complete``, which has no gap then."""
    ks = markers.select(F.col(shard).cast("long").alias("shard")).distinct()
    gap = ks.select((F.col("shard") + 1).alias("shard")).union(markers.sparkSession.range(1).select(F.col("id").alias("shard"))).join(ks, "shard", "left_anti").agg(F.min("shard").alias("prefix"))
    last = F.when(F.lit(complete), F.col("prefix")).otherwise(F.expr(f"prefix - prefix % {group}"))
    return ks.crossJoin(F.broadcast(gap)).where(F.col("shard") < last).select(F.expr(f"shard div {group}").alias("group"), "shard")  # gap is one row


class IncompletePool(RuntimeError):
    """A pool that is said to be complete lacks a shard before its last."""


def by_groups(markers: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, shard: str = "shard", group: int = 8, complete: Callable[[], bool] = lambda: False):
    """Works on groups of committed shards as they become ready, each exactly once over any number of runs.

    ``markers`` is a stream with a row for each committed shard, in any order; ``work`` turns (group, shard) rows of new groups
    into results with a column ``group``. Results of a group are a partition of ``path``/results and its mark one of
    ``path``/done, written last: a group whose mark is missing is worked on again and its partition replaced. Groups that
    became ready while no marker came are taken up by the next call with one, or by ``catch_up``.
    """

    def write(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        df.select(F.col(shard).cast("long").alias("shard")).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(f"{path}/markers")
        catch_up(spark, work, path, group, complete())

    return markers.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def catch_up(spark: SparkSession, work: Callable[[DataFrame], DataFrame], path: str, group: int = 8, complete: bool = False) -> None:
    """Works on the ready groups that have no mark."""
    markers = spark.read.schema("shard long, epoch long").parquet(f"{path}/markers")
    if complete:
        n = markers.agg(F.count_distinct("shard").alias("n"), F.max("shard").alias("last")).first()
        if n["n"] and n["n"] != n["last"] + 1:
            raise IncompletePool(f"{n['n']} shards up to {n['last']}")
    ready = ready_groups(markers, "shard", group, complete)
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/done")
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        ready = ready.join(spark.read.schema("n long, group long").parquet(f"{path}/done"), "group", "left_anti")
    fresh = ready.groupBy("group").agg(F.count("*").alias("n")).cache()
    try:
        if fresh.isEmpty():
            return
        put = lambda df, name: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("group").parquet(f"{path}/{name}")
        put(work(ready), "results")
        put(fresh, "done")
    finally:
        fresh.unpersist()
