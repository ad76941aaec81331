"""Streams of occurrences: first seen, routes, committed epochs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def first_seen(stream: DataFrame, key: str) -> DataFrame:
    """The first occurrence of each key; its state survives restarts in the checkpoint."""
    return stream.dropDuplicates([key])


def routed(stream: DataFrame, include: DataFrame | None, exclude: DataFrame | None, key: str) -> DataFrame:
    """Rows whose key is on the include list, if there is one, and not on the exclude list: stream-static joins."""
    out = stream if include is None else stream.join(include.select(key).distinct(), key, "left_semi")
    return out if exclude is None else out.join(exclude.select(key).distinct(), key, "left_anti")


def windowed(stream: DataFrame, ts: str, late: str, every: str, *by: str) -> DataFrame:
    """Counts by tumbling window; rows later than the watermark are left out."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, every).alias("window"), *by).agg(F.count("*").alias("n"))


def run_once(stream: DataFrame, batch: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Everything that is there, epoch by epoch; an epoch that is run again replaces its own partition."""

    def write(df: DataFrame, epoch: int) -> None:
        batch(df).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class ExcessiveRejection(RuntimeError):
    """More rows of a stream are rejected than its limit allows."""


def counters(spark, path: str) -> DataFrame:
    """(reason, n) of everything that was consumed: each epoch's counts are a partition, written after its rows."""
    return spark.read.parquet(f"{path}/counters").groupBy("reason").agg(F.sum("n").alias("n"))


def guarded(stream: DataFrame, reason: str, path: str, checkpoint: str, most: float = 0.5, least: int = 1000):
    """Writes the rows without a ``reason`` to ``path``/rows and counts by reason to ``path``/counters, epoch by epoch.

    Stops with ExcessiveRejection once at least ``least`` rows were read and more than the share ``most`` of them were
    rejected. The totals are read from the counters, so that a restart goes on from the last epoch consumed; an epoch
    that is run again replaces its own partitions.
    """

    def put(df: DataFrame, epoch: int, name: str) -> None:
        out = df.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.partitionBy("epoch").parquet(f"{path}/{name}")

    def write(df: DataFrame, epoch: int) -> None:
        put(df.where(F.col(reason).isNull()).drop(reason), epoch, "rows")
        seen = Observation(f"epoch {epoch}")
        told = df.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))
        put(told.observe(seen, F.sum("n").alias("n")), epoch, "counters")
        if not seen.get["n"]:
            return
        total = counters(df.sparkSession, path).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("reason") != "kept", F.col("n")).otherwise(0)).alias("bad")).first()
        if total["n"] >= least and total["bad"] > most * total["n"]:
            raise ExcessiveRejection(f"{total['bad']} of {total['n']} rows rejected")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
