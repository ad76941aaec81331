"""Queries that run a stream over files made from a table, in the order of its events, and return what the stream wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.sequences import _shared_folder
from ..streaming import collapse as C
from ..streaming import ledger as L
from .core import query, table


def _folder(df) -> str:
    _shared_folder(df)
    return f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


def _runs(df, by: str, n: int, folder: str, start) -> None:
    """The rows by ranges of ``by``: each range is written and a run that goes on from the last one reads it whole."""
    cuts = df.approxQuantile(by, [i / n for i in range(1, n)], 0.01)
    part = sum((F.when(F.col(by) > c, 1).otherwise(0) for c in cuts), F.lit(0))
    for i in range(n):
        df.where(part == i).write.mode("append").parquet(f"{folder}/in")
        start(df.sparkSession.readStream.schema(df.schema).parquet(f"{folder}/in")).awaitTermination()


@query("""with f as (select event_id, user_id, event_type, first_value(event_type) over o as kept, row_number() over o = 1 as first from events window o as (partition by user_id order by event_id))
select event_id, user_id, first, kept <> event_type as conflict from f""")
def st5_replayed(spark, d):
    """Users as ids, event types as contents: occurrences in the order of their numbers, three runs that go on from one another."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    folder = _folder(e)

    def start(stream):
        told = L.replayed(stream, "user_id", "event_type", "event_id")
        return told.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()

    _runs(e, "event_id", 3, folder, start)
    return spark.read.parquet(f"{folder}/out").select("event_id", "user_id", "first", "conflict")


@query("""with f as (select user_id, min(event_id) as first_step from events group by 1), m as (select quantile_disc(event_id, 0.5) as step from events)
select user_id, first_step, e.value as size, first_step <= step as kept from f join events e using (user_id), m where e.event_id = first_step""")
def st7_ledger_replayed(spark, d):
    """First sightings of users by a stream, taken back to the median step and replayed: the same ledger as one straight run."""
    e = table(spark, d, "events").select("event_id", "user_id", "value")
    step = e.agg(F.expr("percentile_disc(0.5) within group (order by event_id)")).first()[0]
    folder = _folder(e)
    _runs(e, "event_id", 3, folder, lambda s: L.keep_ledger(L.sightings(s, "user_id", "value", "event_id"), f"{folder}/out", f"{folder}/check"))
    L.rolled_back(spark, f"{folder}/check", step).write.parquet(f"{folder}/base")
    base = spark.read.parquet(f"{folder}/base")
    again = spark.readStream.schema(e.schema).parquet(f"{folder}/in")
    L.keep_ledger(L.resumed(again, base, "user_id", "value", "event_id", step), f"{folder}/out2", f"{folder}/check2").awaitTermination()
    both = base.withColumn("kept", F.lit(True)).union(L.ledger_at(spark, f"{folder}/check2").withColumn("kept", F.lit(False)))
    return both.select(F.col("key").alias("user_id"), "first_step", "size", "kept")


@query("""with m as (select distinct doc_id // 10 as shard from documents where doc_id // 10 <> 37), p as (select min(shard + 1) as prefix from (select -1 as shard union all select shard from m) where shard + 1 not in (select shard from m)),
r as (select shard // 8 as g, shard from m, p where shard < prefix - prefix % 8) select r.g as "group", count(distinct shard) as shards, count(*) as docs, cast(sum(n_chars) as bigint) as chars from r join documents on doc_id // 10 = shard group by 1""")
def st12_shard_groups(spark, d):
    """Documents in shards of ten, groups of eight committed shards; shard 37 is missing, so later groups wait."""
    docs = table(spark, d, "documents").withColumn("shard", F.expr("doc_id div 10"))
    marks = docs.select("shard").distinct().where("shard <> 37")
    marks = marks.withColumn("order", F.expr("pmod(hash(shard), 100)"))
    folder = _folder(marks)

    def work(ready):
        both = ready.join(docs, "shard")
        return both.groupBy("group").agg(F.count_distinct("shard").alias("shards"), F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))

    _runs(marks, "order", 2, folder, lambda s: L.by_groups(s, work, folder, f"{folder}/check"))
    return spark.read.schema("shards long, docs long, chars long, group long").parquet(f"{folder}/results").select("group", "shards", "docs", "chars")


@query()
def st11_collapses(spark, d):
    """Where each user's events, taken as a training's log with purchases as its validations, raise an alarm of collapse."""
    kind = F.when(F.col("event_type") == "purchase", C.VALID).otherwise(C.TRAIN)
    log = table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), kind.alias("kind"), F.col("value").alias("loss"), F.col("value").alias("gradient"), (F.col("value") / 100).alias("errors"))
    return C.alarms(log, "run", C.Limits(window=5, ready=0, factor=2.0))
