"""Sinks: checked manifests, write-once tables, copies with some columns made anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators import gates


def manifest(df: DataFrame, path: str, key: str) -> None:
    """JSON lines sorted by a key that no two rows share; the committer renames files when the job is whole."""
    gates.expect_empty(gates.duplicates(df, key), "keys that occur twice")
    df.orderBy(key).write.json(path)


def shards(df: DataFrame, path: str, by: str) -> None:
    """Partitioned Parquet; only the partitions written are replaced, so a repeated epoch changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(by).parquet(path)


def freeze(df: DataFrame, path: str) -> None:
    """Writes once; a table that is there must hold the same rows."""
    try:
        df.write.mode("errorifexists").parquet(path)
    except AnalysisException:
        gates.expect_empty(gates.same_rows(df.sparkSession.read.parquet(path), df), "rows that the frozen table doesn't share")


def refilter(df: DataFrame, path: str, **columns: Column) -> None:
    """A copy with some columns made anew, others unchanged."""
    df.withColumns(columns).write.parquet(path)


def content_hash(df: DataFrame, *columns: str) -> DataFrame:
    """(n, content): the same for the same rows in any order."""
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0)).alias("content"))


def report(df: DataFrame, path: str, title: str, most: int = 10_000) -> str:
    """A Markdown table of an aggregate's rows, written as one text file; a table of more than ``most`` rows is refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |", *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]
    df.sparkSession.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)
    return "\n".join(lines)


def sized(df: DataFrame, path: str, plain: list[str], group_bytes: int = 16 << 20) -> None:
    """Parquet with row groups of about ``group_bytes`` and no dictionary for the columns that hardly repeat."""
    out = df.write.option("compression", "zstd").option("parquet.block.size", group_bytes)
    for c in plain:
        out = out.option(f"parquet.enable.dictionary#{c}", "false")
    out.parquet(path)


def cache(df: DataFrame, path: str, by: str, **derived: Column) -> list:
    """Builds a text cache by shards and returns those written now: rows with ``derived`` columns go to ``path``/shards, a
    partition for each value of ``by``, and, once those are whole, a marker (number of rows, sum of their hashes) to
    ``path``/done.

    A shard with a marker is left alone; one whose marker's content is no longer what its source gives is refused, and one
    without is written anew. Null values of ``by`` are a shard of their own.
    """
    spark = df.sparkSession
    rows = df.withColumns(derived)
    content = rows.groupBy(by).agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)")).cast("string").alias("content"))
    try:
        done = spark.read.parquet(f"{path}/done").select(F.col(by).alias("__by"), F.col("rows").alias("__rows"), F.col("content").alias("__content"))
        have = content.join(done, F.col(by).eqNullSafe(F.col("__by")), "left")
    except AnalysisException:
        have = content.withColumns({"__by": F.lit(None), "__rows": F.lit(None), "__content": F.lit(None)})
    have = have.checkpoint() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else have
    gates.expect_empty(have.where((F.col("__rows") != F.col("rows")) | (F.col("__content") != F.col("content"))).select(by), "shards whose source has changed")
    fresh = have.where(F.col("__rows").isNull()).select(by, "rows", "content")
    todo = [r[0] for r in fresh.select(by).collect()]  # a value for each shard
    if todo:
        wanted = fresh.select(F.col(by).alias("__by"))
        shards(rows.join(wanted, F.col(by).eqNullSafe(F.col("__by")), "left_semi").withColumn("shard", F.col(by)), f"{path}/shards", "shard")
        fresh.write.mode("append").parquet(f"{path}/done")
    return todo
