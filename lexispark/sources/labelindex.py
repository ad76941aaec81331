"""A persisted label index: a bucketed, sorted table under the hash of everything its labels depend on."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gates

FORMAT = 1


class IndexMismatch(RuntimeError):
    """An index of another identity, format or content."""


def identity_of(parts: dict) -> tuple[dict, str]:
    """(identity, its hash): the parts and the format as canonical JSON."""
    text = json.dumps({"format": FORMAT, **parts}, sort_keys=True, separators=(",", ":"), default=str)
    return json.loads(text), hashlib.sha256(text.encode()).hexdigest()


def _path(spark: SparkSession, text: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(text)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _content(df: DataFrame) -> dict:
    """Number of rows and a sum of their hashes, the same in any order."""
    r = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum")).first()
    return {"records": r["n"], "content": r["sum"]}


def write(labels: DataFrame, root: str, parts: dict, key: str, buckets: int = 64) -> str:
    """Writes ``labels`` once for an identity: bucketed and sorted by ``key``, the identity's record last. An index that is
    there is kept. Keys that occur twice or are null are refused. The index's folder."""
    spark = labels.sparkSession
    identity, digest = identity_of(parts)
    folder = f"{root}/{digest[:24]}"
    record, fs = _path(spark, f"{folder}.json")
    if fs.exists(record):
        return folder
    gates.expect_empty(gates.duplicates(labels, key), "keys that occur twice")
    gates.expect_empty(labels.where(F.col(key).isNull()), "null keys")
    name = f"label_index_{digest[:24]}"
    spark.sql(f"drop table if exists {name}")
    labels.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", folder).option("compression", "zstd").saveAsTable(name)
    body = {"identity": identity, "digest": digest, "key": key, "buckets": buckets, "schema": labels.schema.jsonValue(), **_content(spark.table(name))}
    spark.createDataFrame([(json.dumps(body, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}.json")
    return folder


def load(spark: SparkSession, folder: str, parts: dict, verify: bool = False) -> DataFrame:
    """The index at ``folder``, which must have been written under exactly these parts; with ``verify`` its rows are compared
    with the record as well. The table's buckets are known to the planner, so that joins by its key don't deal it anew."""
    identity, digest = identity_of(parts)
    record, fs = _path(spark, f"{folder}.json")
    if not fs.exists(record):
        raise IndexMismatch(f"{folder} has no record")
    body = json.loads(spark.read.text(f"{folder}.json").first()[0])
    if body["digest"] != digest or body["identity"] != identity:
        other = sorted(k for k in {*identity, *body["identity"]} if identity.get(k) != body["identity"].get(k))
        raise IndexMismatch(f"{folder} is of another identity (differs in {other})")
    name = f"label_index_{digest[:24]}"
    if not spark.catalog.tableExists(name):
        from pyspark.sql import types as T

        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in T.StructType.fromJson(body["schema"]))
        spark.sql(f"create table {name} ({columns}) using parquet clustered by (`{body['key']}`) sorted by (`{body['key']}`) into {body['buckets']} buckets location '{folder}'")
    table = spark.table(name)
    if verify and _content(table) != {k: body[k] for k in ("records", "content")}:
        raise IndexMismatch(f"{folder}: its rows differ from its record")
    return table


def looked_up(occurrences: DataFrame, index: DataFrame, key: str, refuse: bool = True) -> DataFrame:
    """``occurrences`` with the index's columns and ``state``: ``kept``, ``rejected`` (a record whose label is null) or ``missing``.

    A missing record stops the job if ``refuse``. Only the occurrences are shuffled, by a merge join on the index's buckets.
    """
    label = next(c for c in index.columns if c != key)
    marked = index.withColumn("__found", F.lit(True)).hint("merge")
    state = F.when(F.col("__found").isNull(), F.raise_error(F.concat(F.lit("no record of "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("string") if refuse else F.lit("missing"))
    state = state.when(F.col(label).isNull(), "rejected").otherwise("kept")
    return occurrences.join(marked, key, "left").withColumn("state", state).drop("__found")
