"""Readers of the file forms that corpora come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def manifest(spark: SparkSession, path: str, schema: str, key: str = "id") -> DataFrame:
    """JSON lines with exactly these fields, in order of the key; a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path).orderBy(key)


def tolerant_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records, lines that aren't whole records): torn, blank and NUL lines don't stop a log from being read."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.withColumn("r", F.from_json("value", f"{schema}, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}))
    bad = F.col("r").isNull() | F.col("r.__bad").isNotNull()
    return parsed.where(~bad).select("r.*").drop("__bad"), parsed.where(bad).select("value")


def tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Tab-separated text without quoting; the named columns must be there."""
    df = spark.read.option("sep", "\t").option("quote", "").option("header", True).csv(path)
    if absent := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{path} has no column {', '.join(absent)}")
    return df.select(*columns)


def rules(spark: SparkSession, path: str, least: int) -> DataFrame:
    """Rule tables: lines of at least so many non-empty fields, with # comments."""
    fields = F.split("value", "\t")
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    ok = (F.size(fields) >= least) & ~F.exists(fields, lambda f: F.trim(f) == "")
    whole = F.when(ok, fields).otherwise(F.raise_error(F.concat(F.lit("malformed rule: "), "value")))
    return lines.select(*(whole[i].alias(f"f{i}") for i in range(least)))


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of ``records`` in JSON files of one object each."""
    df = spark.read.schema(f"records array<struct<{', '.join(x.strip().replace(' ', ': ', 1) for x in schema.split(','))}>>").option("multiLine", True).json(path)
    return df.select(F.explode("records").alias("r")).select("r.*")


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of subtitle files: cue numbers, times and tags are left out."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", "\r?\n").alias("l"))
    spoken = F.filter("l", lambda x: ~x.rlike(r"^\s*\d*\s*$") & ~x.contains("-->"))
    return lines.select("file", F.trim(F.regexp_replace(F.array_join(spoken, " "), "<[^>]*>", "")).alias("text"))


def nested(spark: SparkSession, path: str, *fields: str) -> DataFrame:
    """Only these nested fields of a Parquet table (``a.b`` as ``a_b``): the scan reads no other leaf."""
    return spark.read.parquet(path).select(*(F.col(f).alias(f.replace(".", "_")) for f in fields))


def utterance_lists(spark: SparkSession, root: str) -> DataFrame:
    """(id, text, file) of all ``*.trans.txt`` below a folder: lines of an id, a space and a text; a line without text is an error."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.trans.txt").text(root)
    parts = F.split(F.trim("value"), " ", 2)
    text = F.when(F.size(parts) == 2, parts[1]).otherwise(F.raise_error(F.concat(F.lit("no text: "), "value")))
    return lines.where(F.trim("value") != "").select(parts[0].alias("id"), text.alias("text"), F.col("_metadata.file_path").alias("file"))


def interval_tiers(spark: SparkSession, path: str) -> DataFrame:
    """(file, tier, start, end, text) of the intervals of long-form TextGrid files; doubled quotes stand for one."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", r"item \[\d+\]:").alias("tiers"))
    tiers = whole.select("file", F.explode(F.expr("slice(tiers, 2, size(tiers))")).alias("t")).select("file", F.regexp_extract("t", r'name = "([^"]*)"', 1).alias("tier"), "t")
    found = tiers.select("file", "tier", F.explode(F.expr(r"""regexp_extract_all(t, 'intervals \\[\\d+\\]:\\s+xmin = [0-9.]+\\s+xmax = [0-9.]+\\s+text = "(?:[^"]|"")*"', 0)""")).alias("x"))
    number = lambda name: F.regexp_extract("x", rf"{name} = ([0-9.]+)", 1).cast("double")
    return found.select("file", "tier", number("xmin").alias("start"), number("xmax").alias("end"), F.replace(F.regexp_extract("x", '(?s)text = "(.*)"', 1), F.lit('""'), F.lit('"')).alias("text"))


def markup(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of files with markup: tags become spaces, white space is single."""
    whole = spark.read.text(path, wholetext=True)
    text = F.trim(F.regexp_replace(F.regexp_replace("value", "<[^>]*>", " "), r"(?U)\s+", " "))
    return whole.select(F.col("_metadata.file_path").alias("file"), text.alias("text"))
