"""Validation gates: each check is a DataFrame of violations, and a build goes on only if it is empty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class GateError(ValueError):
    """A check found violations; the message shows some."""


def expect_empty(violations: DataFrame, name: str, show: int = 20) -> None:
    found = violations.limit(show).collect()
    if found:
        raise GateError(f"{name}: " + "; ".join(str(r.asDict()) for r in found))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row has."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing(listing: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """What is listed and not done."""
    return listing.select(*keys).distinct().join(done.select(*keys).distinct(), list(keys), "left_anti")


def dependent(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one value: violations of the functional dependency key -> value."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("n_values")).where("n_values > 1")


def positions(df: DataFrame, batch: str, pos: str) -> DataFrame:
    """Rows whose position isn't 0, 1, ... within their batch."""
    w = W.partitionBy(batch).orderBy(pos)
    return df.withColumn("expected", (F.row_number().over(w) - 1).cast("long")).where(F.col("expected") != F.col(pos))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows, with their multiplicity, that only one side has."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def completeness(occurrences: DataFrame, records: DataFrame, key: str, source: str | None = None) -> DataFrame:
    """One row: keys without a record, records without an occurrence, and records of another source."""
    occ = occurrences.groupBy(key).agg(F.min(source or F.lit("")).alias("os"), F.count("*").alias("n"))
    rec = records.groupBy(key).agg(F.min(source or F.lit("")).alias("rs"), F.count("*").alias("m"))
    both = occ.join(rec, key, "full_outer")
    return both.agg(
        F.count_if(F.col("m").isNull()).alias("without_record"), F.count_if(F.col("n").isNull()).alias("without_occurrence"),
        F.count_if(F.col("os") != F.col("rs")).alias("wrong_source"), F.count_if(F.col("m") > 1).alias("duplicate_records"),
    )


def leakage(train: DataFrame, reserved: DataFrame, unit: str = "unit") -> DataFrame:
    """Training units that are a reserved unit or lie below one (``a/b`` below ``a``): an equi-join on every prefix."""
    parts = F.split(unit, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    hit = train.withColumn("__prefix", F.explode(prefixes)).join(reserved.select(F.col(unit).alias("__prefix")).distinct(), "__prefix", "left_semi")
    return hit.drop("__prefix").distinct()


def gaps(shards: DataFrame, first: str, last: str, *by: str) -> DataFrame:
    """Shards (last excluded) that don't begin where the one before them in their group ends, with that place as ``expected``.

    A listing of shards has one row for each, so its order is a window; empty shards and overlaps are told as well.
    """
    w = W.partitionBy(*by).orderBy(first, last)
    told = shards.select(*by, first, last, F.lag(last).over(w).alias("expected"))
    return told.where((F.col("expected") != F.col(first)) | (F.col(last) <= F.col(first)))


def reach(shards: DataFrame, first: str, last: str, through: int, *by: str) -> DataFrame:
    """Groups whose shards, contiguous from 0, end before ``through``: (by, covered)."""
    w = W.partitionBy(*by).orderBy(first, last)
    ends = shards.select(*by, first, last, F.coalesce(F.lag(last).over(w), F.lit(0)).alias("expected"))
    broken = F.max((F.col("expected") != F.col(first)).cast("int")).over(w)
    covered = ends.withColumn("__broken", broken).groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("__broken") == 0, F.col(last))), F.lit(0)).cast("long").alias("covered"))
    return covered.where(F.col("covered") < through)


def shared(tables: DataFrame, table: str, form: str) -> DataFrame:
    """Forms, in any case, that more than one table lists: (form, tables)."""
    told = tables.select(F.lower(form).alias("form"), F.col(table).alias("__table")).where("form is not null")
    return told.groupBy("form").agg(F.array_sort(F.collect_set("__table")).alias("tables")).where("size(tables) > 1")


def unsettled(forms: DataFrame, written: str, output: str) -> DataFrame:
    """(written, output, form): replacements in whose output a listed form stands, so that a second pass would change it.

    Every run of whole words of an output is looked up by value; a form that is replaced by itself is settled.
    """
    said = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    told = forms.select(written, output, F.split(said(output), " ").alias("__w")).distinct()
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("__w")), lambda i: F.transform(F.sequence(i, F.size("__w")), lambda j: F.array_join(F.slice("__w", i, j - i + 1), " "))))
    listed = forms.where(said(written) != said(output)).select(said(written).alias("form")).distinct()
    return told.select(written, output, F.explode(F.array_distinct(runs)).alias("form")).where(F.col("form") != "").join(listed, "form").select(written, output, "form")


def expect_final(parts: list[str], sets: DataFrame, part: str, final: bool = True) -> list[str]:
    """The required parts that no set has; a final build refuses to go on without them."""
    have = {r[0] for r in sets.where(F.col(part).isin(parts)).select(part).distinct().collect()} if parts else set()
    absent = [p for p in parts if p not in have]
    if final and absent:
        raise GateError(f"a final build without {absent}")
    return absent
