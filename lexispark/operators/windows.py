"""Windows of long items whose lengths are drawn from another table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequences import numbered


def drawn_windows(items: DataFrame, key: str, size: str, lengths: DataFrame, length: str, block: Column, order: list[str], most: int = 4, least: int = 1, salt: str = "windows") -> DataFrame:
    """(key, i, start, length) of up to ``most`` windows of each item, one behind the other from its start.

    A window's length is that of a row of ``lengths`` drawn by hash, each as likely as the other, cut where the item ends; there
    is none where fewer than ``least`` of the item are left. Rows of ``lengths`` are numbered by counted blocks of their order
    (``block`` must follow ``order``) and joined by number, so neither table is sent whole. Null sizes give no window, null and
    non-positive lengths aren't drawn; keys are distinct.
    """
    usable = lengths.where(F.col(length) > 0)
    n = usable.count()
    if not n:
        return items.select(key, F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("length")).limit(0)
    placed = numbered(usable.select(*order, F.col(length).cast("long").alias("__length")), block, *order, by=[], name="__place").select("__place", "__length")
    each = items.where(F.col(size) >= least).select(key, F.col(size).cast("long").alias("__size"), F.explode(F.expr(f"sequence(0L, {most - 1}L)")).alias("i"))
    place = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(salt), F.col(key).cast("string"), F.col("i"))), 1, 7), 16, 10).cast("long") % n
    drawn = each.withColumn("__place", place).join(placed, "__place")
    by_item = drawn.groupBy(key, "__size").agg(F.array_sort(F.collect_list(F.struct("i", "__length"))).alias("__w"))  # ``most`` entries
    start = lambda i: F.aggregate(F.slice("__w", 1, i), F.lit(0).cast("long"), lambda a, x: a + x["__length"])
    laid = F.transform("__w", lambda x, i: F.struct(x["i"].alias("i"), start(i).alias("start"), x["__length"].alias("length")))
    out = by_item.select(key, "__size", F.explode(laid).alias("w")).where(F.col("__size") - F.col("w.start") >= least)
    return out.select(key, "w.i", "w.start", F.least(F.col("w.length"), F.col("__size") - F.col("w.start")).alias("length"))
