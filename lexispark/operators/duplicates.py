"""Removal of exact and near duplicates among short texts: the first stays, texts kept before come first of all."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .sequences import stored

PRIME = 2147483647
ROWS, BANDS = 3, 10
#: 64-bit words of marks; texts of a bucket that are compared with all its others in the first round; buckets from which size
#: on are compared in so many parts.
MARKS, HEADS, SPLIT, PARTS = 4, 8, 4096, 32


def _bigrams(norm):
    """Hashes of a text's word bigrams, or of its one word."""
    pairs = T.grams(T.words(norm), 2)
    return F.array_distinct(F.transform(F.when(F.size(pairs) > 0, pairs).otherwise(F.array(norm)), lambda g: F.xxhash64(g)))


def _banded(sets: DataFrame) -> DataFrame:
    """(place, size, marks, bucket): a text's ten buckets, each the hash of three minima of linear hashes of its bigrams.

    ``marks`` are bits of the bigrams: a bit that one text has and another lacks is a bigram that the other lacks.
    """
    k = np.arange(ROWS * BANDS, dtype=np.int64)
    a, b = (1 + 2 * ((k * 7919 + 104729) % 1000003))[:, None], ((k * 15485863 + 32452843) % 1000003)[:, None]

    def marks(x: np.ndarray) -> np.ndarray:
        bits = np.zeros(64 * MARKS, bool)
        bits[x % (64 * MARKS)] = True
        return np.packbits(bits).view(np.int64)

    def least(batches):
        for batch in batches:
            rows = [batch.column(1)[i].values.to_numpy() for i in range(batch.num_rows)]
            minima = pa.array([((a * (x % PRIME) + b) % PRIME).min(axis=1) for x in rows], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), minima, pa.array([marks(x) for x in rows], pa.list_(pa.int64())), pa.array([len(x) for x in rows], pa.int32())], names=["place", "minima", "marks", "size"])

    signed = sets.select("place", "shingles").mapInArrow(least, "place long, minima array<bigint>, marks array<bigint>, size int")
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.slice("minima", i * ROWS + 1, ROWS)))
    return signed.select("place", "size", "marks", F.explode(band).alias("bucket"))


def _may_be_alike(similar: float):
    """Whether texts a and b, by their sizes and marks, may be near duplicates; true of all that are."""
    least = F.lit(similar / (1 + similar)) * (F.col("a.size") + F.col("b.size")) - 1e-6
    lacks = lambda x, y: sum(F.bit_count(F.get(f"{x}.marks", F.lit(i)).bitwiseAND(F.bitwise_not(F.get(f"{y}.marks", F.lit(i))))) for i in range(MARKS))
    return (F.col("a.size") - lacks("a", "b") >= least) & (F.col("b.size") - lacks("b", "a") >= least)


def keep_first(df: DataFrame, key: str, norm: str, prior: DataFrame | None = None, similar: float = 0.7) -> DataFrame:
    """(key, reason): ``duplicate`` of a kept text, ``near_duplicate`` of one, or null; in order of a whole-number key.

    A text is a near duplicate if its word bigrams have a Jaccard similarity of ``similar`` with those of an earlier text
    that is kept and shares a bucket. ``prior`` (a column named ``norm``) holds texts kept before: they precede all rows and
    aren't returned. Texts are decided in rounds: the first ``heads`` undecided texts of each bucket are compared with all
    later ones of it, which decides every text that is a head wherever it stands, but for those near an undecided one. So
    many copies go in the first rounds, with ``heads`` comparisons each, and as ``heads`` grows eightfold from round to
    round, a bucket of many unlike texts takes few rounds. A null text is empty; empty texts are copies of each other; rows
    of one key share its decision.
    """
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(norm), F.lit("")).alias("norm"))
    firsts = rows.groupBy("norm").agg(F.min("key").alias("place"))
    if prior is not None:
        old = prior.select("norm").distinct().select("norm", (-1 - F.abs(F.xxhash64("norm") % (1 << 60))).alias("place"))
        firsts = firsts.join(old, "norm", "left_anti").select("norm", "place").unionByName(old)
    texts = stored(firsts.select("place", "norm", _bigrams(F.col("norm")).alias("shingles")))
    sets = texts.select("place", "shingles")
    entries = stored(_banded(texts))
    may = _may_be_alike(similar)

    def alike(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that are near duplicates."""
        pairs = pairs.select(F.col("a.place").alias("a"), F.col("b.place").alias("b")).distinct()
        both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").withColumn("n", F.size(F.array_intersect("x", "y")))
        return both.where(F.col("n") >= similar * (F.size("x") + F.size("y") - F.col("n"))).select("a", "b")

    left, gone, heads = entries.where("place >= 0"), [], HEADS
    if prior is not None:
        met = entries.where("place < 0").alias("a").join(left.alias("b"), F.col("a.bucket") == F.col("b.bucket")).where(may)
        gone.append(stored(alike(met).select(F.col("b").alias("place")).distinct()))
        left = left.join(gone[-1], "place", "left_anti")
    while True:
        ranked = stored(left.withColumn("rank", F.row_number().over(W.partitionBy("bucket").orderBy("place"))).withColumn("part", F.pmod(F.xxhash64("place"), F.lit(PARTS))))
        if ranked.isEmpty():
            break
        # a bucket of many texts is compared in parts, each with all of its heads
        head = ranked.join(ranked.where(F.col("rank") > SPLIT).select("bucket").distinct().withColumn("large", F.lit(True)), "bucket", "left").where(F.col("rank") <= heads)
        head = head.withColumn("part", F.explode(F.when(F.col("large"), F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).otherwise(F.array(F.lit(-1).cast("long")))))
        rest = ranked.join(head.where("part >= 0").select("bucket", F.lit(True).alias("large")).distinct(), "bucket", "left").withColumn("part", F.when(F.col("large"), F.col("part")).otherwise(-1))
        met = head.alias("a").join(rest.alias("b"), (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.rank") < F.col("b.rank"))).where(may)
        near = stored(alike(met))
        later = ranked.where(F.col("rank") > heads).select(F.col("place").alias("a")).distinct()
        while not near.isEmpty():
            free = stored(near.select("a").distinct().join(near.select(F.col("b").alias("a")), "a", "left_anti").join(later, "a", "left_anti"))
            if free.isEmpty():
                break
            gone.append(stored(near.join(free, "a", "left_semi").select(F.col("b").alias("place")).distinct()))
            out = gone[-1].select(F.col("place").alias("a"))
            near = stored(near.join(free, "a", "left_anti").join(out, "a", "left_anti").join(out.toDF("b"), "b", "left_anti").select("a", "b"))
        open_ = later.unionByName(near.select(F.col("b").alias("a"))).distinct().withColumnRenamed("a", "place")
        dropped = reduce(DataFrame.unionByName, gone) if gone else None
        left = entries.join(open_, "place", "left_semi")
        left = left if dropped is None else left.join(dropped, "place", "left_anti")
        heads *= 8
    stays = texts if not gone else texts.join(reduce(DataFrame.unionByName, gone), "place", "left_anti")
    stays = stays.select("norm", F.col("place").alias("first"))
    reason = F.when(F.col("first").isNull(), "near_duplicate").when(F.col("first") != F.col("key"), "duplicate")
    return rows.distinct().join(stays, "norm", "left").select(F.col("key").alias(key), reason.alias("reason"))
