"""Best-fit packing of token sequences: best-two-fit on the histogram of lengths, then a rank within each length.

Bins hold ``size`` tokens. A document's ids are its byte-level BPE ids and one 0; only a document longer than a bin is
cut, its first piece taking what is left over so that the others are full. There are at most ``size`` different lengths,
so the packing is decided on their counts, whose size doesn't depend on the corpus: a bin opens with the longest piece
left, takes the longest that fits until none does, and then its smallest document is replaced by the two unpacked
documents that fit the widened gap most tightly, if they fill it better. Each pattern repeats as often as the counts
allow. Pieces find their place by rank within their length; ranks come from counts by (length, hash bucket), so no
window holds a whole length.

Null and empty texts are the single id 0. Equal rows and null keys are packed like any others, an empty table gives an
empty result, and columns other than key and text are left out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SIZE = 2048
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
_SPECIAL = "<|endoftext|>"
_loaded: dict = {}


def encoder(vocabulary: str, ranks: str, pattern: str):
    """A function from texts to ids, kept for the life of a worker.

    The ids are those of ``tokenizers`` with the vocabulary file. The same merges run four times as fast by rank file, so
    those are used for texts without a special token's name; the vocabulary file is only loaded for the others. A test
    holds one against the other.
    """
    if (vocabulary, ranks) not in _loaded:
        import base64

        import tiktoken

        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines)}
        fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        slow = []

        def encode(text: str) -> list[int]:
            if _SPECIAL not in text:
                return fast.encode_ordinary(text)
            if not slow:
                from tokenizers import Tokenizer

                slow.append(Tokenizer.from_file(vocabulary))
            return slow[0].encode(text, add_special_tokens=False).ids

        _loaded[vocabulary, ranks] = encode
    return _loaded[vocabulary, ranks]


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, vocabulary: str | None = None, ranks: str | None = None, pattern: str | None = None, keep_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32) and, if asked for, the ids: one row for each piece of a document."""
    import public_tokenizers

    vocabulary, ranks, pattern = vocabulary or public_tokenizers.path(VOCABULARY), ranks or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    kind = docs.schema[key].dataType.simpleString()
    arrow = common.arrow_type(docs, key)

    def run(batches):
        encode = encoder(str(vocabulary), str(ranks), pattern)
        for keys, texts in common.rows(batches, 256, 1_000_000):
            out = []
            for k, t in zip(keys, texts, strict=True):
                ids = np.array([*encode(t), 0], "<u4")
                a, b, n = 0, len(ids) % size or min(size, len(ids)), 0
                while a < len(ids):
                    part = ids[a:b]
                    out.append((k, n, a, b - a, zlib.crc32(part.tobytes()), *([part.tolist()] if keep_ids else [])))
                    a, b, n = b, b + size, n + 1
            types = [arrow, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=False)], names=["key", "piece", "start", "length", "ids_crc32", "ids"][: len(cols)])

    schema = f"key {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<bigint>" * keep_ids
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, list[int]]]:
    """(times, lengths in a bin) patterns that use up ``counts`` exactly."""
    left = np.zeros(size + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    out = []
    while left.any():
        bin_, gap, free = [], size, left.copy()
        while (fit := np.flatnonzero(free[: gap + 1])).size:
            n = int(fit[-1])
            bin_.append(n)
            free[n] -= 1
            gap -= n
        if gap and len(bin_) > 1:
            small = bin_[-1]
            wide, best = gap + small, (small, None)
            have = np.flatnonzero(free[: wide + 1])
            for a in have[::-1]:
                a = int(a)
                rest = have[have <= min(a, wide - a)]
                rest = rest[:-1] if rest.size and rest[-1] == a and free[a] < 2 else rest
                if rest.size and a + int(rest[-1]) > best[0]:
                    best = (a + int(rest[-1]), (a, int(rest[-1])))
                    if best[0] == wide:
                        break
            if best[1]:
                bin_ = [*bin_[:-1], *best[1]]
        used = np.bincount(bin_, minlength=size + 1)
        times = int((left[used > 0] // used[used > 0]).min())
        left -= used * times
        out.append((times, bin_))
    return out


def _runs(patterns: list[tuple[int, list[int]]]) -> dict[int, tuple]:
    """For each length: where runs of ranks begin, the first sequence of each, its step and the offset in the bin."""
    taken: dict[int, int] = {}
    runs: dict[int, list] = {}
    first = 0
    for times, bin_ in patterns:
        offset = 0
        for n in bin_:
            at = taken.get(n, 0)
            runs.setdefault(n, []).append((at, first, offset))
            taken[n] = at + times
            offset += n
        first += times
    return {n: tuple(np.array(c, np.int64) for c in zip(*x, strict=True)) for n, x in runs.items()}


def pack(cut: DataFrame, size: int = SIZE, per_bucket: int = 20_000) -> DataFrame:
    """``cut`` (pieces with a length) with sequence_id and offset. ``cut`` is read three times: pass it materialised."""
    spark = cut.sparkSession
    total = cut.count()
    buckets = max(1, -(-total // per_bucket))
    others = [c for c in cut.columns if c != "length"]
    placed = cut.withColumn("__bucket", F.pmod(F.hash(*others[:4]), F.lit(buckets)))
    sizes = placed.groupBy("length", "__bucket").agg(F.count("*").alias("__n"))
    sizes = common.materialize(sizes)
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("__n").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(_runs(plan(counts, size)))
    span = "partition by length order by __bucket rows between unbounded preceding and 1 preceding"
    before = sizes.select("length", "__bucket", F.expr(f"coalesce(sum(__n) over ({span}), 0L)").alias("__before"))
    inner = "partition by length, __bucket order by " + ", ".join(f"`{c}`" for c in others if c != "ids")
    ranked = placed.withColumn("__rank", F.expr(f"cast(row_number() over ({inner}) - 1 as long)"))
    ranked = ranked.join(before, ["length", "__bucket"]).withColumn("__rank", F.col("__rank") + F.col("__before")).select(*cut.columns, "__rank")
    names, n = cut.columns, len(cut.columns)
    at = cut.columns.index("length")

    def run(batches):
        runs = shared.value
        for batch in batches:
            length, rank = batch.column(at).to_numpy(), batch.column(n).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for v in np.unique(length):
                mine = np.flatnonzero(length == v)
                start, first, place = runs[int(v)]
                k = np.searchsorted(start, rank[mine], "right") - 1
                sequence[mine] = first[k] + rank[mine] - start[k]
                offset[mine] = place[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies."""
    return pack(common.stored(pieces(common.table(spark, sf_dir, "documents"))))
