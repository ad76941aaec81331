"""All pairs of texts whose sets of shingles are alike: an exact similarity join, no pair left to chance."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequences import components, stored

#: Least Jaccard similarity, as a fraction of whole numbers.
ALIKE = (7, 10)
#: Shingles that this many prefixes of a batch's sets, or of all, hold come last in the order of shingles.
FREQUENT, MOST_FREQUENT = 100, 200_000
#: Classes that a task remembers, so as to tell of each once; told again, a class changes nothing.
SEEN = 100_000
#: Shingles of a range, about, and of sets that are held against each other in one task; pairs that are looked at together;
#: copies of a set that are paired in one go.
RANGE, GROUP, PAIRS, COPIES = 500_000, 2_000_000, 1_000_000, 1000
_ENTRY = np.dtype([("t", "<i8"), ("cls", "<i8"), ("n", "<i4"), ("at", "<i4")])


def prefix(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The shingles of a sorted set of which one is the first that it shares, in an order with the frequent ones last, with any set
    alike: it shares at least ``ALIKE`` of its own, so no more than the rest can come before."""
    often = np.isin(s, frequent, assume_unique=True) if len(frequent) else np.zeros(len(s), bool)
    return np.concatenate([s[~often], s[often]])[: len(s) + ALIKE[0] * len(s) // -ALIKE[1] + 1]


def _distinct(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    new = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))[: len(x)]
    return x[new], y[new]


def met(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x, y), x < y: classes that share a shingle of their prefixes and, by their sizes and its place in both, may be alike."""
    a, b = ALIKE
    e = e[np.lexsort((e["cls"], e["n"], e["t"]))]
    e = e[np.append(True, (e["t"][1:] != e["t"][:-1]) | (e["cls"][1:] != e["cls"][:-1]))[: len(e)]]
    by_size = (np.cumsum(np.append(False, e["t"][1:] != e["t"][:-1])[: len(e)]).astype(np.int64) << 32) + e["n"]
    larger = by_size - e["n"] + e["n"].astype(np.int64) * b // a  # the largest set that may be alike
    count = np.searchsorted(by_size, larger, side="right") - np.arange(len(e)) - 1
    upto, start, held = np.cumsum(count), 0, 0
    out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    while start < len(e):
        end = max(start + 1, int(np.searchsorted(upto, PAIRS + (upto[start - 1] if start else 0), side="right")))
        k = count[start:end]
        one = np.repeat(np.arange(start, end), k)
        two = one + 1 + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        x, y = e[one], e[two]
        most = np.minimum(x["n"] - x["at"], y["n"] - y["at"]).astype(np.int64)  # shared shingles, if this is the first
        on = (a + b) * most >= a * (x["n"].astype(np.int64) + y["n"])
        x, y = x["cls"][on], y["cls"][on]
        out.append(_distinct(np.minimum(x, y), np.maximum(x, y)))
        held += len(out[-1][0])
        if held > 4 * PAIRS:
            out = [_distinct(*(np.concatenate(c) for c in zip(*out, strict=True)))]
            held = 0
        start = end
    return _distinct(*(np.concatenate(c) for c in zip(*out, strict=True)))


def marks(s: np.ndarray) -> bytes:
    """A bit for each shingle, of four to eight times as many as there are shingles."""
    bits = np.zeros(max(64, 1 << int(4 * len(s) - 1).bit_length()), bool)
    bits[s & (len(bits) - 1)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def may_be_alike(n: int, a: bytes, m: int, b: bytes) -> bool:
    """Whether sets of n and m shingles may be alike, by their marks: a bit that only one has is a shingle that only it has."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    k = min(len(x), len(y))
    x, y = np.bitwise_or.reduce(x.reshape(-1, k)), np.bitwise_or.reduce(y.reshape(-1, k))
    most = min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))
    return sum(ALIKE) * most >= ALIKE[0] * (n + m)


def _overlaps(near: pa.Table, sets: pa.Table) -> pa.Table:
    """(x, y, n, union) of the pairs of a bucket: shared shingles and those of both."""
    if not near.num_rows:
        return pa.table({c: pa.array([], pa.int64()) for c in ("x", "y", "n", "union")})
    cls, s = sets["cls"].to_numpy(), sets["s"].combine_chunks()
    s = s.chunk(0) if isinstance(s, pa.ChunkedArray) else s
    values, offset = s.values.to_numpy(), s.offsets.to_numpy()
    order = np.argsort(cls, kind="stable")
    x, y = _distinct(near["x"].to_numpy(), near["y"].to_numpy())
    at = [order[np.searchsorted(cls[order], c)] for c in (x, y)]
    n, size, edge = np.zeros(len(x), np.int64), np.diff(offset).astype(np.int64), np.flatnonzero(np.append(True, x[1:] != x[:-1])).tolist()
    for i, j in zip(edge, [*edge[1:], len(x)], strict=True):
        one, k = values[offset[at[0][i]] : offset[at[0][i] + 1]], size[at[1][i:j]]
        two = values[np.repeat(offset[at[1][i:j]] - np.cumsum(k) + k, k) + np.arange(k.sum())]
        n[i:j] = np.add.reduceat(one[np.minimum(np.searchsorted(one, two), len(one) - 1)] == two, np.cumsum(k) - k, dtype=np.int64)
    return pa.table({"x": pa.array(x), "y": pa.array(y), "n": pa.array(n), "union": pa.array(size[at[0]] + size[at[1]] - n)})


def pairs(sets: DataFrame, key: str, shingles: str) -> DataFrame:
    """(a, b, similarity), a < b: every two rows of different keys whose shingles (an array of hashes, repeats allowed) are alike.

    Equal sets are one class. Of each class only a prefix of its shingles, about three tenths, is dealt by hash; classes that
    meet there and whose marks don't tell them apart, directly or through others, send their whole sets to one task, which holds those that met against each other; a
    group of more than ``GROUP`` shingles is cut into blocks, and pairs of blocks are sent. Rows with a null key or without shingles have no pair. k rows
    that are alike have k (k - 1) / 2 pairs, so time and rows grow with the square of such a group.
    """
    kind = sets.schema[key].dataType.simpleString()

    def name(batches):
        for batch in batches:
            rows = batch.column(1)
            s = [np.unique(rows[i].values.to_numpy()) for i in range(batch.num_rows)]
            cls = [int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True) for x in s]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cls, pa.int64()), pa.array([len(x) for x in s], pa.int32()), pa.array([marks(x) for x in s], pa.binary()), pa.array(s, pa.list_(pa.int64()))], names=["key", "cls", "n", "marks", "s"])

    def each(batches):
        """The classes of a batch with their sets, each once for a task."""
        seen: set[int] = set()
        for batch in batches:
            got = {c: i for i, c in enumerate(batch.column("cls").to_pylist()) if c not in seen}
            if len(seen) > SEEN:
                seen.clear()
            seen |= got.keys()
            if got:
                yield list(got), [batch.column("s")[i].values.to_numpy() for i in got.values()]

    def often(batches):
        for _, s in each(batches):
            t, c = np.unique(np.concatenate([prefix(x, x[:0]) for x in s]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(t[c >= 3]), pa.array(c[c >= 3].astype(np.int64))], names=["t", "c"])

    rows = sets.where(F.col(key).isNotNull() & (F.size(shingles) > 0)).select(F.col(key).alias("key"), F.col(shingles).alias("s"))
    told = stored(rows.mapInArrow(name, f"key {kind}, cls long, n int, marks binary, s array<bigint>"))
    total = told.agg(F.sum("n")).first()[0] or 0
    counts = told.select("cls", "s").mapInArrow(often, "t long, c long").groupBy("t").agg(F.sum("c").alias("c"))
    frequent = np.array([r["t"] for r in counts.where(F.col("c") >= max(FREQUENT, total // MOST_FREQUENT)).select("t").collect()], np.int64)
    last, ranges = sets.sparkSession.sparkContext.broadcast(frequent), total // RANGE + 1

    def deal(batches):
        for cls, s in each(batches):
            p = [prefix(x, last.value) for x in s]
            size = [len(x) for x in p]
            e = np.empty(sum(size), _ENTRY)
            e["t"], e["cls"], e["n"] = np.concatenate(p), np.repeat(cls, size), np.repeat([len(x) for x in s], size)
            e["at"] = np.concatenate([np.arange(k) for k in size])
            place = (e["t"] & (2**62 - 1)) // 2**20 % ranges
            order = np.argsort(place, kind="stable")
            e, place = e[order], place[order]
            edge = np.flatnonzero(np.diff(place, prepend=-1, append=-1)).tolist()
            data = [pa.compress(b"".join(np.ascontiguousarray(e[c][i:j]).tobytes() for c in _ENTRY.names), "zstd", asbytes=True) for i, j in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(place[edge[:-1]]), pa.array(np.diff(edge), pa.int64()), pa.array(data, pa.binary())], names=["b", "k", "data"])

    def meet(table: pa.Table) -> pa.Table:
        e, start = np.empty(pa.compute.sum(table["k"]).as_py(), _ENTRY), 0
        for data, k in zip(table["data"], table["k"].to_pylist(), strict=True):
            raw, at = pa.decompress(data.as_py(), k * _ENTRY.itemsize, "zstd", asbytes=True), 0
            for c in _ENTRY.names:
                size = k * _ENTRY[c].itemsize
                e[c][start : start + k] = np.frombuffer(raw[at : at + size], _ENTRY[c])
                at += size
            start += k
        x, y = met(e)
        return pa.table({"x": pa.array(x), "y": pa.array(y)})

    dealt = told.select("cls", "s").mapInArrow(deal, "b long, k long, data binary")
    near = dealt.groupBy("b").applyInArrow(meet, "x long, y long").distinct()
    first = told.groupBy("cls").agg(F.min(F.struct("key", "n", "marks")).alias("f")).select("cls", "f.key", "f.n", "f.marks")

    def apart(batches):
        for batch in batches:
            cols = (batch.column(c).to_pylist() for c in ("n", "marks", "m", "others"))
            yield batch.select(["x", "y"]).filter(pa.array([may_be_alike(*r) for r in zip(*cols, strict=True)], pa.bool_()))

    near = near.join(first.selectExpr("cls as x", "n", "marks"), "x").join(first.selectExpr("cls as y", "n as m", "marks as others"), "y")
    near, first = stored(near.mapInArrow(apart, "x long, y long")), first.drop("marks")
    groups = components(near, "x", "y").withColumnRenamed("node", "cls").join(first, "cls")
    sizes = groups.groupBy("label").agg(F.sum("n").alias("w")).withColumn("k", F.when(F.col("w") > GROUP, F.ceil(2 * F.col("w") / GROUP)).otherwise(1).cast("long"))
    groups = stored(groups.join(sizes, "label").withColumn("block", F.pmod(F.xxhash64("cls"), "k")).drop("w"))
    buckets = (groups.agg(F.sum(F.col("n") * F.col("k"))).first()[0] or 0) // GROUP + 1
    bucket = lambda p, q: F.pmod(F.xxhash64("label", F.least(p, q), F.greatest(p, q)), F.lit(buckets)).alias("b")
    asked = groups.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    asked = asked.select("cls", "key", bucket("block", "other")).distinct()
    whole = told.select("cls", "key", "s").join(asked, ["cls", "key"]).select("b", "cls", "s")
    sent = near.join(groups.selectExpr("cls as x", "label", "block as p"), "x").join(groups.selectExpr("cls as y", "block as q"), "y").select("x", "y", bucket("p", "q"))
    both = sent.groupBy("b").cogroup(whole.groupBy("b")).applyInArrow(_overlaps, "x long, y long, n long, union long")
    alike = stored(both.where(ALIKE[1] * F.col("n") >= ALIKE[0] * F.col("union")).select("x", "y", F.round(F.col("n") / F.col("union"), 9).alias("similarity")).distinct())
    members = told.select("key", "cls")
    of = lambda x, name: members.toDF(name, x)
    others = alike.join(of("x", "a"), "x").join(of("y", "b"), "y").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")
    # copies are paired in parts, each with all of its class
    copies = members.join(members.groupBy("cls").agg(F.count("*").alias("k")).where("k > 1"), "cls").withColumn("parts", F.floor(F.col("k") / COPIES) + 1)
    one = copies.select("cls", F.col("key").alias("a"), F.pmod(F.xxhash64("key"), "parts").alias("part"))
    two = copies.select("cls", F.col("key").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    same = one.join(two, ["cls", "part"]).where("a < b").select("a", "b", F.lit(1.0).alias("similarity"))
    return others.unionByName(same)
