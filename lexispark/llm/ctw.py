"""Language-model scores by context-tree weighting over binary-decomposed bytes.

A text is its tokens: its words after folding A-Z, as UTF-8 bytes with a space between them, and an end byte (255, which
UTF-8 never has), so score and base are probabilities of the same sequence of tokens. A byte is eight binary decisions, and each
decision at each point of the byte has a context tree over the preceding ``DEPTH`` bytes (255 before the text). Each node
has a Krichevsky-Trofimov estimate from the zeros and ones that followed its context in training; a node's weighted
probability is half that estimate's and half the product of its children's, so all depths are mixed by how well they
coded the training data. The model's probability of a byte in its context follows from these weights alone, so it is
computed once for each distinct context and byte; with the end byte, a text of n bytes has n + 1 of them, over which
``bits_per_byte`` is its mean code length.

Everything about the corpus goes through Spark: texts are dealt into blocks of bounded size; each block sends its
distinct (context, byte) and words with their training counts, these are summed over blocks, the trees are built in
groups that share the last two bytes, and each block gets back just the values that its texts need. Only the two top
levels of the trees (at most 256 x 255 nodes) pass through the driver.

Null and empty texts are the end alone. Rows with a null key belong to training. Rows repeat as in the input, and each
counts in training. Without training texts every decision has probability 1/2 and the base is -log10(1) for each token.
An empty table gives an empty result; only key and text are read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DEPTH = 5
#: Bytes of text in a block, about, and of a chunk within it.
BLOCK, CHUNK = 32_000_000, 1_000_000
END = b"\xff"
_HALF = np.log(0.5)
LOG10_2 = np.log10(2.0)


def tokens(text: str) -> list[bytes]:
    return text.encode().lower().split()


def grams(data: bytes, depth: int = DEPTH) -> np.ndarray:
    """Each byte with its context, as (c_depth .. c_1, byte) in an integer."""
    b = np.frombuffer(END * depth + data + END, np.uint8).astype(np.int64)
    g = b[: len(b) - depth].copy()
    for j in range(1, depth + 1):
        g <<= 8
        g |= b[j : len(b) - depth + j]
    return g


def lgamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by 7; x > 0."""
    shift = np.prod([x + i for i in range(7)], axis=0)
    y = x + 7
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability."""
    return lgamma(zeros + 0.5) + lgamma(ones + 0.5) - lgamma(zeros + ones + 1.0) - np.log(np.pi)


class Level:
    """The nodes of one depth: context and place within the byte, counts, weighted probability, weight of stopping."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
        self.keys, self.zeros, self.ones = keys, zeros, ones
        own = kt(zeros, ones)
        self.log = own if below is None else np.logaddexp(_HALF + own, _HALF + below)
        self.stop = np.ones(len(keys)) if below is None else np.exp(_HALF + own - self.log)

    def predict(self, at: np.ndarray, bit: np.ndarray, deeper: np.ndarray | float) -> np.ndarray:
        p = (np.where(bit, self.ones[at], self.zeros[at]) + 0.5) / (self.zeros[at] + self.ones[at] + 1.0)
        return self.stop[at] * p + (1 - self.stop[at]) * deeper


def decisions(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(8, n): place within the byte before each decision, and the decision."""
    x = g & 255
    k = np.arange(8)[:, None]
    return (1 << k) | (x >> (8 - k)), (x >> (7 - k)) & 1


def build(g: np.ndarray, counts: np.ndarray, top: int, depth: int = DEPTH) -> tuple[list[Level], np.ndarray]:
    """Each decision's level ``top`` and, for each of the sorted ``g``, its mixed probability from that depth down.

    The eight decisions have trees of their own, so they are built one after the other.
    """
    n, made, q = counts.astype(float), [], np.empty((8, len(g)))
    for k in range(8):
        level, q[k] = _build(g, n, k, top, depth)
        made.append(level)
    return made, q


def _build(g: np.ndarray, n: np.ndarray, k: int, top: int, depth: int) -> tuple[Level, np.ndarray]:
    """The deepest nodes of a decision lie in the order of ``g``; each level above comes from the nodes below it."""
    bit = (g >> (7 - k) & 1).astype(bool)
    node = (g >> 8 << 8) | (1 << k) | ((g & 255) >> (8 - k))
    new = np.concatenate([node[:1] >= 0, node[1:] != node[:-1]])
    at = (np.cumsum(new) - 1).astype(np.int32)
    keys = node[new]
    del node, new
    levels, parents = [Level(keys, np.bincount(at, n * ~bit, len(keys)), np.bincount(at, n * bit, len(keys)), None)], []
    for d in range(depth - 1, top - 1, -1):
        last = levels[-1]
        keys, parent = np.unique(((last.keys >> 8 & ((1 << 8 * d) - 1)) << 8) | (last.keys & 255), return_inverse=True)
        levels.append(Level(keys, *(np.bincount(parent, v, len(keys)) for v in (last.zeros, last.ones, last.log))))
        parents.append(parent.astype(np.int32))
    q: np.ndarray | float = 0.0
    for level, parent in zip(levels, [*parents, None], strict=True):
        q = level.predict(at, bit, q)
        at = at if parent is None else parent[at]
    return levels[-1], q


def _tree(table: pa.Table) -> pa.Table:
    """Depths 2 and more of the trees whose contexts end with the same two bytes."""
    g, c = table["g"].to_numpy(), table["c"].to_numpy()
    order = np.argsort(g)
    g, c = g[order], c[order]
    pa.default_memory_pool().release_unused()
    levels, q = build(g, c, 2)
    keys, zeros, ones, log = (np.concatenate([getattr(x, v) for x in levels]) for v in ("keys", "zeros", "ones", "log"))
    none = lambda n, kind: pa.nulls(n, kind)
    n, m = len(g), len(keys)
    packed = pa.FixedSizeListArray.from_arrays(pa.array(q.T.ravel()), 8).cast(pa.list_(pa.float64()))
    one = lambda a, b: pa.chunked_array([a, b])
    return pa.table({
        "g": one(pa.array(g), none(m, pa.int64())), "q": one(packed, none(m, pa.list_(pa.float64()))),
        "node": one(none(n, pa.int64()), pa.array(keys & 0xFFFF)),
        **{k: one(none(n, pa.float64()), pa.array(v)) for k, v in (("zeros", zeros), ("ones", ones), ("log", log))},
    })


class Top:
    """Depths 0 and 1, from the sums of depth 2 over the second byte back."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, logs: np.ndarray):
        order = np.argsort(keys)
        self.one = Level(keys[order], zeros[order], ones[order], logs[order])
        place, at = np.unique(self.one.keys & 255, return_inverse=True)
        add = lambda v: np.bincount(at, v, len(place))
        self.zero = Level(place, add(self.one.zeros), add(self.one.ones), add(self.one.log))

    def log10(self, g: np.ndarray, q: np.ndarray) -> np.ndarray:
        """log10 of the probability of each byte, given the mixture ``q`` (8, n) from depth 2 down."""
        place, bit = decisions(g)
        q = self.one.predict(np.searchsorted(self.one.keys, (g & 0xFF00) | place), bit, q)
        return np.log10(self.zero.predict(np.searchsorted(self.zero.keys, place), bit, q)).sum(axis=0)


def _count(table: pa.Table) -> pa.Table:
    """Distinct (context, byte) and words of a block, with training counts."""
    block = table["block"][0].as_py()
    merged, words, unseen = [], Counter(), set()
    size = {True: 0, False: 0}
    pending: dict[bool, list] = {True: [], False: []}

    def merge() -> None:
        g, c = (np.concatenate(x) for x in zip(*merged, strict=True))
        merged.clear()
        order = np.argsort(g)
        g, c = g[order], c[order]
        first = np.flatnonzero(np.concatenate([g[:1] >= 0, g[1:] != g[:-1]]))
        merged.append((g[first], np.add.reduceat(c, first)))

    def flush(train: bool) -> None:
        if pending[train]:
            u, c = np.unique(np.concatenate(pending[train]), return_counts=True)
            merged.append((u, (c * train).astype(np.int64)))
            pending[train], size[train] = [], 0
            if sum(len(u) for u, _ in merged[1:]) > 2 * CHUNK:
                merge()

    for text, train in zip(table["text"], table["train"].to_pylist(), strict=True):
        w = tokens(text.as_py())
        data = b" ".join(w)
        pending[train].append(grams(data))
        size[train] += len(data)
        (words if train else unseen).update(w)
        if size[train] > CHUNK:
            flush(train)
    flush(True)
    flush(False)
    merge()
    u, c = merged[0]
    unseen -= words.keys()
    w = [*words, *unseen]
    wc = np.fromiter((*words.values(), *(0 for _ in unseen)), np.int64, len(w))
    return pa.table({
        "block": pa.array(np.full(len(u) + len(w), block)), "g": pa.chunked_array([pa.array(u), pa.nulls(len(w), pa.int64())]),
        "w": pa.chunked_array([pa.nulls(len(u), pa.binary()), pa.array(w, pa.binary())]), "c": pa.chunked_array([pa.array(c), pa.array(wc)]),
    })


def score(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for each row; ``train`` says which are learned from."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    arrow = common.arrow_type(docs, key)
    source = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(train, F.lit(True)).alias("train"))
    told = source.agg(F.sum(F.octet_length("text")), F.sum(F.col("train").cast("long"))).first()
    n_blocks, n_train = max(1, -(-(told[0] or 0) // block_bytes)), told[1] or 0
    source = source.withColumn("block", F.pmod(F.xxhash64("key", F.octet_length("text")), F.lit(n_blocks)))
    counted = common.stored(source.groupBy("block").applyInArrow(_count, "block long, g long, w binary, c long"))
    every = counted.where("g is not null").groupBy("g").agg(F.sum("c").alias("c"))
    trees = common.stored(every.groupBy((F.shiftright("g", 8).bitwiseAND(0xFFFF)).alias("two")).applyInArrow(_tree, "g long, q array<double>, node long, zeros double, ones double, log double"))
    # at most 256 * 255 rows: the byte before and the place within the byte
    rows = trees.where("node is not null").groupBy("node").agg(F.sum("zeros"), F.sum("ones"), F.sum("log")).collect()
    if not rows:
        return source.select(F.col("key").alias(key), *(F.lit(0).cast(t).alias(c) for c, t in (("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double"), ("bits_per_byte", "double"))))
    top = spark.sparkContext.broadcast(Top(*(np.array(c, t) for c, t in zip(zip(*rows, strict=True), (np.int64, float, float, float), strict=True))))

    def finish(batches):
        for b in batches:
            g = b.column(0).to_numpy()
            q = b.column(1).values.to_numpy().reshape(-1, 8).T if len(g) else np.zeros((8, 0))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(top.value.log10(g, q))], names=["g", "value"])

    bytes_ = trees.where("g is not null").select("g", "q").mapInArrow(finish, "g long, value double")
    words = counted.where("w is not null").groupBy("w").agg(F.sum("c").alias("c"))
    total = words.agg(F.sum("c"), F.sum((F.col("c") > 0).cast("long"))).first()
    n = (total[0] or 0) + n_train
    norm, end = float(np.log10(n + (total[1] or 0) + (n_train > 0) + 1)), float(np.log10(n_train + 1))
    need = counted.where("g is not null").select("block", "g").join(bytes_, "g").select("block", "g", F.lit(None).cast("binary").alias("w"), "value")
    need = need.unionByName(counted.where("w is not null").select("block", "w").join(words, "w").select("block", F.lit(None).cast("long").alias("g"), "w", F.log10(F.col("c") + 1).alias("value")))

    def measure(texts: pa.Table, values: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()
        g = values["g"].combine_chunks()
        mine = g.is_valid().to_numpy(zero_copy_only=False)
        v = values["value"].to_numpy()
        keys, logs = g.drop_null().to_numpy(), v[mine]
        order = np.argsort(keys)
        keys, logs = keys[order], logs[order]
        base = dict(zip(values["w"].filter(pa.array(~mine)).to_pylist(), v[~mine].tolist(), strict=True))
        out, scores, parts, sizes, size = [], [], [], [], 0

        def flush() -> None:
            # contexts and bytes in order, each with the number of its text in the low 16 bits: equal ones lie together
            x = np.sort(np.concatenate(parts))
            own = (x >> np.uint64(16)).astype(np.int64)
            new = np.concatenate([[True], own[1:] != own[:-1]])
            values = logs[np.searchsorted(keys, own[new])][np.cumsum(new) - 1]
            scores.extend(np.bincount((x & np.uint64(0xFFFF)).astype(np.int64), values, len(parts)).tolist())
            parts.clear()

        for k, text in zip(texts["key"].to_pylist(), texts["text"], strict=True):
            w = tokens(text.as_py())
            parts.append((grams(b" ".join(w)).astype(np.uint64) << np.uint64(16)) | np.uint64(len(parts)))
            sizes.append(len(parts[-1]))
            size += sizes[-1]
            if size > CHUNK or len(parts) == 1 << 16:
                flush()
                size = 0
            c = np.fromiter(map(base.__getitem__, w), float, len(w))
            out.append((k, len(w) + 1, int((c > 0).sum()) + (n_train > 0), n, float(c.sum() + end - norm * (len(w) + 1))))
        if parts:
            flush()
        out = [(*o, x, -x / (n * LOG10_2)) for o, x, n in zip(out, scores, sizes, strict=True)]
        types = (arrow, pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
        cols = zip(*out, strict=True) if out else [[]] * 7
        return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["key", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])

    scored = source.select("block", "key", "text").groupBy("block").cogroup(need.groupBy("block")).applyInArrow(measure, f"key {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
    return scored.withColumnRenamed("key", key)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by the model of those whose crc32 of the key leaves another rest than 2 by 7."""
    docs, held_out = common.table(spark, sf_dir, "documents"), common.crc_mod(F.col("doc_id"), 7, 2)
    scored = score(docs, ~held_out)
    return scored.select("doc_id", common.crc_mod(F.col("doc_id"), 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


