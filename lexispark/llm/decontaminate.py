"""Benchmark decontamination: word windows of test items looked up in every training text.

Words are runs of digits, letters and non-ASCII characters after folding A-Z. A window is ``width`` consecutive words of
an item; an item of fewer words, but not none, is one window. The distinct windows are a hash set of flat arrays, built once and
broadcast, when the benchmark has at most ``most_chars`` characters (some 6 bytes for each of them, and the vocabulary); a
larger one is gathered and sent in blocks of that size, one at a time, and the hits are merged by row. A hit in the hash set
is verified word by word. Texts are scanned in slices, so that a very long text bounds memory.

Null and empty texts have no words and no hits; an item without an id marks words but is not listed; repeated items
count once per id; an empty benchmark or table gives no hits. Rows repeat as they do in ``docs``, and columns with
clashing names don't matter because only key and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WIDTH = 13
#: Benchmark text that one broadcast may hold.
MOST_CHARS = 32_000_000
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[bytes]:
    return text.encode().translate(_KEEP).split()


class Windows:
    """The distinct windows of some items as arrays: by length, sorted hashes, where each window stands first in the items' words,
    and the numbers of the items that hold it. Built once, sent to the tasks as they are."""

    def __init__(self, items: list[tuple], width: int = WIDTH):
        self.width, self.vocab, self.ids = width, {}, sorted({str(i) for i, _ in items if i is not None})
        place = {x: n for n, x in enumerate(self.ids)}
        vocab = self.vocab
        flat = [np.fromiter((vocab.setdefault(x, len(vocab) + 1) for x in words(text or "")), np.uint32) for _, text in items]
        size = np.array([len(w) for w in flat], np.int64)
        first = np.concatenate([[0], np.cumsum(size)])
        self.flat = np.concatenate([*flat, np.zeros(0, np.uint32)])
        owner = np.array([-1 if i is None else place[str(i)] for i, _ in items], np.int64)
        self.by_length = []
        for n in np.unique(np.minimum(size[size > 0], width)).tolist():
            of = np.flatnonzero(np.minimum(size, width) == n)
            count = size[of] - n + 1
            start = np.repeat(first[:-1][of] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            self.by_length.append(self._grouped(n, start, np.repeat(owner[of], count)))

    def _grouped(self, n: int, start: np.ndarray, owner: np.ndarray) -> tuple:
        """(n, hashes, starts, edges, owners, alike): an entry for each distinct window, up to ``alike`` of them with one hash."""
        h = self._hash([self.flat[start + j] for j in range(n)])
        order = np.lexsort((owner, h))
        h, start, owner = h[order], start[order], owner[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        other = np.zeros(len(h), bool)
        for j in range(n):
            other[1:] |= ~new[1:] & (self.flat[start[1:] + j] != self.flat[start[:-1] + j])
        if other.any():  # different windows of one hash: put equal ones together
            order = np.lexsort((owner, *(self.flat[start + j] for j in range(n)), h))
            h, start, owner = h[order], start[order], owner[order]
            for j in range(n):
                new[1:] |= self.flat[start[1:] + j] != self.flat[start[:-1] + j]
            new[1:] |= h[1:] != h[:-1]
        again = ~new & (owner == np.concatenate([[-2], owner[:-1]]))
        keep = ~again & (owner >= 0)
        edges = np.concatenate([[0], np.cumsum(keep)])[np.append(np.flatnonzero(new), len(h))]
        alike = int(np.unique(h[new], return_counts=True)[1].max())
        return n, h[new], start[new].astype(np.int64), edges, owner[keep].astype(np.int32), alike

    @staticmethod
    def _hash(columns: list[np.ndarray]) -> np.ndarray:
        h = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            h = h * _BASE + c.astype(np.uint64)
        return common.mix(h)

    def scan(self, texts: list[str]):
        """For each text: its words, which of them are hit, and the places in ``ids`` of the items found."""
        split = [words(t) for t in texts]
        size = np.array([len(w) for w in split], np.int64)
        first = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
        ids = np.zeros(int(size.sum()) + len(size), np.uint64)  # a zero after each text keeps windows apart
        get = self.vocab.get
        for at, w in zip(first, split, strict=True):
            ids[at : at + len(w)] = np.fromiter(map(get, w, repeat(0)), np.uint64, len(w))
        delta = np.zeros(len(ids) + 1, np.int64)
        items: dict[int, set] = {}
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        for n, hashes, starts, edges, owners, alike in self.by_length:
            if len(ids) < n:
                continue
            at = np.flatnonzero(unknown[n:] == unknown[:-n])
            if not len(at):
                continue
            h = self._hash([ids[at + j] for j in range(n)])
            lo = np.searchsorted(hashes, h)
            for step in range(alike):  # equal hashes, if ever, follow one another
                k = np.minimum(lo + step, len(hashes) - 1)
                hit = (hashes[k] == h) & (lo + step < len(hashes))
                hit[hit] = (self.flat[starts[k[hit]][:, None] + np.arange(n)] == ids[at[hit][:, None] + np.arange(n)]).all(axis=1)
                np.add.at(delta, at[hit], 1)
                np.add.at(delta, at[hit] + n, -1)
                for doc, w in set(zip((np.searchsorted(first, at[hit], "right") - 1).tolist(), k[hit].tolist(), strict=True)):
                    items.setdefault(doc, set()).update(owners[edges[w] : edges[w + 1]].tolist())
        marked = np.cumsum(delta)[:-1] > 0
        for d, (at, n) in enumerate(zip(first, size, strict=True)):
            yield split[d], marked[at : at + n], sorted(items.get(d, ()))


def _blocks(benchmark: DataFrame, key: str, text: str, most: int) -> Iterator[list[tuple]]:
    """Items in blocks of at most ``most`` characters each (or of one item), one block at a time."""
    block, size = [], 0
    for item, body in benchmark.select(key, text).toLocalIterator():
        if size and size + len(body or "") > most:
            yield block
            block, size = [], 0
        block.append((item, body))
        size += len(body or "")
    if block:
        yield block


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WIDTH, most_chars: int = MOST_CHARS) -> DataFrame:
    """(key, n_words, hits, items) for each row: hits are the runs of hit words as (first, end), items the ids found."""
    kind = docs.schema[key].dataType.simpleString()
    arrow = common.arrow_type(docs, key)
    size = benchmark.agg(F.sum(F.length(item_text))).first()[0] or 0
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def scan(block: list[tuple]) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(Windows(block, width))

        def run(batches):
            windows = shared.value
            for keys, texts in common.rows(batches):
                n, hits, items = [], [], []
                for w, marked, found in windows.scan(texts):
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(np.int8), [0]])))
                    n.append(len(w))
                    hits.append(edge.tolist())
                    items.append([windows.ids[i] for i in found])
                yield pa.RecordBatch.from_arrays([pa.array(keys, arrow), pa.array(n, pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names=["key", "n_words", "hits", "items"])

        return source.mapInArrow(run, f"key {kind}, n_words long, hits array<bigint>, items array<string>")

    if size <= most_chars:
        return scan([tuple(r) for r in benchmark.select(item, item_text).collect()]).withColumnRenamed("key", key)
    # Beyond the bound: each block marks the words in turn; a row's number is its place in the materialised input.
    source = common.materialize(source.withColumn("row", F.monotonically_increasing_id()))
    texts = source.select("row", "key", "text")
    source = texts.select(F.col("row").alias("key"), "text")
    kind, arrow = "bigint", pa.int64()
    found = None
    for block in _blocks(benchmark, item, item_text, most_chars):
        one = common.materialize(scan(block))
        found = one if found is None else found.unionByName(one)
    flat = F.array_sort(F.flatten(F.collect_list(F.expr("transform(sequence(0, size(hits) div 2 - 1, 1), i -> struct(hits[2 * i] as a, hits[2 * i + 1] as b))"))))
    found = found.withColumn("hits", F.when(F.size("hits") > 0, F.col("hits")).otherwise(F.array(F.lit(0).cast("long"), F.lit(0).cast("long"))))
    merged = found.groupBy("key").agg(F.max("n_words").alias("n_words"), flat.alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = "aggregate(filter(runs, r -> r.b > r.a), cast(array() as array<bigint>), (acc, r) -> if(size(acc) > 0 and acc[size(acc) - 1] >= r.a, concat(slice(acc, 1, size(acc) - 1), array(greatest(acc[size(acc) - 1], r.b))), concat(acc, array(r.a, r.b))))"
    merged = merged.select(F.col("key").alias("row"), "n_words", F.expr(joined).alias("hits"), "items")
    return texts.select("row", "key").join(merged, "row").drop("row").withColumnRenamed("key", key)


def remove(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", one_in: int = 20, text: str = "text", width: int = WIDTH, most_chars: int = MOST_CHARS) -> DataFrame:
    """``docs`` without contamination, other columns unchanged.

    ``documents`` drops a row of whose words at least one in ``one_in`` is hit; ``spans`` keeps every row and cuts the
    hit words out of its text. A benchmark beyond ``most_chars`` is scanned in blocks, as by ``find``, with the same rows.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(mode)
    if (benchmark.agg(F.sum(F.length("text"))).first()[0] or 0) > most_chars:
        return _remove_in_blocks(docs, benchmark, mode, one_in, text, width, most_chars)
    items = [tuple(r) for r in benchmark.select("item_id", "text").collect()]
    shared = docs.sparkSession.sparkContext.broadcast(Windows(items, width))
    at = docs.columns.index(text)

    def run(batches):
        windows = shared.value
        for batch in batches:
            texts = [x.as_py() for x in batch.column(at)]
            keep, new = [], []
            for k in range(0, len(texts), 1024):
                for t, (w, marked, _) in zip(texts[k : k + 1024], windows.scan([x or "" for x in texts[k : k + 1024]]), strict=True):
                    n = int(marked.sum())
                    if mode == "documents":
                        keep.append(not (n and one_in * n >= len(w)))
                    else:
                        new.append(cut(t, marked) if n else t)
            if mode == "documents":
                yield batch.filter(pa.array(keep, pa.bool_()))
            else:
                yield batch.set_column(at, text, pa.array(new, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def _remove_in_blocks(docs: DataFrame, benchmark: DataFrame, mode: str, one_in: int, text: str, width: int, most_chars: int) -> DataFrame:
    """``remove`` by ``find``'s hits, joined back on a row number that is stored with the rows."""
    numbered = common.materialize(docs.select(F.monotonically_increasing_id().alias("__row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc")))
    texts = numbered.select("__row", F.col(f"__doc.`{text}`").alias("text"))
    found = find(texts, benchmark, key="__row", width=width, most_chars=most_chars)
    n_hit = F.expr("aggregate(hits, 0L, (acc, x) -> x - acc)")  # runs in order: the alternating sum is their length
    if mode == "documents":
        bad = found.select("__row", "n_words", n_hit.alias("n")).where((F.col("n") > 0) & (one_in * F.col("n") >= F.col("n_words")))
        return numbered.join(bad.select("__row"), "__row", "left_anti").select("__doc.*")

    def run(batches):
        for batch in batches:
            new = []
            for t, hits, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                marked = np.zeros(n, bool)
                for a, b in zip(hits[::2], hits[1::2], strict=True):
                    marked[a:b] = True
                new.append(cut(t, marked) if hits else t)
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()), batch.column(3)], names=["__text", "__doc"])

    joined = numbered.join(found, "__row").select(F.col(f"__doc.`{text}`").alias("__text"), "hits", "n_words", "__doc")
    return joined.mapInArrow(run, f"__text string, __doc {docs.schema.simpleString()}").select(*(F.col("__text").alias(c) if c == text else F.col(f"__doc.`{c}`").alias(c) for c in docs.columns))


def cut(text: str, marked: np.ndarray) -> str:
    """The text without its marked words (what stands between two of them goes as well)."""
    data = text.encode()
    inside = np.frombuffer(data.translate(_KEEP), np.uint8) != 32
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    ends = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])) + 1
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(np.int8), [0]])))
    out, last = [], 0
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        out.append(data[last : starts[a]])
        last = ends[b - 1]
    return b"".join([*out, data[last:]]).decode()


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document."""
    found = find(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    hit = F.expr("aggregate(sequence(0, size(hits) div 2), 0L, (acc, i) -> acc + if(2 * i < size(hits), hits[2 * i + 1] - hits[2 * i], 0L))")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256")).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    )
