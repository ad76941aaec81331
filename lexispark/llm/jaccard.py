"""N-gram Jaccard join: documents whose sets of word shingles overlap enough, as connected components.

A document's set is its distinct 5-word shingles (all its words as one, if fewer); documents with equal sets are one
class. Two classes link when 100 * |intersection| >= 80 * |union|, which asks for an overlap of T = 4 (n + m) / 9.

1. Classes and frequent shingles: one scan gives each document's class (a 128-bit digest of its set) and, from groups of
   documents, counts of the shingles that repeat within a group. Shingles that these show in a large part of all sets
   are few by arithmetic (their counts sum to no more than all shingles), so they are broadcast.
2. Prefixes: shingles are ordered by hash, frequent ones last. Linked classes share at least T' = ceil(0.8 n) shingles,
   so they share l of their first n - T' + l; l is a tenth of n. Only these prefixes are dealt by hash and counted.
   Those that another class has as well come back; a class with too few of them to share l has no partner.
3. Index: among shared shingles of a prefix, in the order of frequency, linked classes meet in one of all but the last
   l - 1. Inverted lists of these hold candidates. Whole sets are read again for the classes in them alone.
4. Candidate groups: classes that share a list are joined, list by list, to groups (nothing is verified yet, and no pairs
   are made). Groups are small, as a class is in a list only if enough of its prefix is shared. Each group's whole sets
   go to one task, many groups to a bucket. A group of more than ``GROUP`` shingles is cut into bands of size (linked
   sizes differ by a factor of 1.25 at most) and each band into blocks by hash; pairs of blocks are searched instead, so
   memory stays bounded and nothing is lost, at a cost that grows with the square of the blocks.
5. T-occurrence search: from a class on, each class that is reached asks an inverted index of those not reached yet. Its
   short lists are merged and counted, the longest (DivideSkip) are probed by binary search for those that can still
   reach T. The links found span the components of all links.

Shingles are 64-bit hashes: two different shingles of one pair of documents meet with a chance below 1e-12. The search
names a class by 64 bits of its digest; two given classes share them with a chance of 2**-64.

Null, empty and blank texts have no shingles and are linked with nothing; a null key is linked but never names a
component, whose id is null if it has no other key. Rows repeat as in ``docs``; equal rows are one class. An empty table
gives an empty result; only key and text are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components, roots

WORDS = 5
#: Frequent shingles: in at least FREQUENT sets, and so many that there are fewer than MOST_FREQUENT of them.
FREQUENT, MOST_FREQUENT = 1000, 200_000
#: Shingles of a group of candidates that are searched together, and about those of a bucket of groups.
GROUP = 2_000_000
#: Classes that a task remembers, so as to tell of each once; told again, a class changes nothing.
SEEN = 500_000


def sets_of(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    return [np.unique(h) for h in common.shingle_hashes(texts, WORDS)]


def digest(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def needed(n: int) -> int:
    """Least overlap of a set of ``n`` with any set that it links with."""
    return (4 * n + 4) // 5


def common_in_prefix(n: int) -> int:
    """The l of a set of ``n``; it never falls as n grows."""
    return max(1, n // 10)


def name(cls: bytes) -> int:
    """The 64 bits that name a class in the search."""
    return int.from_bytes(cls[:8], "little", signed=True)


def classes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, n, cls, id) of documents and rows (t, c) of shingles that repeat in a group of documents."""
    kind = docs.schema[key].dataType.simpleString()
    arrow = common.arrow_type(docs, key)

    def run(batches):
        for keys, texts in common.rows(batches, chars=8_000_000):
            sets = sets_of(texts)
            cls = [digest(s) if len(s) else None for s in sets]
            once = {c: s for c, s in zip(cls, sets, strict=True) if c}
            t, c = np.unique(np.concatenate([*once.values(), np.zeros(0, np.uint64)]), return_counts=True)
            t, c = t[c >= 3].view(np.int64), c[c >= 3]
            none = lambda k, kind: pa.nulls(k, kind)
            names = ["key", "n", "cls", "id", "t", "c"]
            yield pa.RecordBatch.from_arrays([pa.array(keys, arrow), pa.array([len(s) for s in sets], pa.int64()), pa.array(cls, pa.binary()), pa.array([c and name(c) for c in cls], pa.int64()), none(len(keys), pa.int64()), none(len(keys), pa.int64())], names=names)
            yield pa.RecordBatch.from_arrays([none(len(t), arrow), none(len(t), pa.int64()), none(len(t), pa.binary()), none(len(t), pa.int64()), pa.array(t), pa.array(c.astype(np.int64))], names=names)

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n long, cls binary, id long, t long, c long")


#: Kinds of rows (b, kind, id, x, o), each three arrays side by side: shingles x of the prefixes, sizes x of classes,
#: frequent shingles x of prefixes with their order o, shingles x that several classes share with their frequency o.
_PREFIX, _SIZE, _OFTEN, _SHARED = range(4)
_ROWS = "b long, kind int, id array<bigint>, x array<bigint>, o array<bigint>"
_ARROW = pa.schema([("b", pa.int64()), ("kind", pa.int32()), *((c, pa.list_(pa.int64())) for c in ("id", "x", "o"))])
#: What is added to the order of a frequent shingle, so that it comes after all others.
_LAST = 1 << 30


def _labels(spark: SparkSession) -> np.ndarray:
    """A number for each range of hashes that hash partitioning sends to a partition of its own."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = spark.range(64 * parts).groupBy(F.pmod(F.hash("id"), F.lit(parts)).alias("p")).agg(F.min("id").alias("id")).orderBy("p").collect()
    return np.array([r["id"] for r in named], np.int64)


def _dealt(label: np.ndarray, by: np.ndarray, kind: int, *cols: np.ndarray) -> pa.RecordBatch:
    """Columns (id, x, o) as one row for each range of the hashes ``by``; within it in the order of id."""
    place = ((by.view(np.uint64) >> np.uint64(32)) * np.uint64(len(label)) >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((cols[0], place))
    place = place[order]
    cut = np.flatnonzero(np.diff(place, prepend=-1))
    offsets = pa.array(np.append(cut, len(place)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x.view(np.int64)[order])) for x in cols]
    lists += [pa.nulls(len(cut), pa.list_(pa.int64()))] * (3 - len(lists))
    return pa.RecordBatch.from_arrays([pa.array(label[place[cut]]), pa.array(np.full(len(cut), kind, np.int32)), *lists], schema=_ARROW)


def _held(table: pa.Table, kind: int, columns: list[str]) -> list[np.ndarray]:
    """The arrays of the rows of a kind, joined."""
    rows = table.filter(pa.compute.equal(table["kind"], kind))
    return [rows[c].combine_chunks().flatten().to_numpy() if rows.num_rows else np.zeros(0, np.int64) for c in columns]


def _distinct(*cols: np.ndarray) -> list[np.ndarray]:
    """Sorted rows of parallel columns, each once."""
    order = np.lexsort(cols[::-1])
    cols = [c[order] for c in cols]
    new = np.any([c[1:] != c[:-1] for c in cols], axis=0)
    return [c[np.concatenate([np.ones(min(1, len(c)), bool), new])] for c in cols]


def tokens(docs: DataFrame, text: str, frequent: np.ndarray, label: np.ndarray) -> DataFrame:
    """The prefixes and sizes of all classes, dealt by hash into ranges. A task tells of each class once."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        seen: set[bytes] = set()
        order = np.argsort(shared.value)
        in_order = np.concatenate([shared.value[order], np.full(1, -1).view(np.uint64)])
        for _, texts in common.rows(batches, chars=8_000_000):
            ids, n, light, size, often, of = [], [], [], [], [], []
            for s in sets_of(texts):
                c = digest(s)
                if not len(s) or c in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(c)
                at = np.searchsorted(in_order[:-1], s)
                known = (in_order[at] == s) & (at < len(order))
                most = len(s) - needed(len(s)) + common_in_prefix(len(s))
                light.append(s[~known][:most])
                size.append(len(light[-1]))
                often.append(np.sort(order[at[known]])[: most - size[-1]])
                of.append(len(often[-1]))
                ids.append(name(c))
                n.append(len(s))
            if not n:
                continue
            ids = np.array(ids, np.int64)
            flat, often = np.concatenate(light), np.concatenate(often).astype(np.int64)
            yield _dealt(label, flat, _PREFIX, np.repeat(ids, size), flat)
            yield _dealt(label, ids, _SIZE, ids, np.array(n, np.int64))
            if len(often):
                own = np.repeat(ids, of)
                yield _dealt(label, own, _OFTEN, own, shared.value[often], often + _LAST)

    return docs.select(F.lit(0).alias("key"), F.col(text).alias("text")).mapInArrow(run, _ROWS)


def candidates(found: DataFrame, label: np.ndarray) -> DataFrame:
    """(cls, n, prefix) of the classes that can have a partner; ``prefix`` holds their shingles in the index."""

    def shared(table: pa.Table) -> pa.Table:
        t, ids = _distinct(*_held(table, _PREFIX, ["x", "id"]))
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(t)), bool), t[1:] != t[:-1]]))
        df = np.diff(np.append(first, len(t)))
        df = np.repeat(df, df)
        several = df > 1
        rest = table.filter(pa.compute.not_equal(table["kind"], _PREFIX)).combine_chunks().cast(_ARROW)
        return pa.Table.from_batches([*rest.to_batches(), _dealt(label, ids[several], _SHARED, ids[several], t[several], df[several])], _ARROW)

    def index(table: pa.Table) -> pa.Table:
        named, n = _distinct(*_held(table, _SIZE, ["id", "x"]))
        ids, o, t = _distinct(*(np.concatenate(c) for c in zip(_held(table, _OFTEN, ["id", "o", "x"]), _held(table, _SHARED, ["id", "o", "x"]), strict=True)))
        starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(ids)), bool), ids[1:] != ids[:-1]]))
        ends = np.append(starts[1:], len(ids))
        sizes = n[np.searchsorted(named, ids[starts])]
        least = np.array([common_in_prefix(needed(x)) for x in sizes.tolist()], np.int64)
        can = ends - starts >= least
        stops, starts = (ends - least + 1)[can], starts[can]
        take = stops - starts
        at = np.repeat(starts - np.cumsum(take) + take, take) + np.arange(take.sum())
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(take)).astype(np.int32)), pa.array(t[at]))
        return pa.table({"cls": pa.array(ids[starts]), "n": pa.array(sizes[can]), "prefix": lists})

    back = found.repartition(len(label), "b").groupBy("b").applyInArrow(shared, _ROWS)
    return back.repartition(len(label), "b").groupBy("b").applyInArrow(index, "cls long, n long, prefix array<bigint>")


def sets(docs: DataFrame, key: str, text: str, base: DataFrame, held: DataFrame) -> DataFrame:
    """(cls, n, light) of the classes of ``held``: their sizes and whole sets, from one document of each."""
    one = base.where("id is not null").groupBy("id").agg(F.min("key").alias("k")).join(held.select(F.col("cls").alias("id")), "id", "left_semi").select("k")
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    texts = texts.join(one.hint("merge"), F.col("key").eqNullSafe(F.col("k")), "left_semi")  # alike at any size

    def run(batches):
        for _, group in common.rows(batches):
            light = [s for s in sets_of(group) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([name(digest(s)) for s in light], pa.int64()), pa.array([len(s) for s in light], pa.int64()), pa.array([s.view(np.int64) for s in light], pa.list_(pa.int64()))], names=["cls", "n", "light"])

    return texts.mapInArrow(run, "cls long, n long, light array<bigint>")


class Index:
    """Inverted lists of the sets with the numbers ``of``, for T-occurrence search by DivideSkip."""

    def __init__(self, sets: list[np.ndarray], of: np.ndarray):
        flat = np.concatenate([sets[i] for i in of])
        order = np.argsort(flat, kind="stable")
        self.owner = np.repeat(of, [len(sets[i]) for i in of])[order]
        self.token, self.start = np.unique(flat[order], return_index=True)
        self.end = np.append(self.start[1:], len(flat))
        self.held = len(of)

    def search(self, query: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Numbers of the sets whose overlap with ``query`` reaches their ``least`` (by number)."""
        at = np.searchsorted(self.token, query)
        at = at[self.token[np.minimum(at, len(self.token) - 1)] == query]
        bound = needed(len(query))
        if len(at) < bound:
            return np.zeros(0, np.int64)
        size = self.end[at] - self.start[at]
        at = at[np.argsort(-size, kind="stable")]
        long = min(bound - 1, int(bound / (0.1 * math.log2(int(size.max()) + 1) + 1)))
        start, size = self.start[at[long:]], np.sort(size)[::-1][long:]
        merged = np.sort(self.owner[np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())], kind="stable")  # sorted runs, merged
        left, count = np.unique(merged, return_counts=True)
        left, count = left[count >= least[left] - long], count[count >= least[left] - long]
        for k in at[:long]:
            if not len(left):
                break
            run = self.owner[self.start[k] : self.end[k]]
            count += run[np.minimum(np.searchsorted(run, left), len(run) - 1)] == left
        return left[count >= least[left]]


def spanning(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between ``sets``, by number, that span the components of all their links."""
    n = np.array([len(s) for s in sets])
    open_, out = np.ones(len(sets), bool), []
    index = Index(sets, np.arange(len(sets)))
    for seed in range(len(sets)):
        todo = [seed] if open_[seed] else []
        open_[seed] = False
        while todo:
            i = todo.pop()
            left = int(open_.sum())
            if not left:
                return out
            if 4 * left < 3 * index.held:
                index = Index(sets, np.flatnonzero(open_))
            least = np.where(open_, -(-4 * (n + n[i]) // 9), len(sets[i]) + 1)
            found = index.search(sets[i], least)
            open_[found] = False
            out += [(i, j) for j in found.tolist()]
            todo += found.tolist()
    return out


def _search(table: pa.Table) -> pa.Table:
    """The links that span each group of a bucket."""
    a, b = [], []
    order = table["g"].to_numpy().argsort(kind="stable")
    table = table.take(pa.array(order)).combine_chunks()
    g, cls, light = table["g"].to_numpy(), table["cls"].to_numpy(), table["light"].chunk(0)
    flat, offset = light.values.to_numpy().view(np.uint64), light.offsets.to_numpy()
    edge = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]]))
    for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        ids = cls[x:y]
        for i, j in spanning([flat[offset[k] : offset[k + 1]] for k in range(x, y)]):
            a.append(ids[i])
            b.append(ids[j])
    return pa.table({"u": pa.array(a, pa.int64()), "v": pa.array(b, pa.int64())})


def _candidate_groups(held: DataFrame, label: np.ndarray) -> DataFrame:
    """(node, label): classes of ``held`` that share lists, directly or through others."""

    def deal(batches):
        for batch in batches:
            lists = batch.column("prefix")
            t, cls = lists.flatten().to_numpy(), batch.column("cls").to_numpy()
            if len(t):
                yield _dealt(label, t, _PREFIX, np.repeat(cls, pa.compute.list_value_length(lists).to_numpy()), t)

    def join(table: pa.Table) -> pa.Table:
        t, cls = _distinct(*_held(table, _PREFIX, ["x", "id"]))
        nodes, at = np.unique(cls, return_inverse=True)
        first = np.concatenate([np.ones(min(1, len(t)), bool), t[1:] != t[:-1]])
        lead = np.maximum.accumulate(np.where(first, np.arange(len(t)), 0))
        root = roots(at, at[lead], len(nodes))
        on = root != np.arange(len(nodes))
        return pa.table({"u": pa.array(nodes[on]), "v": pa.array(nodes[root[on]])})

    dealt = held.mapInArrow(deal, _ROWS).repartition(len(label), "b")
    return components(dealt.groupBy("b").applyInArrow(join, "u long, v long"))


def links(held: DataFrame, sets: DataFrame, label: np.ndarray, group: int = GROUP) -> DataFrame:
    """(node, label) over the classes that have links."""
    groups = common.stored(held.select(F.col("cls").alias("node"), "n").join(_candidate_groups(held, label), "node"))
    sizes = groups.groupBy("label").agg(F.sum("n").alias("w"))
    members = groups.join(sizes, "label").selectExpr("node as cls", "label", "w", "floor(ln(n) / ln(1.25D)) as band", "ceil(2 * w / %d) as k" % group)
    small = members.where(F.col("w") <= group).selectExpr("cls", "label as g")
    blocks = members.where(F.col("w") > group).selectExpr("cls", "label", "k", "pmod(xxhash64(cls), k) as s", "explode(array(band, band + 1)) as band")
    blocks = blocks.selectExpr("*", "explode(sequence(0L, k - 1)) as o").selectExpr("cls", "xxhash64(label, band, least(s, o), greatest(s, o)) as g")
    asked = common.stored(small.unionByName(blocks))
    total = asked.join(groups.select(F.col("node").alias("cls"), "n"), "cls").agg(F.sum("n")).first()[0] or 0
    buckets = max(len(label), total // group + 1)
    found = asked.join(sets, "cls").select(F.pmod(F.xxhash64("g"), F.lit(buckets)).alias("b"), "g", "cls", "light")
    return components(found.groupBy("b").applyInArrow(_search, "u long, v long"))


def _labelled(docs: DataFrame, key: str, text: str, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """Documents (key, n, cls) and classes (cls, least, label): smallest key and component."""
    told = common.stored(classes(docs, key, text))
    base = told.where("c is null").select("key", "n", "cls", "id")
    total = base.agg(F.sum("n")).first()[0] or 0
    often = told.where("c is not null").groupBy("t").agg(F.sum("c").alias("c")).where(F.col("c") >= max(FREQUENT, total // MOST_FREQUENT + 1)).orderBy("c", "t")
    frequent = np.array([r["t"] for r in often.collect()], np.int64).view(np.uint64)
    label = _labels(docs.sparkSession)
    held = common.stored(candidates(tokens(docs, text, frequent, label), label))
    whole = common.stored(sets(docs, key, text, base, held).dropDuplicates(["cls"]))
    labels = links(held, whole, label, group)
    by_class = base.where("cls is not null").groupBy("cls", "id").agg(F.min("key").alias("least"))
    return base, by_class.join(labels.select(F.col("node").alias("id"), "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """(key, n_shingles, component_id) for each row of ``docs``."""
    base, by_class = _labelled(docs, key, text, group)
    least = by_class.groupBy("label").agg(F.min("least").alias("least"))
    by_class = by_class.drop("least").join(least, "label").select("cls", "least")
    linked = base.where("cls is not null").join(by_class, "cls").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))
    return linked.unionByName(base.where("cls is null").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("key").alias("component_id")))


def unique(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component, that of the smallest key (any of a key's equal sets), columns unchanged.

    Rows without shingles all stay.
    """
    _, by_class = _labelled(docs, key, text)
    best = F.min(F.struct(F.col("least").isNull().alias("no"), "least", "cls")).alias("b")
    winners = by_class.groupBy("label").agg(best).select(F.col("b.least").alias("__key"), F.col("b.cls").alias("__cls"))
    at, cols = docs.columns.index(text), docs.columns

    def run(batches):
        for batch in batches:
            sets = [s for i in range(0, batch.num_rows, 256) for s in sets_of([x.as_py() or "" for x in batch.column(at)[i : i + 256]])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([digest(s) if len(s) else None for s in sets], pa.binary())], names=[*cols, "__cls"])

    schema = docs.select("*", F.lit(None).cast("binary").alias("__cls")).schema
    told = docs.mapInArrow(run, schema)
    # texts are dealt by key and class at any size, which the removal of repeated rows uses as well
    kept = told.where("__cls is not null").alias("d").join(winners.hint("merge").alias("w"), F.col(f"d.{key}").eqNullSafe(F.col("w.__key")) & (F.col("d.__cls") == F.col("w.__cls")), "left_semi")
    kept = kept.dropDuplicates([key, "__cls"])
    return kept.unionByName(told.where("__cls is null")).select(*cols)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return join(common.table(spark, sf_dir, "documents"))
