"""Vector code compression: product quantisation with partial-distance search.

Vectors become integers and are cut into parts; each part has a codebook, and a vector is stored as the index of the
nearest entry of each part (a byte a part with 256 entries). The nearest entry is found by partial distances: dimensions
are taken in descending variance of the codebook, and an entry is dropped as soon as its accumulated distance strictly
exceeds the smallest complete distance known, so ties survive and go to the lower index. All arithmetic is on integers,
so codes don't depend on how rows are dealt out.

Each round reads the stored integer vectors once. Tasks send sums by (part, entry), which Spark adds up; the driver holds
the codebooks alone, whose size is parts x entries x width. Labels' sums are joined by broadcast while there are at most
``FEW`` labels and otherwise by label and a salt, so that no label falls to one task.

Null vectors and those with a null or non-finite component are left out, as are vectors of an unusual length
(``common.integer_vectors``). With fewer vectors than entries the codebook has as many entries as there are vectors.
Repeated rows count as often as they occur; rows of equal keys seed the codebook in order of their vectors and null keys
come last. An empty table gives an empty result. A width that the parts don't divide gives the first parts one more.
Integers are worked on as doubles while those hold every sum exactly, and as Python integers beyond that; an error beyond a long becomes
the greatest long, a label's sum beyond it null. Columns other than those named aren't read.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
FEW, SALTS = 100_000, 64
#: Rows whose distances to all entries are held at once.
ROWS = 256
_MOST = (1 << 63) - 1


def borders(width: int, parts: int) -> list[tuple[int, int]]:
    ends = np.cumsum([0, *(len(a) for a in np.array_split(np.arange(width), parts))]).tolist()
    return list(zip(ends, ends[1:], strict=False))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest entry of ``book`` for each row of ``x``, ties to the lower index."""
    if x.size == 0:
        return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    reach = common.reach(x) + common.reach(book)
    kind = np.float64 if reach * reach * x.shape[1] < 1 << 53 else object
    order = np.argsort(-book.astype(float).var(axis=0), kind="stable")
    x, book = x[:, order].astype(kind), book[:, order].astype(kind)
    found = [_search(x[a : a + ROWS], book) for a in range(0, len(x), ROWS)]
    index, distance = np.concatenate([i for i, _ in found]), np.concatenate([d for _, d in found])
    return index, distance if kind is object else distance.astype(np.int64)


def _search(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first half of the dimensions in one product for all entries, then one at a time for those still alive."""
    half = x.shape[1] // 2
    a, b = x[:, :half], book[:, :half]
    first = (a * a).sum(axis=1)[:, None] + ((b * b).sum(axis=1) - 2 * (a @ b.T))
    best = ((x - book[first.argmin(axis=1)]) ** 2).sum(axis=1)
    row, entry = np.nonzero(first <= best[:, None])
    sums = first[row, entry]
    for d in range(half, x.shape[1]):
        step = x[row, d] - book[entry, d]
        sums = sums + step * step
        if d == (half + x.shape[1]) // 2:  # the closest so far is completed
            _, low = _lowest(row, sums)
            best = np.minimum(best, ((x - book[entry[low]]) ** 2).sum(axis=1))
        alive = sums <= best[row]
        row, entry, sums = row[alive], entry[alive], sums[alive]
    _, low = _lowest(row, sums)
    return entry[low], sums[low]


def _lowest(row: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each row's run begins and where its first smallest sum is; every row has a run, in order."""
    heads = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    least = np.minimum.reduceat(sums, heads)
    at = np.flatnonzero(sums == least[row])
    return heads, at[np.concatenate([[True], row[at[1:]] != row[at[:-1]]])]


def first_books(vectors: DataFrame, parts: int, entries: int) -> list[np.ndarray]:
    """The parts of the vectors with the smallest keys."""
    rows = [r["x"] for r in vectors.select("key", "x").orderBy(F.col("key").asc_nulls_last(), "x").limit(entries).collect()]
    x = np.array(rows, np.int64).reshape(len(rows), len(rows[0]) if rows else 0)
    return [x[:, a:b] for a, b in borders(x.shape[1], parts)]


def renewed(vectors: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Each used entry becomes the floor of the mean of the parts nearest to it; the others stay."""
    spark, width = vectors.sparkSession, sum(b.shape[1] for b in books)
    shared, cuts = spark.sparkContext.broadcast(books), borders(width, len(books))
    most = max(b - a for a, b in cuts)

    def run(batches):
        totals: dict = {}
        for _, x in common.matrices(batches, 0):
            for p, (a, b) in enumerate(cuts):
                index, _ = nearest(x[:, a:b], shared.value[p])
                order = np.argsort(index, kind="stable")
                used, heads, counts = np.unique(index[order], return_index=True, return_counts=True)
                part = x[order, a:b]
                if common.reach(part) * len(part) > _MOST:
                    part = part.astype(object)
                sums = np.add.reduceat(part, heads, axis=0).tolist()
                for e, n, s in zip(used.tolist(), counts.tolist(), sums, strict=True):
                    if (p, e) in totals:
                        n0, s0 = totals[p, e]
                        n, s = n + n0, [u + v for u, v in zip(s, s0, strict=True)]
                    totals[p, e] = n, s
        if totals:
            cols = [[k[0] for k in totals], [k[1] for k in totals], [[Decimal(v) for v in [n, *s]] for n, s in totals.values()]]
            types = [pa.int32(), pa.int32(), pa.list_(pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["part", "entry", "sums"])

    partial = vectors.select("x").mapInArrow(run, "part int, entry int, sums array<decimal(38,0)>")
    out = [b.copy() for b in books]
    for r in common.summed(partial, ["part", "entry"], "sums", most + 1):
        n = int(r["s0"])
        out[r["part"]][r["entry"]] = [int(r[f"s{j + 1}"]) // n for j in range(out[r["part"]].shape[1])]
    shared.unpersist()
    return out


def encode(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``vectors`` with x replaced by code (hex digits of the indexes, two a part up to 256 entries) and error."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    others = [c for c in vectors.columns if c != "x"]
    cuts = borders(sum(b.shape[1] for b in books), len(books))
    digits = max(2, len(f"{max(1, max(len(b) for b in books)) - 1:x}"))

    def run(batches):
        words = np.array([f"{i:0{digits}x}" for i in range(max(len(b) for b in shared.value))], object)
        for rows, x in common.matrices(batches, len(others)):
            code, error = np.full(len(x), "", object), np.zeros(len(x), np.int64)
            for p, (a, b) in enumerate(cuts):
                index, distance = nearest(x[:, a:b], shared.value[p])
                code, error = code + words[index], error.astype(distance.dtype) + distance
            if error.dtype == object:
                error = np.minimum(error, _MOST).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*rows.columns[: len(others)], pa.array(code, pa.string()), pa.array(error)], names=[*others, "code", "error"])

    schema = ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in others) + ", code string, error long"
    return vectors.select(*others, "x").mapInArrow(run, schema)


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for entry in b.tolist() for v in entry).encode()).hexdigest()


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", keep: list[str] | None = None, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """(key, *keep, code, error) of every usable vector, and the codebooks they refer to, one array a part."""
    keep = keep or []
    vectors = common.stored(common.integer_vectors(df, key, vector, scale, keep))
    books = first_books(vectors, parts, entries)
    for _ in range(rounds if len(books[0]) else 0):
        books = renewed(vectors, books)
    coded = encode(vectors, books)
    return coded.select(F.col("key").alias(key), *[F.col(f"keep{n}").alias(c) for n, c in enumerate(keep)], "code", "error"), books


def label_errors(coded: DataFrame, label: str = "label", few: int = FEW, salts: int = SALTS) -> DataFrame:
    """``coded`` with label_error, the sum of error over rows of an equal label, null ones being equal to each other."""
    sums = common.materialize(coded.groupBy(F.col(label).alias("__label")).agg(F.try_sum("error").alias("label_error")))
    on = F.col(label).eqNullSafe(F.col("__label"))
    if sums.count() <= few:
        return coded.join(F.broadcast(sums), on).drop("__label")
    salted = sums.withColumn("__dealt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = coded.withColumn("__salt", F.pmod(F.xxhash64(*coded.columns), F.lit(salts)).cast("int"))
    return rows.join(salted.hint("merge"), on & (F.col("__salt") == F.col("__dealt"))).drop("__label", "__salt", "__dealt")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes, errors and the codebooks' digest over all of embeddings."""
    coded, books = compress(common.table(spark, sf_dir, "embeddings"), keep=["label"])
    out = label_errors(common.stored(coded))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The same by brute force over all entries: distances from inner products, exact in doubles at this scale."""
    steps = [
        "kept as materialized (select vec_id, label, list_transform(embedding, lambda v: cast(floor(1024 * cast(v as double)) as bigint)) as x, row_number() over () as r from embeddings"
        " where embedding is not null and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0)",
        "part as materialized (select r, p, x[p * (len(x) // 4) + 1 : (p + 1) * (len(x) // 4)] as x from kept, range(4) as t(p))",
        "first as (select r, row_number() over (order by vec_id) - 1 as e from kept qualify e < 256)",
        "book0 as materialized (select p, e, x as c from part join first using (r))",
    ]
    for n in range(5):
        distance = "list_inner_product(cast(x as double[]), cast(x as double[])) - 2 * list_inner_product(cast(x as double[]), cast(c as double[])) + list_inner_product(cast(c as double[]), cast(c as double[]))"
        steps.append(f"near{n} as materialized (select r, p, any_value(x) as x, min({{'d': cast({distance} as bigint), 'e': e}}) as m from part join book{n} using (p) group by r, p)")
        if n < 4:
            steps.append(f"place{n} as (select p, m.e as e, unnest(x) as v, generate_subscripts(x, 1) as j from near{n})")
            steps.append(f"mean{n} as (select p, e, j, cast((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) as bigint) as v from place{n} group by p, e, j)")
            steps.append(f"used{n} as (select p, e, list(v order by j) as c from mean{n} group by p, e)")
            steps.append(f"book{n + 1} as materialized (select b.p, b.e, coalesce(u.c, b.c) as c from book{n} b left join used{n} u on u.p = b.p and u.e = b.e)")
    steps.append("final as (select r, string_agg(printf('%02x', cast(m.e as int)), '' order by p) as code, cast(sum(m.d) as bigint) as error from near4 group by r)")
    steps.append("flat as (select p, e, unnest(c) as v, generate_subscripts(c, 1) as j from book4)")
    steps.append("hash as (select sha256(string_agg(cast(v as varchar), ',' order by p, e, j)) as h from flat)")
    return f"with {', '.join(steps)} select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, h as codebooks_sha256 from kept join final using (r), hash"


ORACLE = _sql()
