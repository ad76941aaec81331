"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` would fold other alphabets too."""
    return F.translate(col, UPPER, UPPER.lower())


def crc_mod(col: Column, mod: int, rest: int) -> Column:
    """Whether crc32 of the column as text leaves ``rest``; false for null."""
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % mod == rest, F.lit(False))


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local session that has none gets a temporary one."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lexispark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint: for small tables that steps of an iteration hand on."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a compressed table in the shared folder: for large ones. Spark removes it as it ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def arrow_type(df: DataFrame, column: str) -> pa.DataType:
    """The Arrow type in which Spark hands a column to tasks and takes it back."""
    return to_arrow_type(df.schema[column].dataType)


def rows(batches: Iterator[pa.RecordBatch], most: int = 2048, chars: int = 2_000_000) -> Iterator[tuple[list, list]]:
    """(keys, texts) of small bounded groups of rows from batches of (key, text); null text is empty."""
    for batch in batches:
        keys, texts, size = [], [], 0
        for key, text in zip(batch.column(0), batch.column(1), strict=True):
            text = text.as_py() or ""
            keys.append(key.as_py())
            texts.append(text)
            size += len(text)
            if len(texts) >= most or size >= chars:
                yield keys, texts
                keys, texts, size = [], [], 0
        if texts:
            yield keys, texts


def mix(a: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values (the finaliser of splitmix64)."""
    a = (a ^ (a >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    a = (a ^ (a >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return a ^ (a >> np.uint64(31))


#: An odd multiplier and its inverse modulo 2**64; the powers grow with the longest chunk seen.
_P = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _powers(n: int) -> list[np.ndarray]:
    while len(_POWERS[0]) < n:
        for k, base in ((0, _P), (1, pow(_P, -1, 1 << 64))):
            old = _POWERS[k]
            _POWERS[k] = np.concatenate([old, old * np.uint64(pow(base, len(old), 1 << 64))])
    return _POWERS


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts (A-Z folded, split at \\x20 and \\x09-\\x0D) and where each text's begin.

    A word's hash is a polynomial in its bytes, taken from prefix sums over the joined texts and scrambled.
    """
    parts = [t.encode().lower() for t in texts]
    data = np.frombuffer(b" ".join([b"", *parts, b""]), np.uint8)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    space = _SPACE[data]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    power, inverse = _powers(len(data))
    sums = np.cumsum(data * power[: len(data)])
    hashes = mix((sums[ends - 1] - sums[starts - 1]) * inverse[starts])
    return hashes, np.searchsorted(starts, np.concatenate([[0], np.cumsum(size + 1)]) + 1)


def shingle_hashes(texts: list[str], n: int, chars: int = 1_000_000) -> list[np.ndarray]:
    """For each text the hashes of its ``n``-word shingles in order; of all its words as one, if fewer (but not none).

    Texts are hashed in groups of about ``chars`` characters, which bounds the arrays (but for a longer text).
    """
    out, group, size = [], [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= chars:
            out += _shingles(group, n)
            group, size = [], 0
    return out + _shingles(group, n)


def _shingles(texts: list[str], n: int) -> list[np.ndarray]:
    w, first = word_hashes(texts)
    h = np.full(max(0, len(w) - n + 1), n, np.uint64)
    for j in range(n):
        h = h * np.uint64(_P) + w[j : len(w) - n + 1 + j] if len(h) else h
    h = mix(h)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n or a == b:
            out.append(h[a : b - n + 1].copy() if b > a else h[:0])
        else:
            one = np.full(1, b - a, np.uint64)
            for j in range(a, b):
                one = one * np.uint64(_P) + w[j]
            out.append(mix(one))
    return out


def slices(batch: pa.RecordBatch, size: int, column: int = 1) -> Iterator[pa.RecordBatch]:
    """Parts of a batch in which ``column`` (string or binary) holds about ``size`` bytes, a longer value alone."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, "right")))
        yield batch.slice(a, b - a)
        a = b


def integer_vectors(df: DataFrame, key: str, vector: str, scale: int, keep: list[str] | None = None) -> DataFrame:
    """(key, x, *keep): x holds floor(scale * component) of each vector of finite components, as longs.

    Null vectors and those with a null, NaN or infinite component go. A product beyond a long becomes the nearest long.
    Only vectors of the most frequent length stay (of lengths equally frequent, the greater), as no other fits them; an
    empty vector never stays.
    """
    if len({key, vector, *(keep or [])}) < 2 + len(keep or []):
        raise ValueError("key, vector and kept columns must differ")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    x = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    good = df.where(F.col(vector).isNotNull() & finite & (F.size(vector) > 0)).select(F.col(key).alias("key"), x.alias("x"), *[F.col(c).alias(f"keep{n}") for n, c in enumerate(keep or [])])
    usual = good.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return good.where(F.size("x") == (usual["width"] if usual else 0))


def reach(x: np.ndarray) -> int:
    """Greatest absolute value, 0 for none; numpy's own would overflow for the least long."""
    return max(int(x.max()), -int(x.min())) if x.size else 0


def matrices(batches: Iterator[pa.RecordBatch], column: int, values: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, their equally long lists of longs as a matrix) in parts of about ``values`` numbers."""
    for batch in batches:
        if batch.num_rows:
            step = max(1, values // len(batch.column(column)[0]))
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def summed(partial: DataFrame, keys: list[str], values: str, width: int) -> list:
    """Rows of ``keys`` and the sums of the places of the array ``values``: partial sums of tasks, added up by Spark."""
    return partial.groupBy(*keys).agg(*[F.sum(F.get(values, F.lit(j))).alias(f"s{j}") for j in range(width)]).collect()
