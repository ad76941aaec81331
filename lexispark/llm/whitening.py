"""Embedding whitening: leading components by a randomised range finder with power passes and Rayleigh-Ritz.

Components of a vector become integers, and the distinct integer vectors are the fit list. Their sums are exact. A pass
over the fit list multiplies the covariance by a narrow basis without building it: each task centres its rows, multiplies
them by the basis and back, and sends a width x basis matrix; Spark adds these up. A pass starts from random directions,
more than are asked for, and each pass gives Ritz pairs and their residuals. If these aren't negligible against the gaps
between the eigenvalues after ``PASSES`` passes, the basis becomes all dimensions; one more pass then gives the
covariance itself and Rayleigh-Ritz its exact eigenvectors.

Null vectors, those with a null or non-finite component and those of an unusual length are left out
(``common.integer_vectors``). Repeated vectors count once for the fit, and each row gets its components. With fewer
dimensions than components asked for there are as many as dimensions. A direction without variance (all rows equal, one
row) has a null whitened value and isn't part of identity_error; without any variance explained is null. An empty table
gives an empty result. A deviation beyond 38 digits is null. Null and repeated keys are kept as they are; columns other
than those named aren't read.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

COMPONENTS, OVERSAMPLE, PASSES, SCALE, SEED = 4, 12, 6, 256, 17
#: Greatest residual of a Ritz pair, as a share of the gap to the next eigenvalue.
TOLERANCE = 1e-11
#: Columns of a partial sum; wider bases are sent in several blocks.
BLOCK = 64


def sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each dimension."""

    def run(batches):
        n, total = 0, [0] * width
        for _, x in common.matrices(batches, 0):
            n += len(x)
            wide = common.reach(x) * len(x) >= 1 << 63
            total = [a + b for a, b in zip(total, (x.astype(object) if wide else x).sum(axis=0).tolist(), strict=True)]
        if n:
            values = [n, *total]
            starts = range(0, len(values), BLOCK)
            cut = [[Decimal(v) for v in values[a : a + BLOCK]] for a in starts]
            yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int32()), pa.array(cut, pa.list_(pa.decimal128(38, 0)))], names=["at", "part"])

    found = {r["at"]: r for r in common.summed(fit.mapInArrow(run, "at int, part array<decimal(38,0)>"), ["at"], "part", BLOCK)}
    values = [int(found[j // BLOCK * BLOCK][f"s{j % BLOCK}"]) for j in range(width + 1)]
    return values[0], values[1:]


def product(fit: DataFrame, mean: np.ndarray, basis: np.ndarray, gram: bool = False) -> np.ndarray:
    """Sum over centred rows a of a (a basis), or, as ``gram``, of (a basis) (a basis)."""
    shared = fit.sparkSession.sparkContext.broadcast((mean, basis))
    height, width = (basis.shape[1] if gram else basis.shape[0]), basis.shape[1]

    def run(batches):
        centre, b = shared.value
        total = np.zeros((height, width))
        seen = False
        for _, x in common.matrices(batches, 0):
            a = x - centre
            y = a @ b
            total += (y if gram else a).T @ y
            seen = True
        if seen:
            starts = range(0, width, BLOCK)
            cells = [(i, c, total[i, c : c + BLOCK].tolist()) for i in range(height) for c in starts]
            types = [pa.int32(), pa.int32(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells, strict=True), types, strict=True)], names=["i", "at", "part"])

    out = np.zeros((height, width))
    for r in common.summed(fit.mapInArrow(run, "i int, at int, part array<double>"), ["i", "at"], "part", min(BLOCK, width)):
        for j in range(r["at"], min(r["at"] + BLOCK, width)):
            out[r["i"], j] = r[f"s{j - r['at']}"]
    shared.unpersist()
    return out


def components(fit: DataFrame, n: int, mean: np.ndarray, many: int, oversample: int = OVERSAMPLE, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray, bool]:
    """Leading eigenvalues, unit eigenvectors as columns (largest entry positive), and whether all dimensions were used."""
    width = len(mean)
    k = min(width, many + max(1, oversample))
    basis = np.linalg.qr(np.random.default_rng(SEED).standard_normal((width, k)))[0]
    full = k == width
    for _ in range(0 if full else passes):
        image = product(fit, mean, basis) / n
        values, inside = np.linalg.eigh(basis.T @ image)
        values, inside = values[::-1], inside[:, ::-1]
        vectors = basis @ inside
        residual = np.linalg.norm(image @ inside - vectors * values, axis=0)[:many]
        gaps = np.abs(np.diff(values))[:many]
        if np.all(residual <= TOLERANCE * np.minimum(gaps, np.concatenate([[np.inf], gaps[:-1]]))):
            break
        basis = np.linalg.qr(image)[0]
    else:
        full = True
        image = product(fit, mean, np.eye(width)) / n
        values, vectors = np.linalg.eigh((image + image.T) / 2)
        values, vectors = values[::-1], vectors[:, ::-1]
    vectors = vectors[:, :many]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    return values[:many], vectors, full


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", many: int = COMPONENTS, scale: int = SCALE, oversample: int = OVERSAMPLE, passes: int = PASSES) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): one row for each usable row and component."""
    spark, kind = df.sparkSession, df.schema[key].dataType.simpleString()
    schema = f"key {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    rows = common.stored(common.integer_vectors(df, key, vector, scale))
    head = rows.first()
    if head is None:
        return spark.createDataFrame([], schema).withColumnRenamed("key", key)
    width = len(head["x"])
    fit = common.stored(rows.select("x").distinct())
    n, total = sums(fit, width)
    mean = np.array([s / n for s in total])
    values, vectors, _ = components(fit, n, mean, min(many, width), oversample, passes)
    trace = variance(fit, mean) / n
    alive = values > trace * np.finfo(float).eps * width
    weights = np.where(alive, vectors / np.sqrt(np.where(alive, values, 1.0)), np.nan)
    good = weights[:, alive]
    error = float(np.abs(product(fit, mean, good, gram=True) / n - np.eye(good.shape[1])).max()) if good.size else None
    shared = spark.sparkContext.broadcast((mean, weights, (values / trace).tolist() if trace > 0 else [None] * len(values), total))

    def run(batches):
        centre, w, share, sums_ = shared.value
        c = w.shape[1]
        for part, x in common.matrices(batches, 1):
            white = ((x - centre) @ w).ravel()
            reach = n * common.reach(x) + max(map(abs, sums_))
            if reach * reach * width < 1 << 63:
                far = pa.array(((n * x - np.array(sums_)) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
            else:
                exact = ((n * x.astype(object) - np.array(sums_, object)) ** 2).sum(axis=1)
                far = pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))
            again = pa.array(np.repeat(np.arange(len(x)), c))
            cols = [part.column(0).take(again), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), len(x))), pa.array(np.full(len(again), n)), far.take(again)]
            cols += [pa.array(white, pa.float64(), mask=np.isnan(white)), pa.array(share * len(x), pa.float64()), pa.array([error] * len(again), pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("key", "x").mapInArrow(run, schema).withColumnRenamed("key", key)


def variance(fit: DataFrame, mean: np.ndarray) -> float:
    """Sum of squares of all centred components."""
    shared = fit.sparkSession.sparkContext.broadcast(mean)

    def run(batches):
        for _, x in common.matrices(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array([float(((x - shared.value) ** 2).sum())])], names=["total"])

    return fit.mapInArrow(run, "total double").agg(F.sum("total")).first()[0]


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened leading components of all embeddings. A deviation that no long holds is null here."""
    return whiten(common.table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))
