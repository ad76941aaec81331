"""Containment deny-lists: which recordings hold the text of held-out utterances.

Grams are 64-bit hashes of 8 words, counted with partial aggregation. A gram in more than ``most_df`` recordings is
boilerplate; an utterance is contained in a recording that holds at least ``share`` of its other grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .sequences import stored

GRAM, BOILERPLATE, SHARE = 8, 100, 0.5
#: Characters whose grams a range of hashes holds, about.
RANGE = 4_000_000


def recordings(rows: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Each recording's rows joined in order: (key, norm). A recording is one document's worth of text."""
    said = F.array_sort(F.collect_list(F.struct(order, F.col(text).alias("t"))))
    return rows.groupBy(key).agg(T.simple_norm(F.concat_ws(" ", F.transform(said, lambda x: x["t"]))).alias("norm"))


def gram_rows(df: DataFrame, key: str, norm: str = "norm", n: int = GRAM) -> DataFrame:
    """Distinct (key, gram)."""
    return df.select(key, F.explode(F.array_distinct(T.gram_hashes(T.words(F.col(norm)), n))).alias("gram"))


def frequencies(df: DataFrame, chars: int, norm: str = "norm", n: int = GRAM) -> DataFrame:
    """(df, n): how many grams occur in ``df`` rows each, for those in more than one. ``chars``: about how many the texts have.

    A batch sends its grams with their counts as flat arrays, a row for each range of hashes, so that a gram takes no row of its
    own in sorts and hash maps; a range adds them up.
    """
    ranges = chars // RANGE + 1

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gram, times = np.unique(b.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
            if len(gram):
                place = gram % ranges
                order = np.argsort(place, kind="stable")
                gram, times, place = gram[order], times[order].astype(np.uint32), place[order]
                edge = np.flatnonzero(np.diff(place, prepend=-1, append=-1)).tolist()
                parts = [gram[a:z].tobytes() + times[a:z].tobytes() for a, z in zip(edge[:-1], edge[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(place[edge[:-1]], pa.int64()), pa.array(parts, pa.binary())], names=["b", "data"])

    def added(table: pa.Table) -> pa.Table:
        parts = [x.as_buffer() for x in table["data"]]
        gram = np.concatenate([np.frombuffer(x, np.int64, x.size // 12) for x in parts])
        times = np.concatenate([np.frombuffer(x, np.uint32, x.size // 12, x.size // 12 * 8) for x in parts])
        order = np.argsort(gram)
        gram, times = gram[order], times[order].astype(np.int64)
        total = np.add.reduceat(times, np.flatnonzero(np.append(True, gram[1:] != gram[:-1])))
        found, many = np.unique(total[total > 1], return_counts=True)
        return pa.table([pa.array(found, pa.int64()), pa.array(many, pa.int64())], names=["df", "n"])

    grams = df.select(F.array_distinct(T.gram_hashes(T.words(F.col(norm)), n)).alias("grams"))
    sums = grams.mapInArrow(counted, "b long, data binary").groupBy("b").applyInArrow(added, "df long, n long")
    return sums.groupBy("df").agg(F.sum("n").alias("n"))


def probe(training: DataFrame, held: DataFrame, rec: str, utt: str, n: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(held-out grams by utterance, training recordings that have them), stored: all texts are cut into grams once."""
    wanted = stored(gram_rows(held, utt, n=n))
    return wanted, stored(gram_rows(training, rec, n=n).join(wanted.select("gram").distinct(), "gram", "left_semi"))


def contained(training: DataFrame, held: DataFrame, rec: str, utt: str, n: int = GRAM, most_df: int = BOILERPLATE, share: float = SHARE, boilerplate: DataFrame | None = None, probed: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(rec, utt, matched, n_grams) of each contained utterance. ``boilerplate``: a given table of grams instead of counts."""
    wanted, found = probed or probe(training, held, rec, utt, n)
    if boilerplate is None:
        boilerplate = found.groupBy("gram").agg(F.count("*").alias("df")).where(F.col("df") > most_df).select("gram")
    wanted = wanted.join(boilerplate, "gram", "left_anti")
    need = wanted.groupBy(utt).agg(F.count("*").alias("n_grams"))
    matched = found.join(wanted, "gram").groupBy(rec, utt).agg(F.count("*").alias("matched"))
    return matched.join(need, utt).where(F.col("matched") >= F.ceil(F.col("n_grams") * share)).select(rec, utt, "matched", "n_grams")


def sentences_held(made: DataFrame, corpus: DataFrame, key: str, rec: str, n: int = GRAM, share: float = SHARE) -> DataFrame:
    """(key, n_grams, found, contained): every sentence, and whether ``share`` of its grams occur anywhere in the corpus."""
    wanted, found = probe(corpus, made, rec, key, n)
    seen = found.select("gram").distinct().withColumn("__seen", F.lit(1))
    told = wanted.join(seen, "gram", "left").groupBy(key).agg(F.count("*").alias("n_grams"), F.count("__seen").alias("found"))
    out = made.select(key).join(told, key, "left").select(key, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_grams", "found")))
    return out.withColumn("contained", (F.col("n_grams") > 0) & (F.col("found") >= F.col("n_grams") * share))


def report(training: DataFrame, held: DataFrame, rec: str, utt: str, n: int = GRAM, most_df: int = BOILERPLATE, share: float = SHARE) -> DataFrame:
    """One row: utterances checked, too short for a gram, of boilerplate only, contained; and recordings denied."""
    wanted, found = probed = probe(training, held, rec, utt, n)
    hits = contained(training, held, rec, utt, n, most_df, share, probed=probed).select(rec, utt)
    common = found.groupBy("gram").agg(F.count("*").alias("df")).where(F.col("df") > most_df).select("gram")
    left = wanted.join(common, "gram", "left_anti").select(utt).distinct().withColumn("__left", F.lit(True))
    state = held.select(utt, (F.size(T.words(F.col("norm"))) < n).alias("short")).join(left, utt, "left")
    none = [F.lit(None).alias(c) for c in ("checked", "short", "empty")]
    told = state.select(
        F.lit(1).alias("checked"), F.col("short").cast("int").alias("short"), (~F.col("short") & F.col("__left").isNull()).cast("int").alias("empty"),
        F.lit(None).cast("string").alias("utt"), F.lit(None).cast("string").alias("rec"),
    ).unionByName(hits.select(*(c.cast("int") for c in none), F.col(utt).cast("string").alias("utt"), F.col(rec).cast("string").alias("rec")).toDF("checked", "short", "empty", "utt", "rec"))
    return told.agg(
        F.coalesce(F.sum("checked"), F.lit(0)).alias("checked"), F.coalesce(F.sum("short"), F.lit(0)).alias("skipped_short"), F.coalesce(F.sum("empty"), F.lit(0)).alias("skipped_empty"),
        F.count_distinct("utt").alias("contained"), F.count_distinct("rec").alias("recordings"),
    )


def set_report(training: DataFrame, held: DataFrame, identity: DataFrame, rec: str, utt: str, group: str, n: int = GRAM, most_df: int = BOILERPLATE, share: float = SHARE) -> DataFrame:
    """One row for each held-out set: its utterances by what became of them, and the recordings that it denies.

    ``held`` has one row for each utterance, ``identity`` (group, rec) the recordings that its ids name; rows without a group
    are left out. Columns: utterances, checked, skipped_short, skipped_empty (of boilerplate only), contained_utterances,
    containment_recordings, identity_recordings, recordings (either).
    """
    held = held.where(F.col(group).isNotNull())
    wanted, found = probed = probe(training, held, rec, utt, n)
    hits = stored(contained(training, held, rec, utt, n, most_df, share, probed=probed).select(rec, utt))
    common = found.groupBy("gram").agg(F.count("*").alias("df")).where(F.col("df") > most_df).select("gram")
    flag = lambda df, name: df.select(utt).distinct().withColumn(name, F.lit(True))
    state = held.select(group, utt, (F.size(T.words(F.col("norm"))) < n).alias("__short"))
    state = state.join(flag(wanted.join(common, "gram", "left_anti"), "__left"), utt, "left").join(flag(hits, "__hit"), utt, "left")
    told = state.groupBy(group).agg(
        F.count("*").alias("utterances"), F.count_if("__short").alias("skipped_short"),
        F.count_if(~F.col("__short") & F.col("__left").isNull()).alias("skipped_empty"), F.count("__hit").alias("contained_utterances"),
    )
    of = hits.join(held.select(group, utt), utt).select(group, rec, F.lit(True).alias("__in"), F.lit(False).alias("__named"))
    named = identity.where(F.col(group).isNotNull() & F.col(rec).isNotNull()).select(group, rec, F.lit(False).alias("__in"), F.lit(True).alias("__named"))
    by_rec = of.unionByName(named).groupBy(group, rec).agg(F.max("__in").alias("__in"), F.max("__named").alias("__named"))
    denied = by_rec.groupBy(group).agg(F.count_if("__in").alias("containment_recordings"), F.count_if("__named").alias("identity_recordings"), F.count("*").alias("recordings"))
    counts = [c for c in (*told.columns, *denied.columns) if c != group]
    out = told.join(denied, group, "full_outer").select(group, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts))
    return out.withColumn("checked", F.col("utterances") - F.col("skipped_short") - F.col("skipped_empty"))


def talks(rows: DataFrame, held: DataFrame, rec: str, order: str, labels: dict[str, str], utt: str, size: int = 20, most_df: int = BOILERPLATE, share: float = SHARE) -> DataFrame:
    """(rec, label_set, windows, closest): how near a recording comes to held-out talks, in each of its sets of labels.

    ``labels``: name -> column of ``rows``. A recording's rows are joined in order, so that grams cross them, and held against
    windows of ``size`` words of each talk. ``windows`` are those of which it has ``share`` of the grams, ``closest`` is the largest
    share. Boilerplate is counted within a label set. Recordings without a gram of a talk have no row.
    """
    cut = windows(held, utt, size=size).withColumn("__unit", F.struct(utt, "window"))
    out = None
    for name, text in labels.items():
        met = contained(recordings(rows, rec, order, text), cut, rec, "__unit", most_df=most_df, share=0.0)
        near = met.groupBy(rec).agg(F.count_if(F.col("matched") >= F.ceil(F.col("n_grams") * share)).alias("windows"), F.max(F.col("matched") / F.col("n_grams")).alias("closest"))
        near = near.select(rec, F.lit(name).alias("label_set"), "windows", "closest")
        out = near if out is None else out.unionByName(near)
    return out


def rejected(rows: DataFrame, near: DataFrame, rec: str, key: str) -> DataFrame:
    """(key, label_sets): every id of each recording that ``talks`` found a window in, with the label sets that had it."""
    bad = near.where("windows > 0").groupBy(rec).agg(F.array_sort(F.collect_set("label_set")).alias("label_sets"))
    return rows.select(rec, key).distinct().join(bad, rec).select(key, "label_sets")


def windows(df: DataFrame, key: str, norm: str = "norm", size: int = 20) -> DataFrame:
    """Each text cut into consecutive windows of ``size`` words: (key, window, norm)."""
    w = T.words(F.col(norm))
    part = lambda v, i: F.struct((i / size).cast("int").alias("window"), F.array_join(F.slice(v, i + 1, size), " ").alias("norm"))
    cut = T.let(w, lambda v: F.transform(F.sequence(F.lit(0), F.size(v) - 1, F.lit(size)), lambda i: part(v, i)))
    return df.where(F.size(w) > 0).select(key, F.explode(cut).alias("x")).select(key, "x.window", "x.norm")


def denylist(training: DataFrame, held: DataFrame, reserved: DataFrame, rec: str, utt: str, identity: DataFrame | None = None, **rule) -> DataFrame:
    """(rec, rules): recordings that are reserved, contain a held-out utterance or, by ``identity``, are named by a held-out id.

    Named recordings are denied whether or not they are in ``training``; a null names none.
    """
    hits = contained(training, held, rec, utt, **rule).select(rec).distinct().withColumn("rule", F.lit("containment"))
    every = hits.unionByName(reserved.select(rec).distinct().withColumn("rule", F.lit("reserved")))
    if identity is not None:
        every = every.unionByName(identity.select(rec).where(F.col(rec).isNotNull()).distinct().withColumn("rule", F.lit("identity")))
    return every.groupBy(rec).agg(F.array_sort(F.collect_set("rule")).alias("rules"))


def subset(stats: DataFrame, denied: DataFrame, rec: str, hits: str, words: str, least_words: int, per_thousand: float) -> DataFrame:
    """``stats`` with ``state``: qualifies by length and density, and whether it is denied."""
    marked = stats.join(denied.select(rec).distinct().withColumn("__no", F.lit(True)), rec, "left")
    ok = (F.col(words) >= least_words) & (1000.0 * F.col(hits) >= per_thousand * F.col(words))
    return marked.withColumn("state", F.when(~ok, "not_qualified").when(F.col("__no"), "denied").otherwise("selected")).drop("__no")
