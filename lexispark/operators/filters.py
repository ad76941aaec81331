"""Row filters with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import grams, let


def duration_drop_reason(d: Column, lo: float = 1.0, hi: float = 30.0) -> Column:
    """empty_audio, too_short, too_long or null; bounds are kept."""
    bad = d.isNull() | F.isnan(d) | (d <= 0)
    return F.when(bad, "empty_audio").when(d < lo, "too_short").when(d > hi, "too_long")


def teacher_drop_reason(seconds: Column, said: Column, human: Column, rate: Column, infinite: Column, lo: float = 1.0, hi: float = 30.0, most: float = 0.5) -> Column:
    """Duration out of bounds, then nothing said, then too far from a human text, where there is one; null keeps."""
    far = (F.length(F.trim(human)) > 0) & (infinite | (rate > most))
    empty = F.length(F.trim(F.coalesce(said, F.lit("")))) == 0
    outside = seconds.isNull() | ~seconds.between(lo, hi)
    return F.when(outside, "duration_out_of_range").when(empty, "empty_teacher_text").when(far, "teacher_human_wer_gt_0.5")


def first_reason(reasons: dict[str, Column]) -> Column:
    """The name of the first condition that holds, or null."""
    return F.coalesce(*(F.when(c, F.lit(name)) for name, c in reasons.items()))


def all_reasons(reasons: dict[str, Column]) -> Column:
    """The names of all conditions that hold."""
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in reasons.items())))


def duplicate_of_earlier(key: str, *order: str) -> Column:
    return F.row_number().over(W.partitionBy(key).orderBy(*order)) > 1


def funnel(df: DataFrame, reason: str = "reason", size: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows (and their summed size) by reason; a null reason is ``kept``."""
    out = [F.count("*").alias("n"), *([F.sum(size).alias("size")] if size else [])]
    return df.groupBy(*by, F.coalesce(reason, F.lit("kept")).alias("reason")).agg(*out)


def equal_run(words: Column) -> Column:
    """Length of the longest run of equal words."""
    step = lambda acc, w: F.struct(
        w.alias("last"), F.when(acc["last"].eqNullSafe(w), acc["run"] + 1).otherwise(1).alias("run"),
        F.greatest(acc["best"], F.when(acc["last"].eqNullSafe(w), acc["run"] + 1).otherwise(1)).alias("best"),
    )
    zero = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))
    return F.aggregate(words, zero, step, lambda acc: acc["best"])


def ngram_loop(words: Column, run: int = 5, n: int = 3, times: int = 4, most: int = 30) -> Column:
    """Whether a word comes ``run`` times in a row, or in a short text an n-gram ``times`` times."""
    often = lambda grams: F.exists(grams, lambda g: F.size(F.filter(grams, lambda x: x == g)) >= times)
    looped = lambda w: (equal_run(w) >= run) | F.when((F.size(w) >= n) & (F.size(w) <= most), let(grams(w, n), often)).otherwise(False)
    return let(words, looped)


def fast_speech(n_words: Column, seconds: Column, confirm_wer: Column, most: float = 6.0, waive: float = 0.2) -> Column:
    """More words a second than ``most``, unless a second label confirms the text."""
    rate = F.try_divide(n_words, seconds)
    return F.coalesce(rate > most, F.lit(False)) & ~F.coalesce(confirm_wer <= waive, F.lit(False))


def confirmed(wer: Column, most: float = 0.5) -> Column:
    return wer.isNotNull() & ~F.isnan(wer) & (wer <= most)


def round_trip(text: Column, hyp_wer: Column, hit_cap: Column, duration: Column, most: float = 0.25) -> Column:
    """The first reason to drop a synthesised clip, or null: duration, transcript, cap, error rate."""
    return first_reason({"duration": duration_drop_reason(duration).isNotNull(), "no_transcript": F.coalesce(text, F.lit("")) == "", "hit_cap": hit_cap, "wer": F.coalesce(hyp_wer > most, F.lit(True))})


def runaway(insertions: Column, ref_words: Column, hyp_words: Column, k: int = 20, ratio: float = 1.5, slack: int = 10) -> Column:
    return (insertions >= k) | (hyp_words > ratio * ref_words + slack)


def capped_by_duration(words: Column, seconds: Column, rate: float = 4.5, slack: int = 5) -> Column:
    """At most ``rate`` words a second and ``slack`` more."""
    return F.slice(words, 1, F.greatest(F.floor(seconds * rate).cast("int") + slack, F.lit(0)))


def held_out_reason(df: DataFrame, speakers: DataFrame, clips: DataFrame, sentences: DataFrame, keys: str = "keys") -> DataFrame:
    """``df`` with ``reason``: its speaker, its clip or one of its sentence keys is held out (in that order).

    Each list is deduplicated and joined by equality; the planner broadcasts those it finds small.
    """
    hit = df.withColumn("__row", F.monotonically_increasing_id())
    said = hit.select("__row", F.explode(keys).alias("key")).join(sentences.select("key").distinct(), "key", "left_semi").select("__row").distinct()
    mark = lambda t, k, n: t.select(k).distinct().withColumn(n, F.lit(True))
    hit = hit.join(mark(speakers, "speaker", "__s"), "speaker", "left").join(mark(clips, "clip", "__c"), "clip", "left").join(said.withColumn("__t", F.lit(True)), "__row", "left")
    reason = F.when(F.col("__s"), "speaker").when(F.col("__c"), "clip").when(F.col("__t"), "sentence")
    return hit.withColumn("reason", reason).drop("__row", "__s", "__c", "__t")


def checked(col: Column, pattern: str, name: str) -> Column:
    """The value, if the whole of it matches; an error otherwise."""
    return F.when(col.rlike(f"^(?:{pattern})$"), col).otherwise(F.raise_error(F.concat(F.lit(f"{name}: "), F.coalesce(col, F.lit("null")))))
