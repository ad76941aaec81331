"""Queries on transcripts and streams of rows: normal forms, error rates, grams across records, generated sentences."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import align
from ..functions import english as E
from ..functions import text as T
from ..operators import decontaminate as D
from ..operators import filters as R
from .core import norm, query, split, table


def _sql_english(x: str) -> str:
    # DuckDB's word boundaries know ASCII only: other letters stand between two x meanwhile.
    x = f"regexp_replace(lower(coalesce({x}, '')), '([^\\x00-\\x7F\\pP\\pS\\pZ])', 'x\\1x', 'g')"
    quoted = lambda p, s, x: "regexp_replace({}, '{}', '{}', 'g')".format(x, p.replace("'", "''"), s.replace("'", "''"))
    for p, s in E.BEFORE_SYMBOLS:
        x = quoted(p, s, x)
    x = f"regexp_replace({x}, 'x([^\\x00-\\x7F])x', '\\1', 'g')"
    x = f"regexp_replace(strip_accents({x}), '[^\\pL\\pN\\s.%$¢€£]', ' ', 'g')"
    for p, s in E.AFTER_SYMBOLS:
        x = quoted(p, s, x)
    return f"trim({x})"


@query(f"select conv_id, turn, {_sql_english('text')} as text from conversations")
def x1_normal_english(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", E.normal_english(F.col("text")).alias("text"))


@query()
def x27_style_neutral(spark, d):
    neutral = E.style_neutral("acr unit cmp dis", {"per cent": "%", "kilometers": "km", "hours": "h"}, {"any one": "anyone"}, ("ah", "eh", "oh"))
    return table(spark, d, "conversations").select("conv_id", "turn", neutral(T.simple_norm(F.col("text"))).alias("text"))


# Error rates and alignments of a turn (reference) and the next (hypothesis)


def _pairs(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", T.simple_norm(F.col("text")).alias("ref"))
    return turns.join(turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ref").alias("hyp")), ["conv_id", "turn"])


@query()
def x9_alignment_steps(spark, d):
    return _pairs(spark, d).select("conv_id", "turn", F.posexplode(align.alignment("ref", "hyp")).alias("step", "x")).select("conv_id", "turn", "step", "x.*")


#: Word edit distance: a row of the cost table for each word of the reference, the running minimum of each row by slices.
RATE_SQL = f"""t as (select conv_id, turn, {split(norm('text'))} as w from conversations),
p as materialized (select a.conv_id, a.turn, a.w as r, b.w as h from t a join t b on b.conv_id = a.conv_id and b.turn = a.turn + 1),
f as (select conv_id, turn, 0 as i, range(len(h) + 1) as line from p
union all select conv_id, turn, i + 1, list_transform(range(1, len(u) + 1), lambda k: list_min(u[1:k]) + k) from (select conv_id, turn, i,
list_transform(range(1, len(h) + 2), lambda j: case when j = 1 then i + 1 else least(line[j] + 1, line[j - 1] + case when h[j - 1] = r[i + 1] then 0 else 1 end) end - j) as u from f join p using (conv_id, turn) where i < len(r))),
e as (select conv_id, turn, line[len(line)] as errors, len(r) as words, len(h) as said from f join p using (conv_id, turn) where i = len(r))"""


@query(f"with recursive {RATE_SQL} select conv_id, turn, case when words > 0 then errors / words when said = 0 then 0.0 end as wer, words = 0 and said > 0 as infinite from e")
def x12_utterance_rate(spark, d):
    e = _pairs(spark, d).withColumn("e", align.edit_counts("ref", "hyp"))
    rate, infinite = align.wer(F.expr("e.s + e.d + e.i"), T.n_words(F.col("ref")), T.n_words(F.col("hyp")))
    return e.select("conv_id", "turn", rate.alias("wer"), infinite.alias("infinite"))


@query()
def f18_teacher_reasons(spark, d):
    """Length stands for duration, fifteen characters a second."""
    e = _pairs(spark, d).withColumn("e", align.edit_counts("ref", "hyp")).withColumn("seconds", F.length("hyp") / 15.0)
    rate, infinite = align.wer(F.expr("e.s + e.d + e.i"), T.n_words(F.col("ref")), T.n_words(F.col("hyp")))
    return R.funnel(e.withColumn("reason", R.teacher_drop_reason(F.col("seconds"), F.col("hyp"), F.col("ref"), rate, infinite)), size="seconds")


# Grams


_SPOKEN = f"""w as (select conv_id, turn, unnest({split(norm("text"))}) as word, generate_subscripts({split(norm("text"))}, 1) as i from conversations),
g as (select conv_id, turn, lead(turn, 7) over o as last from w window o as (partition by conv_id order by turn, i))"""


@query(f"with {_SPOKEN} select conv_id, count(*) as n_grams, count(*) filter (turn <> last) as crossing from g where last is not null group by 1")
def w21_crossing_grams(spark, d):
    """8-grams of a record's rows read on; the window looks seven words ahead, so no record is held whole."""
    w = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(T.words(T.simple_norm(F.col("text")))).alias("i", "word"))
    g = w.select("conv_id", "turn", F.lead("turn", 7).over(W.partitionBy("conv_id").orderBy("turn", "i")).alias("last")).where("last is not null")
    return g.groupBy("conv_id").agg(F.count("*").alias("n_grams"), F.count_if(F.col("turn") != F.col("last")).alias("crossing"))


def _grams_sql(t: str, key: str) -> str:
    return f"""(select distinct {key}, array_to_string(w[i:i + 7], ' ') as gram from (select {key}, {split(norm("text"))} as w from {t}), lateral (select unnest(range(1, len(w) - 6)) as i))"""


@query(f"""with s as {_grams_sql("benchmark", "item_id")}, held as (select distinct gram from {_grams_sql("documents", "doc_id")}),
n as (select item_id, count(*) as n_grams, count(h.gram) as found from s left join held h using (gram) group by 1)
select item_id, coalesce(n_grams, 0) as n_grams, coalesce(found, 0) as found, coalesce(2 * found >= n_grams, false) as contained from benchmark left join n using (item_id)""")
def d5_generated_sentences(spark, d):
    """Which sentences are held by the given corpus: at least half of their 8-grams occur there."""
    made = table(spark, d, "benchmark").select("item_id", T.simple_norm(F.col("text")).alias("norm"))
    corpus = table(spark, d, "documents").select("doc_id", T.simple_norm(F.col("text")).alias("norm"))
    return D.sentences_held(made, corpus, "item_id", "doc_id")


@query(f"select doc_id, count(gram) as n_grams from documents left join {_grams_sql('documents', 'doc_id')} using (doc_id) group by 1")
def x4_gram_hashes(spark, d):
    """Distinct hashes of 8 words in order: as many as there are distinct grams."""
    hashes = F.array_distinct(T.gram_hashes(T.words(T.simple_norm(F.col("text")))))
    return table(spark, d, "documents").select("doc_id", F.size(hashes).cast("long").alias("n_grams"))
