"""Queries of cleaning rules on turns and documents in which some words are made compact or spelled out by place."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import distance
from ..functions import respelling as Y
from .core import query, table
from .transcripts import RATE_SQL, _pairs


def _spelled(text):
    """Every third of the short ASCII words in capitals, every third as single letters."""
    plain = lambda w: w.rlike("^[A-Za-z]{3,4}$")
    word = lambda w, i: F.when(plain(w) & (i % 3 == 0), F.upper(w)).when(plain(w) & (i % 3 == 1), F.array_join(F.split(F.upper(w), ""), " ")).otherwise(w)
    return F.array_join(F.transform(F.split(text, " "), word), " ")


_FORMS = [("variants", "per cent", "percent"), ("forms", "on the", "on-the"), ("dialect", "gonna", "going to"), ("forms", "usa", "USA")]
_SETS = {"the": ["the", "thee*", "ye*"], "la": ["la", "le*"], "de": ["de", "du"]}
_RULES = {"forms": _FORMS, "sets": _SETS, "units": {"milligrams": "mg", "mg": "mg", "words": "w", "w": "w"}, "before": ["spelled"], "after": ["dot com"]}


def _lexicon(spark, d) -> dict:
    docs = table(spark, d, "documents").select("doc_id", _spelled(F.col("text")).alias("text"))
    return Y.lexicon_of(Y.acronym_counts(docs, "text", "doc_id"))


@query()
def a23_acronym_counts(spark, d):
    """How often letters are written as an acronym and spelled out, and in how many documents."""
    docs = table(spark, d, "documents").select("doc_id", _spelled(F.col("text")).alias("text"))
    return Y.acronym_counts(docs, "text", "doc_id")


@query()
def x20_spelled_acronyms(spark, d):
    """Spelled-out capitals of documents made compact."""
    rules = Y.Rules(forms=_FORMS)
    docs = table(spark, d, "documents").select("doc_id", _spelled(F.col("text")).alias("text"))
    return docs.select("doc_id", Y._counted(rules.acronyms, 1)("text").alias("x")).select("doc_id", "x.*")


@query()
def x21_letter_runs(spark, d):
    """The class of every run of single letters in the documents, judged with the documents' own lexicon."""
    docs = table(spark, d, "documents").select("doc_id", _spelled(F.col("text")).alias("text"))
    runs = docs.select("doc_id", F.explode(Y.judge(Y.Rules(**_RULES, lexicon=_lexicon(spark, d)))("text")).alias("r"))
    return runs.select("doc_id", "r.*")


@query("select doc_id, concat_ws(' ', cast(n_chars as varchar), 'mg/w', text) as text, 1::int as edits from documents")
def x22_unit_forms(spark, d):
    """Units behind numbers: each text's own length, said in front of it."""
    said = F.concat_ws(" ", F.col("n_chars").cast("string"), F.lit("milligrams per words"), "text")
    return table(spark, d, "documents").select("doc_id", Y._counted(Y.Rules(units=_RULES["units"]).dose_units, 1)(said).alias("x")).select("doc_id", "x.*")


# Spans, answers and decisions: answers are stored once for each key; here they are made from the key's own digits

_WEIGHTS = 4


def _answers(asked):
    weight = lambda i: F.pow(F.conv(F.substring("key", 1 + 2 * i, 2), 16, 10).cast("double"), F.lit(float(_WEIGHTS)))
    options = F.transform(F.sequence(F.lit(0), F.size("options") - 1), lambda i: F.element_at(F.array(*(weight(k) for k in range(8))), i + 1))
    return asked.select("key", options.alias("probabilities")).dropDuplicates(["key"])


def _asked(turns):
    turns = turns.select("conv_id", "turn", "text", F.explode(Y.spans(Y.Rules(sets=_SETS))("text")).alias("s")).select("conv_id", "turn", "text", "s.*")
    return turns.withColumn("key", Y.prompt_key("spelling", F.col("text"), F.col("start"), F.col("end"), F.col("options")))


_OFFERS = " ".join(f"when '{m}' then {[x.removesuffix('*') for x in ms] + ['cant']}" for ms in _SETS.values() for m in ms if not m.endswith("*")).replace("'cant'", "'can''t tell'")


DECIDED_SQL = f"""with t as (select conv_id, turn, text, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+(?:[''.][\\p{{L}}\\p{{N}}]+)*|[^\\p{{L}}\\p{{N}}]+') as tokens from conversations),
u as (select conv_id, turn, text, unnest(tokens) as token, generate_subscripts(tokens, 1) as i from t),
p as (select *, coalesce(sum(length(token)) over (partition by conv_id, turn order by i rows between unbounded preceding and 1 preceding), 0)::int as start from u),
o as (select conv_id, turn, text, start, start + length(token)::int as stop, token as original, case lower(token) {_OFFERS} end as options from p where lower(token) in ('the', 'la', 'de', 'du')),
k as (select *, sha256(concat_ws(chr(31), 'spelling', text, start::varchar, stop::varchar, array_to_string(options, chr(31)))) as key from o),
w as (select *, list_transform(range(len(options)), lambda i: pow(('0x' || substr(key, 1 + 2 * i::int, 2))::int::double, {_WEIGHTS})) as p from k),
decided as (select *, list_position(p, list_max(p)) as best, case when list_sum(p) > 0 and list_position(p, list_max(p)) < len(options) and list_max(p) / list_sum(p) >= 0.9 then options[list_position(p, list_max(p))] end as chosen from w)"""


@query(f"{DECIDED_SQL} select conv_id, turn, start, stop, original, key, chosen from decided")
def x24_span_decisions(spark, d):
    """Places where a spelling is open, and what the stored answers decide for them."""
    asked = _asked(table(spark, d, "conversations"))
    return Y.decided(asked, _answers(asked)).select("conv_id", "turn", "start", F.col("end").alias("stop"), "original", "key", "chosen")


@query()
def x25_clean(spark, d):
    """Turns without marks, words partly spelled out, cleaned in all layers: decided spellings, the turn's own marks, letters, units, tables."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", _spelled(F.col("text")).alias("donor"))
    turns = turns.withColumn("text", F.regexp_replace("donor", "[.,?!:;]", ""))
    asked = _asked(turns)
    picked = Y.decided(asked, _answers(asked)).select("conv_id", "turn", "start", "end", "original", "set", "chosen")
    by_turn = picked.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("start", "end", "original", "set", "chosen"))).alias("choices"))
    turns = turns.join(by_turn, ["conv_id", "turn"], "left")
    out = turns.select("conv_id", "turn", Y.cleaner(Y.Rules(**_RULES, lexicon=_lexicon(spark, d)))("text", "donor", F.coalesce("choices", F.array())).alias("x"))
    return out.select("conv_id", "turn", "x.text", F.size("x.edits").alias("n_edits"))


@query(f"with recursive {RATE_SQL} select conv_id, turn, errors as distance from e")
def x10_word_distance(spark, d):
    """Words by which a turn and the next differ, in bulk."""
    return _pairs(spark, d).select("conv_id", "turn", distance.word_distance("ref", "hyp").alias("distance"))
