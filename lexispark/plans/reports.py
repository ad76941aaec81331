"""Reports whose rules are whole: harm screens, exposure, rates, outcomes of choices, coverage of a split vocabulary, recordings of ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import respelling as Y
from ..functions import text as T
from ..operators import statistics as S
from ..operators import vocabulary as V
from .cleaned import DECIDED_SQL, _answers, _asked
from .core import letters, norm, query, split, table
from .core import ORACLE as _SQL
from .vocabularies import _phrases

_CELLS = "select {0} as grp, {1} as label_set, count(*) as aligned, count(*) filter (l_discount > 0.05) as original, count(*) filter (l_tax > 0.04) as cleaned from lineitem where l_returnflag <> 'N' or l_linenumber < 5 group by all"


@query(f"""with c as (select *, aligned >= 300 as judged, aligned >= 300 and original > cleaned as harm from (
{_CELLS.format("l_returnflag || l_linenumber", "l_linestatus")} union all {_CELLS.format("l_returnflag || l_linenumber", "'both'")}))
select grp as "group", label_set, aligned, original, cleaned, judged, harm, grp not like 'R%' and bool_or(harm) over (partition by grp) as disabled from c""")
def a40_harm_screen(spark, d):
    """Groups of edits by label set and pooled; a group that isn't exempt is disabled by any judged cell in which the original matches more often."""
    lines = table(spark, d, "lineitem").where("l_returnflag <> 'N' or l_linenumber < 5")
    lines = lines.select(F.concat("l_returnflag", "l_linenumber").alias("group"), F.col("l_linestatus").alias("label_set"), (F.col("l_discount") > 0.05).alias("o"), (F.col("l_tax") > 0.04).alias("c"))
    out = S.harm_screen(lines, "group", "label_set", "o", "c", 300, F.col("group").startswith("R"))
    return out.select("group", "label_set", "aligned", "original", "cleaned", "judged", "harm", "disabled")


@query("""with o as (select doc_id, lang, n_chars, row_number() over (order by sha256('exposure|' || doc_id), doc_id) - 1 as place from documents), t as (select doc_id, lang, n_chars, place + k * (select count(*) from documents) as tick from o, range(2) r(k) where k = 0 or doc_id % 3 = 0),
p as (select *, row_number() over (order by tick) - 1 as seq from t), b as (select seq // 32 as batch, max(n_chars) * count(*) as padded from p group by 1)
select lang, count(*) as presentations, cast(sum(n_chars) as bigint) as size, count(distinct doc_id) as unique_ids, (select cast(sum(padded) as bigint) from b) as padded from p group by lang""")
def a25_exposure(spark, d):
    """What a run of two passes, the second over a third of the documents, presents of each language, and what its batches of 32 pad to."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    tape = docs.withColumn("k", F.explode(F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return S.exposure(tape.withColumn("h", T.salted("exposure", "doc_id")), "lang", "doc_id", "n_chars", ["k", "h", "doc_id"], 32)


@query(f"""with t as (select lang, len({split(norm('text'))}) as tokens, n_chars / 15.0 as seconds from documents where n_chars > 0)
select lang, count(*) as clips, round(sum(tokens) / sum(seconds), 9) as tokens_per_second, round(avg(tokens / seconds), 9) as mean_rate, round(avg(case when tokens > floor(seconds * 2.5) then 1.0 else 0.0 end), 9) as over_frames from t group by lang""")
def a27_token_rates(spark, d):
    """Tokens a second as ratio of sums and as mean of ratios, and the share of clips with more tokens than nominal frames."""
    t = table(spark, d, "documents").where("n_chars > 0").select("lang", T.n_words(T.simple_norm(F.col("text"))).alias("tokens"), (F.col("n_chars") / 15.0).alias("seconds"))
    return S.token_rates(t, "lang", "tokens", "seconds", 2.5)


@query(f"""{DECIDED_SQL}
select lower(original) as member, count(*) as found, count(chosen) as chosen, count(*) filter (lower(chosen) <> lower(original)) as changed, count(*) filter (chosen is null and best = len(options)) as cant_tell, count(*) filter (chosen is null and best < len(options)) as below from decided group by 1""")
def a42_span_outcomes(spark, d):
    """By member: places found, decided, changed, left because the model can't tell or isn't sure enough."""
    asked = _asked(table(spark, d, "conversations"))
    best = F.array_position("probabilities", F.array_max("probabilities"))
    out = Y.decided(asked, _answers(asked)).join(_answers(asked).select("key", best.alias("best")), "key")
    return out.groupBy(F.lower("original").alias("member")).agg(
        F.count("*").alias("found"), F.count("chosen").alias("chosen"), F.count_if(F.lower("chosen") != F.lower("original")).alias("changed"),
        F.count_if(F.col("chosen").isNull() & (F.col("best") == F.size("options"))).alias("cant_tell"), F.count_if(F.col("chosen").isNull() & (F.col("best") < F.size("options"))).alias("below"),
    )


@query(f"""with s as ({_SQL["d7_phrase_groups"]}), w as (select lang, unnest({split(letters('text'))}) as phrase from documents)
select lang, side, count(*) as occurrences, count(distinct phrase) as phrases, sum(case when side = 'targeted' then count(*) else 0 end) over (partition by lang) < 100 as underpowered from w join s using (phrase) group by lang, side""")
def a43_split_coverage(spark, d):
    """Occurrences of a split vocabulary's words by language and side; languages with fewer than 100 targeted ones are underpowered."""
    terms = _phrases(spark, d).select(F.lit("all").alias("domain"), F.xxhash64("phrase").alias("position"), F.col("phrase").alias("term"))
    sides = V.split(terms, ["all"], share=0.75, salt="vocabulary", normal=lambda c: c).where("state = 'kept'").select("phrase", "side")
    w = table(spark, d, "documents").select("lang", F.explode(T.words(T.letters_norm(F.col("text")))).alias("phrase"))
    n = w.groupBy("lang", "phrase").agg(F.count("*").alias("n")).join(sides, "phrase").groupBy("lang", "side").agg(F.sum("n").alias("occurrences"), F.count("*").alias("phrases"))
    power = n.groupBy(F.col("lang").alias("l")).agg((F.sum(F.when(F.col("side") == "targeted", F.col("occurrences")).otherwise(0)) < 100).alias("underpowered"))
    return n.join(power, F.col("lang").eqNullSafe(F.col("l"))).drop("l")


_IDS = "['yodas-en:v_id_' || doc_id || '_1_2_3_4', 'librispeech:' || doc_id || '-7-0001', 'voxpopuli:' || doc_id || '_s_2', 'ami:A_' || doc_id || '_H_4_5', 'med-osce:' || doc_id || '-2', 'other:x_' || doc_id || '_9'][1 + doc_id % 6]"


@query(f"""select id, case doc_id % 6 when 0 then 'yodas-en:v_id_' || doc_id when 1 then 'librispeech:' || doc_id when 2 then 'voxpopuli:' || doc_id when 3 then 'ami:A_' || doc_id || '_H' when 4 then 'med-osce:' || doc_id else 'other:x_' || doc_id end as recording
from (select doc_id, {_IDS} as id from documents)""")
def x17_recordings(spark, d):
    """The recording of ids of six sources."""
    ids = F.expr("element_at(array(concat('yodas-en:v_id_', doc_id, '_1_2_3_4'), concat('librispeech:', doc_id, '-7-0001'), concat('voxpopuli:', doc_id, '_s_2'), concat('ami:A_', doc_id, '_H_4_5'), concat('med-osce:', doc_id, '-2'), concat('other:x_', doc_id, '_9')), cast(1 + doc_id % 6 as int))")
    return table(spark, d, "documents").select(ids.alias("id")).select("id", T.recording(F.col("id")).alias("recording"))
