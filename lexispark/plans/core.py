"""Queries over the test tables: each applies an operator to whole tables and stands beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import align
from ..functions import text as T
from ..operators import decontaminate as D
from ..operators import filters as R
from ..operators import gates as G
from ..operators import sequences as Q
from ..operators import statistics as S

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def norm(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9'' ]', ' ', 'g'), ' +', ' ', 'g'))"


def letters(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^a-z ]', ' ', 'g'), ' +', ' ', 'g'))"


def split(n: str) -> str:
    return f"[w for w in string_split({n}, ' ') if w <> '']"


WORDS_SQL = f"select doc_id, source, lang, {split(norm('text'))} as w from documents"


def words(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source", "lang", T.words(T.simple_norm(F.col("text"))).alias("w"))


# Scans


@query("select doc_id, source, n_chars from documents where n_chars >= 1000")
def sc1_projected_scan(spark, d):
    return table(spark, d, "documents").where("n_chars >= 1000").select("doc_id", "source", "n_chars")


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def sc5_listing_without_reserved(spark, d):
    return G.missing(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem)")
def sc7_unfinished_listing(spark, d):
    return G.missing(table(spark, d, "orders"), table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey")


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def x40_json_access(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


# Sinks: the identity of what is written


@query("select source, count(*) as n, cast(sum(cast('0x' || substr(md5(text), 1, 8) as bigint)) as bigint) as content from documents group by source")
def sk4_content_hash(spark, d):
    digest = F.conv(F.substring(F.md5("text"), 1, 8), 16, 10).cast("long")
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum(digest).alias("content"))


@query("select l_partkey, l_suppkey, count(*) as n from lineitem group by all having count(*) > 1")
def sk5_duplicate_ids(spark, d):
    return G.duplicates(table(spark, d, "lineitem"), "l_partkey", "l_suppkey")


_CHANGED = "case when doc_id in (select doc_id from labels where toxic = 1) then n_chars + 1 else n_chars end"


@query(f"""with a as (select doc_id, lang, source, n_chars from documents), b as (select doc_id, lang, source, {_CHANGED} as n_chars from documents)
select *, 'left' as side from (from a except all from b) union all select *, 'right' from (from b except all from a)""")
def sk7_freeze_difference(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    toxic = table(spark, d, "labels").where("toxic = 1").select("doc_id", F.lit(1).alias("more")).distinct()
    written = docs.join(toxic, "doc_id", "left").select("doc_id", "lang", "source", (F.col("n_chars") + F.coalesce("more", F.lit(0))).alias("n_chars"))
    return G.same_rows(docs, written)


@query(f"select doc_id, lang, source, n_chars, {norm('text')} as text from documents")
def sk8_refilter_copy(spark, d):
    return table(spark, d, "documents").withColumn("text", T.simple_norm(F.col("text")))


# Filters

_DROP = "case when l_quantity is null or isnan(l_quantity) or l_quantity <= 0 then 'empty_audio' when l_quantity < 2 then 'too_short' when l_quantity > 30 then 'too_long' end"


@query(f"select coalesce({_DROP}, 'kept') as reason, count(*) as n, sum(l_quantity) as size from lineitem group by 1")
def f1_duration_reasons(spark, d):
    df = table(spark, d, "lineitem").withColumn("reason", R.duration_drop_reason(F.col("l_quantity"), 2.0, 30.0))
    return R.funnel(df, size="l_quantity")


@query(f"""select l_linestatus, coalesce(reason, 'kept') as reason, count(*) as n from (select l_linestatus,
  coalesce(case when l_returnflag = 'R' then 'dropped' end, case when l_tax >= 0.08 then 'excluded' end, {_DROP},
    case when row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) > 1 then 'duplicate' end) as reason from lineitem) group by all""")
def f2_first_failing_reason(spark, d):
    q = R.duration_drop_reason(F.col("l_quantity"), 2.0, 30.0)
    reason = F.coalesce(
        R.first_reason({"dropped": F.col("l_returnflag") == "R", "excluded": F.col("l_tax") >= 0.08}), q,
        F.when(R.duplicate_of_earlier("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), "duplicate"),
    )
    return R.funnel(table(spark, d, "lineitem").withColumn("reason", reason), by=("l_linestatus",))


@query("""select array_to_string(reasons, ',') as reasons, len(reasons) = 0 as kept, count(*) as n from (select
  [x for x in [case when n_chars < 500 then 'short' end, case when lang <> 'en' then 'lang' end, case when quality = 0 then 'quality' end, case when quality is null then 'no_label' end] if x is not null] as reasons
  from documents left join labels using (doc_id)) group by all""")
def f3_all_failing_reasons(spark, d):
    df = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    reasons = R.all_reasons({"short": F.col("n_chars") < 500, "lang": F.col("lang") != "en", "quality": F.col("quality") == 0, "no_label": F.col("quality").isNull()})
    return df.groupBy(F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("kept")).agg(F.count("*").alias("n"))


@query("select o_orderkey from orders left join labels on o_orderkey = doc_id where coalesce(o_custkey / nullif(o_totalprice / 10000, 0) > 6, false) and not coalesce(quality <= 0.2, false)")
def f4_fast_speech(spark, d):
    df = table(spark, d, "orders").join(table(spark, d, "labels"), F.col("o_orderkey") == F.col("doc_id"), "left")
    return df.where(R.fast_speech(F.col("o_custkey"), F.col("o_totalprice") / 10000, F.col("quality"))).select("o_orderkey")


@query(f"""with lines as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents),
w as (select doc_id, line_no, {split(norm('line'))} as w from lines),
x as (select doc_id, line_no, unnest(w) as word, generate_subscripts(w, 1) as i from w),
runs as (select doc_id, line_no, count(*) as run from (select *, i - row_number() over (partition by doc_id, line_no, word order by i) as g from x) group by doc_id, line_no, word, g),
grams as (select doc_id, line_no, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select doc_id, line_no, w, unnest(range(1, len(w) - 1)) as i from w where len(w) between 3 and 30)),
often as (select doc_id, line_no from grams group by doc_id, line_no, g having count(*) >= 4)
select distinct doc_id, cast(line_no as bigint) as line_no from (select doc_id, line_no from runs where run >= 5 union all select * from often)""")
def f5_ngram_loop(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    w = T.words(T.simple_norm(F.col("line")))
    return lines.where(R.ngram_loop(w)).select("doc_id", F.col("line_no").cast("long").alias("line_no"))


@query("select doc_id, trim(regexp_replace(replace(translate(text, '‘’“”–— ', '''''\"\"-- '), '…', '...'), '[ \\t\\n]+', ' ', 'g')) as text from documents")
def f6_map_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.map_text(F.col("text")).alias("text"))


@query("select lang, count(*) as n, count(*) filter (regexp_full_match(text, '[ -~\\n]*')) as covered from documents group by lang")
def f7_coverage(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(T.covered(F.col("text"), "[ -~\\n]")).alias("covered"))


@query(f"""with x as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from ({WORDS_SQL})), n as (select doc_id, len(w) as size from ({WORDS_SQL})),
l as (select doc_id, i, word, {", ".join(f"lag(word, {k}) over o as l{k}" for k in range(1, 7))} from x window o as (partition by doc_id order by i)),
m as ({" union all ".join(f"select doc_id, i, {k} as n from l where word = l{k}" for k in range(1, 7))}),
r as (select doc_id, n, count(*) // n + 1 as copies from (select doc_id, n, i - row_number() over (partition by doc_id, n order by i) as g from m) group by doc_id, n, g),
b as (select doc_id, max(copies) as repeats, arg_min(n, (-copies, n)) as n from r where copies > 1 group by 1)
select doc_id, coalesce(repeats, least(size, 1))::int as repeats, coalesce(b.n, least(size, 1))::int as n from n left join b using (doc_id)""")
def f8_longest_repeat(spark, d):
    return words(spark, d).select("doc_id", align.longest_repeat("w").alias("r")).select("doc_id", "r.repeats", "r.n")


@query(f"""with x as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from ({WORDS_SQL})),
runs as (select doc_id, count(*) as run from (select *, i - row_number() over (partition by doc_id, word order by i) as g from x) group by doc_id, word, g),
best as (select doc_id, max(run) as run from runs group by doc_id)
select cast(coalesce(run, 0) as bigint) as run, count(*) as n from documents left join best using (doc_id) group by 1""")
def f9_repetition_histogram(spark, d):
    return words(spark, d).groupBy(R.equal_run(F.col("w")).cast("long").alias("run")).agg(F.count("*").alias("n"))


@query("select doc_id, case when toxic = 1 then null else n_chars end as n_chars from documents left join labels using (doc_id)")
def f10_reject_list(spark, d):
    bad = table(spark, d, "labels").where("toxic = 1").select("doc_id", F.lit(True).alias("no"))
    return table(spark, d, "documents").join(bad, "doc_id", "left").select("doc_id", F.when(F.col("no").isNull(), F.col("n_chars")).alias("n_chars"))


@query("""select source, count(*) as rows, count(*) filter (quality is not null) as labelled, count(*) filter (quality = 1) as good,
  count(*) filter (quality = 1 and toxic = 0) as selected from documents left join labels using (doc_id) group by source""")
def f11_selection_funnel(spark, d):
    df = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return df.groupBy("source").agg(F.count("*").alias("rows"), F.count("quality").alias("labelled"), F.count_if(F.expr("quality = 1")).alias("good"), F.count_if(F.expr("quality = 1 and toxic = 0")).alias("selected"))


@query("""with r as (select event_id, user_id, value, case when event_type = 'error' then 'type' when value < 5 then 'short' when value > 150 then 'long'
  when row_number() over (partition by user_id, event_type order by ts, event_id) > 20 then 'repeat' end as reason from events)
select coalesce(reason, 'kept') as reason, count(*) as clips, round(sum(value), 2) as size, count(distinct user_id) as speakers from r group by 1""")
def f12_stage_summary(spark, d):
    late = F.row_number().over(W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")) > 20
    reason = R.first_reason({"type": F.col("event_type") == "error", "short": F.col("value") < 5, "long": F.col("value") > 150, "repeat": late})
    df = table(spark, d, "events").withColumn("reason", reason)
    return df.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("clips"), F.round(F.sum("value"), 2).alias("size"), F.count_distinct("user_id").alias("speakers"))


@query(f"""with k as (select doc_id, source, {norm('text')} as a, {letters('text')} as b from documents),
held as (select distinct unnest([a, b]) as key from k where doc_id % 50 = 0)
select case when source = 'src3' then 'speaker' when l.doc_id is not null then 'clip' when a in (select key from held) or b in (select key from held) then 'sentence' else 'none' end as reason, count(*) as n
from k left join labels l on l.doc_id = k.doc_id and l.toxic = 1 group by 1""")
def f13_held_out_rule(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("speaker"), F.col("doc_id").alias("clip"), T.sentence_keys(F.col("text")).alias("keys"))
    held = docs.where("clip % 50 = 0").select(F.explode("keys").alias("key"))  # what is held out, by its rule
    speakers = spark.createDataFrame([("src3",)], "speaker string")
    out = R.held_out_reason(docs, speakers, table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("clip")), held)
    return out.groupBy(F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"select doc_id, {norm('text')} as first, len(list_distinct([{norm('text')}, {letters('text')}])) as n_keys from documents")
def f14_sentence_keys(spark, d):
    keys = T.sentence_keys(F.col("text"))
    return table(spark, d, "documents").select("doc_id", keys[0].alias("first"), F.size(keys).cast("long").alias("n_keys"))


@query("select distinct source, regexp_full_match(source, '[a-z]+[0-9]+') as safe from documents")
def f15_safe_names(spark, d):
    return table(spark, d, "documents").select("source", F.col("source").rlike("^(?:[a-z]+[0-9]+)$").alias("safe")).distinct()


@query("select l_returnflag, count(*) filter (l_discount <= 0.05) as kept, count(*) as n from lineitem group by 1")
def f16_confirmed(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_if(R.confirmed(F.col("l_discount"), 0.05)).alias("kept"), F.count("*").alias("n"))


@query("""select case when l_quantity <= 0 or l_quantity < 1 or l_quantity > 30 then 'duration' when l_returnflag = 'R' then 'hit_cap' when l_tax > 0.05 then 'wer' else 'kept' end as reason, count(*) as n from lineitem group by 1""")
def f17_round_trip(spark, d):
    reason = R.round_trip(F.col("l_linestatus"), F.col("l_tax"), F.col("l_returnflag") == "R", F.col("l_quantity"), 0.05)
    return R.funnel(table(spark, d, "lineitem").withColumn("reason", reason))


@query(f"""select doc_id, len(w) > 1.5 * len(v) + 10 as runaway, cast(least(len(w), greatest(cast(floor(len(v) * 0.5) as bigint) + 5, 0)) as bigint) as n_capped
from ({WORDS_SQL}) join (select doc_id + 1 as doc_id, w as v from ({WORDS_SQL})) using (doc_id)""")
def f19_runaway(spark, d):
    a, b = words(spark, d).select("doc_id", "w"), words(spark, d).select((F.col("doc_id") + 1).alias("doc_id"), F.size("w").alias("v"))
    capped = R.capped_by_duration(F.col("w"), F.col("v"), 0.5, 5)
    return a.join(b, "doc_id").select("doc_id", R.runaway(F.lit(0), F.col("v"), F.size("w")).alias("runaway"), F.size(capped).cast("long").alias("n_capped"))


@query(f"""select case when not regexp_full_match(line, '[A-Za-z0-9 .,;:''!?-]*') then 'characters' when n < 3 then 'too_short' when n > 60 then 'too_long' else 'kept' end as reason, count(*) as n
from (select line, len({split(norm('line'))}) as n from (select unnest(string_split(text, chr(10))) as line from documents)) group by 1""")
def f21_allowed_forms(spark, d):
    lines = table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    n = T.n_words(T.simple_norm(F.col("line")))
    reason = R.first_reason({"characters": ~T.covered(F.col("line"), "[A-Za-z0-9 .,;:'!?-]"), "too_short": n < 3, "too_long": n > 60})
    return R.funnel(lines.withColumn("reason", reason))


@query("select conv_id, turn, trim(regexp_replace(string_split(trim(text), chr(10))[1], '^[\"'']+|[\"'']+$', '', 'g')) as sentence from conversations")
def f22_extract_sentence(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.extract_sentence(F.col("text")).alias("sentence"))


@query("""select case when url like 'http://%' then 'licence' when html like '%robots%' then 'labels' else 'kept' end as reason, count(*) as n from pages group by 1""")
def f23_licence_ladder(spark, d):
    reason = R.first_reason({"licence": F.col("url").startswith("http://"), "labels": F.col("html").contains("robots")})
    return R.funnel(table(spark, d, "pages").withColumn("reason", reason))


# Joins

_UNITS = f"select item_id, unnest(list_distinct([array_to_string(w[i:i + 7], ' ') for i in range(1, len(w) - 6)])) as gram from (select item_id, {split(norm('text'))} as w from benchmark) where len(w) >= 8"
_GRAMS = f"select doc_id, unnest(list_distinct([array_to_string(w[i:i + 7], ' ') for i in range(1, len(w) - 6)])) as gram from ({WORDS_SQL}) where len(w) >= 8"
_FOUND = f"with h as ({_UNITS}), g as (select * from ({_GRAMS}) where gram in (select gram from h)), common as (select gram from g group by gram having count(*) > 100), u as (select * from h where gram not in (select gram from common))"
_HITS = "hits as (select doc_id, item_id, count(*) as matched, any_value(n) as n_grams from g join u using (gram) join (select item_id, count(*) as n from u group by item_id) using (item_id) group by doc_id, item_id having count(*) >= ceil(any_value(n) * 0.5))"


def _corpus(spark, d) -> tuple[DataFrame, DataFrame]:
    held = table(spark, d, "benchmark").select("item_id", T.simple_norm(F.col("text")).alias("norm"))
    return table(spark, d, "documents").select("doc_id", "source", T.simple_norm(F.col("text")).alias("norm")), held


@query(_FOUND + " select doc_id, count(*) as n from g group by doc_id")
def j1_gram_probe(spark, d):
    return D.probe(*_corpus(spark, d), "doc_id", "item_id")[1].groupBy("doc_id").agg(F.count("*").alias("n"))


@query(_FOUND + " select doc_id, item_id, count(*) as n from g join h using (gram) group by all")
def j2_gram_postings(spark, d):
    wanted, found = D.probe(*_corpus(spark, d), "doc_id", "item_id")
    return found.join(wanted, "gram").groupBy("doc_id", "item_id").agg(F.count("*").alias("n"))


@query("select doc_id, quality from documents left join labels using (doc_id)")
def j3_label_lookup(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", "quality")


@query("""select count(*) filter (m is null) as without_record, count(*) filter (n is null) as without_occurrence, count(*) filter (os <> rs) as wrong_source, count(*) filter (m > 1) as duplicate_records
from (select l_orderkey as k, min(l_linestatus) as os, count(*) as n from lineitem group by 1) full join (select o_orderkey as k, min(o_orderstatus) as rs, count(*) as m from orders group by 1) using (k)""")
def j4_completeness(spark, d):
    occ = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linestatus").alias("s"))
    return G.completeness(occ, table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s")), "k", "s")


@query("""with a as (select l_orderkey as k, l_linenumber as n, l_quantity, count(*) over (partition by l_orderkey, l_linenumber) as c from lineitem where l_linestatus = 'O'),
b as (select l_orderkey as k, l_linenumber as n, l_tax, count(*) over (partition by l_orderkey, l_linenumber) as c from lineitem where l_linestatus = 'F')
select a.k, a.n, l_quantity, l_tax from a join b on a.k = b.k and a.n = b.n where a.c = 1 and b.c = 1""")
def j5_unambiguous_pairs(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), "l_linestatus", "l_quantity", "l_tax")
    one = lambda s: lines.where(F.col("l_linestatus") == s).withColumn("c", F.count("*").over(W.partitionBy("k", "n"))).where("c = 1")
    return one("O").select("k", "n", "l_quantity").join(one("F").select("k", "n", "l_tax"), ["k", "n"])


@query("select case when l.doc_id is null then 'no_record' when toxic = 1 then 'held_out' when quality = 0 then 'rejected' else 'selected' end as reason, count(*) as n from documents left join labels l using (doc_id) group by 1")
def j6_pair_selection(spark, d):
    df = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    reason = F.when(F.col("toxic").isNull(), "no_record").when(F.col("toxic") == 1, "held_out").when(F.col("quality") == 0, "rejected").otherwise("selected")
    return df.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("select distinct l_suppkey as id from lineitem where l_partkey in (select l_partkey from lineitem where l_suppkey = 1)")
def j7_speaker_expansion(spark, d):
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_partkey")
    return lines.join(lines.where("l_suppkey = 1").select("l_partkey").distinct(), "l_partkey", "left_semi").select(F.col("l_suppkey").alias("id")).distinct()


@query("select o_custkey, count(*) filter (o_orderstatus = 'F') as f, count(*) filter (o_orderstatus = 'O') as o, count(*) filter (o_orderstatus = 'P') as p from orders group by 1 having f > 0 and o > 0 and p > 0")
def j8_aligned_models(spark, d):
    wide = table(spark, d, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).count().toDF("o_custkey", "f", "o", "p")
    return wide.dropna()


@query(_FOUND + " select distinct doc_id from g")
def j9_shared_gram(spark, d):
    return D.probe(*_corpus(spark, d), "doc_id", "item_id")[1].select("doc_id").distinct()


@query("select case when source not in ('src1', 'src2', 'src3') then 'not_included' when d.doc_id in (select doc_id from labels where toxic = 1) then 'excluded' else 'kept' end as reason, count(*) as n from documents d group by 1")
def j10_route_filter(spark, d):
    bad = table(spark, d, "labels").where("toxic = 1").select("doc_id", F.lit(True).alias("no"))
    df = table(spark, d, "documents").join(bad, "doc_id", "left")
    return R.funnel(df.withColumn("reason", R.first_reason({"not_included": ~F.col("source").isin("src1", "src2", "src3"), "excluded": F.coalesce("no", F.lit(False))})))


@query("""with t as (select page_id, regexp_replace(url, '^https?://', '') as unit from pages), r as (select regexp_extract(url, '^https?://([^/]*/[^/?]*)', 1) as u from pages where page_id % 7 = 0)
select distinct page_id from t join r on unit = u or starts_with(unit, u || '/')""")
def j11_leakage(spark, d):
    pages = table(spark, d, "pages")
    reserved = pages.where("page_id % 7 = 0").select(F.regexp_extract("url", "^https?://([^/]*/[^/?]*)", 1).alias("unit"))
    return G.leakage(pages.select("page_id", F.regexp_replace("url", "^https?://", "").alias("unit")), reserved).select("page_id")


_TOKENS = f"select distinct w as t from (select unnest({split(letters('text'))}) as w from benchmark) where length(w) >= 5"


@query(f"select a.t as a, b.t as b, levenshtein(a.t, b.t) as distance from ({_TOKENS}) a join ({_TOKENS}) b on substr(a.t, 1, 2) = substr(b.t, 1, 2) and a.t < b.t where levenshtein(a.t, b.t) <= 2")
def j13_confusable_pairs(spark, d):
    t = table(spark, d, "benchmark").select(F.explode(T.words(T.letters_norm(F.col("text")))).alias("t")).where("length(t) >= 5").distinct()
    t = t.withColumn("block", F.substring("t", 1, 2))
    pairs = t.alias("a").join(t.alias("b"), F.expr("a.block = b.block and a.t < b.t"))
    return pairs.select(F.col("a.t").alias("a"), F.col("b.t").alias("b"), F.expr("levenshtein(a.t, b.t, 2)").cast("long").alias("distance")).where("distance >= 0")


_STOP = "'the', 'and', 'for', 'with', 'from', 'are', 'into', 'over', 'under', 'per', 'via', 'its'"
_FOLDS = T.SOUND_FOLDS
_ENDS = "('s', 'es', 'ic', 'ics', 'ity', 'ities', 'al', 'ally', 'ly', 'ing', 'ed', 'er', 'ers', 'ation', 'ations', 'ion', 'ions', 'ive', 'ism', 'ist', 'ists', 'ness')"
#: The rule that two sound keys x and y meet, of which s is the shorter one's length; null for none.
_RULE = """case when x = y then 'same-sound' when s >= 3 and left(x, s) = left(y, s) and abs(length(x) - length(y)) between 1 and 3 then 'prefix'
when s >= 5 and left(x, greatest(5, cast(floor((7 * s + 9) / 10) as int))) = left(y, greatest(5, cast(floor((7 * s + 9) / 10) as int))) then 'shared-prefix'
when levenshtein(x, y) <= case when s <= 6 then 1 else 2 end then 'edit' end"""


def _inflected(short: str, long: str) -> str:
    stem = f"left({short}, length({short}) - 1)"
    return f"((left({long}, length({short})) = {short} and substr({long}, length({short}) + 1) in {_ENDS}) or (right({short}, 1) in ('e', 'y') and left({long}, length({short}) - 1) = {stem} and substr({long}, length({short})) in {_ENDS}))"


_UNINFLECTED = f"not case when length(a) <= length(b) then {_inflected('a', 'b')} else {_inflected('b', 'a')} end"


def _sound_key(fold, runs) -> str:
    """SQL of a token's sound key; RE2 has no back references, so runs of a letter are collapsed letter by letter."""
    key = "t"
    for old, new in _FOLDS:
        key = fold(key, old, new)
    return runs(key)


def _runs_by_letter(key: str) -> str:
    for c in "abcdefghijklmnopqrstuvwxyz":
        key = f"regexp_replace({key}, '{c}+', '{c}', 'g')"
    return key


_SOUNDS = f"""select t, {_sound_key(lambda k, a, b: f"replace({k}, '{a}', '{b}')", _runs_by_letter)} as k from (select distinct w as t from (select unnest({split(letters('text'))}) as w from benchmark)) where length(t) >= 3 and t not in ({_STOP})"""


@query(f"""with k as materialized ({_SOUNDS}), p as (select m.t as a, n.t as b, m.k as x, n.k as y, least(length(m.k), length(n.k)) as s from k m join k n on m.t < n.t)
select a, b, {_RULE} as rule from p where {_RULE} is not null and {_UNINFLECTED}""")
def j13_confusable_sounds(spark, d):
    t = table(spark, d, "benchmark").select(F.explode(T.words(T.letters_norm(F.col("text")))).alias("t")).where(f"length(t) >= 3 and t not in ({_STOP})").distinct()
    keys = t.withColumn("k", F.expr(_sound_key(lambda k, a, b: f"replace({k}, '{a}', '{b}')", lambda k: f"regexp_replace({k}, '(.)\\\\1+', '$1')")))
    less = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
    one = less(F.col("k"))
    two = F.when(F.length("k") >= 7, F.flatten(F.transform(one, less))).otherwise(F.array().cast("array<string>"))
    # Keys at an edit distance of n have a string in common after up to n letters are left out of each.
    near = keys.select("t", "k", F.explode(F.array_distinct(F.concat(F.array("k"), one, two))).alias("on"))
    begin = keys.select("t", "k", F.explode(F.expr("filter(array(k, left(k, length(k) - 1), left(k, length(k) - 2), left(k, length(k) - 3)), p -> length(p) >= 3)")).alias("on")).distinct()
    first = keys.where("length(k) >= 5").select("t", "k", F.expr("left(k, 5)").alias("on"))
    whole = keys.select("t", "k", F.col("k").alias("on"))
    met = [m.alias("m").join(n.alias("n"), F.expr("m.on = n.on and m.t <> n.t")).select(F.col("m.t").alias("u"), F.col("m.k").alias("ku"), F.col("n.t").alias("v"), F.col("n.k").alias("kv")) for m, n in ((near, near), (begin, whole), (first, first))]
    pairs = met[0].unionByName(met[1]).unionByName(met[2]).selectExpr("least(u, v) as a", "greatest(u, v) as b", "if(u < v, ku, kv) as x", "if(u < v, kv, ku) as y").distinct()
    pairs = pairs.withColumn("s", F.expr("least(length(x), length(y))"))
    return pairs.withColumn("rule", F.expr(_RULE)).where("rule is not null and " + _UNINFLECTED).select("a", "b", "rule")


@query("select key as k, event_type, count(*) as n from (select cast(json_extract(props, '$.k') as bigint) % 10 as key, event_type from events) group by all")
def j16_group_breakdown(spark, d):
    groups = table(spark, d, "events").select("event_type", F.create_map(F.lit("k"), F.from_json("props", "k long")["k"] % 10).alias("m"))
    return groups.select("event_type", F.explode("m").alias("kind", "k")).groupBy("k", "event_type").agg(F.count("*").alias("n"))


# Aggregations


@query(f"select source, count(*) as rows, cast(sum(n_chars) as bigint) as size, cast(sum(case when n_chars between 1000 and 3000 then n_chars else 0 end) as bigint) as size_kept, cast(sum(len(w)) as bigint) as words from documents join ({WORDS_SQL.replace('source, lang, ', '')}) using (doc_id) group by source")
def a1_recording_stats(spark, d):
    docs = table(spark, d, "documents").withColumn("w", T.n_words(T.simple_norm(F.col("text"))))
    kept = F.when(F.col("n_chars").between(1000, 3000), F.col("n_chars")).otherwise(0)
    return docs.groupBy("source").agg(F.count("*").alias("rows"), F.sum("n_chars").alias("size"), F.sum(kept).alias("size_kept"), F.sum("w").alias("words"))


@query("select l_orderkey, count(*) as rows, string_agg(distinct l_returnflag, ',' order by l_returnflag) as flags from lineitem group by 1")
def a2_locators(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("rows"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"))


@query(f"select conv_id, {norm('t')} as norm from (select conv_id, string_agg(text, ' ' order by turn) as t from conversations group by 1)")
def a3_ordered_concat(spark, d):
    return D.recordings(table(spark, d, "conversations"), "conv_id", "turn", "text")


@query(f"select df, count(*) as n from (select gram, count(*) as df from ({_GRAMS}) group by gram) where df > 1 group by df")
def a4_document_frequency(spark, d):
    chars = table(spark, d, "documents").agg(F.sum(F.length("text"))).first()[0] or 0
    return D.frequencies(_corpus(spark, d)[0], chars)


@query(_FOUND + ", " + _HITS + " select doc_id, item_id, matched, n_grams from hits")
def a5_contained(spark, d):
    return D.contained(*_corpus(spark, d), "doc_id", "item_id")


@query(_FOUND + ", " + _HITS + f""" select (select count(*) from benchmark) as checked, (select count(*) from benchmark where len({split(norm('text'))}) < 8) as skipped_short,
(select count(*) from benchmark where len({split(norm('text'))}) >= 8 and item_id not in (select item_id from u)) as skipped_empty,
(select count(distinct item_id) from hits) as contained, (select count(distinct doc_id) from hits) as recordings""")
def a6_denylist_report(spark, d):
    return D.report(*_corpus(spark, d), "doc_id", "item_id")


@query("select lang, count(*) as recordings, cast(sum(n_chars) as bigint) as words from documents where n_chars >= 1000 group by lang")
def a7_subset_summary(spark, d):
    return table(spark, d, "documents").where("n_chars >= 1000").groupBy("lang").agg(F.count("*").alias("recordings"), F.sum("n_chars").alias("words"))


@query("select round(sum(l_linenumber) / sum(l_quantity), 9) as wer from lineitem")
def a8_ratio_of_sums(spark, d):
    return table(spark, d, "lineitem").agg(F.round(F.try_divide(F.sum("l_linenumber"), F.sum("l_quantity")), 9).alias("wer"))


@query("select round(avg(r), 9) as macro, count(*) as sets from (select l_suppkey, sum(l_linenumber) / sum(l_quantity) as r from lineitem group by 1)")
def a9_mean_over_sets(spark, d):
    sets = table(spark, d, "lineitem").groupBy("l_suppkey").agg((F.sum("l_linenumber") / F.sum("l_quantity")).alias("r"))
    return sets.agg(F.round(F.avg("r"), 9).alias("macro"), F.count("*").alias("sets"))


@query("""select source, count(*) as occurrences, count(distinct doc_id) as ids, count(*) filter (quality = 0) as dropped, count(*) filter (quality = 0) <= 0.2 * count(*) as ok from documents join labels using (doc_id) group by source""")
def a10_drop_table(spark, d):
    df = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    dropped = F.count_if(F.expr("quality = 0"))
    return df.groupBy("source").agg(F.count("*").alias("occurrences"), F.count_distinct("doc_id").alias("ids"), dropped.alias("dropped"), (dropped <= 0.2 * F.count("*")).alias("ok"))


@query("select coalesce(case when n_chars < 500 then 'short' when n_chars > 5000 then 'long' end, 'kept') as reason, count(*) as n, cast(sum(n_chars) as bigint) as size from documents group by 1")
def a11_reason_counts(spark, d):
    return R.funnel(table(spark, d, "documents").withColumn("reason", R.first_reason({"short": F.col("n_chars") < 500, "long": F.col("n_chars") > 5000})), size="n_chars")


@query("select tag, count(*) as checked, round(avg(case when o_orderstatus = 'F' then 1.0 else 0.0 end), 9) as rate from (select unnest(string_split(o_orderpriority, '-')) as tag, o_orderstatus from orders) group by tag")
def a12_tag_rates(spark, d):
    tags = table(spark, d, "orders").select(F.explode(F.split("o_orderpriority", "-")).alias("tag"), "o_orderstatus")
    return tags.groupBy("tag").agg(F.count("*").alias("checked"), F.round(F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)), 9).alias("rate"))


@query("""with a as (select user_id % 5 as g, event_type as e, count(*) filter (value < 50) as x, count(*) filter (value >= 50) as y from events group by all)
select g, cast(sum(least(x, y)) as bigint) as both, cast(sum(greatest(x - y, 0)) as bigint) as only_x, cast(sum(greatest(y - x, 0)) as bigint) as only_y from a group by g""")
def a13_multiset_sizes(spark, d):
    n = table(spark, d, "events").groupBy((F.col("user_id") % 5).alias("g"), "event_type").agg(F.count_if(F.expr("value < 50")).alias("x"), F.count_if(F.expr("value >= 50")).alias("y"))
    return n.groupBy("g").agg(F.sum(F.least("x", "y")).alias("both"), F.sum(F.greatest(F.col("x") - F.col("y"), F.lit(0))).alias("only_x"), F.sum(F.greatest(F.col("y") - F.col("x"), F.lit(0))).alias("only_y"))


@query("select l_returnflag, round(sum(l_tax) / nullif(sum(l_quantity), 0), 9) as rate, round(sum(case when l_tax > 1 then 1 else 0 end) / nullif(sum(case when l_tax > 1 then l_quantity else 0 end), 0), 9) as none from lineitem group by 1")
def a14_metric_sums(spark, d):
    high = F.when(F.col("l_tax") > 1, F.col("l_quantity")).otherwise(0.0)
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.try_divide(F.sum("l_tax"), F.sum("l_quantity")), 9).alias("rate"), F.round(F.try_divide(F.count_if(F.expr("l_tax > 1")), F.sum(high)), 9).alias("none"))


@query("""with m as (select l_orderkey as id, l_linenumber as m, min(l_returnflag) as hyp from lineitem where l_linenumber <= 3 group by all)
select a.m as a, b.m as b, count(*) as n, count(*) filter (a.hyp = b.hyp) as agree from m a join m b on a.id = b.id and a.m < b.m group by all""")
def a15_agreement(spark, d):
    m = table(spark, d, "lineitem").where("l_linenumber <= 3").groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("m")).agg(F.min("l_returnflag").alias("hyp"))
    pairs = m.alias("a").join(m.alias("b"), F.expr("a.id = b.id and a.m < b.m"))
    return pairs.groupBy(F.col("a.m").alias("a"), F.col("b.m").alias("b")).agg(F.count("*").alias("n"), F.count_if(F.expr("a.hyp = b.hyp")).alias("agree"))


@query("""with m as (select l_orderkey as id, min(l_returnflag) filter (l_linenumber = 1) as x, min(l_returnflag) filter (l_linenumber = 2) as y, min(l_returnflag) filter (l_linenumber = 3) as z from lineitem group by 1)
select id, case when y = z then y else x end as vote from m where x is not null and y is not null and z is not null""")
def a16_majority_vote(spark, d):
    wide = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).pivot("l_linenumber", [1, 2, 3]).agg(F.min("l_returnflag")).toDF("id", "x", "y", "z").dropna()
    return wide.select("id", F.when(F.col("y") == F.col("z"), F.col("y")).otherwise(F.col("x")).alias("vote"))


@query("select lang, round(avg(case when regexp_matches(text, '[.,;:!?]') then 1.0 else 0.0 end), 9) as punctuated, round(avg(case when regexp_matches(text, '[A-Z]') then 1.0 else 0.0 end), 9) as upper from documents group by lang")
def a17_style_rates(spark, d):
    share = lambda p: F.round(F.avg(F.when(F.col("text").rlike(p), 1.0).otherwise(0.0)), 9)
    return table(spark, d, "documents").groupBy("lang").agg(share("[.,;:!?]").alias("punctuated"), share("[A-Z]").alias("upper"))


@query("select count(*) as n, round(avg(case when n_chars > 0 then 1.0 else 0.0 end), 9) as share from documents where doc_id not in (select doc_id from labels)")
def a18_excluded_output(spark, d):
    df = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti")
    return df.agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("n_chars") > 0, 1.0).otherwise(0.0)), 9).alias("share"))


@query("select source, count(*) as occurrences, count(*) filter (quality = 1) as reproduced, round(count(*) filter (quality = 1) / nullif(count(*), 0), 9) as recall from documents join labels using (doc_id) group by rollup (source)")
def a19_term_recall(spark, d):
    df = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    good = F.count_if(F.expr("quality = 1"))
    return df.rollup("source").agg(F.count("*").alias("occurrences"), good.alias("reproduced"), F.round(F.try_divide(good, F.count("*")), 9).alias("recall"))


@query("select l_suppkey, count(*) filter (l_returnflag = 'A') as a, count(*) filter (l_returnflag = 'N') as n, count(*) filter (l_returnflag = 'R') as r, count(*) filter (l_returnflag = 'A') - count(*) filter (l_returnflag = 'N') as delta from lineitem group by 1")
def a20_error_profile(spark, d):
    wide = table(spark, d, "lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).count().na.fill(0).toDF("l_suppkey", "a", "n", "r")
    return wide.withColumn("delta", F.col("a") - F.col("n"))


@query(f"select word, count(*) as n from (select unnest({split(letters('text'))}) as word from documents) group by word")
def a24_word_counts(spark, d):
    return table(spark, d, "documents").select(F.explode(T.words(T.letters_norm(F.col("text")))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("select event_type, count(*) as presentations, round(sum(value), 2) as size, count(distinct user_id) as ids, least(count(distinct user_id), 300) as recordings from events group by 1")
def a25_exposure(spark, d):
    ids = F.count_distinct("user_id")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("presentations"), F.round(F.sum("value"), 2).alias("size"), ids.alias("ids"), F.least(ids, F.lit(300)).alias("recordings"))


@query("select floor(count(*) / count(distinct user_id) + 0.5)::bigint as mean_occurrences, round(avg(value / (event_id % 7 + 1)), 6) as mean_of_ratios, round(sum(value) / sum(event_id % 7 + 1), 6) as ratio_of_means from events")
def a26_means(spark, d):
    k = F.col("event_id") % 7 + 1
    return table(spark, d, "events").agg(F.floor(F.count("*") / F.count_distinct("user_id") + 0.5).alias("mean_occurrences"), F.round(F.avg(F.col("value") / k), 6).alias("mean_of_ratios"), F.round(F.sum("value") / F.sum(k), 6).alias("ratio_of_means"))


@query("""with s as (select n_chars as s, count(*) filter (toxic = 1) as p, count(*) filter (toxic <> 1) as n from documents join labels using (doc_id) group by 1),
r as (select *, coalesce(sum(n) over (order by s rows between unbounded preceding and 1 preceding), 0) as below from s)
select round(sum(p * (below + n / 2)) / nullif(sum(p) * sum(n), 0), 9) as auroc from r""")
def a28_auroc(spark, d):
    df = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return S.auroc(df, "n_chars", "toxic").select(F.round("auroc", 9).alias("auroc"))


@query("select round(avg(case when toxic = 1 then case when n_chars < 2000 then 1.0 else 0.0 end end), 9) as fnr, round(avg(case when toxic = 0 then case when n_chars >= 2000 then 1.0 else 0.0 end end), 9) as fpr from documents join labels using (doc_id)")
def a29_error_rates(spark, d):
    df = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    low = F.col("n_chars") < 2000
    return df.agg(F.round(F.avg(F.when(F.col("toxic") == 1, low.cast("double"))), 9).alias("fnr"), F.round(F.avg(F.when(F.col("toxic") == 0, (~low).cast("double"))), 9).alias("fpr"))


@query("select doc_id, len(regexp_extract_all(text, 'the')) as ref, len(regexp_extract_all(text, 'and')) as hyp, least(len(regexp_extract_all(text, 'the')), len(regexp_extract_all(text, 'and'))) as both from documents")
def a30_lexical_terms(spark, d):
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return table(spark, d, "documents").select("doc_id", n("the").alias("ref"), n("and").alias("hyp"), F.least(n("the"), n("and")).alias("both"))


@query("select cast(sum(levenshtein(a.c_name, b.c_name)) as bigint) as edits, cast(sum(length(b.c_name)) as bigint) as chars, count(*) filter (a.c_name = '') as empty from customer a join customer b on a.c_custkey = b.c_custkey + 1")
def a31_character_errors(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    pairs = c.join(c.select((F.col("c_custkey") + 1).alias("c_custkey"), F.col("c_name").alias("ref")), "c_custkey")
    return pairs.agg(F.sum(F.levenshtein("c_name", "ref").cast("long")).alias("edits"), F.sum(F.length("ref").cast("long")).alias("chars"), F.count_if(F.col("c_name") == "").alias("empty"))


@query("""select user_id, round(sum(p), 3) as integral, count(*) as n from (select user_id, (epoch_us(ts) - lag(epoch_us(ts)) over w) / 1e6 * (value + lag(value) over w) / 2 as p from events window w as (partition by user_id order by ts)) group by 1""")
def a32_trapezoid(spark, d):
    ev = table(spark, d, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "value")
    return S.trapezoid(ev, "t", "value", "user_id").select("user_id", F.round("integral", 3).alias("integral"), "n")


@query("""with p as (select s_suppkey as k, count(*) as a, sum(l_quantity) as b, max(l_tax) as c from supplier join lineitem on s_suppkey = l_suppkey group by 1)
select k from p where not exists (select 1 from p q where q.a >= p.a and q.b >= p.b and q.c >= p.c and (q.a > p.a or q.b > p.b or q.c > p.c))""")
def a33_pareto(spark, d):
    p = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("a"), F.sum("l_quantity").alias("b"), F.max("l_tax").alias("c"))
    return S.pareto(p, "k", "a", "b", "c")


@query("select source, sha256(string_agg(cast(doc_id as varchar), chr(10) order by doc_id)) as identity from documents group by source")
def a34_set_identity(spark, d):
    return S.set_identity(table(spark, d, "documents"), "source", "doc_id")


@query("select count(distinct text) as contents, (select cast(sum(n) as bigint) from (select max(n_chars) as n from documents group by text)) as size from documents")
def a35_content_ledger(spark, d):
    by = table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.max("n_chars").alias("n"))
    return by.agg(F.count("*").alias("contents"), F.sum("n").alias("size"))


@query("select l_suppkey, l_returnflag, cast(sum(l_quantity) as bigint) as words, cast(sum(l_linenumber) as bigint) as errors from lineitem group by all")
def a37_clusters(spark, d):
    table_ = S.clusters(table(spark, d, "lineitem"), "l_suppkey", "l_returnflag", "l_quantity", errors="l_linenumber")
    return table_.withColumn("words", F.col("words").cast("long"))


@query("select doc_id, n_chars from documents order by n_chars desc, doc_id limit 25")
def a38_top_list(spark, d):
    return table(spark, d, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(25)


@query("select vec_id, len(embedding) as n, round(list_avg([cast(x as double) for x in embedding]), 6) as mean, round(cast(list_min(embedding) as double), 6) as least from embeddings")
def a39_array_stats(spark, d):
    e = F.col("embedding")
    mean = F.aggregate(e, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(e)
    return table(spark, d, "embeddings").select("vec_id", F.size(e).cast("long").alias("n"), F.round(mean, 6).alias("mean"), F.round(F.array_min(e).cast("double"), 6).alias("least"))


@query("select l_returnflag, coalesce(l_linestatus, 'both') as label_set, count(*) as n from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_returnflag)) having count(*) >= 5")
def a40_harm_cells(spark, d):
    out = table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping_id().alias("level")).where("level < 3")
    return out.where("n >= 5").select("l_returnflag", F.coalesce("l_linestatus", F.lit("both")).alias("label_set"), "n")


@query("select source, lang as canonical from (select source, lang, row_number() over (partition by source order by count(*) desc, lang) as r from documents group by source, lang) where r = 1")
def a41_canonical_form(spark, d):
    n = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return n.groupBy("source").agg(F.min_by("lang", F.struct(-F.col("n"), "lang")).alias("canonical"))


@query("select label, count(*) as found, count(*) filter (list_max(embedding) >= 0.3) as chosen, count(*) filter (list_position(embedding, list_max(embedding)) = 1) as first from embeddings group by label")
def a42_choice_outcomes(spark, d):
    e, top = F.col("embedding"), F.array_max("embedding")
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("found"), F.count_if(top.cast("double") >= 0.3).alias("chosen"), F.count_if(F.array_position(e, top) == 1).alias("first"))


@query("select lang, count(*) as n, count(distinct source) as phrases, count(*) < 100 as underpowered from documents group by lang")
def a43_coverage(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("source").alias("phrases"), (F.count("*") < 100).alias("underpowered"))


@query("select round(avg(l_quantity), 9) as mean from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'F') and l_quantity between 1 and 30")
def a44_subset_mean(spark, d):
    of = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").join(of, "l_orderkey", "left_semi").where("l_quantity between 1 and 30").agg(F.round(F.avg("l_quantity"), 9).alias("mean"))


@query("select count(*) as n, count(*) filter (a.label <> b.label) as different, greatest(3, cast(ceil(0.01 * count(*)) as bigint)) as allowance from embeddings a join embeddings b on a.vec_id + 1 = b.vec_id where a.label > 1 and b.label > 1")
def a45_two_runs(spark, d):
    a = table(spark, d, "embeddings").select("vec_id", "label")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("other"))
    return a.join(b, "vec_id").where("label > 1 and other > 1").agg(F.count("*").alias("n"), F.count_if(F.expr("label <> other")).alias("different"), F.greatest(F.lit(3), F.ceil(0.01 * F.count("*"))).alias("allowance"))


@query("select a.vec_id, a.embedding = b.embedding as same, round(list_max([abs(cast(a.embedding[i] as double) - cast(b.embedding[i] as double)) for i in range(1, len(a.embedding) + 1)]), 6) as largest from embeddings a join embeddings b on a.vec_id + 1 = b.vec_id")
def a46_array_difference(spark, d):
    a = table(spark, d, "embeddings").select("vec_id", "embedding")
    both = a.join(a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    gap = F.zip_with("embedding", "other", lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return both.select("vec_id", (F.col("embedding") == F.col("other")).alias("same"), F.round(F.array_max(gap), 6).alias("largest"))


# Resampling


@query()
def b1_paired_bootstrap(spark, d):
    lines = table(spark, d, "lineitem").withColumn("x", F.floor(F.col("l_tax") * 100)).withColumn("y", F.floor(F.col("l_discount") * 100))
    return S.paired_bootstrap(S.clusters(lines, "l_returnflag", "l_suppkey", "l_quantity", a="x", b="y"), "l_returnflag", "l_suppkey", "a", "b")


@query("select case when sum(l_tax) < sum(l_discount) then 'better' when sum(l_tax) = sum(l_discount) then 'tie' else 'worse' end as decision from lineitem")
def b7_decision(spark, d):
    a, b = F.sum("l_tax"), F.sum("l_discount")
    return table(spark, d, "lineitem").agg(F.when(a < b, "better").when(a == b, "tie").otherwise("worse").alias("decision"))
