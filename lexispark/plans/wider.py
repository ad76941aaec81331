"""Further queries over the test tables, each beside its DuckDB SQL: plans, bootstraps, series, identities, text rules."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import alike as A
from ..operators import sequences as Q
from ..operators import statistics as S
from .core import letters, norm, query, split, table

# Aggregates


@query("""with b as (select doc_id // 16 as batch, count(*) as n, max(n_chars) as most, sum(n_chars) as total from documents group by 1)
select cast(sum(total) as bigint) as size, cast(sum(n * most) as bigint) as padded, min(n) as least_rows, max(n) as most_rows from b""")
def a22_padding(spark, d):
    b = table(spark, d, "documents").groupBy(F.expr("doc_id div 16")).agg(F.count("*").alias("n"), F.max("n_chars").alias("most"), F.sum("n_chars").alias("total"))
    return b.agg(F.sum("total").alias("size"), F.sum(F.col("n") * F.col("most")).alias("padded"), F.min("n").alias("least_rows"), F.max("n").alias("most_rows"))


_TOKENS = "[A-Za-z]+"


@query(f"""select lower(w) as form, count(*) filter (w = upper(w)) as compact, count(*) filter (w <> upper(w)) as spelled, least(count(distinct doc_id), 300) as documents
from (select doc_id, unnest(regexp_extract_all(text, '{_TOKENS}')) as w from documents) group by 1 having count(*) filter (w = upper(w)) > 0""")
def a23_lexicon(spark, d):
    w = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_TOKENS), F.lit(0))).alias("w"))
    w = w.select("doc_id", F.lower("w").alias("form"), (F.col("w") == F.upper("w")).cast("long").alias("up"))
    by_doc = w.groupBy("form", "doc_id").agg(F.sum("up").alias("up"), F.count("*").alias("n"))  # documents are counted without a distinct set
    out = by_doc.groupBy("form").agg(F.sum("up").alias("compact"), (F.sum("n") - F.sum("up")).alias("spelled"), F.least(F.count("*"), F.lit(300).cast("long")).alias("documents"))
    return out.where("compact > 0")


_REASON = "case when text is null or text = '' then 'empty' when n_chars < 200 then 'too_short' when n_chars > 20000 then 'too_long' else 'kept' end"


@query(f"select source, {_REASON} as reason, count(*) as n from documents group by all")
def a36_stream_counters(spark, d):
    return table(spark, d, "documents").groupBy("source", F.expr(_REASON).alias("reason")).agg(F.count("*").alias("n"))


@query("""select doc_id, case when n_chars is null or text is null then 'undecodable' when n_chars = 0 then 'empty' when n_chars > 50000 then 'oversize' else 'ok' end as state,
avg(case when n_chars between 1 and 50000 then 0.0 else 1.0 end) over (partition by source) > 0.5 as tripped from documents""")
def f20_row_acceptance(spark, d):
    state = F.expr("case when n_chars is null or text is null then 'undecodable' when n_chars = 0 then 'empty' when n_chars > 50000 then 'oversize' else 'ok' end")
    docs = table(spark, d, "documents").select("doc_id", "source", state.alias("state"))
    rates = docs.groupBy("source").agg((F.avg(F.when(F.col("state") == "ok", 0.0).otherwise(1.0)) > 0.5).alias("tripped"))
    return docs.join(rates, "source").select("doc_id", "state", "tripped")


# Bootstraps: a unit's weight in a replicate is a Poisson draw by hash, so replicates are sums without any resampling join

REPLICATES = 200
_DRAW = S.poisson_sql


def _interval(stat, low=0.05, high=0.95):
    return [F.round(F.percentile(stat, F.lit(q)), 9).alias(n) for q, n in ((low, "low"), (high, "high"))]


_UNITS = "select l_orderkey as unit, cast(sum(l_quantity) as double) as words, cast(sum(l_linenumber) as double) as errors, cast(sum(l_linenumber * (l_linenumber % 2)) as double) as other from lineitem group by 1"
_DRAWN = f"drawn as (select u.*, r.rep, {_DRAW('unit', 'rep', 'duck')} as k from ({_UNITS}) u, (select unnest(range({REPLICATES})) as rep) r)"


def _units(spark, d):
    part = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("unit"))
    units = part.agg(F.sum("l_quantity").cast("double").alias("words"), F.sum("l_linenumber").cast("double").alias("errors"), F.sum(F.expr("l_linenumber * (l_linenumber % 2)")).cast("double").alias("other"))
    return S.poisson_drawn(units, "unit", REPLICATES)


@query(f"""with {_DRAWN}, s as (select rep, sum(k * errors) / sum(k * words) as x, sum(k * other) / sum(k * words) as y from drawn group by rep)
select 'errors' as name, round(quantile_cont(x, 0.05), 9) as low, round(quantile_cont(x, 0.95), 9) as high from s
union all select 'other', round(quantile_cont(y, 0.05), 9), round(quantile_cont(y, 0.95), 9) from s""")
def b3_utterance_bootstrap(spark, d):
    s = _units(spark, d).groupBy("rep").agg(*((F.sum(F.col("k") * F.col(c)) / F.sum(F.col("k") * F.col("words"))).alias(c) for c in ("errors", "other")))
    long = s.select("rep", F.explode(F.map_from_arrays(F.array(F.lit("errors"), F.lit("other")), F.array("errors", "other"))).alias("name", "x"))
    return long.groupBy("name").agg(*_interval("x"))


@query(f"""with u as (select s_suppkey as unit, s_nationkey as part, s_suppkey % 3 as found, s_suppkey % 2 as asked from supplier),
drawn as (select u.*, r.rep, {_DRAW("unit", "rep", "duck")} as k from u, (select unnest(range({REPLICATES})) as rep) r),
s as (select part, rep, sum(k * found) / nullif(sum(k * asked), 0) as x from drawn group by all)
select part, count(x) as finite, round(quantile_cont(x, 0.05), 9) as low, round(quantile_cont(x, 0.95), 9) as high from s group by part""")
def b4_recall_ratio_bootstrap(spark, d):
    u = table(spark, d, "supplier").selectExpr("s_suppkey as unit", "s_nationkey as part", "s_suppkey % 3 as found", "s_suppkey % 2 as asked")
    s = S.poisson_drawn(u, "unit", REPLICATES).groupBy("part", "rep").agg(F.try_divide(F.sum(F.expr("k * found")), F.sum(F.expr("k * asked"))).alias("x"))
    return s.groupBy("part").agg(F.count("x").alias("finite"), *_interval("x"))


@query(f"""with m as (select l_returnflag as model, l_suppkey as unit, cast(count(*) as double) as n, cast(count(*) filter (l_tax > 0.04) as double) as bad from lineitem group by all),
drawn as (select m.*, r.rep, {_DRAW("unit", "rep", "duck")} as k from m, (select unnest(range({REPLICATES})) as rep) r),
s as (select model, rep, sum(k * bad) / nullif(sum(k * n), 0) as x from drawn group by all)
select model, round(quantile_cont(x, 0.05), 9) as low, round(quantile_cont(x, 0.95), 9) as high from s group by model""")
def b5_variant_bootstrap(spark, d):
    m = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("model"), F.col("l_suppkey").alias("unit")).agg(F.count("*").cast("double").alias("n"), F.count_if(F.expr("l_tax > 0.04")).cast("double").alias("bad"))
    s = S.poisson_drawn(m, "unit", REPLICATES).groupBy("model", "rep").agg(F.try_divide(F.sum(F.expr("k * bad")), F.sum(F.expr("k * n"))).alias("x"))
    return s.groupBy("model").agg(*_interval("x"))


@query(f"""with c as (select c_nationkey % 7 as part, c_nationkey as unit, avg(c_acctbal) as x from customer where c_nationkey < 20 group by all),
drawn as (select c.*, r.rep, {_DRAW("unit", "rep", "duck")} as k from c, (select unnest(range({REPLICATES})) as rep) r),
s as (select part, rep, sum(k * x) / nullif(sum(k), 0) as m from drawn group by all)
select part, n as clusters, case when n > 1 then round(quantile_cont(m, 0.05), 6) end as low, case when n > 1 then round(quantile_cont(m, 0.95), 6) end as high
from s join (select part, count(*) as n from c group by 1) using (part) group by part, n""")
def b6_delta_bootstrap(spark, d):
    c = table(spark, d, "customer").where("c_nationkey < 20").groupBy((F.col("c_nationkey") % 7).alias("part"), F.col("c_nationkey").alias("unit")).agg(F.avg("c_acctbal").alias("x"))
    s = S.poisson_drawn(c, "unit", REPLICATES).groupBy("part", "rep").agg(F.try_divide(F.sum(F.expr("k * x")), F.sum("k")).alias("m"), F.count("*").alias("n"))
    only = lambda q: F.when(F.max("n") > 1, F.round(F.percentile("m", F.lit(q)), 6))
    return s.groupBy("part").agg(F.max("n").alias("clusters"), only(0.05).alias("low"), only(0.95).alias("high"))


# Plans


@query("""with s as (select doc_id, cast(substr(source, 4) as bigint) as src, row_number() over (partition by source order by sha256('m|' || source || '|' || doc_id), doc_id) as place, count(*) over (partition by source) as n from documents),
t as (select *, case src % 3 when 0 then 1 when 1 then 2 else case when place <= n // 2 then 2 else 1 end end as times from s)
select (src << 27) | doc_id as entry, pass from (select src, doc_id, unnest(range(times)) as pass from t)""")
def w11_multi_source_plan(spark, d):
    """Sources once, twice, or about 1.5 times (every row once and the first half by hash again)."""
    docs = Q.hash_shuffle(table(spark, d, "documents").select("doc_id", "source"), "m", "doc_id", "source").withColumn("src", F.substring("source", 4, 9).cast("long"))
    n = docs.groupBy("source").agg(F.count("*").alias("n"))
    times = F.expr("case src % 3 when 0 then 1 when 1 then 2 else if(place <= n div 2, 2, 1) end")
    every = docs.join(n, "source").select("src", "doc_id", F.explode(F.sequence(F.lit(0), times - 1)).alias("pass"))
    return every.select(F.shiftleft("src", 27).bitwiseOR(F.col("doc_id")).alias("entry"), F.col("pass").cast("long").alias("pass"))


@query("""with r as (select lang, doc_id, row_number() over (partition by lang order by sha256('t|' || lang || '|' || doc_id), doc_id) - 1 as i, count(*) over (partition by lang) as n from documents),
l as (select lang, n, row_number() over (order by lang) as share from (select distinct lang, n from r)),
p as (select lang, share, n, unnest(range(200 * share)) as j from l)
select j // share as block, lang, j % share as slot, j // p.n as pass, doc_id from p join r using (lang) where r.i = j % p.n""")
def w20_common_tape(spark, d):
    """200 blocks with exactly ``share`` clips of each domain, each domain's clips in turn without replacement."""
    ranks = Q.hash_shuffle(table(spark, d, "documents").select("doc_id", "lang"), "t", "doc_id", "lang").select("lang", "doc_id", (F.col("place") - 1).cast("long").alias("i"))
    n = ranks.groupBy("lang").agg(F.count("*").alias("n")).withColumn("share", F.row_number().over(W.orderBy("lang")).cast("long"))  # a row for each domain
    places = n.withColumn("j", F.explode(F.expr("sequence(0L, 200L * share - 1)"))).withColumn("i", F.expr("j % n"))
    return places.join(ranks, ["lang", "i"]).selectExpr("j div share as block", "lang", "j % share as slot", "j div n as pass", "doc_id")


@query("""with t as (select p_brand as domain, p_partkey as term, row_number() over (partition by p_brand order by sha256('g|' || p_brand || '|' || p_partkey), p_partkey) - 1 as i, count(*) over (partition by p_brand) as n from part),
dom as (select domain, n, row_number() over (order by domain) - 1 as k, count(*) over () as m from (select distinct domain, n from t)),
p as (select domain, n, unnest(range(40)) as pass, k, m from dom)
select p.pass * p.m + p.k as prompt, p.domain, term from p join t using (domain) where t.i = p.pass % p.n""")
def w30_prompts(spark, d):
    """Domains in turn; each takes its terms in hashed order without replacement and then begins anew."""
    terms = Q.hash_shuffle(table(spark, d, "part").select(F.col("p_brand").alias("domain"), F.col("p_partkey").alias("term")), "g", "term", "domain").select("domain", "term", (F.col("place") - 1).cast("long").alias("i"))
    n = terms.groupBy("domain").agg(F.count("*").alias("n"))
    order = F.row_number().over(W.orderBy("domain")).cast("long") - 1  # a row for each domain
    asked = n.withColumn("k", order).withColumn("m", F.count("*").over(W.partitionBy())).withColumn("pass", F.explode(F.expr("sequence(0L, 39L)"))).withColumn("i", F.expr("pass % n"))
    return asked.join(terms, ["domain", "i"]).selectExpr("pass * m + k as prompt", "domain", "term")


@query(f"""with w as (select doc_id, len({split(norm("text"))}) as n from documents)
select doc_id, i, i * 100 as start, 100 as length from (select doc_id, unnest(range(least(4, n // 100))) as i from w)""")
def w31_long_windows(spark, d):
    n = T.n_words(T.simple_norm(F.col("text")))
    docs = table(spark, d, "documents").select("doc_id", F.least(F.lit(4), F.floor(n / 100)).cast("int").alias("k")).where("k > 0")
    out = docs.select("doc_id", F.explode(F.expr("sequence(0L, k - 1L)")).alias("i"))
    return out.select("doc_id", "i", (F.col("i") * 100).alias("start"), F.lit(100).alias("length"))


@query("""with s as (select event_id // 50 as shard, count(*) as n, count(*) filter (event_type = 'purchase') as bad from events group by 1),
g as (select *, row_number() over (order by shard) - 1 as i, max(case when n < 50 or bad > 12 then 1 else 0 end) over (order by shard rows unbounded preceding) as stopped from s)
select shard, n from g where stopped = 0 and shard = i""")
def sk3_committed_prefix(spark, d):
    """Shards before the first that is short or not committed, as long as their numbers follow one another from 0."""
    s = table(spark, d, "events").groupBy(F.expr("event_id div 50").alias("shard")).agg(F.count("*").alias("n"), F.count_if(F.expr("event_type = 'purchase'")).alias("bad"))
    first_bad = s.where("n < 50 or bad > 12").agg(F.min("shard").alias("stop"))
    gap = s.select("shard", (F.col("shard") + 1).alias("next")).alias("a").join(s.select(F.col("shard").alias("next")), "next", "left_anti").agg(F.min("shard").alias("gap"))
    begins = s.where("shard = 0").select(F.lit(True).alias("begins"))
    whole = s.crossJoin(F.broadcast(first_bad)).crossJoin(F.broadcast(gap)).crossJoin(F.broadcast(begins))  # one row each
    return whole.where("(stop is null or shard < stop) and shard <= gap").select("shard", "n")


@query("""with f as (select user_id, min(event_id) as first_step from events group by 1) select user_id, first_step from f where first_step <= 400""")
def st7_ledger_rollback(spark, d):
    """The ledger of first sightings after a return to step 400: later first sightings are forgotten."""
    return table(spark, d, "events").groupBy("user_id").agg(F.min("event_id").alias("first_step")).where("first_step <= 400")


# Series


@query("""select event_id, round(1 - (value - lag(value) over w) / nullif(greatest(event_id - lag(event_id) over w, 0), 0), 9) as busy from events window w as (partition by user_id order by ts, event_id)""")
def ts2_busy_fraction(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    total = F.col("event_id") - F.lag("event_id").over(w)
    idle = F.col("value") - F.lag("value").over(w)
    return table(spark, d, "events").select("event_id", F.round(1 - F.when(total > 0, idle / total), 9).alias("busy"))


@query("""with b as (select user_id, event_id, value, min(value) over (partition by user_id order by ts, event_id rows unbounded preceding) as best, row_number() over (partition by user_id order by ts, event_id) as i from events),
c as (select *, best <= 20 and (value > best * 2 or value > best + 30) as bad from b),
g as (select *, i - sum(case when bad then 1 else 0 end) over (partition by user_id order by i rows unbounded preceding) as run from c)
select event_id, best, bad and sum(case when bad then 1 else 0 end) over (partition by user_id, run order by i rows unbounded preceding) >= 3 as tripped from g""")
def ts9_validation_breaker(spark, d):
    """Armed once the best value is at most 20; three readings in a row beyond twice the best, or 30 more, trip it."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    b = table(spark, d, "events").withColumn("best", F.min("value").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("i", F.row_number().over(order))
    b = b.withColumn("bad", F.expr("best <= 20 and (value > best * 2 or value > best + 30)"))
    b = b.withColumn("run", F.col("i") - F.sum(F.col("bad").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    streak = F.sum(F.col("bad").cast("int")).over(W.partitionBy("user_id", "run").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    return b.select("event_id", "best", (F.col("bad") & (streak >= 3)).alias("tripped"))


@query("""with m as (select l_returnflag as part, l_suppkey as arm, round(avg(l_discount), 6) as score, sum(l_quantity) as cost from lineitem group by all),
t as (select *, max(score) over (partition by part) as best from m)
select part, arm, score from (select *, row_number() over (partition by part order by cost, arm) as r from t where score >= best - 0.002) where r = 1""")
def ts12_anchored_winner(spark, d):
    m = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("part"), F.col("l_suppkey").alias("arm")).agg(F.round(F.avg("l_discount"), 6).alias("score"), F.sum("l_quantity").alias("cost"))
    best = m.groupBy("part").agg(F.max("score").alias("best"))
    tied = m.join(best, "part").where("score >= best - 0.002")
    return tied.groupBy("part").agg(F.min_by(F.struct("arm", "score"), F.struct("cost", "arm")).alias("w")).select("part", "w.arm", "w.score")


# Identities and texts


@query("""with m as (select s_suppkey as id, s_suppkey // 2 as up from supplier where s_suppkey % 11 <> 0)
select s_suppkey as id, case when coalesce(f.up, e.up, dd.up, c.up, b.up, a.up, s_suppkey) in (select id from m) then null else coalesce(f.up, e.up, dd.up, c.up, b.up, a.up, s_suppkey) end as root
from supplier left join m a on a.id = s_suppkey left join m b on b.id = a.up left join m c on c.id = b.up left join m dd on dd.id = c.up left join m e on e.id = dd.up left join m f on f.id = e.up""")
def j12_provenance_chain(spark, d):
    """The root that six hops through the wrapper map reach; none (refused) where more would be needed."""
    ids = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    wrap = ids.where("id % 11 <> 0").select(F.col("id").alias("at"), F.expr("id div 2").alias("up"))
    now = ids.withColumn("at", F.col("id"))
    for _ in range(6):
        now = now.join(wrap, "at", "left").select("id", F.coalesce("up", "at").alias("at"))
    more = wrap.select("at", F.lit(True).alias("more"))
    return now.join(more, "at", "left").select("id", F.when(F.col("more").isNull(), F.col("at")).alias("root"))


_HOST = "'^https?://([^/]+)'"


@query(f"""select page_id, case when regexp_matches(url, '/[0-9]+') then 'n:' || regexp_extract(url, '/([0-9]+)', 1) when regexp_matches(url, {_HOST}) then 'h:' || regexp_extract(url, {_HOST}, 1) else 'u:' || url end as cluster from pages""")
def x18_cluster_of_id(spark, d):
    return table(spark, d, "pages").select("page_id", F.expr(f"case when url rlike '/[0-9]+' then 'n:' || regexp_extract(url, '/([0-9]+)', 1) when url rlike {_HOST} then 'h:' || regexp_extract(url, {_HOST}, 1) else 'u:' || url end").alias("cluster"))


@query(f"""select item_id, array_to_string({split(letters("text"))}, '') as variant_key from benchmark""")
def x14_variant_key(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(T.words(T.letters_norm(F.col("text"))), "").alias("variant_key"))


#: Digits by their names.
_DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_DIGIT_CASE = "case w " + " ".join(f"when '{k}' then '{v}'" for k, v in _DIGITS.items()) + " else w end"


@query(f"""select conv_id, turn, array_to_string([{_DIGIT_CASE} for w in {split(norm("text"))}], ' ') as spoken from conversations""")
def x37_digit_string(spark, d):
    words = F.transform(T.words(T.simple_norm(F.col("text"))), lambda w: F.coalesce(F.create_map(*(F.lit(x) for kv in _DIGITS.items() for x in kv))[w], w))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(words, " ").alias("spoken"))


@query("""select doc_id, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || ',"source":"' || source || '"}') as identity from documents""")
def x39_identity_hash(spark, d):
    """SHA-256 of the canonical JSON: sorted keys, no spaces."""
    return table(spark, d, "documents").select("doc_id", F.sha2(F.to_json(F.struct("doc_id", "lang", "n_chars", "source")), 256).alias("identity"))


_UNIT = (("milligrams?", "mg"), ("micrograms?", "mcg"), ("millilit(?:er|re)s?", "ml"), ("kilograms?", "kg"), ("grams?", "g"), ("percent", "%"))


def _units_sql(x: str, engine: str) -> str:
    for word, unit in _UNIT:
        x = f"regexp_replace({x}, '([0-9]) {word}( |$)', '\\1 {unit}\\2', 'g')" if engine == "duck" else f"regexp_replace({x}, '([0-9]) {word}( |$)', '$1 {unit}$2')"
    return x


@query(f"select conv_id, turn, {_units_sql(norm('text'), 'duck')} as text from conversations")
def x22_dose_units(spark, d):
    return table(spark, d, "conversations").withColumn("n", T.simple_norm(F.col("text"))).select("conv_id", "turn", F.expr(_units_sql("n", "spark")).alias("text"))


@query(f"""select doc_id, [replace(x, ' ', '') for x in regexp_extract_all({letters("text")}, '\\b[a-z](?: [a-z])+\\b')] as acronyms from documents""")
def x20_acronyms(spark, d):
    runs = F.regexp_extract_all(T.letters_norm(F.col("text")), F.lit(r"\b[a-z](?: [a-z])+\b"), F.lit(0))
    return table(spark, d, "documents").select("doc_id", F.transform(runs, lambda x: F.replace(x, F.lit(" "), F.lit(""))).alias("acronyms"))


_MARKERS = "'um', 'uh', 'er', 'hmm'"


@query(f"""with w as (select conv_id, turn, [x for x in {split(norm("text"))} if x not in ({_MARKERS})] as v from conversations)
select conv_id, turn, case when len(v) = 0 then '' else array_to_string(list_filter(v, lambda x, i: i = 1 or x <> v[i - 1]), ' ') end as text from w""")
def x26_style(spark, d):
    """Without markers and immediate repeats; what would be emptied is empty."""
    v = F.filter(T.words(T.simple_norm(F.col("text"))), lambda x: ~x.isin("um", "uh", "er", "hmm"))
    kept = T.let(v, lambda a: F.filter(a, lambda x, i: (i == 0) | (x != F.get(a, i - 1))))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(kept, " ").alias("text"))


_PAIRED = "[A-Za-z0-9]+[.,;:!?]?"


@query(f"""with p as (select lang, unnest(regexp_extract_all(text, '{_PAIRED}')) as x from documents)
select lang, regexp_extract(x, '[.,;:!?]$', 0) as mark, count(*) as words, count(*) filter (regexp_matches(x, '^[A-Z]')) as capitals from p group by all""")
def x28_word_marks(spark, d):
    p = table(spark, d, "documents").select("lang", F.explode(F.regexp_extract_all("text", F.lit(_PAIRED), F.lit(0))).alias("x"))
    return p.groupBy("lang", F.regexp_extract("x", "[.,;:!?]$", 0).alias("mark")).agg(F.count("*").alias("words"), F.count_if(F.col("x").rlike("^[A-Z]")).alias("capitals"))


#: Accented letters and what they fold to.
_ACCENTED, _PLAIN = "àâäáãåçèéêëìíîïñòóôöõùúûüýÿÀÂÄÁÃÅÇÈÉÊËÌÍÎÏÑÒÓÔÖÕÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


@query(f"select doc_id, translate(text, '{_ACCENTED}', '{_PLAIN}') as folded, length(regexp_replace(translate(text, '{_ACCENTED}', '{_PLAIN}'), '[ -~\\s]', '', 'g')) as left_over from documents")
def x33_ascii_fold(spark, d):
    folded = F.translate("text", _ACCENTED, _PLAIN)
    return table(spark, d, "documents").select("doc_id", folded.alias("folded"), F.length(F.regexp_replace(folded, r"[ -~\t\n\f\r]", "")).cast("long").alias("left_over"))


@query("select a.p_partkey as a, case when levenshtein(a.p_name, b.p_name) <= 12 then levenshtein(a.p_name, b.p_name) else -1 end as distance from part a join part b on b.p_partkey = a.p_partkey + 1")
def x11_capped_distance(spark, d):
    p = table(spark, d, "part")
    both = p.alias("a").join(p.alias("b"), F.expr("b.p_partkey = a.p_partkey + 1"))
    return both.select(F.col("a.p_partkey").alias("a"), F.expr("levenshtein(a.p_name, b.p_name, 12)").cast("long").alias("distance"))


# Near duplicates among short texts

_ROWS, _BANDS = 3, 10
_PRIME = 2147483647
_SETS = f"select doc_id, {split(norm('text'))} as w from documents"
_HASHES = [(1 + 2 * (k * 7919 + 104729) % 1000003, (k * 15485863 + 32452843) % 1000003) for k in range(_ROWS * _BANDS)]
_SIGNED = f"""sets as (select doc_id, list_distinct([w[i:i + 4] for i in range(1, len(w) - 3)]) as s from ({_SETS}) where len(w) >= 5),
hashed as (select doc_id, [('0x' || substr(md5(array_to_string(g, ' ')), 1, 7))::bigint for g in s] as h from sets),
signed as (select doc_id, [{", ".join(f"list_min([(x * {a} + {b}) % {_PRIME} for x in h])" for a, b in _HASHES)}] as signature from hashed)"""


def _signatures(docs):
    w = T.words(T.simple_norm(F.col("text")))
    # a filter on the hashes would make them twice; only the words are made twice here
    long = docs.where(F.size(w) >= 5)
    hashed = long.select("doc_id", F.transform(F.array_distinct(T.grams(w, 5)), lambda g: F.conv(F.substring(F.md5(g), 1, 7), 16, 10).cast("long")).alias("h"))
    a, b = (np.array(x, np.int64)[:, None] for x in zip(*_HASHES, strict=True))

    def least(batches):
        for batch in batches:
            rows = batch.column("h")
            minima = [((a * rows[i].values.to_numpy() + b) % _PRIME).min(axis=1) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(minima, pa.list_(pa.int64()))], names=["doc_id", "signature"])

    return hashed.mapInArrow(least, "doc_id long, signature array<bigint>")


@query(f"with {_SIGNED} select doc_id, signature from signed")
def x7_minhash_signature(spark, d):
    """30 minima of linear hashes of a text's 5-word shingles."""
    return _signatures(table(spark, d, "documents"))


@query(f"""with sets as (select row_number() over () as r, doc_id, list_distinct([w[i:i + 4] for i in range(1, len(w) - 3)]) as s from ({_SETS}) where len(w) >= 5),
held as (select r, doc_id, len(s) as k, unnest([md5_number(array_to_string(g, ' ')) for g in s]) as h from sets),
pairs as (select x.doc_id as a, y.doc_id as b, count(*) as n, any_value(x.k + y.k) as k from held x join held y using (h) where x.doc_id < y.doc_id group by x.r, y.r, x.doc_id, y.doc_id)
select a, b, round(n / (k - n), 9) as similarity from pairs where 10 * n >= 7 * (k - n)""")
def j14_minhash_bands(spark, d):
    """All pairs of documents whose 5-word shingles have a Jaccard similarity of 0.7 or more. Bands of minima would leave out one
    in 67 at 0.7 and, by the first of each band, copies of one another: here prefixes of the sets meet, which leaves out none."""
    docs = table(spark, d, "documents")
    return A.pairs(docs.select("doc_id", T.gram_hashes(T.words(T.simple_norm(F.col("text"))), 5).alias("s")), "doc_id", "s")


# Vocabulary and provenance


@query(f"""with t as (select w, min(item_id) as owner from (select item_id, unnest({split(letters("text"))}) as w from benchmark) where length(w) >= 3 group by w),
k as (select w, owner, regexp_replace(w, 's$', '') as key from t)
select w, owner, key, case when substr(sha256('y|' || key), 1, 16) < '4000000000000000' then 'held_out' else 'training' end as side from k""")
def d7_vocabulary_split(spark, d):
    """A word belongs to its first owner; variants share a key, and the key decides the side."""
    w = table(spark, d, "benchmark").select("item_id", F.explode(T.words(T.letters_norm(F.col("text")))).alias("w")).where("length(w) >= 3")
    t = w.groupBy("w").agg(F.min("item_id").alias("owner")).withColumn("key", F.regexp_replace("w", "s$", ""))
    return t.select("w", "owner", "key", F.when(Q.hash_side(0.25, "y", "key"), "held_out").otherwise("training").alias("side"))


_LICENSED = "(?i)licen[cs]e|copyright|all rights"


@query(f"""select source, count(*) as rows_read, count(*) filter (regexp_matches(coalesce(text, ''), '{_LICENSED}')) as licensed, sha256(min(doc_id)::varchar || ':' || max(doc_id)) as extent,
case when count(*) filter (text is null) > 0 then 'refused' else 'ok' end as state from documents group by source""")
def d9_provenance(spark, d):
    docs = table(spark, d, "documents")
    return docs.groupBy("source").agg(
        F.count("*").alias("rows_read"), F.count_if(F.coalesce("text", F.lit("")).rlike(_LICENSED)).alias("licensed"),
        F.sha2(F.concat_ws(":", F.min("doc_id").cast("string"), F.max("doc_id").cast("string")), 256).alias("extent"),
        F.when(F.count_if(F.col("text").isNull()) > 0, "refused").otherwise("ok").alias("state"),
    )
