"""Queries of windows, samples, cuts, set operations, text functions, deny-lists and telemetry."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import align
from ..functions import text as T
from ..operators import decontaminate as D
from ..operators import filters as R
from ..operators import gates as G
from ..operators import sequences as Q
from ..operators import statistics as S
from .core import _FOUND, _GRAMS, _HITS, WORDS_SQL, _corpus, _runs_by_letter, _sound_key, letters, norm, query, split, table, words

# Windows and ordered selections


@query("select event_id, row_number() over (partition by user_id, event_type order by ts, event_id) = 1 as first from events")
def w1_first_occurrence(spark, d):
    df = table(spark, d, "events").withColumn("id", F.concat_ws("|", "user_id", "event_type"))
    return Q.first_flag(df, "id", "ts", "event_id").select("event_id", "first")


@query("select event_id from (select event_id, event_type, first_value(event_type) over (partition by user_id order by ts, event_id) as f from events) where f <> event_type")
def w2_id_conflicts(spark, d):
    return Q.conflicts(table(spark, d, "events"), "user_id", "event_type", "ts", "event_id").select("event_id")


@query("""select user_id, max(n) as run from (select user_id, event_type, count(*) as n from (select *, row_number() over (partition by user_id order by ts, event_id) - row_number() over (partition by user_id, event_type order by ts, event_id) as g from events) group by user_id, event_type, g) group by user_id""")
def w3_equal_runs(spark, d):
    all_, own = W.partitionBy("user_id").orderBy("ts", "event_id"), W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    g = table(spark, d, "events").withColumn("g", F.row_number().over(all_) - F.row_number().over(own))
    return g.groupBy("user_id", "event_type", "g").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.max("n").alias("run"))


@query("select l_orderkey, l_linenumber, expected from (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_linenumber) - 1 as expected from lineitem) where l_linenumber <> expected")
def w4_positions(spark, d):
    return G.positions(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "expected")


@query("select event_id, cast(floor(event_id / 128) as bigint) as pool from events")
def w5_pools(spark, d):
    return table(spark, d, "events").select("event_id", F.floor(F.col("event_id") / 128).cast("long").alias("pool"))


_CUT = """with recursive o as (select doc_id, n_chars as s, doc_id // 64 as pool, row_number() over (partition by doc_id // 64 order by n_chars, doc_id) as i from documents),
r as (select doc_id, s, pool, i, cast(0 as bigint) as batch, cast(0 as bigint) as pos from o where i = 1
  union all select o.doc_id, o.s, o.pool, o.i, case when (r.pos + 2) * o.s > 20000 then r.batch + 1 else r.batch end, case when (r.pos + 2) * o.s > 20000 then 0 else r.pos + 1 end from r join o on o.pool = r.pool and o.i = r.i + 1)"""


def _sized(spark, d):
    return table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("s"), F.floor(F.col("doc_id") / 64).cast("long").alias("pool"))


@query(_CUT + " select doc_id, pool, batch, pos from r")
def w6_greedy_cut(spark, d):
    return Q.greedy_cut(_sized(spark, d), 20_000, "s", "doc_id", "pool").select("doc_id", "pool", "batch", "pos")


@query("""with recursive o as (select doc_id, n_chars as s, doc_id // 64 as pool, row_number() over (partition by doc_id // 64 order by n_chars desc, doc_id) as i from documents),
r as (select doc_id, s, pool, i, cast(0 as bigint) as batch, 1 as n, s as total from o where i = 1
  union all select o.doc_id, o.s, o.pool, o.i, case when n = 8 or total + o.s > 20000 then batch + 1 else batch end, case when n = 8 or total + o.s > 20000 then 1 else n + 1 end, case when n = 8 or total + o.s > 20000 then o.s else total + o.s end from r join o on o.pool = r.pool and o.i = r.i + 1)
select doc_id, pool, batch from r""")
def w7_duration_batches(spark, d):
    return Q.duration_batches(_sized(spark, d), 8, 20_000, "s", "doc_id", "pool").select("doc_id", "pool", "batch")


@query("select doc_id, row_number() over (partition by source order by sha256('7|' || source || '|' || doc_id), doc_id) as place from documents")
def w8_seeded_permutation(spark, d):
    return Q.hash_shuffle(table(spark, d, "documents"), "7", "doc_id", "source").select("doc_id", F.col("place").cast("long").alias("place"))


@query("""with c as (select o_orderkey as k, floor(o_totalprice) as s from orders), m as (select k, s, coalesce(sum(s) over (order by k rows between unbounded preceding and 1 preceding), 0) + s / 2 as mid from c),
p as (select pool, sum(real * 0.3) over (order by pool) as upto from (select l_suppkey as pool, floor(sum(l_extendedprice)) as real from lineitem group by 1))
select (select min(pool) from p where upto >= mid) as pool, k, s from m where mid <= (select max(upto) from p)""")
def w9_diffused_draw(spark, d):
    # floor() gives a long, which has no NaN and an end; doubles beyond 2^52 are whole numbers
    floor = lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)
    clips = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), floor(F.col("o_totalprice")).alias("s"))
    real = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("pool")).agg(F.sum("l_extendedprice").alias("real")).withColumn("real", floor(F.col("real")))
    return Q.diffused_draw(clips, real, 0.3, "s", "k")


@query("select doc_id, pass, row_number() over (partition by pass order by sha256('3|' || pass || '|' || doc_id), doc_id) as place from documents, range(3) t(pass)")
def w10_passes(spark, d):
    passes = table(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("pass"))
    return Q.hash_shuffle(passes, "3", "doc_id", "pass").withColumn("place", F.col("place").cast("long"))


@query()
def w12_two_key_caps(spark, d):
    df = table(spark, d, "events").select("event_id", "user_id", "event_type")
    return Q.capped(df, {"user_id": 20, "event_type": 60}, "event_id")


@query("""select event_id from (select event_id, user_id, row_number() over (partition by user_id order by sha256('5|' || event_id), event_id) as r from events) where r <= 2 order by sha256('6|' || event_id), event_id limit 20""")
def w13_capped_sample(spark, d):
    ranked = table(spark, d, "events").withColumn("r", F.row_number().over(W.partitionBy("user_id").orderBy(T.salted("5", "event_id"), "event_id")))
    return Q.hash_sample(ranked.where("r <= 2"), 20, "6", "event_id").select("event_id")


@query("select event_id from (select event_id, row_number() over (order by event_id) - 1 as i, count(*) over () as n from events) where i % greatest(n // 100, 1) = 0 and i < 100 * greatest(n // 100, 1)")
def w14_systematic_sample(spark, d):
    return Q.every_kth(table(spark, d, "events"), 100, "event_id").select("event_id")


@query("""select l_suppkey, l_returnflag, case when r <= round_even(0.3 * n, 0) then 'selection' else 'test' end as side from (select *, row_number() over (partition by l_returnflag order by sha256('s|' || l_returnflag || '|' || l_suppkey), l_suppkey) as r, count(*) over (partition by l_returnflag) as n from (select distinct l_suppkey, l_returnflag from lineitem))""")
def w15_cluster_split(spark, d):
    keys = table(spark, d, "lineitem").select("l_suppkey", "l_returnflag").distinct()
    return Q.hash_split(keys, 0.3, "s", "l_suppkey", "l_returnflag").select("l_suppkey", "l_returnflag", "side")


@query("select source from (select source, coalesce(sum(n) over (order by sha256('h|' || source), source rows between unbounded preceding and 1 preceding), 0) as b from (select source, count(*) as n from documents group by source)) where b < 50")
def w16_until_target(spark, d):
    groups = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return Q.until_target(groups, 50, "n", T.salted("h", "source"), F.col("source")).select("source")


@query("select doc_id, substr(sha256('v|' || doc_id), 1, 16) < '4000000000000000' as held from documents")
def w17_hash_side(spark, d):
    return table(spark, d, "documents").select("doc_id", Q.hash_side(0.25, "v", "doc_id").alias("held"))


@query("""select doc_id from (select doc_id, source, bin, row_number() over (partition by source, bin order by sha256('n|' || doc_id), doc_id) as r from (select doc_id, source, ntile(4) over (partition by source order by n_chars, doc_id) as bin from documents)) where r <= 2""")
def w18_binned_subset(spark, d):
    bins = table(spark, d, "documents").withColumn("bin", F.ntile(4).over(W.partitionBy("source").orderBy("n_chars", "doc_id")))
    r = F.row_number().over(W.partitionBy("source", "bin").orderBy(T.salted("n", "doc_id"), "doc_id"))
    return bins.withColumn("r", r).where("r <= 2").select("doc_id")


@query("""select doc_id, slot from (select doc_id, source, lang, (r - 1) // 4 as slot, count(*) over (partition by source, lang, (r - 1) // 4) as n from (select *, row_number() over (partition by source, lang order by sha256('k|' || doc_id), doc_id) as r from documents)) where n = 4""")
def w19_slots(spark, d):
    r = F.row_number().over(W.partitionBy("source", "lang").orderBy(T.salted("k", "doc_id"), "doc_id"))
    slots = table(spark, d, "documents").withColumn("slot", F.floor((r - 1) / 4))
    return slots.withColumn("n", F.count("*").over(W.partitionBy("source", "lang", "slot"))).where("n = 4").select("doc_id", "slot")


@query("select event_id, row_number() over (partition by user_id order by ts, event_id) as n, user_id from events where event_type = 'view'")
def w23_worker_merge(spark, d):
    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return table(spark, d, "events").where("event_type = 'view'").select("event_id", n.alias("n"), "user_id").orderBy("n", "user_id")


@query("select event_id, round(case when event_id < 100 then 0.001 * (event_id + 1) / 100 when event_id < 800 then 0.001 else greatest(0.001 * (1000 - event_id) / 200, 0) end, 9) as rate from events")
def w24_schedule(spark, d):
    return table(spark, d, "events").select("event_id", F.round(S.schedule(F.col("event_id"), 100, 1000, 200, 0.001), 9).alias("rate"))


@query(_CUT + ", b as (select pool, batch, row_number() over (order by sha256('b|' || pool || '|' || batch), pool, batch) - 1 as served_at from (select distinct pool, batch from r)) select doc_id, served_at, pos from r join b using (pool, batch)")
def w25_batch_lookup(spark, d):
    cut = Q.greedy_cut(_sized(spark, d), 20_000, "s", "doc_id", "pool")
    order = cut.select("pool", "batch").distinct().withColumn("h", T.salted("b", "pool", "batch"))
    served = Q.ranked(order, "h", "pool", "batch").select("pool", "batch", F.col("rank").alias("served_at"))
    return cut.join(served, ["pool", "batch"]).select("doc_id", "served_at", "pos")


@query(_CUT + """, t as (select pool, batch, count(*) as n from r group by all), o2 as (select doc_id, n_chars as s, doc_id // 64 as pool from documents)
select pool, count(*) as batches, cast(sum(n) as bigint) as clips from t where pool < (select count(distinct doc_id // 64) // 2 from documents) group by pool""")
def w26_plan_prefix(spark, d):
    """The plan of the first half of the pools, made alone; its SQL takes the plan of all and keeps that part."""
    sized = _sized(spark, d)
    half = sized.select("pool").distinct().count() // 2
    short = Q.greedy_cut(sized.where(F.col("pool") < half), 20_000, "s", "doc_id", "pool")
    return short.groupBy("pool").agg(F.count_distinct("batch").alias("batches"), F.count("*").alias("clips"))


@query("""select source, case when r <= 0.7 * n then 'train' when r <= 0.85 * n then 'dev' else 'test' end as part from (select source, row_number() over (order by sha256('p|' || source), source) as r, count(*) over () as n from (select distinct source from documents))""")
def w27_three_way_split(spark, d):
    groups = table(spark, d, "documents").select("source").distinct()
    ranks = Q.ranked(groups.withColumn("h", T.salted("p", "source")), "h", "source").select("source", (F.col("rank") + 1).alias("r"))
    parts = ranks.join(F.broadcast(groups.agg(F.count("*").alias("n"))))  # one row
    return parts.select("source", F.expr("case when r <= 0.7 * n then 'train' when r <= 0.85 * n then 'dev' else 'test' end").alias("part"))


@query("""select doc_id, (i - 1) % 3 as engine, (row_number() over (partition by (i - 1) % 3 order by lang, i) - 1) % 5 as voice from (select doc_id, lang, row_number() over (partition by lang order by sha256('e|' || lang || '|' || doc_id), doc_id) as i from documents)""")
def w29_round_robin(spark, d):
    i = Q.hash_shuffle(table(spark, d, "documents"), "e", "doc_id", "lang").withColumn("engine", (F.col("place") - 1).cast("long") % 3)
    v = Q.numbered(i, F.struct("lang", F.expr("place div 65536")), "lang", "place", by=["engine"], name="v")
    return v.select("doc_id", "engine", (F.col("v").cast("long") % 5).alias("voice"))


# Sorts, set operations


@query("select doc_id, row_number() over (partition by source order by n_chars, lang, doc_id) as place from documents")
def so1_ordered(spark, d):
    return table(spark, d, "documents").select("doc_id", F.row_number().over(W.partitionBy("source").orderBy("n_chars", "lang", "doc_id")).cast("long").alias("place"))


@query("select event_id, value from events order by value desc, event_id limit 20")
def so3_top_n(spark, d):
    return table(spark, d, "events").orderBy(F.desc("value"), "event_id").limit(20).select("event_id", "value")


@query("select l_suppkey from (select l_suppkey, sum(l_tax) / sum(l_quantity) as r, count(*) as n from lineitem group by 1) where r <= (select min(r) + 0.0001 from (select sum(l_tax) / sum(l_quantity) as r from lineitem group by l_suppkey)) order by n, l_suppkey limit 1")
def so4_best_with_near_ties(spark, d):
    r = table(spark, d, "lineitem").groupBy("l_suppkey").agg((F.sum("l_tax") / F.sum("l_quantity")).alias("r"), F.count("*").alias("n"))
    near = r.join(r.agg((F.min("r") + 0.0001).alias("most")), F.col("r") <= F.col("most"))
    return near.orderBy("n", "l_suppkey").limit(1).select("l_suppkey")


@query("select doc_id from documents order by sha256('11|' || doc_id), doc_id limit 20")
def so5_seeded_sample(spark, d):
    return Q.hash_sample(table(spark, d, "documents"), 20, "11", "doc_id").select("doc_id")


@query("select text, count(*) as n from (select text from benchmark union all select text from conversations) group by text")
def set1_union(spark, d):
    both = table(spark, d, "benchmark").select("text").unionByName(table(spark, d, "conversations").select("text"))
    return both.groupBy("text").agg(F.count("*").alias("n"))


@query("select distinct user_id, event_type from events")
def set2_distinct(spark, d):
    return table(spark, d, "events").select("user_id", "event_type").distinct()


@query("select doc_id as id from documents intersect select doc_id from labels")
def set3_intersect(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id")).intersect(table(spark, d, "labels").select("doc_id"))


@query("select l_suppkey from lineitem where l_linestatus = 'O' except all select l_suppkey from lineitem where l_linestatus = 'F'")
def set4_multiset_except(spark, d):
    lines = table(spark, d, "lineitem")
    return lines.where("l_linestatus = 'O'").select("l_suppkey").exceptAll(lines.where("l_linestatus = 'F'").select("l_suppkey"))


@query("select doc_id from documents except select doc_id from labels")
def set5_difference(spark, d):
    return table(spark, d, "documents").select("doc_id").subtract(table(spark, d, "labels").select("doc_id"))


@query("""with recursive e as (select c_custkey as a, c_custkey - c_custkey % 7 as b from customer where c_custkey % 7 > 0),
r as (select c_custkey as node, c_custkey - c_custkey % 7 as label from customer where c_custkey % 7 > 0 union select b, b from e) select node, label from r""")
def set6_components(spark, d):
    c = table(spark, d, "customer").where("c_custkey % 7 > 0")
    return Q.components(c.select(F.col("c_custkey").alias("a"), (F.col("c_custkey") - 1).alias("b")))


@query("select text as content, count(distinct source) as n_values from documents group by text having count(distinct source) > 1")
def set7_dependency(spark, d):
    return G.dependent(table(spark, d, "documents").withColumnRenamed("text", "content"), "content", "source")


# Text functions


@query(f"select doc_id, {norm('text')} as norm from documents")
def x2_simple_norm(spark, d):
    return table(spark, d, "documents").select("doc_id", T.simple_norm(F.col("text")).alias("norm"))


@query(f"select doc_id, len(w) as n from ({WORDS_SQL})")
def x3_word_count(spark, d):
    return table(spark, d, "documents").select("doc_id", T.n_words(T.simple_norm(F.col("text"))).alias("n"))


@query(f"select doc_id, count(*) as n, count(distinct gram) as n_distinct, min(gram) as least from (select doc_id, unnest([array_to_string(w[i:i + 7], ' ') for i in range(1, len(w) - 6)]) as gram from ({WORDS_SQL}) where len(w) >= 8) group by doc_id")
def x5_ngrams(spark, d):
    told = T.let(F.array_distinct(T.grams(F.col("w"), 8)), lambda g: F.struct(F.size(g).cast("long").alias("n_distinct"), F.array_min(g).alias("least")))
    return words(spark, d).where("size(w) >= 8").select("doc_id", (F.size("w") - 7).cast("long").alias("n"), told.alias("g")).select("doc_id", "n", "g.n_distinct", "g.least")


_BI = f"select conv_id, turn, list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) as b from (select conv_id, turn, {split(norm('text'))} as w from conversations)"


@query(f"select a.conv_id, a.turn, round(len(list_intersect(a.b, b.b)) / nullif(len(list_distinct(list_concat(a.b, b.b))), 0), 9) as jaccard from ({_BI}) a join ({_BI}) b on a.conv_id = b.conv_id and a.turn + 1 = b.turn")
def x6_bigram_jaccard(spark, d):
    b = table(spark, d, "conversations").select("conv_id", "turn", F.array_distinct(T.grams(T.words(T.simple_norm(F.col("text"))), 2)).alias("b"))
    nxt = b.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("b").alias("c"))
    return b.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.jaccard(F.col("b"), F.col("c")), 9).alias("jaccard"))


@query()
def x8_edit_counts(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", T.simple_norm(F.col("text")).alias("t"))
    both = turns.join(turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("h")), ["conv_id", "turn"])
    rate, infinite = align.wer(F.expr("e.s + e.d + e.i"), T.n_words(F.col("t")), T.n_words(F.col("h")))
    return both.withColumn("e", align.edit_counts("t", "h")).select("conv_id", "turn", "e.s", "e.d", "e.i", rate.alias("wer"), infinite.alias("infinite"))


@query(f"""with x as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from ({WORDS_SQL})), l as (select doc_id, word, lag(word) over (partition by doc_id order by i) as before from x)
select doc_id, case when before in ('of', 'in', 'and') then before || ' the' else 'the' end as phrase, count(*) as n from l where word = 'the' group by all""")
def x13_phrase_match(spark, d):
    phrases = ["of the", "the", "in the", "and the"]
    found = words(spark, d).select("doc_id", F.explode(align.phrase_matcher(phrases)("w")).alias("m"))
    return found.groupBy("doc_id", F.col("m.phrase").alias("phrase")).agg(F.count("*").alias("n"))


@query("select page_id, regexp_extract(url, '^https?://([^/]+)', 1) as recording, cast(nullif(regexp_extract(url, '/([0-9]+)', 1), '') as bigint) as position from pages")
def x17_record_keys(spark, d):
    n = F.regexp_extract("url", "/([0-9]+)", 1)
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("recording"), F.when(n != "", n).cast("long").alias("position"))


@query("select doc_id, round(1000.0 * len(regexp_extract_all(text, 'the')) / n_chars, 9) as density, case when n_chars < 500 then 'short' when lang = 'en' then 'english' else 'other' end as class from documents where n_chars > 0")
def x16_density(spark, d):
    cls = F.coalesce(R.first_reason({"short": F.col("n_chars") < 500, "english": F.col("lang") == "en"}), F.lit("other"))
    return table(spark, d, "documents").where("n_chars > 0").select("doc_id", F.round(1000.0 * F.regexp_count("text", F.lit("the")) / F.col("n_chars"), 9).alias("density"), cls.alias("class"))


@query(f"""select t as word, {_sound_key(lambda k, a, b: f"replace({k}, '{a}', '{b}')", _runs_by_letter)} as key from (select distinct w as t from (select unnest({split(letters('text'))}) as w from benchmark))""")
def x29_sound_keys(spark, d):
    """The key by which pairs of confusable terms meet."""
    w = table(spark, d, "benchmark").select(F.explode(T.words(T.letters_norm(F.col("text")))).alias("word")).distinct()
    return w.select("word", T.sound_key(F.col("word")).alias("key"))


@query(f"select distinct word, case when word like '%ies' and length(word) > 4 then regexp_replace(word, 'ies$', '') || 'y' when regexp_matches(word, '(ches|shes|sses|xes)$') then regexp_replace(word, 'es$', '') when regexp_matches(word, '[^s]s$') and length(word) > 3 then regexp_replace(word, 's$', '') else word end as singular from (select unnest({split(letters('text'))}) as word from benchmark)")
def x31_singular(spark, d):
    w = table(spark, d, "benchmark").select(F.explode(T.words(T.letters_norm(F.col("text")))).alias("word")).distinct()
    return w.select("word", T.singular(F.col("word")).alias("singular"))


@query(f"with s as (select distinct w[i] || w[i + 1] as surface from (select {split(letters('text'))} as w from benchmark), lateral (select unnest(range(1, len(w))) as i)), r as (select distinct doc_id, w[i] || w[i + 1] as run from ({WORDS_SQL}), lateral (select unnest(range(1, len(w))) as i)) select distinct doc_id from r where run in (select surface from s)")
def x32_joined_surfaces(spark, d):
    joined = lambda w: F.transform(T.grams(w, 2), lambda g: F.replace(g, F.lit(" "), F.lit("")))
    surfaces = table(spark, d, "benchmark").select(F.explode(joined(T.words(T.letters_norm(F.col("text"))))).alias("run")).distinct()
    return words(spark, d).select("doc_id", F.explode(F.array_distinct(joined(F.col("w")))).alias("run")).join(surfaces, "run", "left_semi").select("doc_id").distinct()


@query(f"select doc_id, len([1 for i in range(1, len(w) + 1) if w[i] <> 'the' and (i = 1 or w[i] <> w[i - 1])]) as n from ({WORDS_SQL})")
def x36_collapse(spark, d):
    return words(spark, d).select("doc_id", F.size(T.collapse(F.col("w"), "the")).cast("long").alias("n"))


@query("select doc_id, sha256('s|' || source || '|' || doc_id) as rank from documents")
def x38_salted_rank(spark, d):
    return table(spark, d, "documents").select("doc_id", T.salted("s", "source", "doc_id").alias("rank"))


@query("select event_id, cast(ceil(10 * floor(value) / 9) as bigint) as key, abs(value * 100 - round(value * 100)) > 1e-6 as inexact from events")
def x41_ceil_key(spark, d):
    return table(spark, d, "events").select("event_id", F.ceil(10 * F.floor("value") / 9).cast("long").alias("key"), (F.abs(F.col("value") * 100 - F.round(F.col("value") * 100)) > 1e-6).alias("inexact"))


@query("with p as (select event_type, count(*) / avg(value) as p from events group by 1) select event_type, round(p / sum(p) over (), 9) as p from p")
def x42_mixture(spark, d):
    p = table(spark, d, "events").groupBy("event_type").agg((F.count("*") / F.avg("value")).alias("p"))
    return p.select("event_type", F.round(F.col("p") / F.sum("p").over(W.partitionBy()), 9).alias("p"))


# Deny-lists


@query(_FOUND + ", " + _HITS + " select doc_id, array_to_string(list_sort(list(distinct rule)), ',') as rules from (select doc_id, 'containment' as rule from hits union all select doc_id, 'reserved' from labels where toxic = 1) group by doc_id")
def d1_denylist(spark, d):
    docs, held = _corpus(spark, d)
    out = D.denylist(docs, held, table(spark, d, "labels").where("toxic = 1"), "doc_id", "item_id")
    return out.select("doc_id", F.array_join("rules", ",").alias("rules"))


_CHUNKS = f"select item_id, i // 20 as win, w[i + 1:i + 20] as w from (select item_id, w, unnest(range(0, len(w), 20)) as i from (select item_id, {split(norm('text'))} as w from benchmark) where len(w) > 0)"


@query(f"""with h as (select item_id, win, unnest(list_distinct([array_to_string(w[i:i + 7], ' ') for i in range(1, len(w) - 6)])) as gram from ({_CHUNKS}) where len(w) >= 8),
g as (select * from ({_GRAMS}) where gram in (select gram from h)),
common as (select gram from g group by gram having count(*) > 100), u as (select * from h where gram not in (select gram from common)),
hits as (select doc_id, item_id, win, count(*) as m, any_value(n) as n from g join u using (gram) join (select item_id, win, count(*) as n from u group by all) using (item_id, win) group by doc_id, item_id, win having count(*) >= ceil(any_value(n) * 0.5))
select doc_id, count(*) as windows from hits group by doc_id""")
def d2_talk_windows(spark, d):
    docs, held = _corpus(spark, d)
    cut = D.windows(held, "item_id").withColumn("unit", F.concat_ws("#", "item_id", "window"))
    return D.contained(docs, cut, "doc_id", "unit").groupBy("doc_id").agg(F.count("*").alias("windows"))


@query(f"select source, state, count(*) as n from (select d.doc_id, d.source, case when len(w) < 200 or 1000.0 * len([x for x in w if x = 'the']) < 10.0 * len(w) then 'not_qualified' when l.doc_id is not null then 'denied' else 'selected' end as state from ({WORDS_SQL}) d left join labels l on l.doc_id = d.doc_id and l.toxic = 1) group by all")
def d3_subset_select(spark, d):
    stats = words(spark, d).select("doc_id", "source", F.size("w").alias("n"), F.size(F.filter("w", lambda x: x == "the")).alias("hits"))
    return D.subset(stats, table(spark, d, "labels").where("toxic = 1"), "doc_id", "hits", "n", 200, 10.0).groupBy("source", "state").agg(F.count("*").alias("n"))


@query(_FOUND.replace("having count(*) > 100", "having count(*) > 3") + ", " + _HITS + " select doc_id, item_id, matched, n_grams from hits")
def d4_given_boilerplate(spark, d):
    docs, held = _corpus(spark, d)
    found = D.probe(docs, held, "doc_id", "item_id")[1]
    return D.contained(docs, held, "doc_id", "item_id", boilerplate=found.groupBy("gram").agg(F.count("*").alias("df")).where("df > 3").select("gram"))


# Telemetry


@query("""select event_id, round(delta, 4) as delta, round(case when s > 0 then delta / s end, 4) as rate from (select event_id, (epoch_us(ts) - lag(epoch_us(ts)) over w) / 1e6 as s, case when value < lag(value) over w then value + 1000 - lag(value) over w else value - lag(value) over w end as delta from events window w as (partition by user_id order by ts))""")
def ts1_counter_rates(spark, d):
    ev = table(spark, d, "events").select("event_id", "user_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return S.counter_rates(ev, "value", "t", "user_id", 1000.0, per=1e6, then=("event_id",)).select("event_id", F.round("delta", 4).alias("delta"), F.round("rate", 4).alias("rate"))


@query("select event_id, case when event_type = 'view' then value when event_type = 'click' then value / 2 else 0 end as estimate, case when event_type = 'view' then 'measured' when event_type = 'click' then 'halved' else 'default' end as basis from events")
def ts3_estimates(spark, d):
    t = F.col("event_type")
    est = F.when(t == "view", F.col("value")).when(t == "click", F.col("value") / 2).otherwise(F.lit(0.0))
    return table(spark, d, "events").select("event_id", est.alias("estimate"), F.when(t == "view", "measured").when(t == "click", "halved").otherwise("default").alias("basis"))


@query("""with recursive o as (select event_id, user_id, epoch_us(ts) / 1e6 as t, row_number() over (partition by user_id order by ts) as i from events where value > 50),
r as (select event_id, user_id, t as last, i, true as keep from o where i = 1 union all select o.event_id, o.user_id, case when o.t - r.last >= 36000 then o.t else r.last end, o.i, o.t - r.last >= 36000 from r join o on o.user_id = r.user_id and o.i = r.i + 1)
select event_id, user_id from r where keep""")
def ts4_alerts(spark, d):
    ev = table(spark, d, "events").select("event_id", "user_id", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return Q.alerts(ev, 50.0, 36000.0, "value", "t", "user_id").select("event_id", "user_id")


@query("select event_type, count(*) as n, round(avg(value), 6) as mean, max(value) as largest, round(avg(case when value > 50 then 1.0 else 0.0 end), 9) as high from events where ts >= (select max(ts) - interval 10 day from events) group by 1")
def ts6_tail_readings(spark, d):
    ev = table(spark, d, "events")
    last = ev.agg((F.max("ts") - F.expr("interval 10 days")).alias("since"))
    tail = ev.join(F.broadcast(last), F.col("ts") >= F.col("since"))
    return tail.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("largest"), F.round(F.avg(F.when(F.col("value") > 50, 1.0).otherwise(0.0)), 9).alias("high"))


@query("select event_id from (select event_id, row_number() over (partition by user_id, props order by ts, event_id) as r from events where event_type = 'error') where r = 1")
def ts7_first_errors(spark, d):
    ev = table(spark, d, "events").where("event_type = 'error'")
    return ev.groupBy("user_id", "props").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id")).select("event_id")


@query()
def ts8_breaker(spark, d):
    ev = table(spark, d, "events").select("user_id", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return S.breaker(ev, "value", "t", "user_id")


@query("select event_type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95 from events group by 1")
def ts10_percentiles(spark, d):
    p = lambda q: F.round(F.percentile("value", F.lit(q)), 6)
    return table(spark, d, "events").groupBy("event_type").agg(p(0.5).alias("p50"), p(0.95).alias("p95"))


@query("select a.o_orderpriority as stratum, count(*) as n, round(quantile_cont(100 * (a.o_totalprice - b.o_totalprice) / b.o_totalprice, 0.5), 6) as change from orders a join orders b on a.o_orderkey = b.o_orderkey + 1 group by 1")
def ts11_paired_change(spark, d):
    a = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    both = a.join(a.select((F.col("o_orderkey") + 1).alias("o_orderkey"), F.col("o_totalprice").alias("b")), "o_orderkey")
    return both.groupBy(F.col("o_orderpriority").alias("stratum")).agg(F.count("*").alias("n"), F.round(F.percentile(100 * (F.col("o_totalprice") - F.col("b")) / F.col("b"), F.lit(0.5)), 6).alias("change"))


@query("select round(quantile_cont(m, 0.5), 6) as statistic from (select l_suppkey, avg(l_extendedprice) as m from lineitem group by 1)")
def ts13_median_of_means(spark, d):
    m = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_extendedprice").alias("m"))
    return m.agg(F.round(F.percentile("m", F.lit(0.5)), 6).alias("statistic"))


@query("select event_id from (select event_id, row_number() over (order by event_id) - 1 as i, count(*) over () as n from events) where i in (select cast(round_even(k * (n - 1) / 9, 0) as bigint) from range(10) t(k))")
def ts15_even_sample(spark, d):
    ev = table(spark, d, "events").select("event_id")
    last = ev.count() - 1
    return Q.ranked(ev, "event_id").where(F.col("rank").isin([round(k * last / 9) for k in range(10)])).select("event_id")


@query("select source, lang from (select source, lang, row_number() over (partition by source order by count(*) desc, lang) as r from documents group by source, lang) where r = 1")
def ts16_group_mode(spark, d):
    n = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return n.groupBy("source").agg(F.min_by("lang", F.struct(-F.col("n"), "lang")).alias("lang"))


# Windows over time (an extension: the operators above have none)


@query("select cast(epoch(time_bucket(interval 1 day, ts)) as bigint) as day, event_type, count(*) as n from events group by all")
def time_tumbling(spark, d):
    ev = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = ev.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.unix_seconds("w.start").alias("day"), "event_type", "n")
