"""Queries of vocabularies, persisted labels, drawn windows and crossed draws, each beside its DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import sequences as Q
from ..operators import statistics as S
from ..operators import vocabulary as V
from ..operators import windows as N
from ..sources import labelindex as I
from .core import WORDS_SQL, letters, norm, query, split, table, words


def _regular_sql(x: str) -> str:
    return f"""case when length({x}) <= 3 or regexp_matches({x}, '({"|".join(V.NO_PLURAL)})$') then {x} when {x} like '%ies' and length({x}) > 4 then left({x}, -3) || 'y'
when regexp_matches({x}, '(ches|shes|sses|xes|zes)$') then left({x}, -2) when {x} like '%s' and {x} not like '%''s' then left({x}, -1) else {x} end"""


_ONE_SQL = "case w " + " ".join(f"when '{p}' then '{s}'" for p, s in V.IRREGULAR.items()) + f" else {_regular_sql('w')} end"
_TAIL_SQL = (
    "case " + " ".join(f"when j like '%{p}' then left(j, -{len(p)}) || '{s}'" for p, s in sorted(V.IRREGULAR.items(), key=lambda x: (-len(x[0]), x[0])))
    + f" when regexp_matches(j, '({'|'.join(sorted({v for v in V.IRREGULAR.values() if v.endswith('s')}))})$') then j else {_regular_sql('j')} end"
)


def _phrases(spark, d):
    """Part names, their words in both numbers, and the words of the benchmark."""
    names = table(spark, d, "part").select(F.col("p_name").alias("phrase"))
    w = names.select(F.explode(F.split("phrase", " ")).alias("phrase"))
    bench = table(spark, d, "benchmark").select(F.explode(T.words(T.letters_norm(F.col("text")))).alias("phrase"))
    return names.union(w).union(w.select(F.concat("phrase", F.lit("s")))).union(bench).where("length(phrase) > 1").distinct()


@query(f"""with recursive n as (select p_name as phrase from part), w as (select unnest(string_split(phrase, ' ')) as phrase from n),
p as materialized (select distinct phrase, replace(phrase, ' ', '') as j, string_split(phrase, ' ') as ws from (select * from n union select * from w union select phrase || 's' from w union select unnest({split(letters('text'))}) from benchmark) where length(phrase) > 1),
k as materialized (select phrase, array_to_string([{_ONE_SQL} for w in ws], ' ') as key, {_TAIL_SQL} as canonical from p),
h as materialized (select key, min(phrase) as hub, string_split(key, ' ') as ks from k group by key), c as (select canonical, min(phrase) as hub from k group by canonical),
e as (select phrase as a, hub as b from k join h using (key) union select phrase, hub from k join c using (canonical)
union select x.phrase, y.phrase from p x join p y on y.phrase = left(x.phrase, -1) where x.phrase like '%s' and length(x.ws[-1]) > 2 union select x.phrase, y.phrase from p x join p y on y.phrase = left(x.phrase, -2) where x.phrase like '%es' and length(x.ws[-1]) > 3
union select s.hub, h.hub from (select hub, array_to_string(ks[i:i + l - 1], ' ') as key from h, (select unnest(range(1, 9)) as i), (select unnest(range(1, 9)) as l) where i + l - 1 <= len(ks)) s join h using (key)),
both_ as materialized (select a, b from e where a <> b union select b, a from e where a <> b),
r as (select phrase as a, phrase as b from p union select r.a, x.b from r join both_ x on x.a = r.b), l as (select a as phrase, min(b) as label from r group by 1),
g as (select label, min(canonical) as grp from l join k using (phrase) group by label)
select phrase, grp as "group", case when left(sha256('vocabulary' || chr(10) || grp), 16) < 'c000000000000000' then 'targeted' else 'heldout' end as side from l join g using (label)""")
def d7_phrase_groups(spark, d):
    """Phrases by groups of plurals, nested phrases and spellings, and the side of each group."""
    terms = _phrases(spark, d).select(F.lit("all").alias("domain"), F.xxhash64("phrase").alias("position"), F.col("phrase").alias("term"))
    out = V.split(terms, ["all"], share=0.75, salt="vocabulary", normal=lambda c: c)
    return out.where("state = 'kept'").select("phrase", "group", "side")


@query(f"""with b as (select {split(letters('text'))} as w from benchmark), s as (select distinct array_to_string(w[i:i + 2], '') as surface from b, lateral (select unnest(range(1, len(w) - 1)) as i)),
m as (select max(length(surface)) as most from s), c as (select doc_id, w, array_to_string(w, '') as joined from ({WORDS_SQL})),
o as (select doc_id, i, n, sum(n) over (partition by doc_id order by i)::int as e from (select doc_id, unnest([length(x) for x in w]) as n, generate_subscripts(w, 1)::int as i from c)),
t as (select doc_id, joined, es from c join (select doc_id, list(e order by i) as es from o group by 1) using (doc_id)),
r as (select doc_id, joined, e - n as a, es[k] as b from o join t using (doc_id), m, lateral (select unnest(range(i, least(i + most, len(es)) + 1)) as k) where es[k] - (e - n) <= most)
select distinct doc_id from r where substr(joined, a + 1, b - a) in (select surface from s)""")
def x32_any_runs(spark, d):
    """Documents in which words in a row, of any number, joined are three joined words of the benchmark."""
    forms = table(spark, d, "benchmark").select(F.explode(T.grams(T.words(T.letters_norm(F.col("text"))), 3)).alias("g")).select(F.replace("g", F.lit(" "), F.lit("")).alias("form"))
    return V.holding(words(spark, d).select("doc_id", "w"), "w", forms, "form").select("doc_id")


@query("""select doc_id, case when l.doc_id is null then 'missing' when quality = 0 then 'rejected' else 'kept' end as state, case when quality > 0 then quality end as label
from documents left join labels l using (doc_id)""")
def sk6_label_index(spark, d):
    """Labels of documents from an index written for them: only the documents are shuffled."""
    Q._shared_folder(spark.range(0))
    root = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/index"
    labels = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") > 0, F.col("quality")).alias("label"))
    parts = {"table": f"{d}/labels", "rule": "quality above 0", "use": uuid.uuid4().hex}
    index = I.load(spark, I.write(labels, root, parts, "doc_id", buckets=8), parts)
    return I.looked_up(table(spark, d, "documents").select("doc_id"), index, "doc_id", refuse=False).select("doc_id", "state", "label")


@query(f"""with s as (select len({split(norm('text'))}) as n, conv_id, turn from conversations), p as (select n, row_number() over (order by conv_id, turn) - 1 as place, count(*) over () as total from s where n > 0),
d as (select doc_id, len({split(norm('text'))}) as size from documents), e as (select doc_id, size, i, ('0x' || substr(md5('windows|' || doc_id || '|' || i), 1, 7))::bigint % (select count(*) from p) as place from d, (select unnest(range(4)) as i) where size >= 5),
w as (select doc_id, size, i, n, coalesce(sum(n) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as start from e join p using (place))
select doc_id, i, cast(start as bigint) as start, cast(least(n, size - start) as bigint) as length from w where size - start >= 5""")
def w31_drawn_windows(spark, d):
    """Up to four windows of each document, as long as turns of conversations drawn by hash."""
    count = lambda name, *keys: table(spark, d, name).select(*keys, T.n_words(T.simple_norm(F.col("text"))).alias("n"))
    return N.drawn_windows(count("documents", "doc_id"), "doc_id", "n", count("conversations", "conv_id", "turn"), "n", F.expr("conv_id div 1024"), ["conv_id", "turn"], least=5)


@query(f"""with c as (select l_suppkey::varchar as c, l_linenumber::varchar as r, avg(l_extendedprice) as v from lineitem group by all), b as (select unnest(range(-1, 40)) as b),
m as (select b, c, sum(case when b < 0 then 1 else {S.poisson_sql("'r' || r", "b::varchar", "duck")} end * v) / nullif(sum(case when b < 0 then 1 else {S.poisson_sql("'r' || r", "b::varchar", "duck")} end), 0) as m from c, b group by b, c),
w as (select b, m, case when b < 0 then 1 else {S.poisson_sql("'c' || c", "b::varchar", "duck")} end as w from m)
select b as draw, round(quantile_cont(m, 0.5), 6) as statistic from w, lateral (select unnest(range(w)) as copy) group by b""")
def ts13_crossed_bootstrap(spark, d):
    """Median over suppliers of means over line numbers, in 40 draws of both."""
    out = S.crossed_bootstrap(table(spark, d, "lineitem"), "l_suppkey", "l_linenumber", "l_extendedprice", 40)
    return out.select("draw", F.round("statistic", 6).alias("statistic"))
