"""Queries of deny-lists by held-out set, talks in two sets of labels and further gates, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decontaminate as D
from ..operators import gates as G
from .core import _FOUND, _HITS, WORDS_SQL, _corpus, norm, query, split, table, words

# Deny-lists by set: held-out items are dealt to three sets, and an item's id names a document

_SET_SQL = f"b as (select item_id, 'set' || (item_id % 3) as name, {split(norm('text'))} as w from benchmark)"


def _sets(spark, d):
    docs, held = _corpus(spark, d)
    name = F.concat(F.lit("set"), F.col("item_id") % 3)
    return docs, held.withColumn("name", name), held.select(name.alias("name"), F.col("item_id").alias("doc_id"))


@query(f"""{_FOUND}, {_HITS} select doc_id, array_to_string(list_sort(list(distinct rule)), ',') as rules from (select doc_id, 'containment' as rule from hits
union all select doc_id, 'reserved' from labels where toxic = 1 union all select item_id, 'identity' from benchmark) group by doc_id""")
def d1_identity(spark, d):
    """Recordings that are reserved, named by a held-out id or contain a held-out text."""
    docs, held, named = _sets(spark, d)
    out = D.denylist(docs, held, table(spark, d, "labels").where("toxic = 1"), "doc_id", "item_id", identity=named)
    return out.select("doc_id", F.array_join("rules", ",").alias("rules"))


@query(f"""{_FOUND}, {_HITS}, {_SET_SQL},
s as (select name, count(*) as utterances, count(*) filter (len(w) < 8) as skipped_short, count(*) filter (len(w) >= 8 and item_id not in (select item_id from u)) as skipped_empty,
count(*) filter (item_id in (select item_id from hits)) as contained_utterances from b group by name),
r as (select name, doc_id, true as held, false as named from hits join b using (item_id) union all select name, item_id, false, true from b),
q as (select name, doc_id, bool_or(held) as held, bool_or(named) as named from r group by name, doc_id),
n as (select name, count(*) filter (held) as containment_recordings, count(*) filter (named) as identity_recordings, count(*) as recordings from q group by name)
select *, utterances - skipped_short - skipped_empty as checked from s join n using (name)""")
def d1_set_report(spark, d):
    """What became of each held-out set's utterances, and the recordings that it denies by either rule."""
    docs, held, named = _sets(spark, d)
    return D.set_report(docs, held, named, "doc_id", "item_id", "name")


# Talks: four documents in a row are one recording, whose second set of labels leaves words out

_TALK_SQL = f"""with h as (select item_id, win, unnest(list_distinct([array_to_string(w[i:i + 7], ' ') for i in range(1, len(w) - 6)])) as gram
from (select item_id, i // 20 as win, w[i + 1:i + 20] as w from (select item_id, w, unnest(range(0, len(w), 20)) as i from (select item_id, {split(norm('text'))} as w from benchmark) where len(w) > 0)) where len(w) >= 8),
j as (select doc_id // 4 as rec, string_agg(text, ' ' order by doc_id) as full, string_agg(replace(text, ' the ', ' '), ' ' order by doc_id) as raw from documents group by 1),
r as (select rec, 'full' as label_set, {split(norm('"full"'))} as w from j union all select rec, 'raw', {split(norm('raw'))} from j),
g as (select * from (select label_set, rec, unnest(list_distinct([array_to_string(w[i:i + 7], ' ') for i in range(1, len(w) - 6)])) as gram from r where len(w) >= 8) where gram in (select gram from h)),
common as (select label_set, gram from g group by label_set, gram having count(*) > 100),
u as (select label_set, item_id, win, gram from (select h.*, l.label_set from h, (select 'full' as label_set union all select 'raw') l) where (label_set, gram) not in (select (label_set, gram) from common)),
n as (select label_set, item_id, win, count(*) as n from u group by label_set, item_id, win),
m as (select label_set, rec, item_id, win, count(*) as m, any_value(n) as n from g join u using (label_set, gram) join n using (label_set, item_id, win) group by label_set, rec, item_id, win),
near as (select rec, label_set, count(*) filter (m >= ceil(n * 0.5)) as windows, max(m / n) as closest from m group by rec, label_set)""".replace("as full,", 'as "full",')


def _talks(spark, d):
    rows = table(spark, d, "documents").select(F.expr("doc_id div 4").alias("rec"), "doc_id", "text", F.replace("text", F.lit(" the "), F.lit(" ")).alias("raw"))
    return rows, D.talks(rows, _corpus(spark, d)[1], "rec", "doc_id", {"full": "text", "raw": "raw"}, "item_id")


@query(f"{_TALK_SQL} select rec, label_set, windows, round(closest, 9) as closest from near")
def d2_label_sets(spark, d):
    """How near each recording comes to held-out talks in either set of labels."""
    return _talks(spark, d)[1].withColumn("closest", F.round("closest", 9))


@query(f"{_TALK_SQL} select doc_id, string_agg(label_set, ',' order by label_set) as label_sets from documents join near on doc_id // 4 = rec and windows > 0 group by doc_id")
def d2_rejected_ids(spark, d):
    """Every id of a recording that holds a window of a talk in either set of labels."""
    rows, near = _talks(spark, d)
    return D.rejected(rows, near, "rec", "doc_id").withColumn("label_sets", F.array_join("label_sets", ","))


# Gates

_HOURS = "select event_type, date_trunc('hour', ts) as hour, min(event_id) as first, max(event_id) + 1 as last from events group by 1, 2"


def _hours(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.min("event_id").alias("first"), (F.max("event_id") + 1).alias("last"))


@query(f"select event_type, first, last, expected from (select *, lag(last) over (partition by event_type order by first, last) as expected from ({_HOURS})) where expected <> first or last <= first")
def gate_shard_gaps(spark, d):
    """Hourly shards of a type that don't begin where the last one ends."""
    return G.gaps(_hours(spark, d), "first", "last", "event_type")


@query("""select l_orderkey, coalesce(max(last) filter (broken = 0), 0)::bigint as covered from (select *, max((expected <> first)::int) over (partition by l_orderkey order by first, last) as broken
from (select l_orderkey, l_linenumber - 1 as first, l_linenumber as last, coalesce(lag(l_linenumber) over (partition by l_orderkey order by l_linenumber), 0) as expected from lineitem)) group by l_orderkey having covered < 4""")
def gate_shard_reach(spark, d):
    """Orders whose lines, without a gap from the first, are fewer than four."""
    lines = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("first"), F.col("l_linenumber").alias("last"))
    return G.reach(lines, "first", "last", 4, "l_orderkey")


@query(f"select w as form, string_agg(distinct lang, ',' order by lang) as tables from (select lang, unnest(w) as w from ({WORDS_SQL})) group by w having count(distinct lang) > 1")
def gate_shared_forms(spark, d):
    """Words that the documents of more than one language have, as forms listed in more than one table."""
    forms = words(spark, d).select("lang", F.explode("w").alias("w"))
    return G.shared(forms, "lang", "w").withColumn("tables", F.array_join("tables", ","))


_SWAPS = f"select distinct w[i] || ' ' || w[i + 1] as written, w[i + 1] || ' ' || w[i] as output from (select w, unnest(range(1, len(w))) as i from (select {split(norm('text'))} as w from benchmark))"


@query(f"with f as ({_SWAPS}) select written, output, output as form from f where output in (select written from f where written <> output)")
def gate_unsettled_forms(spark, d):
    """Pairs of words written the other way round where that is a listed form too, so that a second pass would undo the first."""
    w = _corpus(spark, d)[1].select(F.filter(F.split("norm", " "), lambda x: x != "").alias("w"))
    i = w.where("size(w) > 1").select("w", F.explode(F.sequence(F.lit(0), F.size("w") - 2)).alias("i"))
    a, b = F.get("w", F.col("i")), F.get("w", F.col("i") + 1)
    return G.unsettled(i.select(F.concat_ws(" ", a, b).alias("written"), F.concat_ws(" ", b, a).alias("output")), "written", "output")
