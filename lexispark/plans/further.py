"""Queries of rewriting rules, duplicates, quotas, mixtures and reports; SQL stands beside those that it can express."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import align
from ..functions import cleaning as C
from ..functions import respelling as Y
from ..functions import text as T
from ..operators import decontaminate as D
from ..operators import duplicates as N
from ..operators import filters as R
from ..operators import greedy as G
from ..operators import statistics as S
from ..streaming import mixer as M
from .core import _ENDS, _STOP, letters, norm, query, split, table
from .transcripts import _pairs

# Statistics

_CELLS = "select l_returnflag as r, l_linenumber as c, avg(l_quantity) as y from lineitem group by all"


@query(f"""with cells as ({_CELLS}), n as (select count(distinct r) as nr, count(distinct c) as nc, avg(y) as m from cells),
e as (select y, avg(y) over (partition by r) as yr, avg(y) over (partition by c) as yc, nr, nc, m from cells, n)
select round(sqrt(sum((yr - m) ** 2) / max(nr - 1) / max(nc)), 9) as sigma_row, round(sqrt(sum((yc - m) ** 2) / max(nc - 1) / max(nr)), 9) as sigma_column,
round(sqrt(sum((y - yr - yc + m) ** 2) / max((nr - 1) * (nc - 1))), 9) as sigma_noise from e""")
def ts14_variance_components(spark, d):
    cells = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("r"), F.col("l_linenumber").alias("c")).agg(F.avg("l_quantity").alias("y"))
    return S.variance_components(cells, "r", "c", "y").select(*(F.round(x, 9).alias(x) for x in ("sigma_row", "sigma_column", "sigma_noise")))


_POINTS = "select l_linenumber as x, count(*) as y from lineitem group by 1"


@query(f"""with p as ({_POINTS}), l as (select max(x) as lx, arg_max(y, x) as ly from p),
f as (select ly, lx, count(*) as n, regr_slope(ln(y), ln(x)) as exponent, exp(regr_intercept(ln(y), ln(x))) as factor from p, l where x < lx group by all)
select n, round(exponent, 9) as exponent, round(factor, 6) as factor, ly as withheld, round(factor * lx ** exponent, 6) as predicted, round(factor * lx ** exponent / ly - 1, 9) as off from f""")
def b8_withheld_fit(spark, d):
    fit = S.power_law(table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("x")).agg(F.count("*").alias("y")), "x", "y")
    return fit.select("n", F.round("exponent", 9).alias("exponent"), F.round("factor", 6).alias("factor"), "withheld", F.round("predicted", 6).alias("predicted"), F.round("off", 9).alias("off"))


@query("""with m as (select event_type as model, user_id % 5 as part, avg(case when value > 20 then 1.0 else 0.0 end) as rate, count(*) as n from events group by all),
r as (select part, rate as base from m where model = 'view')
select part, model, n, round(rate, 9) as rate, round(rate - base, 9) as delta, case when model = 'view' then 'reference' when part < 3 then 'clean' else 'noisy' end as panel,
abs(rate - base) > 0.05 and n >= 20 as flagged from m left join r using (part)""")
def a20_profile_panels(spark, d):
    """Rates by model and part beside the reference model's, with the part's panel and a flag for large differences."""
    m = table(spark, d, "events").groupBy(F.col("event_type").alias("model"), (F.col("user_id") % 5).alias("part"))
    m = m.agg(F.avg(F.when(F.col("value") > 20, 1.0).otherwise(0.0)).alias("rate"), F.count("*").alias("n"))
    base = F.max(F.when(F.col("model") == "view", F.col("rate"))).over(W.partitionBy("part"))
    panel = F.when(F.col("model") == "view", "reference").when(F.col("part") < 3, "clean").otherwise("noisy")
    m = m.withColumn("delta", F.col("rate") - base)
    return m.select("part", "model", "n", F.round("rate", 9).alias("rate"), F.round("delta", 9).alias("delta"), panel.alias("panel"), ((F.abs("delta") > 0.05) & (F.col("n") >= 20)).alias("flagged"))


_TERMS = ("the", "and", "on", "la", "que")
_TURNS = f"(select conv_id, turn, {split(norm('text'))} as w from conversations)"


@query(f"""with p as (select term, len(list_filter(a.w, lambda x: x = term)) as ref, len(list_filter(b.w, lambda x: x = term)) as hyp
from {_TURNS} a join {_TURNS} b on a.conv_id = b.conv_id and b.turn = a.turn + 1, (select unnest({list(_TERMS)}) as term))
select term, cast(sum(ref) as bigint) as ref, cast(sum(hyp) as bigint) as hyp, cast(sum(least(ref, hyp)) as bigint) as both,
round(sum(least(ref, hyp)) / nullif(sum(hyp), 0), 9) as "precision", round(sum(least(ref, hyp)) / nullif(sum(ref), 0), 9) as recall from p group by term""")
def a30_term_precision(spark, d):
    """Whole words of a turn and the next one, matched by their counts."""
    p = _pairs(spark, d).select(T.words(F.col("ref")).alias("v"), T.words(F.col("hyp")).alias("w"), F.explode(F.array(*map(F.lit, _TERMS))).alias("term"))
    n = lambda c: F.size(F.filter(c, lambda x: x == F.col("term"))).cast("long")
    p = p.select("term", n("v").alias("ref"), n("w").alias("hyp")).withColumn("both", F.least("ref", "hyp"))
    sums = p.groupBy("term").agg(*(F.sum(c).alias(c) for c in ("ref", "hyp", "both")))
    return sums.select("*", F.round(F.try_divide("both", "hyp"), 9).alias("precision"), F.round(F.try_divide("both", "ref"), 9).alias("recall"))


@query(f"""with p as (select a.conv_id % 7 as part, len(a.w) as ref, len(b.w) as one, len(c.w) as two from {_TURNS} a join {_TURNS} b on b.conv_id = a.conv_id and b.turn = a.turn + 1 join {_TURNS} c on c.conv_id = a.conv_id and c.turn = a.turn + 2),
g as (select *, one > 1.5 * ref + 10 as bad_one, two > 1.5 * ref + 10 as bad_two, greatest(3, cast(ceil(0.01 * count(*) over (partition by part)) as bigint)) as allowance from p)
select part, count(*) as clips, count(*) filter (bad_one) as rejected_one, count(*) filter (bad_two) as rejected_two, max(allowance) as allowance, count(*) filter (bad_one or bad_two) as excluded,
cast(coalesce(sum(abs(one - ref)) filter (not (bad_one or bad_two)), 0) as bigint) as off_one, cast(coalesce(sum(abs(two - ref)) filter (not (bad_one or bad_two)), 0) as bigint) as off_two,
count(*) filter (bad_one) <= count(*) filter (bad_two) + max(allowance) as ok from g group by part""")
def a45_guarded_runs(spark, d):
    """Two runs against one reference on the clips whose length guard both pass; one may reject more by its allowance."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", T.n_words(T.simple_norm(F.col("text"))).alias("n"))
    at = lambda k, name: turns.select("conv_id", (F.col("turn") - k).alias("turn"), F.col("n").alias(name))
    p = turns.withColumnRenamed("n", "ref").join(at(1, "one"), ["conv_id", "turn"]).join(at(2, "two"), ["conv_id", "turn"])
    p = p.withColumn("bad_one", F.expr("one > 1.5 * ref + 10")).withColumn("bad_two", F.expr("two > 1.5 * ref + 10"))
    off = lambda c: F.coalesce(F.sum(F.when(~(F.col("bad_one") | F.col("bad_two")), F.abs(F.col(c) - F.col("ref")))), F.lit(0)).alias(f"off_{c}")
    out = p.groupBy((F.col("conv_id") % 7).alias("part")).agg(
        F.count("*").alias("clips"), F.count_if("bad_one").alias("rejected_one"), F.count_if("bad_two").alias("rejected_two"),
        F.greatest(F.lit(3).cast("long"), F.ceil(0.01 * F.count("*"))).alias("allowance"), F.count_if(F.expr("bad_one or bad_two")).alias("excluded"), off("one"), off("two"),
    )
    return out.withColumn("ok", F.col("rejected_one") <= F.col("rejected_two") + F.col("allowance"))


@query("""select doc_id, case when l.doc_id is null then 'missing' when quality = 0 then 'rejected' else 'kept' end as state, case when quality > 0 then quality end as label
from (select distinct doc_id from documents) left join labels l using (doc_id)""")
def j3_label_states(spark, d):
    """Each occurrence's label, null where it was rejected; what has no record at all is told apart (a build refuses it)."""
    store = table(spark, d, "labels").select("doc_id", "quality", F.lit(True).alias("found"))
    state = F.when(F.col("found").isNull(), "missing").when(F.col("quality") == 0, "rejected").otherwise("kept")
    return table(spark, d, "documents").select("doc_id").distinct().join(store, "doc_id", "left").select("doc_id", state.alias("state"), F.when(F.col("quality") > 0, F.col("quality")).alias("label"))


# Texts


def _label_sql(x: str) -> str:
    q = lambda s: s.replace("'", "''")
    x = f"translate({x}, '{q(''.join(T.QUOTES_AND_DASHES.values()))}', '{q(''.join(k * len(v) for k, v in T.QUOTES_AND_DASHES.items()))}')"
    x = f"translate({x}, '{T.BLANKED + T.DROPPED}', '{' ' * len(T.BLANKED)}')"
    for sign, said in T.SPOKEN_SIGNS.items():
        x = f"replace({x}, '{sign}', '{said}')"
    x = f"trim(regexp_replace({x}, '[\\s\\x{{85}}\\p{{Z}}]+', ' ', 'g'))"
    # without lookahead: a point that begins a decimal is set aside meanwhile
    x = f"regexp_replace({x}, ' \\.([0-9])', ' ' || chr(1) || '\\1', 'g')"
    return f"trim(replace(regexp_replace({x}, ' ([,?!:.])', '\\1', 'g'), chr(1), '.'))"


@query(f"select doc_id, {_label_sql('nfc_normalize(text)')} as text from documents")
def f6_label_text(spark, d):
    """Version 3 of the label mapping. The SQL has the canonical form only, which is the same for these tables' letters."""
    return table(spark, d, "documents").select("doc_id", T.label_text(align.nfkc("text")).alias("text"))


@query()
def x19_table_replacement(spark, d):
    """British spellings and contractions replaced in whole turns."""
    rules = {"colour": "color", "per cent": "%", "gonna": "going to", "que la": "que la", "on the": "upon the", "the": "ye", "’tis": "it is", "'tis": "it is"}
    return table(spark, d, "conversations").select("conv_id", "turn", Y.table_replacer(rules)("text").alias("x")).select("conv_id", "turn", "x.*")


@query()
def x23_punctuation_transfer(spark, d):
    """Each text without its marks and capitals gets them back from itself: what the rule can restore."""
    bare = F.lower(F.regexp_replace("text", "[.,?!:;]", ""))
    short = table(spark, d, "conversations").select("conv_id", "turn", Y.punctuation_transfer(bare, F.col("text")).alias("x"))
    return short.select("conv_id", "turn", "x.*")


@query()
def x34_pronunciation(spark, d):
    say = C.pronouncer({"sql": "sequel", "http": None, "the": "thee"})
    return table(spark, d, "pages").select("page_id", say("url").alias("x")).select("page_id", "x.*")


_WORDS = f"select distinct w as t from (select unnest({split(letters('text'))}) as w from documents) where length(w) >= 3 and w not in ({_STOP})"


@query(f"""with t as materialized ({_WORDS}), s as (select t as a, t as stem from t union select t, left(t, length(t) - 1) from t where right(t, 1) in ('e', 'y')),
c as (select a, stem || e as b from s, (select unnest([{_ENDS[1:-1]}]) as e)) select distinct a, b from c where b in (select t from t) and length(b) >= length(a) and a <> b""")
def x30_inflections(spark, d):
    """Words that are another word's inflection, which no pair rule may take: by the endings each stem may have."""
    t = table(spark, d, "documents").select(F.explode(T.words(T.letters_norm(F.col("text")))).alias("t")).where(f"length(t) >= 3 and t not in ({_STOP})").distinct()
    stems = F.when(F.substring("t", -1, 1).isin("e", "y"), F.array("t", F.expr("left(t, length(t) - 1)"))).otherwise(F.array("t"))
    made = t.select(F.col("t").alias("a"), F.explode(stems).alias("stem")).select("a", "stem", F.explode(F.expr(f"array{_ENDS}")).alias("e")).select("a", F.concat("stem", "e").alias("b"))
    return made.where("length(b) >= length(a) and a <> b").join(t.withColumnRenamed("t", "b"), "b", "left_semi").select("a", "b").distinct()


# Reports on aligned texts


@query()
def a21_formatted_metrics(spark, d):
    """By set: rates of formatted, case-sensitive and case errors, and each mark's precision, recall and F1."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("ref"))
    p = turns.join(turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ref").alias("hyp")), ["conv_id", "turn"])
    c = p.select((F.col("conv_id") % 5).alias("part"), C.formatted_counts("ref", "hyp").alias("c")).select("part", "c.*")
    sums = c.groupBy("part").agg(*(F.sum(k).alias(k) for k in C.FORMATTED_COUNTS))
    ratio = lambda a, b, name: F.round(F.try_divide(a, b), 9).alias(name)
    marks = [x for m in ("any", "stop", "comma", "question") for x in (
        ratio(F.col(f"both_{m}"), F.col(f"hyp_{m}"), f"precision_{m}"), ratio(F.col(f"both_{m}"), F.col(f"ref_{m}"), f"recall_{m}"),
        ratio(2 * F.col(f"both_{m}"), F.col(f"ref_{m}") + F.col(f"hyp_{m}"), f"f1_{m}"),
    )]
    return sums.select("part", ratio(F.col("format_errors"), F.col("format_words"), "formatted"), ratio(F.col("case_errors"), F.col("case_words"), "cased"), ratio(F.col("miscased"), F.col("matched"), "miscased"), *marks)


_PHRASES = {"que la": ["que le"], "on the": ["upon the", "on ye"], "the": [], "la": ["le"]}


def _occurrences(spark, d):
    p = _pairs(spark, d).withColumn("spans", align.phrase_matcher(list(_PHRASES))(T.words(F.col("ref"))))
    return p.select("conv_id", "turn", F.explode(C.reproduced(_PHRASES)("ref", "hyp", "spans")).alias("x")).select("conv_id", "turn", "x.*")


@query()
def x15_terms_reproduced(spark, d):
    return _occurrences(spark, d)


#: Units as they are said and as they are written, which count as the same after a number.
_UNITS = [["milligrams", "milligram", "mg"], ["milligrams per word", "mg w"]]


@query()
def x15_number_equivalents(spark, d):
    """Terms of a turn in the next one, behind doses that one says in words and the other in short, one in three without a number."""
    phrases = [*_PHRASES, "milligrams", "milligrams per word"]
    number = F.when(F.col("turn") % 3 != 0, F.col("turn").cast("string")).otherwise("some")
    dose = lambda unit, text: F.concat_ws(" ", number, F.when(F.col("conv_id") % 2 == 0, unit[0]).otherwise(unit[1]), text)
    p = _pairs(spark, d).withColumn("ref", dose(("milligrams", "milligrams per word"), "ref")).withColumn("hyp", dose(("mg", "mg w"), "hyp"))
    p = p.withColumn("spans", align.phrase_matcher(phrases)(T.words(F.col("ref"))))
    said = C.reproduced(_PHRASES, C.equivalent_forms(_UNITS, phrases))
    return p.select("conv_id", "turn", F.explode(said("ref", "hyp", "spans")).alias("x")).select("conv_id", "turn", "x.*")


@query()
def d8_pair_metrics(spark, d):
    """By phrase: how often it is said, another of its pair stands in its place, or the span is near in letters."""
    other = F.create_map(*(F.lit(x) for kv in {"the": "that", "la": "le", "on the": "on that", "que la": "que le"}.items() for x in kv))
    o = _occurrences(spark, d).withColumn("other", other[F.col("phrase")])
    swapped = F.array_contains(T.words(F.col("span")), F.element_at(T.words(F.col("other")), -1)) & ~F.col("reproduced")
    cap = F.greatest(F.lit(2), F.ceil(0.3 * F.length(F.replace("phrase", F.lit(" "), F.lit("")))))
    apart = F.levenshtein(F.replace("phrase", F.lit(" "), F.lit("")), F.replace("span", F.lit(" "), F.lit("")))
    o = o.withColumn("swapped", swapped).withColumn("near", ~F.col("reproduced") & ~F.col("swapped") & (apart <= cap))
    return o.groupBy("phrase").agg(F.count("*").alias("occurrences"), *(F.count_if(c).alias(c) for c in ("reproduced", "swapped", "near")), F.round(F.try_divide(F.count_if("reproduced"), F.count("*")), 9).alias("recall"))


@query()
def j17_edits_against_reference(spark, d):
    """Whether the words that a rule changes, and those it writes, are those of the reference there."""
    p = _pairs(spark, d)
    steps = p.select("conv_id", "turn", F.explode(align.alignment("ref", "hyp")).alias("s")).select("conv_id", "turn", "s.*").where("hyp in ('the', 'la')")
    new = F.when(F.col("hyp") == "the", "that").otherwise("le")
    side = F.when(F.col("ref").eqNullSafe(F.col("hyp")), "before").when(F.col("ref").eqNullSafe(new), "after").when(F.col("ref").isNull(), "inserted").otherwise("neither")
    return steps.groupBy(F.col("hyp").alias("edit"), side.alias("side")).agg(F.count("*").alias("n"))


# Duplicates, quotas, segments


def _sentences(spark, d):
    turns = table(spark, d, "conversations")
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.substring_index("text", "\n", 1).alias("label"), T.simple_norm(F.substring_index("text", "\n", 1)).alias("norm"))


@query()
def d6_keep_first(spark, d):
    """First lines of turns against each other and against the benchmark's texts, which were kept before."""
    prior = table(spark, d, "benchmark").select(T.simple_norm(F.col("text")).alias("norm"))
    return N.keep_first(_sentences(spark, d), "id", "norm", prior)


@query()
def f21_hygiene(spark, d):
    """The first of ten reasons that rejects a sentence, in their fixed order; duplicates are told among what passes the others."""
    w = T.words(F.col("norm"))
    has = lambda words: F.arrays_overlap(w, F.array(*map(F.lit, words)))
    rules = {
        "no_sentence": F.col("norm") == "", "form_symbols": ~T.covered(F.col("label"), "[A-Za-zÀ-ÿ0-9 .,;:?!'\"-]"), "form_length": ~F.size(w).between(3, 60),
        "tokenizer": ~T.covered(F.col("label"), "[ -ÿ]"), "no_target": F.length("norm") < 12, "medical": has(["dose", "tablet"]), "heldout_term": has(["heldout"]),
    }
    rows = _sentences(spark, d).withColumn("reason", R.first_reason(rules))
    passed = rows.where("reason is null").select("id", "norm")
    prior = table(spark, d, "benchmark").select("item_id", T.simple_norm(F.col("text")).alias("norm"))
    corpus = table(spark, d, "documents").select("doc_id", T.simple_norm(F.col("text")).alias("norm"))
    held = D.sentences_held(passed, corpus, "id", "doc_id").where("contained").select("id", F.lit("denylist").alias("denied"))
    passed = passed.join(held, "id", "left")
    told = N.keep_first(passed.where("denied is null"), "id", "norm", prior).withColumnRenamed("reason", "copy")
    out = rows.join(held, "id", "left").join(told, "id", "left")
    return R.funnel(out.withColumn("reason", F.coalesce("reason", "denied", "copy")))


@query()
def w28_quota_fill(spark, d):
    """Orders as sentences, suppliers' classes as groups: orders of a pair first, then each by its target's quota."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_suppkey") % 40)).alias("groups"), F.min("l_linenumber").alias("k"))
    rows = lines.withColumn("order", F.concat(F.sha2(F.concat_ws("|", F.lit("select"), "l_orderkey"), 256), F.col("l_orderkey").cast("string")))
    rows = rows.withColumn("pair", F.when(F.col("l_orderkey") % 5 == 0, F.col("l_orderkey") % 20)).withColumn("target", F.col("l_orderkey") % 40)
    pairs = rows.where("pair is not null").withColumn("needs", F.array("pair"))
    first = G.contrast_fill(pairs, "l_orderkey", "order", "pair", "needs", "groups", 10)
    counted = pairs.join(first.where("decision = 'selected'"), "l_orderkey").select(F.explode("groups").alias("group")).groupBy("group").agg(F.count("*").alias("n"))
    quotas = rows.select(F.explode("groups").alias("group")).distinct().withColumn("n", 20 + F.col("group"))
    return first.unionByName(G.quota_fill(rows.where("pair is null"), quotas, "l_orderkey", "order", "target", "groups", counted))


@query()
def w22_segments(spark, d):
    """A user's events of a month as units of a recording, as long as their values in minutes."""
    units = table(spark, d, "events").select("user_id", F.date_format("ts", "yyyy-MM").alias("month"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("start"), "value")
    units = units.select("user_id", "month", (F.col("start") / 1e6).alias("start"), (F.col("start") / 1e6 + 60 * F.least("value", F.lit(30.0))).alias("end"))
    return G.segments(units, ["user_id", "month"], "start", "end", target=7200.0, limit=14400.0, least=600.0)


# Mixtures


@query("""with s as (select event_type, n, row_number() over (order by event_type) as k from (select event_type, count(*) as n from events group by 1)),
b as (select event_type, n, (sum(k) over (order by event_type) - k) / sum(k) over () as lo, sum(k) over (order by event_type) / sum(k) over () as hi from s),
t as (select i as draw, event_type, n, row_number() over (partition by event_type order by i) - 1 as turn
from (select i, ('0x' || substr(md5('mix|' || i), 1, 7))::bigint / 268435456.0 as u from (select unnest(range(20000)) as i)) join b on u >= lo and u < hi),
p as (select *, turn // n as pass, turn % n as place from t),
i as (select event_type, event_id, pass, row_number() over (partition by event_type, pass order by sha256('mix|' || pass || '|' || event_type || '|' || event_id), event_id) - 1 as place
from events join (select event_type, unnest(range(max(pass) + 1)) as pass from p group by 1) using (event_type))
select draw, event_type, pass, event_id from p join i using (event_type, pass, place)""")
def st1_mixed_sources(spark, d):
    """20,000 draws of a mixture of event types, shares as 1, 2, 3, ... of their sum."""
    e = table(spark, d, "events").select("event_type", "event_id")
    shares = e.select("event_type").distinct().withColumn("share", F.row_number().over(W.orderBy("event_type")))  # a row for each source
    return M.mixed(e, shares, "event_type", "event_id", 20_000)


@query("""with f as (select source, (row_number() over (order by sha256('slot|' || source), source) - 1) // 4 as turn from (select distinct source from documents))
select doc_id, source, turn, row_number() over (partition by turn order by sha256('slot|' || turn || '|' || doc_id), doc_id) - 1 as place from documents join f using (source)""")
def st2_slot_shuffle(spark, d):
    """Sources as files in seeded order, four open at a time."""
    return M.slot_shuffled(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 4).select("doc_id", "source", F.col("turn").cast("long").alias("turn"), F.col("place").cast("long").alias("place"))
