"""Secret scans with multipart credential linking, in DataFrame functions only.

Base spans are the leftmost non-overlapping matches of three kinds (assign, access, hex; see ``BASE``). The method adds
weak candidates, each a part of a credential: a secret (a password-like name with a short value), an identifier (a user,
account or short access key) or an endpoint (a URL with a host, a named host). A weak candidate is reported only where a
complementary part, weak or base, lies within ``SCOPE`` code points in the same text: a secret needs an identifier or an
endpoint and these need a secret. Complements are found by an interval join: every part's interval is dealt to the
blocks of ``SCOPE`` code points that it touches, blocks are joined by equality, and the intervals' distance decides; as
it is a semi join, no pairs are made.

Positions are code points, ends exclusive. Null and empty texts have no spans. Rows repeat as in the input (equal rows
get equal results), a null key stays null, empty tables give empty results, and only key and text are read; ``redact``
keeps the other columns as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SCOPE = 200
#: The kinds in their order, with pattern and least code points of the match (or of the value, for assign).
BASE = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12),
    "access": (r"AKIA[A-Z0-9]+", 18),
    "hex": (r"[0-9a-f]+", 16),
}
#: Runs that fail for their length can't hold a longer match, so these patterns give the same spans at once.
_SCAN = {"assign": BASE["assign"][0], "access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}
WEAK = {
    "secret": r"""(?i:pass|pwd|passphrase|credential|auth|private_?key|signature)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}""",
    "identifier": r"""(?i:user_?name|user_?id|user|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{3,}""",
    "endpoint": r"""(?i:https?|ftp|ssh|jdbc|postgresql|postgres|mysql|redis|mongodb|amqp)://[A-Za-z0-9._:@-]+|(?i:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{3,}""",
}
#: Values of an assign match that are too short for a base span but long enough for a weak secret.
SHORT = (6, 11)
KINDS = [*BASE, *WEAK]
_SPAN = "struct<start: bigint, ord: int, kind: string, stop: bigint>"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Matches whose spans are gathered at once; a text's matches are taken in such blocks, so that time grows in proportion.
BLOCK = 128


def _let(name: str, value: str, body: str) -> str:
    """SQL in which a value is computed once and named."""
    return f"transform(array(struct({value})), {name} -> {body})[0]"


def _matches(kind: str, pattern: str) -> Column:
    """The matches of a pattern in ``text`` as spans: each starts after the pieces and matches before it.

    Lengths are summed by blocks of matches, the blocks' sums are added up, and each block gathers its own spans.
    """
    p, empty, last = _quoted(pattern), f"cast(array() as array<{_SPAN}>)", "size(x.found) - 1"
    blocks = f"sequence(0, ({last}) div {BLOCK})"
    step = f"""(acc, i) -> struct(
        acc.at + length(y.pieces[i]) + length(x.found[i]) as at,
        concat(acc.out, array(struct(acc.at + length(y.pieces[i]) as start, {KINDS.index(kind)} as ord, '{kind}' as kind, acc.at + length(y.pieces[i]) + length(x.found[i]) as stop))) as out)"""
    spans = f"flatten(transform({blocks}, b -> aggregate(sequence(b * {BLOCK}, least(b * {BLOCK} + {BLOCK - 1}, {last})), struct(o.ends[b] as at, {empty} as out), {step}, acc -> acc.out)))"
    ends = f"aggregate({blocks}, array(0L), (acc, b) -> concat(acc, array(element_at(acc, -1) + aggregate(slice(z.sizes, b * {BLOCK} + 1, {BLOCK}), 0L, (a, n) -> a + n)))) as ends"
    sizes = f"transform(sequence(0, {last}), i -> cast(length(y.pieces[i]) + length(x.found[i]) as bigint)) as sizes"
    # ``split`` runs only for texts with a match
    some = _let("y", f"split(text, {p}, -1) as pieces", _let("z", sizes, _let("o", ends, spans)))
    return F.expr(_let("x", f"regexp_extract_all(text, {p}, 0) as found", f"if(size(x.found) = 0, {empty}, {some})"))


def parts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, row, key, base, weak): each row and the base spans and weak candidates of its text, in order."""
    out = docs.select(F.struct("*").alias("doc"), F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    value = f"length(regexp_extract(substring(text, cast(s.start as int) + 1, cast(s.stop - s.start as int)), {_quoted(BASE['assign'][0])}, 1))"
    out = out.select("doc", "key", "text", *(_matches(k, p).alias(f"m_{k}") for k, p in (_SCAN | WEAK).items()))
    out = out.withColumn("m_assign", F.expr(f"transform(m_assign, s -> struct(s, {value} as n))"))
    none = f"cast(array() as array<{_SPAN}>)"
    base = f"array_sort(concat(transform(filter(m_assign, x -> x.n >= {BASE['assign'][1]}), x -> x.s), m_access, m_hex, {none}))"
    short = f"transform(filter(m_assign, x -> x.n between {SHORT[0]} and {SHORT[1]}), x -> struct(x.s.start as start, {KINDS.index('secret')} as ord, 'secret' as kind, x.s.stop as stop))"
    row = F.sha2(F.concat_ws(":", F.coalesce(F.col("key").cast("string"), F.lit("")), "text"), 256).alias("row")
    return out.select("doc", row, "key", F.expr(base).alias("base"), F.expr(f"array_sort(array_distinct(concat({short}, m_secret, m_identifier, m_endpoint, {none})))").alias("weak"))


def _role(kind: str) -> str:
    return f"case when {kind} in ('assign', 'hex', 'secret') then 'secret' when {kind} in ('access', 'identifier') then 'identifier' else 'endpoint' end"


def link(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``found`` (row, base, weak) with ``linked``: the weak candidates that have a complement within ``scope``."""
    some = "exists(concat(base, weak), p -> {0} = 'secret') and exists(concat(base, weak), p -> {0} <> 'secret')".format(_role("p.kind"))
    able = F.expr(f"size(weak) > 0 and {some}")
    cut = lambda lo, hi: f"explode(sequence(({lo}) div {scope}, ({hi}) div {scope})) as block"
    hot = found.where(able)
    every = hot.selectExpr("row", "explode(concat(base, weak)) as p").selectExpr("row", "p", f"{_role('p.kind')} as role")
    every = every.selectExpr("row", "p.start as a", "p.stop as b", "role", cut("p.start", "p.stop"))
    mine = hot.selectExpr("row", "explode(weak) as p").selectExpr("row", "p", f"{_role('p.kind')} as role", cut(f"greatest(p.start - {scope}, 0L)", f"p.stop + {scope}"))
    x, y = mine.alias("x"), every.alias("y")
    near = F.expr(f"x.row = y.row and x.block = y.block and y.a <= x.p.stop + {scope} and y.b + {scope} >= x.p.start and (x.role = 'secret') <> (y.role = 'secret')")
    held = x.join(y, near, "left_semi").groupBy("row").agg(F.array_sort(F.collect_set("p")).alias("linked"))
    none = F.expr(f"cast(array() as array<{_SPAN}>)")
    joined = hot.join(held, "row", "left").withColumn("linked", F.coalesce("linked", none))
    return joined.unionByName(found.where(~able).withColumn("linked", none))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """(key, base, linked) for each row of ``docs``: base spans and linked weak candidates as (start, ord, kind, stop)."""
    found = common.stored(parts(docs, key, text).drop("doc"))
    # Equal rows share ``row`` and so each gets all of their links: sets make them one.
    return link(found, scope).select(F.col("key").alias(key), "base", "linked")


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every base and linked span of its text replaced by ``mark``; a length column follows its text.

    Only rows with weak candidates and a complement are shuffled.
    """
    found = common.stored(parts(docs, key, text).drop("key"))
    told = link(found).select("doc", F.expr(f"doc.`{text}`").alias("text"), F.expr("array_sort(concat(base, linked))").alias("__spans"))
    merged = """aggregate(__spans, cast(array() as array<struct<a: bigint, b: bigint>>), (acc, s) ->
        if(size(acc) > 0 and element_at(acc, -1).b >= s.start,
           concat(slice(acc, 1, size(acc) - 1), array(struct(element_at(acc, -1).a as a, greatest(element_at(acc, -1).b, s.stop) as b))),
           concat(acc, array(struct(s.start as a, s.stop as b)))))"""
    body = f"""concat(array_join(transform(__cuts, (c, i) -> concat(substring(text, cast(if(i = 0, 0L, __cuts[i - 1].b) as int) + 1, cast(c.a - if(i = 0, 0L, __cuts[i - 1].b) as int)), '{mark}')), ''),
        substring(text, cast(element_at(__cuts, -1).b as int) + 1))"""
    plain = F.expr("size(__spans) = 0")
    out = told.withColumn("__cuts", F.expr(merged)).withColumn("__new", F.when(plain, F.col("text")).otherwise(F.expr(body)))
    changed = {text: F.col("__new")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(plain, F.col("doc.n_chars")).otherwise(F.length("__new").cast(docs.schema["n_chars"].dataType))
    return out.select(*(changed.get(c, F.col("doc")[c]).alias(c) for c in docs.columns))


def _listed(spans: str) -> str:
    return f"concat_ws(',', transform({spans}, s -> concat_ws(':', s.kind, s.start, s.stop)))"


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans and linked weak candidates of every document."""
    found = scan(common.table(spark, sf_dir, "documents"))
    count = lambda k: F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}")
    return found.select(
        "doc_id", *(count(k) for k in BASE), F.sha2(F.expr(_listed("base")), 256).alias("base_sha256"),
        F.expr(_listed("array_sort(concat(base, linked))")).alias("spans"), F.size("linked").cast("long").alias("n_linked"),
    )


def _oracle() -> str:
    q = lambda p: "'" + p.replace("'", "''") + "'"

    def all_of(kind: str, pattern: str) -> str:
        return f"""select doc_id, {KINDS.index(kind)} as ord, '{kind}' as kind, m,
          cast(coalesce(sum(length(p) + length(m)) over w, 0) + length(p) as bigint) as a, cast(sum(length(p) + length(m)) over v as bigint) as b
          from (select doc_id, unnest(range(1, len(ms) + 1)) as i, unnest(ms) as m, unnest(ps[1:len(ms)]) as p
            from (select doc_id, regexp_extract_all(text, {q(pattern)}, 0) as ms, string_split_regex(text, {q(pattern)}) as ps from d) where len(ms) > 0)
          window w as (partition by doc_id order by i rows between unbounded preceding and 1 preceding), v as (partition by doc_id order by i rows unbounded preceding)"""

    value = f"length(regexp_extract(m, {q(BASE['assign'][0])}, 1))"
    role = "case when {0} in ('assign', 'hex', 'secret') then 1 else 0 end"
    return f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
assigned as ({all_of("assign", BASE["assign"][0])}),
base as (select doc_id, ord, kind, a, b from assigned where {value} >= 12
  union all select doc_id, ord, kind, a, b from ({all_of("access", BASE["access"][0])}) where b - a >= 18
  union all select doc_id, ord, kind, a, b from ({all_of("hex", BASE["hex"][0])}) where b - a >= 16),
weak as (select distinct * from (select doc_id, {KINDS.index("secret")} as ord, 'secret' as kind, a, b from assigned where {value} between {SHORT[0]} and {SHORT[1]}
  {" ".join(f"union all select doc_id, ord, kind, a, b from ({all_of(k, p)})" for k, p in WEAK.items())})),
every as (select *, {role.format("kind")} as secret from (select * from base union all select * from weak)),
linked as (select w.* from weak w where exists (select 1 from every e where e.doc_id = w.doc_id and e.secret <> {role.format("w.kind")}
  and e.a <= w.b + {SCOPE} and e.b + {SCOPE} >= w.a)),
listed as (select doc_id, 0 as extra, * exclude doc_id from base union all select doc_id, 1, * exclude doc_id from linked),
told as (select doc_id, count(*) filter (kind = 'assign' and extra = 0) as n_assign, count(*) filter (kind = 'access' and extra = 0) as n_access,
  count(*) filter (kind = 'hex' and extra = 0) as n_hex, count(*) filter (extra = 1) as n_linked,
  coalesce(string_agg(kind || ':' || a || ':' || b, ',' order by a, ord, b) filter (extra = 0), '') as base_text,
  string_agg(kind || ':' || a || ':' || b, ',' order by a, ord, b) as spans from listed group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base_text, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_linked, 0) as n_linked
from d left join told t on d.doc_id is not distinct from t.doc_id
"""


ORACLE = _oracle()
