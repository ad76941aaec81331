"""Vocabularies of terms: variants, plurals and nested phrases stay on one side of a split, held-out surfaces are found."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import gates
from .sequences import components, stored

#: Irregular plurals, and endings that are no plural's.
IRREGULAR = {
    "matrices": "matrix", "vertices": "vertex", "indices": "index", "indexes": "index", "appendices": "appendix", "radii": "radius",
    "nuclei": "nucleus", "foci": "focus", "loci": "locus", "criteria": "criterion", "phenomena": "phenomenon", "polyhedra": "polyhedron",
    "data": "datum", "analyses": "analysis", "hypotheses": "hypothesis", "theses": "thesis", "bases": "basis", "axes": "axis",
    "syntheses": "synthesis", "parentheses": "parenthesis", "ellipses": "ellipsis", "spectra": "spectrum", "maxima": "maximum",
    "minima": "minimum", "optima": "optimum", "formulae": "formula", "lemmata": "lemma", "schemata": "schema", "corpora": "corpus",
    "genera": "genus", "media": "medium", "quanta": "quantum", "moduli": "modulus", "tori": "torus", "simplices": "simplex",
    "apices": "apex", "children": "child", "men": "man", "women": "woman", "mice": "mouse", "feet": "foot", "teeth": "tooth",
    "geese": "goose", "people": "person", "gases": "gas", "lenses": "lens", "biases": "bias", "buses": "bus", "viruses": "virus",
    "statuses": "status", "aliases": "alias", "atlases": "atlas", "canvases": "canvas",
}
NO_PLURAL = ("ss", "us", "is", "ics", "sis", "xis")


def _without(word: Column, n: int) -> Column:
    return F.left(word, F.length(word) - n)


def _regular(word: Column) -> Column:
    return (
        F.when((F.length(word) <= 3) | word.rlike(f"({'|'.join(NO_PLURAL)})$"), word)
        .when(word.endswith("ies") & (F.length(word) > 4), F.concat(_without(word, 3), F.lit("y")))
        .when(word.rlike("(ches|shes|sses|xes|zes)$"), _without(word, 2))
        .when(word.rlike("(?<!')s$"), _without(word, 1))
        .otherwise(word)
    )


def singular(word: Column) -> Column:
    """A word's form for grouping: plurals of one word share it."""
    known = F.create_map(*(F.lit(x) for kv in IRREGULAR.items() for x in kv))
    return F.coalesce(F.try_element_at(known, word), _regular(word))


def canonical(words: Column) -> Column:
    """The words joined, the last one singular as far as the letters tell: the same for joined and split spellings."""
    return T.let(F.array_join(words, ""), _singular_tail)


def _singular_tail(joined: Column) -> Column:
    out = None
    for plural in sorted(IRREGULAR, key=lambda p: (-len(p), p)):
        fits, new = joined.endswith(plural), F.concat(_without(joined, len(plural)), F.lit(IRREGULAR[plural]))
        out = F.when(fits, new) if out is None else out.when(fits, new)
    done = "|".join(sorted({v for v in IRREGULAR.values() if v.endswith("s")}))
    return out.when(joined.rlike(f"({done})$"), joined).otherwise(_regular(joined))


def surfaces(key: Column) -> Column:
    """What a canonical key may look like in a text, joined: itself and its regular and irregular plurals."""
    odd = [F.when(key.endswith(one), F.concat(_without(key, len(one)), F.lit(many))) for many, one in IRREGULAR.items()]
    y = F.when(key.endswith("y"), F.concat(_without(key, 1), F.lit("ies")))
    return F.array_distinct(F.array_compact(F.array(key, F.concat(key, F.lit("s")), F.concat(key, F.lit("es")), y, *odd)))


def runs(words: Column, most: int | None = None) -> Column:
    """Every run of consecutive words, joined by spaces, of up to ``most`` words."""
    n = F.size(words)
    last = (lambda i: n - i) if most is None else (lambda i: F.least(n - i, F.lit(most)))
    each = lambda i: F.transform(F.sequence(F.lit(1), last(i)), lambda k: F.array_join(F.slice(words, i + 1, k), " "))
    return F.when(n > 0, F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), n - 1), each)))).otherwise(F.array().cast("array<string>"))


def grouped(phrases: DataFrame) -> DataFrame:
    """(phrase, group) of distinct phrases (words parted by one space): one group for plurals, nested phrases and variants.

    Edges lead from each phrase to the least one of its key, so a key of many phrases gives no pairs; runs of words inside a
    phrase find the phrases nested in it by an equi-join. A group is named by its least canonical key.
    """
    words = F.split("phrase", " ")
    p = stored(phrases.select("phrase").distinct().withColumn("key", F.array_join(F.transform(words, singular), " ")).withColumn("canonical", canonical(words)))
    hub = stored(p.groupBy("key").agg(F.min("phrase").alias("hub")))
    edges = p.join(hub, "key").select(F.col("phrase").alias("a"), F.col("hub").alias("b"))
    same = p.groupBy("canonical").agg(F.min("phrase").alias("b"))
    edges = edges.union(p.join(same, "canonical").select(F.col("phrase").alias("a"), "b"))
    tail = F.element_at(words, -1)
    for cut, ending in ((1, "s"), (2, "es")):
        short = p.where(tail.endswith(ending) & (F.length(tail) > cut + 1)).select(F.col("phrase").alias("a"), _without(F.col("phrase"), cut).alias("b"))
        edges = edges.union(short.join(p.select(F.col("phrase").alias("b")), "b", "left_semi").select("a", "b"))
    inner = hub.select(F.col("hub").alias("a"), F.explode(runs(F.split("key", " "))).alias("key")).join(hub, "key").select("a", F.col("hub").alias("b"))
    label = components(edges.union(inner).where("a <> b").distinct())
    named = p.join(label, p["phrase"] == label["node"], "left").select("phrase", "canonical", F.coalesce("label", "phrase").alias("label"))
    names = named.groupBy("label").agg(F.min("canonical").alias("group"))
    return named.join(names, "label").select("phrase", "group")


def split(terms: DataFrame, domains: list[str], excluded: DataFrame | None = None, share: float = 0.75, salt: str = "split", normal: Callable[[Column], Column] = T.simple_norm) -> DataFrame:
    """(domain, position, term, phrase, state, owner, group, side) of every term of ``terms`` (domain, position, term).

    ``state`` is ``dropped`` (nothing or one character is left of it), ``excluded`` (a phrase of ``excluded`` stands in it),
    ``repeated`` (its phrase is listed before in the domain), ``duplicate`` (in an earlier domain) or ``kept``. ``owner`` is the
    first domain, in the order of ``domains``, that lists one of its joined spellings. Sides belong to groups, so no group has
    two: ``targeted`` where the group's hash is below ``share``, else ``heldout``. Unknown domains and null positions are refused.
    """
    gates.expect_empty(terms.where(~F.coalesce(F.col("domain").isin(domains), F.lit(False)) | F.col("position").isNull()).select("domain", "position"), "unknown domains or positions")
    rank = F.array_position(F.array(*map(F.lit, domains)), F.col("domain"))
    rows = terms.select("domain", "position", "term", T.words(normal(F.coalesce("term", F.lit("")))).alias("words"))
    rows = stored(rows.select("domain", "position", "term", F.array_join("words", " ").alias("phrase"), rank.alias("rank")))
    state = F.when(F.length("phrase") <= 1, "dropped")
    if excluded is not None:
        bad = excluded.select(F.array_join(T.words(normal(F.col(excluded.columns[0]))), " ").alias("run")).where("run <> ''").distinct()
        hit = rows.select("phrase", F.explode(runs(F.split("phrase", " "))).alias("run")).join(bad, "run", "left_semi").select("phrase").distinct().withColumn("bad", F.lit(True))
        rows, state = rows.join(hit, "phrase", "left"), state.when(F.col("bad"), "excluded")
    rows = stored(rows.withColumn("state", state).drop("bad"))
    first = rows.where("state is null").groupBy("phrase").agg(F.min(F.struct("rank", "position", "term")).alias("first"))
    joined = first.groupBy(F.replace("phrase", F.lit(" "), F.lit("")).alias("joined")).agg(F.min("first.rank").alias("owner"))
    first = first.withColumn("joined", F.replace("phrase", F.lit(" "), F.lit(""))).join(joined, "joined")
    side = F.when(F.left(F.sha2(F.concat(F.lit(salt + "\n"), F.col("group")), 256), F.lit(16)) < F.lit(f"{min(int(share * 2**64), 2**64 - 1):016x}"), "targeted").otherwise("heldout")
    first = first.join(grouped(first.select("phrase")), "phrase").withColumn("side", side)
    both = rows.join(first.select("phrase", "first", "owner", "group", "side"), "phrase", "left")
    own = F.struct("rank", "position", "term") == F.col("first")
    told = F.coalesce("state", F.when(own, "kept").when(F.col("rank") == F.col("first.rank"), "repeated").otherwise("duplicate"))
    owner = F.get(F.array(*map(F.lit, domains)), F.col("owner").cast("int") - 1)
    kept = lambda c: F.when(told == "kept", c)
    return both.select("domain", "position", "term", "phrase", told.alias("state"), kept(owner).alias("owner"), kept(F.col("group")).alias("group"), kept(F.col("side")).alias("side"))


class Trie:
    """Surfaces as letters that follow one another, walked across the borders of words."""

    def __init__(self, forms):
        self.root: dict = {}
        for form in forms:
            node = self.root
            for c in form:
                node = node.setdefault(c, {})
            node[""] = True

    def first(self, words: list[str]) -> str | None:
        """The first run of whole words, of any number, that joined is a surface; the shortest from the earliest word."""
        for i in range(len(words)):
            node, at = self.root, i
            while node is not None and at < len(words):
                for c in words[at]:
                    node = node.get(c)
                    if node is None:
                        break
                at += 1
                if node is not None and "" in node and at > i and any(words[i:at]):
                    return "".join(words[i:at])
        return None


def holding(df: DataFrame, words: str, forms: DataFrame, form: str, most_chars: int = 4_000_000) -> DataFrame:
    """Rows of ``df`` in whose array of ``words`` some run of consecutive words, joined, is one of the ``forms``.

    Up to ``most_chars`` characters of distinct forms a trie is sent to the tasks and each row is walked once. Beyond that the
    runs no longer than the longest form are joined with the forms by value. Null arrays and empty forms are left out.
    """
    spark = df.sparkSession
    distinct = stored(forms.select(F.col(form).alias("run")).where("run <> ''").distinct())
    size = distinct.agg(F.coalesce(F.sum(F.length("run")), F.lit(0)).alias("chars"), F.coalesce(F.max(F.length("run")), F.lit(0)).alias("longest")).first()
    if size["chars"] <= most_chars:
        shared, built = spark.sparkContext.broadcast([r[0] for r in distinct.collect()]), []

        @F.pandas_udf("boolean")
        def found(rows: pd.Series) -> pd.Series:
            if not built:
                built.append(Trie(shared.value))
            return pd.Series([w is not None and built[0].first(list(w)) is not None for w in rows])

        return df.where(found(words))
    w, longest = F.col(words), F.lit(size["longest"])
    ends = F.aggregate(w, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(x))))
    id_ = "__row"
    rows = stored(df.withColumn(id_, F.monotonically_increasing_id()))
    cut = stored(rows.where(w.isNotNull()).select(id_, F.array_join(w, "").alias("__text"), F.array_distinct(ends).alias("__ends")))
    pieces = cut.select(id_, "__text", "__ends", F.explode("__ends").alias("__from"))
    pieces = pieces.select(id_, "__text", "__from", F.explode(F.filter("__ends", lambda e: (e > F.col("__from")) & (e - F.col("__from") <= longest))).alias("__to"))
    hits = pieces.select(id_, F.expr("substring(__text, __from + 1, __to - __from)").alias("run")).join(distinct, "run", "left_semi").select(id_).distinct()
    return rows.join(hits, id_, "left_semi").drop(id_)
