"""Column expressions on texts: normal forms, words, n-grams, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, though lambdas in it use it for each of their elements."""
    return F.transform(F.array(value), body)[0]


#: Runs of what isn't in [a-z0-9'] and [a-z], by what they hold: Java takes ten times as long for the negated classes.
NOT_SIMPLE, NOT_LETTERS = r"[\x00-&(-/:-`{-\x{10FFFF}]+", r"[\x00-`{-\x{10FFFF}]+"


def simple_norm(text: Column) -> Column:
    """Lower case, only a-z, 0-9 and apostrophes, single spaces; null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NOT_SIMPLE, " "))


def letters_norm(text: Column) -> Column:
    """The second normal form: as ``simple_norm`` without digits and apostrophes."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NOT_LETTERS, " "))


def sentence_keys(text: Column) -> Column:
    """Both normal forms, once each."""
    return F.array_distinct(F.array(simple_norm(text), letters_norm(text)))


def words(norm: Column) -> Column:
    """Words of a normalised text; none for the empty one."""
    return F.filter(F.split(norm, " "), lambda w: w != "")


def n_words(norm: Column) -> Column:
    return F.size(words(norm)).cast("long")


def grams(words: Column, n: int = 8) -> Column:
    """Contiguous n-grams as strings; none if there are fewer words."""
    at = lambda w: F.sequence(F.lit(0), F.size(w) - n)
    return let(words, lambda w: F.when(F.size(w) >= n, F.transform(at(w), lambda i: F.concat_ws(" ", *(F.get(w, i + j) for j in range(n))))).otherwise(F.array().cast("array<string>")))


def gram_hashes(words: Column, n: int = 8) -> Column:
    """A 64-bit hash for each of ``grams``, for joins at scale: words are hashed once, grams from their words' hashes."""
    at = lambda h: F.sequence(F.lit(0), F.size(h) - n)
    hashed = lambda h: F.transform(at(h), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(n))))
    none = F.array().cast("array<bigint>")
    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) >= n, hashed(h)).otherwise(none))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; null if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def map_text(text: Column) -> Column:
    """Curly quotes, dashes and ellipses in their ASCII forms, single spaces."""
    ascii_ = F.translate(text, "‘’“”–— ", "''\"\"-- ")
    return F.trim(F.regexp_replace(F.replace(ascii_, F.lit("…"), F.lit("...")), "[ \t\n]+", " "))


def covered(text: Column, allowed: str = "[ -~]") -> Column:
    """Whether every character is one that the tokenizer knows."""
    return F.coalesce(text.rlike(f"^(?:{allowed})*$"), F.lit(False))


#: Letters that are written for others of the same sound, in the order in which they are replaced.
SOUND_FOLDS = (("sch", "sh"), ("ph", "f"), ("oe", "o"), ("ue", "u"), ("ae", "e"), ("ee", "e"), ("ck", "k"), ("q", "k"), ("x", "ks"), ("z", "s"), ("y", "i"), ("c", "k"))


def sound_key(word: Column) -> Column:
    """Letters that sound alike folded together, doubled ones once."""
    for old, new in SOUND_FOLDS:
        word = F.replace(word, F.lit(old), F.lit(new))
    return F.regexp_replace(word, r"(.)\1+", "$1")


def singular(word: Column) -> Column:
    """The singular that an English plural form suggests."""
    return (
        F.when(word.rlike("ies$") & (F.length(word) > 4), F.concat(F.regexp_replace(word, "ies$", ""), F.lit("y")))
        .when(word.rlike("(ches|shes|sses|xes)$"), F.regexp_replace(word, "es$", ""))
        .when(word.rlike("[^s]s$") & (F.length(word) > 3), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )


def extract_sentence(raw: Column) -> Column:
    """The first line of a generator's output, without think tags and quotes."""
    text = F.trim(F.regexp_replace(raw, "(?s)<think>.*?</think>", ""))
    return F.trim(F.regexp_replace(F.split(text, "\n").getItem(0), "^[\"']+|[\"']+$", ""))


def collapse(tokens: Column, blank: str = "_") -> Column:
    """Repeats dropped, then blanks."""
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))))
    both = F.filter(F.arrays_zip(tokens.alias("t"), before.alias("p")), lambda x: ~x["t"].eqNullSafe(x["p"]))
    return F.filter(F.transform(both, lambda x: x["t"]), lambda t: t != blank)


def salted(salt: str, *cols: str) -> Column:
    """The hash by which salted ranks and sides are decided, as hex digits."""
    return F.sha2(F.concat_ws("|", F.lit(salt), *(F.col(c).cast("string") for c in cols)), 256)


#: Signs of a label and what they become, in the mapping's first two versions and in its third.
QUOTES_AND_DASHES = {"'": "‘’‚‛′", '"': "“”„‟″", "-": "‐‑‒–—―−"}
DROPPED, BLANKED = '"*', "()[]{}_"
SPOKEN_SIGNS = {";": ",", "&": " and ", "+": " plus ", "=": " equals ", "@": " at ", "°": " degrees ", "§": " section "}


def label_text(nfkc: Column, version: int = 3) -> Column:
    """The stored text of a label in Unicode's compatibility form: ASCII quotes and dashes; from version 3 on signs are said
    or dropped, white space is single and none stands before a mark (but before a decimal's point it may)."""
    if version not in (1, 2, 3):
        raise ValueError(f"unknown version {version}")
    curly = "".join(QUOTES_AND_DASHES.values())
    text = F.translate(nfkc, curly, "".join(k * len(v) for k, v in QUOTES_AND_DASHES.items()))
    if version == 3:
        text = F.translate(text, BLANKED + DROPPED, " " * len(BLANKED))
        for sign, said in SPOKEN_SIGNS.items():
            text = F.replace(text, F.lit(sign), F.lit(said))
        text = F.regexp_replace(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), r" ([,?!:]|\.(?!\d))", "$1")
    return F.trim(text)


def recording(id_: Column) -> Column:
    """The recording that an id (``source:rest``) belongs to, by the source's own way of numbering parts; an id without a
    source stops the job."""
    source, rest = F.substring_index(id_, ":", 1), F.regexp_replace(id_, "^[^:]*:", "")
    but = lambda sep, n: F.when(F.size(F.split(rest, sep)) > n, F.array_join(F.slice(F.split(rest, sep), F.lit(1), F.size(F.split(rest, sep)) - n), sep)).otherwise(F.substring_index(rest, sep, 1))
    part = (
        F.when(source.startswith("yodas"), but("_", 4))
        .when(source.isin("librispeech", "med-osce"), F.substring_index(rest, "-", 1))
        .when(source == "voxpopuli", F.substring_index(rest, "_", 1))
        .when(source == "ami", F.substring_index(rest, "_", 3))
        .otherwise(but("_", 1))
    )
    return F.when(id_.contains(":"), F.concat(source, F.lit(":"), part)).when(id_.isNotNull(), F.raise_error(F.concat(F.lit("no source in "), id_)).cast("string"))
