"""Word alignment and sequence functions that built-in expressions can't state: Arrow-batched UDFs."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .slices import sliced


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_INT, _STR = T.IntegerType(), T.StringType()
COUNTS = _struct(s=_INT, d=_INT, i=_INT)
STEPS = T.ArrayType(_struct(op=_STR, i=_INT, j=_INT, ref=_STR, hyp=_STR))
SPANS = T.ArrayType(_struct(start=_INT, end=_INT, phrase=_STR))


def path(ref: list[str], hyp: list[str]) -> list[tuple[str, int, int]]:
    """(op, i, j) steps of a least-cost alignment; of equal ones a diagonal, then a deletion, then an insertion."""
    n, m = len(ref), len(hyp)
    cost = np.zeros((n + 1, m + 1), np.int32)
    cost[:, 0], cost[0] = np.arange(n + 1), np.arange(m + 1)
    ids: dict[str, int] = {}
    a = np.array([ids.setdefault(w, len(ids)) for w in ref], np.int64)
    b = np.array([ids.setdefault(w, len(ids)) for w in hyp], np.int64)
    ramp = np.arange(m + 1)
    for i in range(1, n + 1):
        row = np.minimum(cost[i - 1, 1:] + 1, cost[i - 1, :-1] + (b != a[i - 1]))
        # an insertion costs one for each step to the right: a running minimum along the row
        cost[i] = np.minimum.accumulate(np.concatenate([[i], row]) - ramp) + ramp
    out, i, j = [], n, m
    while i or j:
        if i and j and cost[i, j] == cost[i - 1, j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            out.append(("=" if a[i] == b[j] else "S", i, j))
        elif i and cost[i, j] == cost[i - 1, j] + 1:
            i -= 1
            out.append(("D", i, j))
        else:
            j -= 1
            out.append(("I", i, j))
    return out[::-1]


@sliced(COUNTS)
def edit_counts(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    """Substitutions, deletions and insertions between the words of two texts."""
    rows = []
    for r, h in zip(ref.fillna(""), hyp.fillna(""), strict=True):
        ops = Counter(o for o, _, _ in path(r.split(), h.split()))
        rows.append((ops["S"], ops["D"], ops["I"]))
    return pd.DataFrame(rows, columns=["s", "d", "i"]).astype("int32")


@sliced(STEPS)
def alignment(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """Every step of the alignment with its words."""
    out = []
    for r, h in zip(ref.fillna(""), hyp.fillna(""), strict=True):
        a, b = r.split(), h.split()
        out.append([{"op": o, "i": i, "j": j, "ref": a[i] if o != "I" else None, "hyp": b[j] if o != "D" else None} for o, i, j in path(a, b)])
    return pd.Series(out)


def wer(errors: Column, n: Column, hyp_words: Column) -> tuple[Column, Column]:
    """(rate, infinite): 0 if both are empty; null with the flag if only the reference is."""
    rate = F.when(n > 0, errors / n).when(hyp_words == 0, F.lit(0.0))
    return rate, (n == 0) & (hyp_words > 0)


def longest(tokens: list, most: int = 6) -> tuple[int, int]:
    """(repeats, n) of the longest run in which an n-gram repeats at once, the smallest n of ties; (0, 0) of nothing.

    A place repeats if its token is the one n places before. m such places in a row are m // n further copies.
    """
    x = np.unique(np.array(tokens, dtype=object).astype(str), return_inverse=True)[1] if len(tokens) else np.zeros(0, int)
    runs = {n: 0 for n in range(1, min(most, len(x) // 2) + 1)}
    for n in runs:
        place = np.arange(len(x) - n)
        broken = np.where(x[n:] == x[:-n], -1, place)
        runs[n] = int((place - np.maximum.accumulate(broken)).max())
    copies = {n: m // n + 1 for n, m in runs.items()}
    if not any(c > 1 for c in copies.values()):
        return (1, 1) if len(x) else (0, 0)
    return max((c, -n) for n, c in copies.items())[0], min(n for n, c in copies.items() if c == max(copies.values()))


@sliced(_struct(repeats=_INT, n=_INT))
def longest_repeat(tokens: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([longest(list(t) if t is not None else []) for t in tokens], columns=["repeats", "n"]).astype("int32")


def phrase_matcher(phrases: list[str]):
    """A UDF: (start, end, phrase) of the greedy longest matches of the phrases in an array of words, left to right."""
    table = {tuple(p.split()): p for p in phrases if p.split()}
    longest_ = max(map(len, table), default=0)

    @sliced(SPANS)
    def match(words: pd.Series) -> pd.Series:
        out = []
        for w in words:
            w, i, found = list(w) if w is not None else [], 0, []
            while i < len(w):
                n = next((n for n in range(min(longest_, len(w) - i), 0, -1) if tuple(w[i : i + n]) in table), 0)
                if n:
                    found.append({"start": i, "end": i + n, "phrase": table[tuple(w[i : i + n])]})
                i += n or 1
            out.append(found)
        return pd.Series(out)

    return match


@F.pandas_udf(_STR)
def nfkc(text: pd.Series) -> pd.Series:
    import unicodedata

    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


#: English number words.
_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = ["", "", *"twenty thirty forty fifty sixty seventy eighty ninety".split()]


def cardinal(n: int) -> str:
    """An integer in English words; from 10**15 digit by digit."""
    if n < 0:
        return "minus " + cardinal(-n)
    if n >= 10**15:
        return " ".join(_ONES[int(c)] for c in str(n))
    if n < 20:
        return _ONES[n]
    if n < 100:
        return _TENS[n // 10] + ("" if n % 10 == 0 else " " + _ONES[n % 10])
    for size, name in ((10**12, "trillion"), (10**9, "billion"), (10**6, "million"), (1000, "thousand"), (100, "hundred")):
        if n >= size:
            rest = n % size
            return cardinal(n // size) + " " + name + (" " + cardinal(rest) if rest else "")
    raise AssertionError


@F.pandas_udf(_STR)
def number_words(n: pd.Series) -> pd.Series:
    return n.map(lambda x: None if pd.isna(x) else cardinal(int(x)))
