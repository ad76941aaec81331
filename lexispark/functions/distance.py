"""Edit distance of word sequences in bulk: bit vectors of 64 reference words, over all pairs of a batch at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import types as T

from .slices import sliced

#: Pairs whose vectors are stepped together.
PAIRS = 4096


def one(a, b) -> int:
    """Distance of two sequences of any length: the columns of the cost table as differences in two integers."""
    if not len(a):
        return len(b)
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, cost = full, 0, len(a)
    for x in b:
        eq = at.get(x, 0)
        level = (((eq & up) + up) ^ up) | eq
        rises, falls = down | ~(level | up) & full, up & level
        cost += bool(rises & last) - bool(falls & last)
        rises, falls = (rises << 1 | 1) & full, falls << 1 & full
        eq |= down
        up, down = falls | ~(eq | rises) & full, rises & eq
    return cost


def _short(refs: list[list[int]], hyps: list[list[int]]) -> np.ndarray:
    """Distances where no reference is empty or longer than 64; pairs leave as their hypothesis ends."""
    n, m = np.array([len(r) for r in refs]), np.array([len(h) for h in hyps])
    order = np.argsort(-m, kind="stable")
    r, h = np.full((len(refs), 64), -1, np.int64), np.full((len(refs), int(m.max(initial=0))), -2, np.int64)
    for k, i in enumerate(order):
        r[k, : n[i]], h[k, : m[i]] = refs[i], hyps[i]
    n, m = n[order], m[order]
    one_ = np.uint64(1)
    last = one_ << (n - 1).astype(np.uint64)
    up, down, cost = np.full(len(n), ~np.uint64(0)), np.zeros(len(n), np.uint64), n.copy()
    for j in range(h.shape[1]):
        k = int(np.searchsorted(-m, -j))  # the pairs that have a word here stand first
        p, d, top = up[:k], down[:k], last[:k]
        eq = np.packbits(r[:k] == h[:k, j : j + 1], axis=1, bitorder="little").view(np.uint64).ravel()
        level = (((eq & p) + p) ^ p) | eq
        rises, falls = d | ~(level | p), p & level
        cost[:k] += ((rises & top) != 0).astype(int) - ((falls & top) != 0)
        rises, falls = rises << one_ | one_, falls << one_
        eq = eq | d
        up[:k], down[:k] = falls | ~(eq | rises), rises & eq
    out = np.empty(len(n), np.int64)
    out[order] = cost
    return out


def many(refs: list[list[str]], hyps: list[list[str]]) -> np.ndarray:
    """Distance of each pair."""
    ids: dict[str, int] = {}
    a = [[ids.setdefault(w, len(ids)) for w in r] for r in refs]
    b = [[ids.setdefault(w, len(ids)) for w in h] for h in hyps]
    out = np.array([len(h) for h in b], np.int64)
    short = np.array([i for i, r in enumerate(a) if 0 < len(r) <= 64], np.int64)
    for k in range(0, len(short), PAIRS):
        part = short[k : k + PAIRS]
        out[part] = _short([a[i] for i in part], [b[i] for i in part])
    for i, r in enumerate(a):
        if len(r) > 64:
            out[i] = one(r, b[i])
    return out


@sliced(T.LongType(), rows=PAIRS)
def word_distance(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """Least number of substituted, deleted and inserted words; null counts as no words."""
    return pd.Series(many([t.split() for t in ref.fillna("")], [t.split() for t in hyp.fillna("")]))
