"""Operators 11 to 13 against plain loops, the library and exact sums, on ordinary and on dirty tables."""

import base64
import hashlib
import math
import random
from fractions import Fraction

import compare  # noqa: F401
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.llm import bpe, common, registry, vectorcodes, whitening

SF = "/root/testdata/sf0.001"


def vectors_table(spark, rows, key="long"):
    """Columns whose names clash with those the operators use inside."""
    return spark.createDataFrame([(k, v, lab, 1, "x", None) for k, v, lab in rows], f"vec_id {key}, embedding array<float>, label int, key int, x string, code string")


def plain_codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    kept = [(k, [math.floor(scale * float(np.float32(x))) for x in v], lab) for k, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            for e, vs in groups.items():
                books[p][e] = [sum(col) // len(vs) for col in zip(*vs, strict=True)]
    out = []
    for k, v, lab in kept:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((k, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), lab))
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return out, digest


def dirty_vectors(seed, n=60, width=8):
    rnd = random.Random(seed)
    vec = lambda s=1.0: [rnd.gauss(0, s) for _ in range(width)]
    same = vec()
    rows = [(i, vec(), rnd.choice([0, 1, None])) for i in range(n)] + [(n + i, same, 5) for i in range(20)]
    rows += [(3, vec(), 1), (3, rows[3][1], rows[3][2]), (None, vec(), 2), (None, None, 2), (900, None, 1), (901, [None] * width, 1)]
    rows += [(902, [float("nan"), *vec()[1:]], 1), (903, [float("inf"), *vec()[1:]], 1), (904, [], 1), (905, [0.0, -0.0] * (width // 2), None), (906, [1.5], 1)]
    rnd.shuffle(rows)
    return rows, [r for r in rows if r[1] is None or len(r[1]) == width]


@pytest.mark.parametrize("seed,entries", [(1, 16), (2, 256)])
def test_codes_equal_plain_loops(spark, seed, entries):
    rows, usual = dirty_vectors(seed)
    coded, books = vectorcodes.compress(vectors_table(spark, rows), keep=["label"], entries=entries)
    want, digest = plain_codes(usual, entries=entries)
    got = vectorcodes.label_errors(coded).collect()
    assert sorted(map(repr, ((r.vec_id, r.code, r.error, r.label) for r in got))) == sorted(map(repr, want))
    assert vectorcodes.digest(books) == digest
    sums = {}
    for _, _, e, lab in want:
        sums[lab] = sums.get(lab, 0) + e
    assert all(r.label_error == sums[r.label] for r in got)
    salted = vectorcodes.label_errors(coded, few=0, salts=3).collect()
    assert sorted(map(repr, salted)) == sorted(map(repr, got))


def test_codes_of_few_empty_large_and_other_keys(spark):
    empty, books = vectorcodes.compress(vectors_table(spark, []), keep=["label"])
    assert vectorcodes.label_errors(empty).count() == 0 and vectorcodes.digest(books) == hashlib.sha256(b"").hexdigest()
    big = [("b", [1e9, -1e9, 3.0, 1e12], 1), ("a", [-1e9, 1e9, 5.0, -1e12], None), ("c", [1e9, -1e9, 4.0, 1e12], 1)]
    coded, books = vectorcodes.compress(vectors_table(spark, big, "string"), entries=2)
    want, digest = plain_codes([(ord(k), v, lab) for k, v, lab in big], entries=2)
    assert {r.vec_id: (r.code, r.error) for r in coded.collect()} == {chr(k): (c, e) for k, c, e, _ in want} and vectorcodes.digest(books) == digest
    one, _ = vectorcodes.compress(vectors_table(spark, [(7, [0.5, 0.25, 1.0], 1)], "int"))  # the last part is empty
    assert [tuple(r) for r in one.collect()] == [(7, "00000000", 0)] and one.schema["vec_id"].dataType.simpleString() == "int"


def test_partial_distances_keep_ties():
    rnd = np.random.default_rng(4)
    for kind in (np.int64, object):
        x, book = rnd.integers(-3, 4, (500, 5)).astype(kind), rnd.integers(-3, 4, (40, 5)).astype(kind)
        every = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        index, distance = vectorcodes.nearest(x, book)
        assert index.tolist() == every.argmin(axis=1).tolist() and distance.tolist() == every.min(axis=1).tolist()


def dirty_texts():
    rnd = random.Random(9)
    words = ["the", " of", "Größe", "naïve", "don't", "I'LL", "日本語", "🙂🙂", "aaaaaaa", "abababab", "12345", "...", " ", "<|endoftext|>", "é", "\x00"]
    out = [None, "", " ", "\n\n  \t", "<|endoftext|>", "a" * 5000, "ab" * 3000 + " x" * 200_000, "".join(chr(rnd.randrange(32, 0x2FFF)) for _ in range(4000))]
    out += [rnd.choice(["", " "]).join(rnd.choice(words) for _ in range(rnd.randint(1, 60))) for _ in range(80)]
    out += ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(1, 120))) for _ in range(200)]
    return [*out, *out[8:14]]


def test_bpe_equals_the_library(spark, monkeypatch):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(bpe.RANKS), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(i, t, 1, "x") for i, t in enumerate(dirty_texts())] + [(None, "null key", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, ids int, key string")
    for line, matches in ((bpe.LINE, bpe.MATCHES), (300, 5)):
        monkeypatch.setattr(bpe, "LINE", line)
        monkeypatch.setattr(bpe, "MATCHES", matches)
        got = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in bpe.decode(bpe.encode(docs)).collect())
        want = []
        for i, t, *_ in rows:
            ids = library.encode_ordinary(t or "")
            want.append((-1 if i is None else i, len(ids), np.array(ids, "<u4").tobytes(), (t or "").encode()))
        assert got == sorted(want)
    assert bpe.decode(bpe.encode(docs.limit(0))).count() == 0
    wide = spark.createDataFrame([(1, "x"), (1, "x")], "doc_id long, text string").withColumn("decoded", F.lit(1))
    assert [bytes(r.decoded) for r in bpe.decode(bpe.encode(wide)).collect()] == [b"x", b"x"]


def test_replay_with_tokens_in_several_splits():
    rnd = random.Random(3)
    for _ in range(60):
        ranks = {bytes([b]): b for b in range(256)}
        strings = {"".join(rnd.choice("abc") for _ in range(rnd.randint(2, 5))) for _ in range(25)}
        for s in rnd.sample(sorted(strings), len(strings)):
            ranks[s.encode()] = len(ranks)
        vocabulary = bpe.Merges(ranks)
        words = [bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 14))) for _ in range(40)]
        assert vocabulary.replay(words) == [vocabulary.alone(w) for w in words]


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_byte_bpe", "op13_embedding_whitening"])
def test_registered_queries(spark, name):
    got = registry.QUERIES[name](spark, SF)
    if name == "op12_byte_bpe":
        rows = {r.doc_id: r for r in got.collect()}
        texts = common.table(spark, SF, "documents").collect()
        assert len(rows) == len(texts) and all(rows[t.doc_id].decoded_sha256 == hashlib.sha256((t.text or "").encode()).hexdigest() for t in texts)
        return
    n = common.table(spark, SF, "embeddings").count()
    assert got.count() == n * (4 if name == "op13_embedding_whitening" else 1)
    assert "key" not in got.columns and got.columns[0] == "vec_id"


def plain_whitening(rows, many=4, scale=256):
    x = [(k, tuple(math.floor(scale * float(np.float32(c))) for c in v)) for k, v, _ in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({v for _, v in x})
    n, w = len(fit), len(fit[0])
    s = [sum(c) for c in zip(*fit, strict=True)]
    a = np.array([[float(Fraction(v[j]) - Fraction(s[j], n)) for j in range(w)] for v in fit])
    cov = a.T @ a / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:many], vectors[:, ::-1][:, :many]
    out = []
    for k, v in x:
        white = np.array([float(Fraction(v[j]) - Fraction(s[j], n)) for j in range(w)]) @ vectors / np.sqrt(values)
        out.append((k, n, sum((n * p - q) ** 2 for p, q in zip(v, s, strict=True)), white, values / np.trace(cov)))
    return out


@pytest.mark.parametrize("oversample,passes,spread", [(12, 6, 1.0), (3, 40, 4.0)])
def test_whitening_equals_a_full_decomposition(spark, oversample, passes, spread):
    rnd = np.random.default_rng(8)
    width = 24
    scale = spread ** -np.arange(width)
    rows = [(i, [float(c) for c in 50 * rnd.normal(size=width) * scale], 0) for i in range(300)]
    rows += [(400 + i, rows[5][1], 0) for i in range(100)] + [(7, rows[9][1], 0), (8, None, 0), (9, [float("nan")] * width, 0), (10, [None] * width, 0), (11, [], 0), (12, [1.0], 0)]
    want = plain_whitening([r for r in rows if r[1] is None or len(r[1]) == width])
    got = whitening.whiten(vectors_table(spark, rows), oversample=oversample, passes=passes).collect()
    assert len(got) == 4 * len(want) and {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-10
    by = {}
    for r in got:
        by.setdefault((r.vec_id, int(r.deviation)), {})[r.component] = r
    signs = None
    for k, n, deviation, white, explained in want:
        mine = by[k, deviation]
        row = np.array([mine[c].whitened for c in (1, 2, 3, 4)])
        signs = np.sign(row * white) if signs is None else signs
        assert np.allclose(row * signs, white, rtol=1e-7, atol=1e-9) and mine[1].n == n
        assert np.allclose([mine[c].explained for c in (1, 2, 3, 4)], explained, rtol=1e-9)


def test_power_passes_suffice_for_a_steep_spectrum(spark):
    rnd = np.random.default_rng(5)
    x = rnd.integers(-1000, 1000, (400, 40)) * (4.0 ** -np.arange(40)) * 1000
    fit = spark.createDataFrame([(v.astype(int).tolist(),) for v in x], "x array<bigint>")
    n, total = whitening.sums(fit, 40)
    mean = np.array(total) / n
    values, vectors, full = whitening.components(fit, n, mean, 4, oversample=8, passes=30)
    a = x.astype(int) - mean
    w, v = np.linalg.eigh(a.T @ a / n)
    assert not full and np.allclose(values, w[::-1][:4], rtol=1e-12)
    assert np.allclose(np.abs(vectors.T @ v[:, ::-1][:, :4]), np.eye(4), atol=1e-10)
    assert whitening.components(fit, n, mean, 4, oversample=1, passes=1)[2]


def test_whitening_of_degenerate_tables(spark):
    assert whitening.whiten(vectors_table(spark, [])).count() == 0
    one = whitening.whiten(vectors_table(spark, [(1, [0.5, 1.0], 0), (2, [0.5, 1.0], 0)])).collect()
    assert [(r.vec_id, r.component, r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in sorted(one)] == [(i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)]
    flat = whitening.whiten(vectors_table(spark, [(1, [0.0, 1.0], 0), (None, [1.0, 1.0], 0)], "string")).collect()
    assert {(r.vec_id, r.component): r.whitened for r in flat if r.component == 2} == {("1", 2): None, (None, 2): None}
    assert {abs(round(r.whitened, 9)) for r in flat if r.component == 1} == {1.0} and {r.explained for r in flat} == {1.0, 0.0}
    huge = whitening.whiten(vectors_table(spark, [(1, [1e30, 1.0], 0), (2, [-1e30, 2.0], 0), (3, [0.0, 0.0], 0)])).collect()
    assert len(huge) == 6
