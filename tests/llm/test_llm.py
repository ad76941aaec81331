"""The dealt operators against brute force on small tables with nulls, blanks, copies and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib

import compare
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.llm import chat, common, ctw, decontaminate, jaccard, media, packing, passages, registry, secrets, toxicity, wordpiece
from lexispark.llm.components import roots

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def corpus(seed=3, n=60):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    shared = " ".join(rnd.choice(words) for _ in range(80))
    out = [None, "", "  \n", "one two", "One\ttwo", "x " * 3000]
    for _ in range(n):
        base = [rnd.choice(words) for _ in range(rnd.randint(5, 120))]
        out.append(" ".join(base))
        if rnd.random() < 0.5:
            base[rnd.randrange(len(base))] = "changed"
            out.append(" ".join(base))
        if rnd.random() < 0.3:
            out.append(" ".join(base[:10]) + " " + shared)
    return [*out, *out[6:12]]


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_sql(spark, name):
    assert compare.differences(registry.QUERIES[name](spark, SF), compare.connect(SF), registry.ORACLE[name]) == []


def test_jaccard_join(spark):
    texts = corpus()
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((label[a], label[b]))
            label = [x if v == y else v for v in label]
    docs = table(spark, texts).withColumn("n", F.lit(1)).withColumn("cls", F.lit("x"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs).collect()}
    assert got == {i: (len(s), label[i]) for i, s in enumerate(sets)}
    blocks = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs, group=100).collect()}  # every group is cut into pairs of blocks
    assert blocks == got
    kept = {r.doc_id for r in jaccard.unique(table(spark, texts)).collect()}
    assert kept == {i for i, s in enumerate(sets) if not s or label[i] == i}
    assert jaccard.join(docs.limit(0)).count() == 0


def test_links_of_a_family_whose_copies_are_partly_linked():
    rnd = random.Random(2)
    words = [f"v{i}" for i in range(100)]
    sets = []
    for _ in range(150):
        copy = list(words)
        for _ in range(rnd.randint(0, 5)):
            copy[rnd.randrange(len(copy))] = f"e{rnd.random()}"
        sets.append(jaccard.sets_of([" ".join(copy)])[0])
    label = {i: {i} for i in range(len(sets))}
    for a, b in itertools.combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[a], sets[b]))
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and label[a] is not label[b]:
            label[a] |= label[b]
            for x in label[b]:
                label[x] = label[a]
    found = jaccard.spanning(sets)
    root = roots(np.array([a for a, _ in found]), np.array([b for _, b in found]), len(sets))
    assert 2 < len(set(root.tolist())) and root.tolist() == [min(label[i]) for i in range(len(sets))]


def test_passages(spark):
    rnd = random.Random(5)
    text = lambda n: " ".join(f"u{rnd.randrange(10**6)}" for _ in range(n))
    shared = text(70)
    texts = [None, "", text(100), f"{text(40)} {shared} {text(90)}", f"{shared} {text(30)}", f"{text(200)} {shared}", text(60)]
    texts += [texts[2], f"{text(20)} {' '.join(shared.split()[:30])}"]
    rows = passages.groups(table(spark, texts)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.passage_doc_id, {})[r.doc_id] = (r.start, r.end)
    assert set(by) == {2, 3} and set(by[2]) == {2, 7} and set(by[3]) == {3, 4, 5}
    assert by[3][4][0] == 0 and by[3][3] == (40, 110) and by[3][5] == (200, 270)


def test_long_edited_runs_keep_their_exact_part():
    rnd = random.Random(11)
    words = [f"u{rnd.randrange(10**6)}" for _ in range(260)]
    edited = words[:60] + [f"e{i}" if i % 10 == 5 else w for i, w in enumerate(words[60:])]
    a, b = passages.sequences([" ".join(words), " ".join(edited)])
    for one, two in ((a, b), (b, a)):
        (s, e, s2, e2, j), *rest = passages.verify(one, two)
        assert (s, s2) == (0, 0) and e >= 56 and e2 >= 56 and j >= passages.SIMILAR
    for seed in range(20):  # against every part of the run from one gap to another
        rnd = random.Random(seed)
        words = [f"u{rnd.randrange(10**6)}" for _ in range(300)]
        edited = [f"e{i}" if rnd.random() < 0.05 else w for i, w in enumerate(words)]
        a, b = passages.sequences([" ".join(words), " ".join(edited)])
        same = a == b
        parts = [(s, e) for s in range(len(a)) for e in range(s + 46, len(a) + 1) if same[s] and same[e - 1] and same[s:e].sum() >= 0.8 * (2 * (e - s) - same[s:e].sum())]
        parts = [(s, e) for s, e in parts if np.diff(np.flatnonzero(same[s:e])).max() <= passages.GAP]
        want = {p for p in parts if not any(q != p and q[0] <= p[0] and p[1] <= q[1] for q in parts)}
        got = passages.verify(a, b)
        assert {g[:2] for g in got} == {g[2:4] for g in got}
        assert all(any(g[0] <= s and e <= g[1] for g in got) for s, e in want)


def test_every_place_of_a_passage_in_either_text(spark):
    rnd = random.Random(8)
    text = lambda n: " ".join(f"u{rnd.randrange(10**6)}" for _ in range(n))
    for _ in range(3):  # which text is looked at first depends on digests
        shared = text(60)
        texts = [f"{text(80)} {shared} {text(80)} {shared} {text(80)} {shared} {text(80)}", f"{text(30)} {shared} {text(30)}"]
        rows = passages.groups(table(spark, texts)).collect()
        assert sorted((r.doc_id, r.start, r.end) for r in rows) == [(0, 80, 140), (0, 220, 280), (0, 360, 420), (1, 30, 90)]
        assert {(r.passage_doc_id, r.passage_start) for r in rows} == {(0, 80)}


@pytest.mark.parametrize("size", [2, 4, 12, 50])
def test_near_copies_of_a_passage_are_one_group(spark, size):
    rnd = random.Random(size)
    text = lambda n: [f"u{rnd.randrange(10**7)}" for _ in range(n)]
    texts, family = [], []
    for _ in range(96 // size):
        base, made = text(120), []
        for _ in range(size):
            copy = list(base)
            for _ in range(rnd.randint(1, 2)):
                copy[rnd.randrange(120)] = f"e{rnd.random()}"
            texts.append(" ".join(text(rnd.randint(10, 60)) + copy + text(rnd.randint(10, 60))))
            made.append((len(texts) - 1, shingles(" ".join(copy))))
        family.append(made)
    label = {}
    for r in passages.groups(table(spark, texts)).collect():
        label.setdefault(r.doc_id, set()).add((r.passage_doc_id, r.passage_start))
    pairs = [(a, b) for made in family for (a, x), (b, y) in itertools.combinations(made, 2) if 100 * len(x & y) >= 80 * len(x | y)]
    seen = sum(bool(label.get(a, set()) & label.get(b, set())) for a, b in pairs)
    assert seen >= 0.97 * len(pairs), (seen, len(pairs))


def test_exact_passages_around_a_line_of_many_texts(spark):
    rnd = random.Random(31)
    text = lambda n: [f"u{rnd.randrange(10**7)}" for _ in range(n)]
    line, texts, pairs = text(45), [], []
    for i in range(150):
        texts.append(" ".join([*text(30), *line, *text(30)]))
    for i in range(40):  # 61 words in two texts, 45 of them the line that all texts have
        left, right = text(i % 17), text(16 - i % 17)
        pairs.append((len(texts), len(texts) + 1))
        texts += [" ".join([*text(20 + i), *left, *line, *right, *text(25)]) for _ in range(2)]
    label = {}
    for r in passages.groups(table(spark, texts)).collect():
        label.setdefault(r.doc_id, set()).add((r.passage_doc_id, r.passage_start))
    assert all(label.get(a, set()) & label.get(b, set()) for a, b in pairs)
    assert not any(i in label for i in range(150))


def test_edited_passages_around_a_line_of_many_texts(spark):
    rnd = random.Random(9)
    text = lambda n: ["".join(rnd.choices("abcdefghijklmnop", k=6)) for _ in range(n)]
    line, texts = text(45), []
    for _ in range(40):  # two texts with the line and up to 17 words behind it, of which one differs: no 50 are equal
        k = rnd.randint(1, 4)
        head, tail = text(k), text(rnd.randint(10, 16) - k)
        texts += [" ".join([*text(70), *line, *head, *text(1), *tail, *text(70)]) for _ in range(2)]
    texts += [" ".join([*text(70), *line, *text(80)]) for _ in range(60)]
    label = {}
    for r in passages.groups(table(spark, texts)).collect():
        label.setdefault(r.doc_id, set()).add((r.passage_doc_id, r.passage_start))
    assert all(label.get(2 * i, set()) & label.get(2 * i + 1, set()) for i in range(40))
    assert not any(i in label for i in range(80, 140)) and len(set.union(*label.values())) == 40


def test_passages_of_repeated_rows_and_equal_words(spark):
    rnd = random.Random(4)
    shared = " ".join(f"u{rnd.randrange(10**6)}" for _ in range(80))
    rows = [(1, shared), (1, shared), (1, shared), (2, f"start {shared}"), (2, f"start {shared}"), (None, shared), (3, "same " * 30_000), (4, "same " * 29_000)]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], DOCS)
    got = sorted((r.doc_id, r.start, r.end, r.passage_doc_id) for r in passages.groups(docs).collect())
    assert got[:5] == [(1, 0, 80, 1)] * 3 + [(2, 0, 81, 1)] * 2
    assert len(passages.compact_windows(np.full(40_000, 7, np.uint64), 46)) < 900
    assert passages.groups(docs.limit(0)).count() == 0


def test_compact_windows():
    values = np.array([5, 3, 8, 1, 9, 2, 7], np.uint64)
    for lo, c, hi in passages.compact_windows(values, 2):
        assert values[lo : hi + 1].min() == values[c] and hi - lo + 1 >= 2


def test_decontamination(spark):
    item = " ".join(f"b{i}" for i in range(30))
    bench = spark.createDataFrame([(1, item), (2, "short one"), (3, None), (4, "")], "item_id long, text string")
    texts = [None, "", f"x {item} y", "a SHORT, one b", " ".join(item.split()[:12]), " ".join(item.split()[5:18])]
    got = {r.doc_id: (r.n_words, list(r.hits), list(r["items"])) for r in decontaminate.find(table(spark, texts), bench).collect()}
    assert got == {0: (0, [], []), 1: (0, [], []), 2: (32, [1, 31], ["1"]), 3: (4, [1, 3], ["2"]), 4: (12, [], []), 5: (13, [0, 13], ["1"])}
    blocks = {r.doc_id: (r.n_words, list(r.hits), list(r["items"])) for r in decontaminate.find(table(spark, texts), bench, most_chars=40).collect()}
    assert blocks == got
    assert {r.doc_id for r in decontaminate.remove(table(spark, texts), bench).collect()} == {0, 1, 4}
    for mode in ("documents", "spans"):  # a benchmark beyond the bound gives the same rows
        docs = table(spark, [*texts, texts[2]])
        whole, parts = (sorted(map(str, decontaminate.remove(docs, bench, mode, most_chars=n).collect())) for n in (1000, 40))
        assert whole == parts


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(str(public_tokenizers.path(packing.VOCABULARY)))
    texts = [None, "", "<|endoftext|> a", *(" ".join(f"word{i}" for i in range(n)) for n in (3, 50, 50, 900, 2500))]
    rows = packing.pack(common.stored(packing.pieces(table(spark, texts)))).collect()
    for i, t in enumerate(texts):
        ids = np.array([*slow.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.start for r in mine] == list(itertools.accumulate([0, *(r.length for r in mine)]))[:-1]
        assert sum(r.length for r in mine) == len(ids) and (len(mine) == 1) == (len(ids) <= 2048)
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in mine)
    for _, bin_ in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in bin_:
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_media(spark):
    texts = [None, "", "é" * 500, "x" * 192]
    for r in media.media(table(spark, texts)).collect():
        data = (texts[r.doc_id] or "").encode()
        back = media.decode(bytes(r.media)).tobytes()
        assert back == media.pad(data) and hashlib.sha256(back).hexdigest() == r.payload_sha256 and r.n_bytes == len(data)
    broken = bytearray(media.encode(media.pad(b"abc")))
    broken[50] ^= 1
    with pytest.raises(ValueError):
        media.decode(bytes(broken))


def test_wordpiece():
    machine = wordpiece.Automaton([b" a", b" ab", b"b", b"c", b"abc", b" abcd"])

    def greedy(word):
        n = 0
        while word:
            k = next((k for k in range(len(word), 0, -1) if word[:k] in {b" a", b" ab", b"b", b"c", b"abc", b" abcd"}), 0)
            if not k:
                return 1
            n, word = n + 1, word[k:]
        return n

    for n in range(1, 6):
        for tail in itertools.product(b"abcd", repeat=n):
            assert machine.count(b" " + bytes(tail)) == greedy(b" " + bytes(tail))


def test_context_trees(spark):
    """The model's probabilities sum to one over the next byte, and base scores follow their formula."""
    g, c = np.unique(np.concatenate([ctw.grams(t) for t in (b"abab abba", b"abba baab")]), return_counts=True)
    ctx = g[0] >> 8
    every = np.sort(np.unique(np.concatenate([g, (ctx << 8) | np.arange(256)])))
    counts = np.where(np.isin(every, g), c[np.minimum(np.searchsorted(g, every), len(g) - 1)], 0)
    q = ctw.build(every, counts, 0)[1].prod(axis=0)
    assert q[(every >> 8) == ctx].sum() == pytest.approx(1.0)
    texts = [None, "", "A b a", "b b c", "zz"]
    rows = {r.doc_id: r for r in ctw.score(table(spark, texts), F.col("doc_id") < 4).collect()}
    n, v = 2 + 4 + 6 - 2, 4  # tokens with ends; a, b, c and the end
    assert rows[4].n_tokens == 2 and rows[4].n_known == 1 and rows[4].train_tokens == n
    assert rows[4].base_score == pytest.approx(np.log10(1 / (n + v + 1)) + np.log10(5 / (n + v + 1)))
    assert all(r.score < 0 for r in rows.values())


def test_toxicity(spark):
    rnd = random.Random(2)
    clean, bad = [f"plain{i}" for i in range(60)], [f"vileword{i}" for i in range(8)]
    texts, labels = [None, ""], [0, 0]
    for i in range(200):
        w = [rnd.choice(clean) for _ in range(30)]
        if i % 3 == 0:
            w[rnd.randrange(30)] = rnd.choice(bad)
        texts.append(" ".join(w))
        labels.append(int(i % 3 == 0))
    model = toxicity.train([t or "" for t in texts[:150]], labels[:150])
    score = {r.doc_id: r.score for r in toxicity.score(table(spark, [*texts, "plain1 vileword33 plain2"]), model).collect()}
    assert sum((score[i] >= 0.3) == bool(labels[i]) for i in range(150, 202)) >= 48
    assert score[len(texts)] >= 0.3 and score[0] < 0.3


def test_secrets(spark):
    texts = [None, "", "login=bob host=db.example pass=short1 x", "pass=short1 alone", "token: abcdefghijkl AKIA" + "B" * 16]
    rows = {r.doc_id: r for r in secrets.scan(table(spark, texts)).collect()}
    assert not rows[0].base and not rows[0].linked and not rows[3].linked and len(rows[2].linked) == 3 and [s.kind for s in rows[4].base] == ["assign", "access"]
    clean = {r.doc_id: r for r in secrets.redact(table(spark, texts)).collect()}
    assert clean[4].text == "[SECRET] [SECRET]" and clean[4].n_chars == 17 and clean[0].text is None


def test_chat_masks(spark):
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", "yo"), (1, 2, None, None)]
    out = chat.views(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for who, said in (("ann", "hi<|end|>"), ("bob", "yo<|end|>"), ("unknown", "<|end|>")):
        mine = sorted((r for r in out if r.speaker == who), key=lambda r: r.position)
        text = "".join(r.rendered for r in mine)
        assert [text[r.mask_start : r.mask_end] for r in mine if r.mask_end > r.mask_start] == [said]
