"""Drafts, bulk distances and the cleaning rules: planted cases, plain models and properties on random texts."""

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.functions import align, distance
from lexispark.functions import respelling as Y
from lexispark.functions.drafts import Change, Draft, apply

LEXICON = {"VHS": (25, 12), "DVD": (30, 11), "NATO": (6, 10), "RARE": (5, 9), "LESS": (10, 10)}
RULES = Y.Rules(
    forms=[("forms", "double check", "double-check"), ("forms", "macos", "macOS"), ("variants", "data set", "dataset"), ("dialect", "goin'", "going"), ("dialect", "'em", "them"),
           ("dialect", "gonna", "going to"), ("forms", "html", "HTML"), ("variants", "p t s d", "PTSD")],
    sets={"maybe": ["maybe", "may be"], "ya": ["ya", "you*"]},
    units={"milligrams": "mg", "mg": "mg", "kilogram": "kg", "kg": "kg", "µg": "mcg", "mcg": "mcg"},
    before=["spelled"], after=["dot com"], lexicon=LEXICON,
)
PLAIN = Y.Rules(forms=RULES.forms, units={}, lexicon=None)


def changed(rule, text, closed=()):
    draft = Draft(text)
    draft.revise(rule(text, list(closed)))
    return draft.text


def test_drafts_keep_the_origin_of_every_piece():
    rnd = random.Random(1)
    for _ in range(400):
        text = "".join(rnd.choice("abcdef ") for _ in range(rnd.randint(0, 25)))
        draft, model = Draft(text), text
        for _ in range(rnd.randint(1, 5)):
            at, changes = 0, []
            while at <= len(model) and rnd.random() < 0.8:
                a = rnd.randint(at, len(model))
                b = rnd.randint(a, min(len(model), a + 3))
                changes.append(Change(a, b, "".join(rnd.choice("XYZ") for _ in range(rnd.randint(0 if b > a else 1, 3))), 1, "r"))
                at = b + 1
            draft.revise(changes)
            model = apply(model, [(c.start, c.end, c.new) for c in changes])
            assert draft.text == model
        edits = draft.edits()
        assert apply(text, [(e[3], e[4], e[6]) for e in edits]) == model
        assert all(text[e[3] : e[4]] == e[5] and model[e[7] : e[8]] == e[6] for e in edits)
        assert all(x[4] <= y[3] and x[8] <= y[7] for x, y in zip(edits, edits[1:], strict=False))
    with pytest.raises(ValueError):
        Draft("abc").revise([Change(0, 2, "x", 1, "r"), Change(1, 3, "y", 1, "r")])


def test_edits_that_meet_become_one_named_by_the_letters():
    text, edits = PLAIN.clean("my M A C O S here")
    assert text == "my macOS here" and [e[1:7] for e in edits] == [("acronyms", "spelled-out", 3, 12, "M A C O S", "macOS")]
    assert PLAIN.clean("H T M L and Gonna")[0] == "HTML and Going to"


@pytest.mark.parametrize("text,want", [
    ("the A. P. I. and", "the API and"), ("the A.P.I.", "the API."), ("an A P I.", "an API."), ("G.P.U.s run", "GPUs run"), ("G P U's", "GPUs"), ("G P Us", "GPUs"),
    ("G. P. U. s", "GPUs"), ("the U.S. is", "the U.S. is"), ("T V set", "T V set"), ("U. S. law", "US law"), ("I I I think", "I I I think"), ("J. A. Mellon", "J. A. Mellon"), ("A B Cat", "A B Cat"),
    ("A P I Cat", "A P I Cat"), ("A-V-E-N", "A-V-E-N"), ("C T X-ray", "C T X-ray"), ("A.P.I.x", "A.P.I.x"), ("hard R. Is that", "hard R. Is that"), ("P T S D. M R Is", "PTSD. MRIs"),
    ("A P I NASA", "API NASA"),
])
def test_spelled_out_acronyms(text, want):
    assert PLAIN.clean(text)[0] == want
    assert PLAIN.clean(want)[0] == want


@pytest.mark.parametrize("text,cls,evidence,want", [
    ("so T V here", "pair", "", "so T V here"), ("so U. S. here", "pair", "", "so US here"), ("so I I I here", "i-repeat", "", "so I I I here"),
    ("so J. A. X. Mellon", "initials", "", "so J. A. X. Mellon"), ("so F, I, T, Z here", "other", "comma", "so F, I, T, Z here"), ("so A B C here", "other", "alphabet", "so A B C here"),
    ("so B A D G U here", "ambiguous", "", "so BADGU here"), ("so B A D E here", "other", "notes", "so B A D E here"), ("Fitz is F I T Z here", "spelling", "echo", "Fitz is F-I-T-Z here"),
    ("Fits is F I T Z here", "spelling", "echo", "Fits is F-I-T-Z here"), ("spelled Q R S T here", "spelling", "cue", "spelled Q-R-S-T here"), ("at Q R S T dot com", "spelling", "cue", "at Q-R-S-T dot com"),
    ("so N A T O here", "acronym", "lexicon", "so NATO here"), ("so R A R E here", "ambiguous", "", "so RARE here"), ("so V H S D V D here", "acronym", "split", "so VHSDVD here"),
    ("so Q-R-S-T here", "spelling", "hyphen", "so Q-R-S-T here"), ("so q r s t here", "other", "lowercase", "so q r s t here"), ("so s-e-n-n-a.", "spelling", "hyphen", "so S-E-N-N-A"),
    ("so Q R S here", "acronym", "short", "so QRS here"), ("so Q R S T here", "ambiguous", "", "so QRST here"),
])
def test_each_class_of_spelled_out_letters(text, cls, evidence, want):
    found = RULES.judged(text, [])
    assert [(c, e) for _, c, e, _ in found] == [(cls, evidence)]
    want = want + "." if text.endswith("a.") else want
    assert RULES.clean(text)[0] == want and RULES.clean(want)[0] == want


def test_letters_split_into_known_acronyms_as_brute_force_does():
    rnd = random.Random(4)
    for _ in range(300):
        known = {"".join(rnd.choice("AB") for _ in range(rnd.randint(2, 6))): (rnd.choice([19, 20, 40]), rnd.choice([9, 10])) for _ in range(8)}
        rules = Y.Rules(lexicon=known)
        word = "".join(rnd.choice("AB") for _ in range(rnd.randint(2, 14)))
        ok = {k for k, (n, r) in known.items() if n >= 20 and r >= 10 and 3 <= len(k) <= 5}
        cuts = (c for n in range(1, len(word)) for c in itertools.combinations(range(1, len(word)), n))
        want = any(all(word[a:b] in ok for a, b in zip((0, *c), (*c, len(word)), strict=True)) for c in cuts)
        assert rules.parts(word) == want


@pytest.mark.parametrize("text,want", [
    ("take 5 milligrams now", "take 5 mg now"), ("1,000-2,000 milligrams per kilogram", "1,000-2,000 mg/kg"), ("2.5-MG", "2.5 mg"), ("3 µg", "3 mcg"), ("v5 milligrams", "v5 milligrams"),
    ("5 mg", "5 mg"), ("5 milligrams's", "5 milligrams's"), ("five milligrams", "five milligrams"), ("1.2.3 mg per kg", "1.2.3 mg per kg"),
])
def test_dose_units(text, want):
    assert changed(RULES.dose_units, text) == want and changed(RULES.dose_units, want) == want


@pytest.mark.parametrize("text,want", [
    ("Double check it", "Double-check it"), ("the Data Set", "the Dataset"), ("goin' on", "going on"), ("said 'I was goin'", "said 'I was goin'"), ("get 'em all", "get them all"), ("the 'em' tag", "the 'em' tag"),
    ("index.html html's html", "index.html html's HTML"), ("'Em", "Them"), ("'goin'", "'goin'"), ("ungonna gonna", "ungonna going to"),
])
def test_tables(text, want):
    assert changed(RULES.tables, text) == want and changed(RULES.tables, want) == want


def test_closed_places_and_recorded_choices():
    text = "Maybe ya double check ya."
    found = RULES.spans(text)
    assert [f[2:] for f in found] == [("Maybe", "maybe"), ("ya", "ya"), ("ya", "ya")] and RULES.spans("ya'll yams") == []
    record = [{"start": a, "end": b, "original": o, "set": s, "chosen": c} for (a, b, o, s), c in zip(found, ("may be", None, "you"), strict=True)]
    out, edits = RULES.clean(text, None, record)
    assert out == "May be ya double-check you." and [(e[0], e[1]) for e in edits] == [(2, "choices"), (1, "forms"), (2, "choices")]
    for spoiled in (record[:2], [{**record[0], "start": 1}, *record[1:]], [{**record[0], "chosen": "perhaps"}, *record[1:]]):
        with pytest.raises(ValueError):
            RULES.clean(text, None, spoiled)
    assert RULES.clean("", None, []) == ("", []) and RULES.clean("", "donor") == ("", [])


def test_faults_of_tables():
    assert RULES.faults() == []
    bad = Y.Rules(forms=[("a", "x y", "z"), ("b", "X Y", "w"), ("c", "p", "x y"), ("d", "plan b", "plan B"), ("e", "may be so", "k")], sets={"one": ["may be"], "two": ["p", "may be"]}, units={"gram": "g"})
    told = "; ".join(bad.faults())
    for part in ("listed twice", "changed again", "single capital", "holds the member", "needs two different", "is in the sets", "stands in", "isn't listed as itself"):
        assert part in told


def test_cleaning_is_settled_and_its_edits_rebuild_the_text():
    rnd = random.Random(7)
    words = "M A C O S|A. P. I.|U.S.|Gonna|double check|Data set|goin'|'em|5 milligrams per kg|I I|J. A. Mellon|F-I-T-Z|fitz|spelled|q r s|V H S D V D|N A T O|maybe|ya|the|it's|P T S D. M R Is|end.|Und|so,".split("|")
    for _ in range(500):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 14)))
        donor = "".join(c.upper() if i and rnd.random() < 0.1 else c for i, c in enumerate(text)) if rnd.random() < 0.7 else None
        donor = donor and " ".join(w + rnd.choice(["", "", ".", ",", "?"]) for w in donor.split())
        record = [{"start": a, "end": b, "original": o, "set": s, "chosen": rnd.choice([None, *RULES.offered(s)[:-1]])} for a, b, o, s in RULES.spans(text)]
        out, edits = RULES.clean(text, donor, record)
        assert apply(text, [(e[3], e[4], e[6]) for e in edits]) == out and out
        assert all(text[e[3] : e[4]] == e[5] != e[6] == out[e[7] : e[8]] for e in edits)
        assert RULES.clean(out)[0] == out
        assert PLAIN.clean(PLAIN.clean(text)[0])[0] == PLAIN.clean(text)[0]


def test_columns(spark):
    rows = [(1, "Maybe N A T O", "Maybe N A T O."), (2, None, "x"), (3, "", None), (4, "ya gonna", None)]
    df = spark.createDataFrame(rows, "id long, text string, donor string").withColumn("choices", F.lit(None).cast(Y.CHOICE.simpleString().join(["array<", ">"])))
    got = {r.id: r.x for r in df.select("id", Y.cleaner(RULES)("text", "donor", "choices").alias("x")).collect()}
    assert got[1].text == "Maybe NATO." and got[2] == (None, None) and got[3] == ("", []) and got[4].text == "ya going to"
    # for letters that a mark is put behind, one edit
    assert [(e.rule, e.start, e.end, e.replacement) for e in got[1].edits][0][0] == "acronyms"
    told = df.select("id", Y.judge(RULES)("text").alias("j")).collect()
    assert {r.id: None if r.j is None else [(j["class"], j.output) for j in r.j] for r in told} == {1: [("acronym", "NATO")], 2: None, 3: [], 4: []}
    asked = df.select("id", "text", F.explode(Y.spans(RULES)("text")).alias("s")).select("id", "text", "s.*")
    asked = asked.withColumn("key", Y.prompt_key("t", F.col("text"), F.col("start"), F.col("end"), F.col("options")))
    keys = {r.id: r.key for r in asked.collect()}
    answers = spark.createDataFrame([(keys[1], [0.05, 0.9, 0.05]), (keys[4], [0.1, 0.2, 1.9])], "key string, probabilities array<double>")
    assert {r.id: r.chosen for r in Y.decided(asked, answers).collect()} == {1: "may be", 4: None}
    for wrong in (answers.limit(1), answers.union(answers), answers.withColumn("probabilities", F.array(F.lit(1.0)))):
        with pytest.raises(Exception, match="no sound answer"):
            Y.decided(asked, wrong).collect()
    for probs, want in (([0.5, 0.5, 0.0], None), ([0.9, 0.1, 0.0], "a"), ([0.0, 0.0, 0.0], None), ([0.0, 0.0, 5.0], None), ([9.0, 0.0, 1.0], "a"), ([0.0, 8.9, 1.0], None)):
        one = spark.range(1).select(Y.decision(F.array(*map(F.lit, probs)), F.array(F.lit("a"), F.lit("b"), F.lit(Y.CANT_TELL))).alias("c")).first()
        assert one.c == want


def test_acronym_counts(spark):
    rows = [("r1", "NATO N A T O NATOs x-NATO"), ("r2", "NATO n-a-t-o"), ("r1", None), (None, "NATO")]
    got = {r.letters: tuple(r)[1:] for r in Y.acronym_counts(spark.createDataFrame(rows, "rec string, text string"), "text", "rec").collect()}
    assert got == {"NATO": (3, 2, 2)}
    counts = spark.createDataFrame([("NATO", 5, 0, 10), ("RARE", 4, 0, 10), ("FEW", 9, 1, 9)], "letters string, compact long, spelled long, recordings long")
    assert Y.lexicon_of(counts) == {"NATO": (5, 10)}
    with pytest.raises(ValueError):
        Y.lexicon_of(counts, most=0)


def test_distances_equal_the_alignment_and_are_faster(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    make = lambda n: [rnd.choice(words) for _ in range(rnd.randint(0, n))]
    refs, hyps = [make(40) for _ in range(700)] + [make(200) for _ in range(20)], [make(40) for _ in range(700)] + [make(200) for _ in range(20)]
    refs += [["a"] * 64, ["a"] * 65, ["a"], []]
    hyps += [["a"] * 63 + ["b"], ["b"] * 65, [], []]
    at = time.time()
    want = [sum(op != "=" for op, _, _ in align.path(a, b)) for a, b in zip(refs, hyps, strict=True)]
    slow, at = time.time() - at, time.time()
    assert distance.many(refs, hyps).tolist() == want
    fast = time.time() - at
    assert [distance.one(a, b) for a, b in zip(refs, hyps, strict=True)] == want
    assert slow > 5 * fast, (slow, fast)
    df = spark.createDataFrame([(" ".join(a), " ".join(b)) for a, b in zip(refs[:50], hyps[:50], strict=True)] + [(None, "x y")], "r string, h string")
    assert [r[0] for r in df.select(distance.word_distance("r", "h")).collect()] == [*want[:50], 2]
    assert distance.many([], []).tolist() == [] and np.array_equal(distance.many([[]], [["x"]]), [1])
