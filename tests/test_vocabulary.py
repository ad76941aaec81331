"""Vocabulary splits, joined surfaces and the label index against plain models."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lexispark.operators import gates, vocabulary
from lexispark.sources import labelindex


def one(w):
    if w in vocabulary.IRREGULAR:
        return vocabulary.IRREGULAR[w]
    if len(w) <= 3 or w.endswith(vocabulary.NO_PLURAL):
        return w
    if w.endswith("ies") and len(w) > 4:
        return w[:-3] + "y"
    if w[-4:] in ("ches", "shes", "sses") or w[-3:] in ("xes", "zes"):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("'s") else w


def tail(s):
    for p in sorted(vocabulary.IRREGULAR, key=lambda p: (-len(p), p)):
        if s.endswith(p):
            return s[: -len(p)] + vocabulary.IRREGULAR[p]
    if any(s.endswith(v) for v in vocabulary.IRREGULAR.values() if v.endswith("s")):
        return s
    return one(s) if s not in vocabulary.IRREGULAR else s


def groups(phrases):
    """All pairs, then closure."""
    phrases = sorted(phrases)
    keys = {p: tuple(map(one, p.split())) for p in phrases}
    inside = lambda a, b: len(b) < len(a) and any(a[i : i + len(b)] == b for i in range(len(a)))
    label = {p: p for p in phrases}

    def related(a, b):
        if keys[a] == keys[b] or tail(a.replace(" ", "")) == tail(b.replace(" ", "")) or inside(keys[a], keys[b]):
            return True
        last = a.split()[-1]
        return any(last.endswith(e) and len(last) > len(e) + 1 and a[: -len(e)] == b for e in ("s", "es"))

    for a in phrases:
        for b in phrases:
            if a != b and label[a] != label[b] and (related(a, b) or related(b, a)):
                gone, to = label[a], label[b]
                label = {p: to if v == gone else v for p, v in label.items()}
    names = {v: min(tail(p.replace(" ", "")) for p in phrases if label[p] == v) for v in label.values()}
    return {p: names[v] for p, v in label.items()}


def test_split_of_a_vocabulary_equals_all_pairs(spark):
    rnd = random.Random(6)
    words = "data datum matrix matrices box boxes gas gases virus lens city cities warehouse ware house lake api apis x bus buses corpora analysis analyses's men".split()
    rows = []
    for d in ("one", "two", "three"):
        rows += [(d, i, rnd.choice(["", " "]).join(rnd.choice(words) for _ in range(rnd.randint(1, 4))) if rnd.random() < 0.3 else " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 3)))) for i in range(35)]
    rows += [("one", 90, None), ("one", 91, "!"), ("two", 92, "x"), ("two", 93, "City's LAKE"), ("three", 94, "one medical lens")]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "domain string, position long, term string").withColumn("phrase", F.lit("clash"))
    got = vocabulary.split(df, ["two", "one", "three"], spark.createDataFrame([("medical lens",), (None,)], "t string"), 0.5, "y").collect()
    normal = lambda t: " ".join("".join(c if c.isalnum() or c in "' " else " " for c in (t or "").lower()).split())
    order = {"two": 1, "one": 2, "three": 3}
    want, seen, joined = {}, {}, {}
    for d, i, t in sorted(rows, key=lambda r: (order[r[0]], r[1])):
        p = normal(t)
        state = "dropped" if len(p) <= 1 else "excluded" if "medical lens" in p else "kept" if p not in seen else "repeated" if seen[p] == d else "duplicate"
        if state == "kept":
            seen[p] = d
            joined.setdefault(p.replace(" ", ""), d)
        want[d, i] = (p, state)
    assert {(r.domain, r.position): (r.phrase, r.state) for r in got} == want
    group = groups(seen)
    kept = {r.phrase: r for r in got if r.state == "kept"}
    assert {p: r.group for p, r in kept.items()} == group
    assert {p: r.owner for p, r in kept.items()} == {p: joined[p.replace(" ", "")] for p in seen}
    side = lambda g: "targeted" if int.from_bytes(hashlib.sha256(f"y\n{g}".encode()).digest()[:8], "big") < 0.5 * 2**64 else "heldout"
    assert all(r.side == side(r.group) for r in kept.values()) and {r.side for r in kept.values()} == {"targeted", "heldout"}
    assert vocabulary.split(df.limit(0), ["two"]).count() == 0
    with pytest.raises(gates.GateError):
        vocabulary.split(df, ["one", "two"])


def test_plural_forms(spark):
    ws = [*vocabulary.IRREGULAR, "cities", "boxes", "gas", "class", "physics", "dogs", "dog's", "as", "quizzes", "dies"]
    got = spark.createDataFrame([(w,) for w in ws], "w string").select("w", vocabulary.singular(F.col("w")).alias("s"), vocabulary.canonical(F.array(F.lit("big"), F.col("w"))).alias("c"), vocabulary.surfaces(F.col("w")).alias("f")).collect()
    assert all(r.s == one(r.w) and r.c == tail("big" + r.w) for r in got)
    assert all({r.w, r.w + "s", r.w + "es"} <= set(r.f) and None not in r.f for r in got)
    forms = {r[0]: set(r[1]) for r in spark.createDataFrame([("submatrix",), ("bigcity",)], "w string").select("w", vocabulary.surfaces(F.col("w"))).collect()}
    assert forms == {"submatrix": {"submatrix", "submatrixs", "submatrixes", "submatrices"}, "bigcity": {"bigcity", "bigcitys", "bigcityes", "bigcities"}}


def test_joined_surfaces_equal_all_runs(spark):
    rnd = random.Random(2)
    make = lambda n: ["".join(rnd.choice("ab") for _ in range(rnd.randint(1, 3))) for _ in range(n)]
    rows = [(i, make(rnd.randint(0, 12))) for i in range(150)] + [(900, None), (901, [""]), (902, ["a", "", "bbbbb"])]
    forms = ["".join(make(rnd.randint(1, 5))) for _ in range(6)] + ["abbbbb", "", None]
    want = {i for i, w in rows if w and any("".join(w[a:b]) in forms[:-2] for a in range(len(w)) for b in range(a + 1, len(w) + 1))}
    df, f = spark.createDataFrame(rows, "id long, w array<string>"), spark.createDataFrame([(x,) for x in forms], "form string")
    assert 902 in want and {r.id for r in vocabulary.holding(df, "w", f, "form").collect()} == want
    assert {r.id for r in vocabulary.holding(df, "w", f, "form", most_chars=0).collect()} == want
    assert vocabulary.holding(df, "w", f.limit(0), "form").count() == 0


def test_label_index(spark, tmp_path):
    root = str(tmp_path / "index")
    labels = spark.createDataFrame([(i, None if i % 5 == 0 else f"t{i}") for i in range(200)], "id long, text string")
    parts = {"run": "r1", "cleaning": {"version": 3}, "shards": [1, 2]}
    folder = labelindex.write(labels, root, parts, "id", buckets=4)
    assert labelindex.write(labels.limit(0), root, {"shards": [1, 2], "cleaning": {"version": 3}, "run": "r1"}, "id") == folder  # kept
    spark.sql(f"drop table label_index_{folder.split('/')[-1]}")  # another session doesn't know the table
    index = labelindex.load(spark, folder, parts, verify=True)
    occurrences = spark.createDataFrame([(i % 120, i) for i in range(300)], "id long, place long")
    out = labelindex.looked_up(occurrences, index, "id")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = labelindex.looked_up(occurrences, index, "id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == 1 and "SelectedBucketsCount: 4 out of 4" in plan  # the side of the index isn't dealt anew
    got = {r.place: (r.state, r.text) for r in out.collect()}
    assert got == {i: ("rejected", None) if i % 120 % 5 == 0 else ("kept", f"t{i % 120}") for i in range(300)}
    with pytest.raises(Exception, match="no record of 500"):
        labelindex.looked_up(spark.createDataFrame([(500, 1)], "id long, place long"), index, "id").collect()
    assert [r.state for r in labelindex.looked_up(spark.createDataFrame([(500, 1)], "id long, place long"), index, "id", refuse=False).collect()] == ["missing"]
    with pytest.raises(labelindex.IndexMismatch, match="cleaning"):
        labelindex.load(spark, folder, {**parts, "cleaning": {"version": 2}})
    with pytest.raises(labelindex.IndexMismatch):
        labelindex.load(spark, root + "/none", parts)
    with pytest.raises(gates.GateError):
        labelindex.write(labels.union(labels), root, {"run": "r2"}, "id")
    labels.limit(3).write.mode("append").parquet(folder)
    spark.catalog.refreshTable(f"label_index_{folder.split('/')[-1]}")
    with pytest.raises(labelindex.IndexMismatch, match="differ"):
        labelindex.load(spark, folder, parts, verify=True)
