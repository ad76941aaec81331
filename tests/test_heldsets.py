"""Deny-lists by held-out set, talks in two sets of labels and gates on hand-made tables."""

import pytest
from pyspark.sql import functions as F

from lexispark.functions import align
from lexispark.functions import cleaning as C
from lexispark.functions import text as T
from lexispark.operators import decontaminate as D
from lexispark.operators import gates as G

TALK = " ".join(f"w{i}" for i in range(60))
LONG = " ".join(f"v{i}" for i in range(12))


@pytest.fixture
def held(spark):
    return spark.createDataFrame([(1, "one", LONG), (2, "one", "too short"), (3, "two", TALK), (4, None, LONG)], "utt long, name string, norm string")


def test_rules_and_report_by_set(spark, held):
    docs = spark.createDataFrame([("a", "x " + LONG + " y"), ("b", "nothing of the kind"), ("c", TALK), ("d", None)], "rec string, norm string")
    named = spark.createDataFrame([("one", "b"), ("one", "a"), ("two", "far"), ("two", None), (None, "b")], "name string, rec string")
    reserved = spark.createDataFrame([("c",)], "rec string")
    rules = {r.rec: r.rules for r in D.denylist(docs, held, reserved, "rec", "utt", identity=named).collect()}
    assert rules == {"a": ["containment", "identity"], "b": ["identity"], "c": ["containment", "reserved"], "far": ["identity"]}
    got = {r.name_: r.asDict() for r in D.set_report(docs, held, named, "rec", "utt", "name").withColumnRenamed("name", "name_").collect()}
    pick = lambda s: tuple(got[s][c] for c in ("utterances", "checked", "skipped_short", "skipped_empty", "contained_utterances", "containment_recordings", "identity_recordings", "recordings"))
    assert set(got) == {"one", "two"} and pick("one") == (2, 1, 1, 0, 1, 1, 2, 2) and pick("two") == (1, 1, 0, 0, 1, 1, 1, 2)
    none = D.set_report(docs.limit(0), held.limit(0), named.limit(0), "rec", "utt", "name")
    assert none.count() == 0


def test_boilerplate_only_utterances(spark, held):
    docs = spark.createDataFrame([(str(i), LONG) for i in range(5)], "rec string, norm string")
    named = spark.createDataFrame([], "name string, rec string")
    got = D.set_report(docs, held.where("utt = 1"), named, "rec", "utt", "name", most_df=4).first()
    assert (got.checked, got.skipped_empty, got.containment_recordings) == (0, 1, 0)


def test_talks_across_rows_and_label_sets(spark, held):
    w = TALK.split()
    rows = [(1, 1, " ".join(w[:10]), None), (1, 2, " ".join(w[10:25]), "other"), (2, 3, "none of it", " ".join(w[20:40])), (3, 4, " ".join(w[:9]), ""), (4, 5, None, None), (None, 6, TALK, TALK)]
    df = spark.createDataFrame(rows, "rec long, id long, text string, raw string")
    near = D.talks(df, held.where("utt = 3"), "rec", "id", {"text": "text", "raw": "raw"}, "utt")
    got = {(r.rec, r.label_set): (r.windows, round(r.closest, 6)) for r in near.collect()}
    assert got[(1, "text")] == (1, 1.0) and got[(2, "raw")] == (1, 1.0) and got[(3, "text")] == (0, round(2 / 13, 6)) and (2, "text") not in got and (4, "raw") not in got
    assert {r.id: r.label_sets for r in D.rejected(df, near, "rec", "id").collect()} == {1: ["text"], 2: ["text"], 3: ["raw"]}


def test_shards(spark):
    df = spark.createDataFrame([("a", 0, 3), ("a", 3, 5), ("a", 5, 9), ("b", 0, 3), ("b", 4, 9), ("c", 1, 9), ("d", 0, 5), ("d", 4, 9), ("e", 0, 4), ("e", 4, 4)], "g string, lo long, hi long")
    assert sorted(tuple(r) for r in G.gaps(df, "lo", "hi", "g").collect()) == [("b", 4, 9, 3), ("d", 4, 9, 5), ("e", 4, 4, 4)]
    assert {r.g: r.covered for r in G.reach(df, "lo", "hi", 9, "g").collect()} == {"b": 3, "c": 0, "d": 5, "e": 4}
    assert G.gaps(df.limit(0), "lo", "hi", "g").count() == 0


def test_tables_of_terms(spark):
    tables = spark.createDataFrame([("a", "X y"), ("b", "x Y"), ("b", "x Y"), ("a", "only"), ("a", "ONLY"), ("a", None)], "t string, f string")
    assert [(r.form, r.tables) for r in G.shared(tables, "t", "f").collect()] == [("x y", ["a", "b"])]
    forms = spark.createDataFrame([("data set", "dataset"), ("gonna", "going  to"), ("to", "too"), ("same", "Same"), ("x", "a data set b"), ("z", "undata set")], "w string, o string")
    assert {(r.w, r.form) for r in G.unsettled(forms, "w", "o").collect()} == {("gonna", "to"), ("x", "data set")}


def test_final_builds_need_all_parts(spark):
    sets = spark.createDataFrame([("m1",), ("m2",), (None,)], "part string")
    assert G.expect_final(["m1", "m2"], sets, "part") == [] and G.expect_final(["m1", "m3"], sets, "part", final=False) == ["m3"] and G.expect_final([], sets, "part") == []
    with pytest.raises(G.GateError, match="m3"):
        G.expect_final(["m1", "m3"], sets, "part")
    assert sets.where(F.col("part").isNull()).count() == 1


def test_forms_that_count_after_a_number(spark):
    phrases = ["mg", "pill box", "pillbox", "milli gram", "milligram", "mg kg"]
    assert C.variant_forms(phrases) == {"pill box": ["pillbox"], "pillbox": ["pill box"], "milli gram": ["milligram"], "milligram": ["milli gram"]}
    groups = [["mg", "milligram"], ["mg kg", "milligrams per kilogram"], ["mg", "em gee"]]
    same = C.equivalent_forms(groups, phrases)
    assert same == {"mg": ["em gee", "milli gram", "milligram"], "milligram": ["mg", "milli gram"], "milli gram": ["mg", "milligram"], "mg kg": ["milligrams per kilogram"]}
    with pytest.raises(ValueError, match="two or more"):
        C.equivalent_forms([["mg", " mg "]], phrases)
    rows = [(0, "take 5 mg now", "take 5 milligram now", True), (1, "take some mg now", "take some milligram now", False), (2, "take one mg now", "take one em gee now", True), (3, "mg now", "milligram now", False),
            (4, "at 2.5 mg kg daily", "at 2.5 milligrams per kilogram daily", True), (5, "x 1 pill box y", "x 1 pillbox y", True), (6, "take 5 mg now", "take 5 now", False), (7, "take 5 mg now", None, False)]
    df = spark.createDataFrame(rows, "id int, r string, h string, want boolean").withColumn("s", align.phrase_matcher(phrases)(T.words(F.col("r"))))
    got = df.select("id", "want", F.explode(C.reproduced(C.variant_forms(phrases), same)("r", "h", "s")).alias("x")).collect()
    assert len(got) == 8 and all(r.x.reproduced == r.want for r in got), [(r.id, r.x) for r in got if r.x.reproduced != r.want]
    assert not any(r.x.reproduced for r in df.where("id in (0, 2, 4)").select(F.explode(C.reproduced({})("r", "h", "s")).alias("x")).collect())
