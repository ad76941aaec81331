"""Operators that SQL can't express, against small models; readers, sinks and streams round trip."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from lexispark.functions import align
from lexispark.operators import gates, sequences, statistics
from lexispark.plans import registry
from lexispark.sources import readers, writers
from lexispark.streaming import journal


def cost(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_alignment_is_least_and_ties_are_ordered():
    rnd = random.Random(1)
    for _ in range(200):
        a, b = ([rnd.choice("abc") for _ in range(rnd.randint(0, 7))] for _ in "xy")
        steps = align.path(a, b)
        assert sum(o != "=" for o, _, _ in steps) == cost(a, b)
        assert [a[i] for o, i, _ in steps if o != "I"] == a and [b[j] for o, _, j in steps if o != "D"] == b
    assert [o for o, _, _ in align.path(["a"], ["b"])] == ["S"]


def test_longest_repeat():
    assert align.longest(list("ababab")) == (3, 2) and align.longest(list("aaaa")) == (4, 1)
    assert align.longest([]) == (0, 0) and align.longest(list("abc")) == (1, 1)


def test_cardinal():
    assert align.cardinal(1_200_021) == "one million two hundred thousand twenty one" and align.cardinal(0) == "zero"
    assert align.cardinal(10**15) == "one" + " zero" * 15


def test_caps_count_only_kept_rows(spark):
    rows = [(i, s, t, 0) for i, (s, t) in enumerate([("a", "x"), ("b", "x"), ("a", "y"), ("c", "x"), ("a", "z"), ("c", "y")])]
    out = sequences.capped(spark.createDataFrame(rows, "i long, s string, t string, g long"), {"s": 2, "t": 2}, "i", group="g")
    assert sorted(r.i for r in out.collect()) == [0, 1, 2, 5]


def test_caps_of_a_whole_table_are_decided_in_rounds(spark):
    rnd = random.Random(4)
    for caps in ({"s": 3, "t": 5}, {"s": 6, "t": 2}):
        rows = [(i, rnd.choice([None, *"abcdefgh"]), rnd.choice("uvwxyz")) for i in range(300)]
        want, held = [], {}
        for i, s, t in rows:
            if held.get(("s", s), 0) < caps["s"] and held.get(("t", t), 0) < caps["t"]:
                want.append(i)
                for k in (("s", s), ("t", t)):
                    held[k] = held.get(k, 0) + 1
        out = sequences.capped(spark.createDataFrame(rows, "i long, s string, t string").repartition(5), caps, "i")
        assert sorted(r.i for r in out.collect()) == want


def test_two_key_caps_of_events(spark):
    sf = "/root/testdata/sf0.01"
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "event_type").orderBy("event_id").collect()
    want, users, types = [], {}, {}
    for e in events:
        if users.get(e.user_id, 0) < 20 and types.get(e.event_type, 0) < 60:
            want.append(e.event_id)
            users[e.user_id], types[e.event_type] = users.get(e.user_id, 0) + 1, types.get(e.event_type, 0) + 1
    out = registry.QUERIES["w12_two_key_caps"](spark, sf)
    assert sorted(r.event_id for r in out.collect()) == want
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (9, 8), (8, 7), (7, 1)]
    out = {r.node: r.label for r in sequences.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 4: 4, 5: 4}


def test_bootstrap(spark):
    rows = [("s", c, 100.0, float(c % 3), float(c % 3 + 2)) for c in range(20)]
    out = statistics.paired_bootstrap(spark.createDataFrame(rows, "set string, c long, words double, a double, b double"), "set", "c", "a", "b", replicates=300).first()
    assert out.delta == pytest.approx(2.0) and out.lo == pytest.approx(2.0) and out.resolved
    alone = statistics.paired_bootstrap(spark.createDataFrame(rows[:1], "set string, c long, words double, a double, b double"), "set", "c", "a", "b", replicates=30).first()
    assert alone.lo is None and not alone.resolved


def test_exact_tests():
    assert statistics.fisher_exact(3, 1, 1, 3) == pytest.approx(0.4857, abs=1e-4)
    assert statistics.upper_bound(0, 10) == pytest.approx(1 - 0.05 ** 0.1, abs=1e-6)


def test_gate(spark):
    with pytest.raises(gates.GateError, match="twice"):
        gates.expect_empty(gates.duplicates(spark.createDataFrame([(1,), (1,)], "i long"), "i"), "twice")


def test_readers(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text("".join(json.dumps({"id": i, "text": "t"}) + "\n" for i in "ba") + "\0\n{torn\n")
    good, bad = readers.tolerant_jsonl(spark, str(tmp_path / "m.jsonl"), "id string, text string")
    assert [r.id for r in good.orderBy("id").collect()] == ["a", "b"] and bad.count() == 2
    (tmp_path / "t.tsv").write_text('client\tpath\n"x\ty\n')
    assert [tuple(r) for r in readers.tsv(spark, str(tmp_path / "t.tsv"), ["client", "path"]).collect()] == [('"x', "y")]
    (tmp_path / "r.tsv").write_text("# rules\ncolour\tcolor\n\n")
    assert [tuple(r) for r in readers.rules(spark, str(tmp_path / "r.tsv"), 2).collect()] == [("colour", "color")]
    (tmp_path / "s.json").write_text(json.dumps({"records": [{"id": 1}, {"id": 2}]}))
    assert readers.records(spark, str(tmp_path / "s.json"), "id long").count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 1.0), ("a", 2.0)], "id string, duration double")
    writers.manifest(df, str(tmp_path / "m"), "id")
    assert [r.id for r in spark.read.json(str(tmp_path / "m")).collect()] == ["a", "b"]
    with pytest.raises(gates.GateError):
        writers.manifest(df.union(df), str(tmp_path / "n"), "id")
    writers.freeze(df, str(tmp_path / "f"))
    writers.freeze(df, str(tmp_path / "f"))
    with pytest.raises(gates.GateError):
        writers.freeze(df.limit(1), str(tmp_path / "f"))


def test_streamed_journal(spark, tmp_path):
    rows = [(i, f"id{i % 5}", float(i % 5 + (i == 9))) for i in range(10)]
    for n, part in enumerate(itertools.batched(rows, 5)):
        spark.createDataFrame(part, "pos long, id string, content double").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("pos long, id string, content double").parquet(str(tmp_path / "in"))
    q = journal.first_seen(stream, "id").writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("firsts").count() == 5
    journal.run_once(stream, lambda df: df.groupBy("id").agg(F.count("*").alias("n")), str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("n")).first()[0] == 10


def test_ranks_of_a_large_table_with_other_columns(spark):
    df = spark.range(300_000).selectExpr("xxhash64(id) as h", "id", "repeat('x', 20) as payload")
    got = sequences.ranked(df, "h", "id").agg(F.count_distinct("rank"), F.max("rank"), F.count("*")).first()
    assert tuple(got) == (300_000, 299_999, 300_000)
    first = sequences.ranked(df, "h", "id").where("rank < 3").orderBy("rank").select("id").collect()
    assert first == df.orderBy("h", "id").limit(3).select("id").collect()
