"""Reports and cache builds against hand-made cases."""

import pytest
from pyspark.sql import functions as F

from lexispark.functions import text as T
from lexispark.operators import gates, sequences, statistics
from lexispark.sources import writers


def test_harm_screen(spark):
    rows = [("g", "A", True, False)] * 3 + [("g", "B", False, True)] * 3 + [("x", "A", True, False)] * 3 + [("few", "A", True, False)] * 2 + [("few", None, True, None)]
    df = spark.createDataFrame(rows, "g string, s string, o boolean, c boolean")
    got = {(r["g"], r["s"]): (r.aligned, r.original, r.cleaned, r.judged, r.harm, r.disabled) for r in statistics.harm_screen(df, "g", "s", "o", "c", 3, F.col("g") == "x").collect()}
    assert got[("g", "A")] == (3, 3, 0, True, True, True) and got[("g", "both")] == (6, 3, 3, True, False, True)
    assert got[("x", "A")] == (3, 3, 0, True, True, False)
    assert got[("few", "A")] == (2, 2, 0, False, False, True) and got[("few", "both")] == (3, 3, 0, True, True, True) and ("few", None) in got


def test_recordings(spark):
    ids = ["yodas:a_b_1_2_3_4", "yodas:short", "librispeech:12-3-4", "voxpopuli:x_y_z", "ami:A_B_C_D_E", "med-osce:7-1", "else:a_b_c", None]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "id string").select(T.recording(F.col("id"))).collect()]
    assert got == ["yodas:a_b", "yodas:short", "librispeech:12", "voxpopuli:x", "ami:A_B_C", "med-osce:7", "else:a_b", None]
    with pytest.raises(Exception, match="no source"):
        spark.createDataFrame([("plain",)], "id string").select(T.recording(F.col("id"))).collect()


def test_seeded_orders_keep_null_groups(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else "a") for i in range(30)], "k long, g string")
    got = sequences.hash_shuffle(df, "s", "k", "g").collect()
    assert sorted(r.place for r in got if r.g is None) == list(range(1, 11)) and sorted(r.place for r in got if r.g) == list(range(1, 21))
    all_ = sequences.numbered(df, F.expr("k div 7"), "k", by=[], name="n").collect()
    assert all(r.n == r.k for r in all_) and len(all_) == 30


def test_cache_builds_each_shard_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "X y"), (2, "b", None), (3, None, "z")], "id long, source string, text string")
    derived = {"norm": F.lower("text")}
    at = str(tmp_path / "cache")
    assert sorted(map(str, writers.cache(df.where("id < 3"), at, "source", **derived))) == ["a", "b"]
    assert writers.cache(df, at, "source", **derived) == [None] and writers.cache(df, at, "source", **derived) == []
    assert {(r.id, r.source, r.norm) for r in spark.read.parquet(f"{at}/shards").select("id", "source", "norm").collect()} == {(1, "a", "x y"), (2, "b", None), (3, None, "z")}
    with pytest.raises(gates.GateError, match="changed"):
        writers.cache(df.withColumn("text", F.lit("other")), at, "source", **derived)


def test_sized_groups(spark, tmp_path):
    import pyarrow.parquet as pq

    at = tmp_path / "sized"
    writers.sized(spark.range(1000).select("id", F.lit("same").alias("word")).coalesce(1), str(at), ["id"])
    meta = pq.ParquetFile(next(at.glob("*.parquet"))).metadata.row_group(0)
    assert "RLE_DICTIONARY" not in str(meta.column(0).encodings) and "DICTIONARY" in str(meta.column(1).encodings)


def test_crossed_bootstrap(spark):
    rows = [(c, r, float(c * 10 + r)) for c in range(9) for r in range(3)] + [(0, 0, None)]
    df = spark.createDataFrame(rows, "c long, r long, v double")
    got = {r.draw: r.statistic for r in statistics.crossed_bootstrap(df, "c", "r", "v", 50).collect()}
    assert got[-1] == 41.0 and len(got) == 51 and len(set(got.values())) > 10
    with pytest.raises(Exception, match="more than 2 replicates"):
        statistics.crossed_bootstrap(df, "c", "r", "v", 5, most=2).collect()


def test_fronts_merge(spark):
    import random

    rnd = random.Random(1)
    rows = [(i, rnd.randint(0, 12), rnd.randint(0, 12)) for i in range(300)]
    want = {i for i, a, b in rows if not any(x >= a and y >= b and (x > a or y > b) for _, x, y in rows)}
    df = spark.createDataFrame([*rows, (900, None, 50)], "k long, a int, b int").repartition(20)
    assert {r.k for r in statistics.pareto(df, "k", "a", "b").collect()} == want
    assert statistics.pareto(df.limit(0), "k", "a", "b").count() == 0
