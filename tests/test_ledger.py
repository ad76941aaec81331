"""Streams that remember, against batch results, over several runs and after failures."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexispark.streaming import ledger


def parts(df, folder, n, by):
    """n files, one after the other in the order of ``by``."""
    rows = df.count()
    numbered = df.withColumn("__n", F.row_number().over(W.orderBy(by)) - 1)
    for i in range(n):
        numbered.where(F.expr(f"__n * {n} div {rows} = {i}")).drop("__n").coalesce(1).write.mode("append").parquet(folder)


def test_replay_in_micro_batches_equals_the_batch(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(i, rnd.choice([None, *"abcdefgh"]), rnd.choice([None, "x", "x", "x", "y"])) for i in range(400)]
    df = spark.createDataFrame(rows, "seq long, id string, content string")
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    half = df.where("seq < 200")
    parts(half, source, 3, "seq")

    def run():
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
        told = ledger.replayed(stream, "id", "content", "seq")
        told.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()

    run()
    parts(df.where("seq >= 200"), source, 2, "seq")
    run()  # goes on from the checkpoint
    first, want = {}, []
    for seq, i, c in rows:
        want.append((i, seq, c, i not in first, first.setdefault(i, c) != c))
    got = [tuple(r) for r in spark.read.parquet(out).collect()]
    assert sorted(got, key=lambda r: r[1]) == want


def test_ledger_taken_back_and_replayed_equals_a_straight_run(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(f"k{rnd.randrange(60)}", rnd.randint(1, 9), step) for step in range(200) for _ in range(2)]
    df = spark.createDataFrame(rows, "id string, size long, step long")
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    parts(df, source, 4, "step")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    ledger.keep_ledger(ledger.sightings(stream, "id", "size", "step"), out, check).awaitTermination()
    want = {}
    for k, size, step in sorted(rows, key=lambda r: (r[2], r[1])):
        want.setdefault(k, (step, size))
    whole = {r.key: (r.first_step, r.size) for r in ledger.ledger_at(spark, check).collect()}
    assert whole == want
    assert {r.key: (r.first_step, r.size) for r in spark.read.parquet(out).collect()} == want  # steps come in order, so entries never change
    early = {r.key: (r.first_step, r.size) for r in ledger.ledger_at(spark, check, 0).collect()}
    assert early == {k: v for k, v in want.items() if v[0] < 50}
    back = ledger.rolled_back(spark, check, 30, 0)
    back.write.parquet(str(tmp_path / "base"))
    base = spark.read.parquet(str(tmp_path / "base"))
    assert {r.key for r in base.collect()} == {k for k, v in want.items() if v[0] <= 30}
    again = ledger.resumed(stream, base, "id", "size", "step", 30)
    ledger.keep_ledger(again, str(tmp_path / "out2"), str(tmp_path / "check2")).awaitTermination()
    joined = base.union(ledger.ledger_at(spark, str(tmp_path / "check2")))
    assert {r.key: (r.first_step, r.size) for r in joined.collect()} == want


def test_groups_of_shards_are_worked_on_once(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    calls, fail, done = [], [], []

    def commit(*ks):
        spark.createDataFrame([(k,) for k in ks], "shard long").coalesce(1).write.mode("append").parquet(source)

    def work(df):
        if fail:
            raise RuntimeError("lost")
        calls.append(sorted(r.group for r in df.select("group").distinct().collect()))
        return df.groupBy("group").agg(F.sum("shard").alias("total"))

    def run():
        stream = spark.readStream.schema("shard long").option("maxFilesPerTrigger", 1).parquet(source)
        ledger.by_groups(stream, work, out, check, group=3, complete=lambda: bool(done)).awaitTermination()

    commit(0, 2, 3)
    run()
    assert calls == []
    commit(5, 4, 6)  # 1 is missing still
    run()
    assert calls == []
    commit(1)  # the gap filled late
    fail.append(1)
    with pytest.raises(Exception, match="lost"):
        run()
    fail.clear()
    run()
    assert calls == [[0, 1]]
    commit(7)
    run()
    assert calls == [[0, 1]]
    done.append(1)
    ledger.catch_up(spark, work, out, 3, True)
    ledger.catch_up(spark, work, out, 3, True)
    assert calls == [[0, 1], [2]]
    assert {(r.group, r.total) for r in spark.read.parquet(f"{out}/results").collect()} == {(0, 3), (1, 12), (2, 13)}
    commit(9)
    with pytest.raises(Exception, match="9 shards up to 9"):
        run()
