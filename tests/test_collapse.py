"""Collapse alarms: each sign planted, and a stream over restarts against the stored log."""

import random

from pyspark.sql import functions as F
from test_ledger import parts

from lexispark.streaming import collapse as C

LIMITS = C.Limits(window=5, ready=10, grace=4, patience=(("loss", 3), ("gradient", 4), ("validation", 2)))
SCHEMA = "run string, step long, kind string, phase string, loss double, gradient double, errors double, empty double, blank double"


def train(run, losses, gradients=None, phases=None):
    return [(run, i, C.TRAIN, phases[i] if phases else None, x, gradients[i] if gradients else 1.0, None, None, None) for i, x in enumerate(losses)]


def valid(run, *rows):
    return [(run, i, C.VALID, None, None, None, *r) for i, r in enumerate(rows)]


def told(df):
    return {r["run"]: (r["step"], r["alarm"]) for r in df.collect()}


def test_every_sign(spark):
    calm = [1.0] * 20
    rows = train("calm", calm + [9.0, 9.0, 1.0, 9.0, 9.0]) + train("loss", calm + [9.0] * 5)
    rows += train("early", [1.0] * 5 + [9.0] * 5) + train("drift", [1.0] * 10 + [4.0] * 10 + [6.0] * 5)  # the base can't rise with a failing run
    rows += train("gradient", calm, [1.0] * 12 + [0.0] * 8) + train("phase", calm + [9.0] * 4 + [1.0] * 3, None, ["a"] * 20 + ["b"] * 7)
    rows += train("nan", [1.0, None, float("nan"), 1.0]) + train("inf", [1.0, 1.0], [1.0, float("inf")]) + train(None, calm + [9.0] * 5)
    good = (0.3, 0.0, 0.5)
    rows += valid("never", (0.9, 0.5, 1.0), (0.95, 1.0, 1.0), (0.95, 1.0, 1.0), (0.99, 1.0, 1.0)) + valid("worse", good, (0.7, 0.0, 0.5), (None, None, None), (0.7, 0.0, 0.5))
    rows += valid("empty", good, (None, 0.95, None), (None, 0.9, None)) + valid("blank", good, (0.3, 0.4, 1.0), (0.3, 0.4, 1.0), (0.3, 0.5, 1.0), (0.3, 0.6, 0.999)) + valid("again", good, (0.7, 0.0, 0.5), good, (0.7, 0.0, 0.5))
    df = spark.createDataFrame(rows, SCHEMA)
    assert told(C.alarms(df, limits=LIMITS)) == {
        "loss": (22, "loss"), "drift": (22, "loss"), "gradient": (15, "gradient"), "nan": (2, "loss not finite"), "inf": (1, "gradient not finite"),
        "worse": (3, "validation"), "empty": (2, "validation"), "blank": (4, "validation"),
    }
    assert C.alarms(df.limit(0), limits=LIMITS).count() == 0
    assert told(C.alarms(df.select("run", "step", "kind", "loss"), limits=LIMITS)) == {"loss": (22, "loss"), "drift": (22, "loss"), "phase": (22, "loss"), "nan": (2, "loss not finite")}  # absent columns are null: no phases


def test_stream_over_restarts_equals_the_log(spark, tmp_path):
    rnd = random.Random(3)
    rows = []
    for step in range(120):
        for run in "abcdef":
            kind = C.VALID if step % 6 == 5 else C.TRAIN
            bad = rnd.random() < 0.02 * "abcdef".index(run)
            rows.append((run, step, kind, rnd.choice([None, "x"]), 9.0 if bad else rnd.uniform(0.5, 1.5), rnd.choice([1.0, None, 0.0]), rnd.choice([0.2, 0.3, 0.9, None]), rnd.choice([0.0, 1.0, None]), None))
    df = spark.createDataFrame(rows, SCHEMA)
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))

    def run():
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
        C.watched(stream, limits=LIMITS).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()

    parts(df.where("step < 40"), source, 3, "step")
    run()
    parts(df.where(F.col("step") >= 40), source, 2, "step")
    run()
    want = told(C.alarms(df, limits=LIMITS))
    assert told(spark.read.parquet(out)) == want and want
