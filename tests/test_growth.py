"""Steps whose time or memory once grew faster than their input, and what they must still give."""

import collections
import datetime
import random
import re

import compare
import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lexispark.functions import text as T
from lexispark.operators import alike, decontaminate, duplicates, sequences, statistics
from lexispark.plans import registry


def test_draw_carries_its_frames_on_and_takes_the_first_of_equal_targets(spark):
    clips = spark.createDataFrame([(i, 10.0) for i in range(1, 41)], "k long, s double")
    real = spark.createDataFrame([(1, 300.0), (2, 0.0), (3, 0.0), (4, 500.0), (5, 0.0)], "pool long, real double")
    out = sequences.diffused_draw(clips, real, 0.3, "s", "k")
    assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()
    assert {r.k: r.pool for r in out.collect()} == {i: 1 if i <= 9 else 4 for i in range(1, 25)}


def test_draw_of_odd_rows_is_that_of_the_sql(spark, tmp_path):
    inf, nan = float("inf"), float("nan")
    plain = [(i, 100.5 + 7 * (i % 5)) for i in range(40)]
    odd = {
        "null sizes": ([(0, None), *plain[1:9], (9, None), (None, 120.0)], [(1, 900.0), (2, 800.0), (3, 700.0)]),
        "null pools": (plain, [(None, 5000.0), (1, None), (2, 900.0), (3, None), (4, 800.0)]),
        "falling targets": (plain, [(1, 4000.0), (2, -3000.0), (3, 5000.0), (4, -100.0), (5, 1000.0)]),
        "beyond long": ([*plain, (40, 1e19), (41, 5.0)], [(1, 900.0), (2, 1e20), (3, 9.5)]),
        "no numbers": ([*plain, (40, nan), (41, 5.0)], [(1, 9000.0), (2, inf), (3, 9.5)]),
        "all null": (plain, [(1, None), (2, None)]),
    }
    for name, (orders, lines) in odd.items():
        at = f"{tmp_path}/{name}"
        spark.createDataFrame(orders, "o_orderkey long, o_totalprice double").write.parquet(f"{at}/orders.parquet")
        spark.createDataFrame(lines, "l_suppkey long, l_extendedprice double").write.parquet(f"{at}/lineitem.parquet")
        con = duckdb.connect()
        for t in ("orders", "lineitem"):
            con.execute(f"create view {t} as select * from read_parquet('{at}/{t}.parquet/*.parquet')")
        assert compare.differences(registry.QUERIES["w9_diffused_draw"](spark, at), con, registry.ORACLE["w9_diffused_draw"]) == [], name


def test_rates_of_short_steps_are_exact(spark, tmp_path):
    at = datetime.datetime(2024, 1, 30, 12, 0, 0, 900001)
    steps = [58867, 58869, 2448301, 7]
    rows, value = [(0, 1, at, 0.0)], 0.0
    for i, us in enumerate(steps, 1):
        at, value = at + datetime.timedelta(microseconds=us), value + 990.46
        rows.append((i, 1, at, value))
    frame = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, value double")
    frame.write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: r.rate for r in registry.QUERIES["ts1_counter_rates"](spark, str(tmp_path)).collect()}
    assert got == {0: None} | {i: round(990.46 / (us / 1e6), 4) for i, us in enumerate(steps, 1)}


def test_normal_forms_name_what_they_drop(spark):
    assert "^" not in T.NOT_SIMPLE + T.NOT_LETTERS
    every = "".join(f"a{chr(c)}" for c in [*range(1, 0x500), *range(0x2000, 0x2100), 0xFFFD, 0x1F600, 0x10FFFF]) + "  ' x9 '"
    rows = spark.createDataFrame([(every,), ("",), (None,), ("\x00A\n\n  B'c-d",)], "t string")
    for r in rows.select(F.lower(F.coalesce("t", F.lit(""))).alias("low"), T.simple_norm(F.col("t")).alias("s"), T.letters_norm(F.col("t")).alias("l")).collect():
        assert r.s == re.sub(" +", " ", re.sub("[^a-z0-9' ]", " ", r.low)).strip(" ")
        assert r.l == re.sub(" +", " ", re.sub("[^a-z ]", " ", r.low)).strip(" ")


def test_a_bucket_of_many_unlike_texts_takes_few_rounds(spark, monkeypatch):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    texts = [" ".join(word() for _ in range(20)) for _ in range(150)]
    for t in rnd.sample(texts, 30):  # chains: each has a word less than the one before
        w = t.split()
        texts += [" ".join(w[k:]) for k in range(1, rnd.randint(2, 6))]
    rnd.shuffle(texts)
    kept, want = [], {}
    for i, t in enumerate(texts):
        s = set(zip(t.split(), t.split()[1:]))
        want[i] = "near_duplicate" if any(len(s & x) >= 0.7 * len(s | x) for x in kept) else None
        kept += [] if want[i] else [s]
    calls, real, banded = [], duplicates.stored, duplicates._banded

    def counted(df):
        calls.append(1)
        assert len(calls) < 60
        return real(df)

    monkeypatch.setattr(duplicates, "stored", counted)
    monkeypatch.setattr(duplicates, "_banded", lambda sets: banded(sets).withColumn("bucket", F.lit(0).cast("long")).distinct())
    monkeypatch.setattr(duplicates, "SPLIT", 50, raising=False)
    got = duplicates.keep_first(spark.createDataFrame(list(enumerate(texts)), "id long, norm string"), "id", "norm").collect()
    assert {r.id: r.reason for r in got} == want


def test_arrow_functions_hold_few_rows_and_give_all(spark):
    from lexispark.functions import align, slices

    size = slices.sliced(LongType())(lambda x: pd.Series([len(x)] * len(x)))
    rows = spark.range(0, 1000, 1, 1).select("id", F.when(F.col("id") % 7 > 0, F.concat_ws(" ", F.lit("a b"), F.col("id") % 5)).alias("r"), F.lit("a 3 c").alias("h"))
    assert {r[0] for r in rows.select(size("r")).collect()} == {slices.ROWS, 1000 % slices.ROWS}
    got = rows.select("r", "h", align.alignment("r", "h").alias("s"), align.edit_counts("r", "h").alias("n"), align.longest_repeat(F.split("r", " ")).alias("l")).collect()
    assert len(got) == 1000
    for r in got:
        a, b = (r.r or "").split(), r.h.split()
        assert [(s.op, s.i, s.j, s.ref, s.hyp) for s in r.s] == [(o, i, j, None if o == "I" else a[i], None if o == "D" else b[j]) for o, i, j in align.path(a, b)]
        assert r.n.s + r.n.d + r.n.i == sum(s.op != "=" for s in r.s) and tuple(r.l) == align.longest(a)


def test_weights_are_drawn_from_digits_as_text_and_units_are_dealt_out(spark):
    plan = registry.QUERIES["b3_utterance_bootstrap"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("conv(") == 0 and plan.count("md5(") == 1 and "Repartition" in plan
    numbers = [n for c in statistics.POISSON for n in range(int(c * 2**28) - 1, int(c * 2**28) + 3)] + [0, 2**28 - 1]
    rows = spark.createDataFrame([(n, f"{n:07x}" + "0" * 25) for n in numbers] + [(None, None)], "n long, digest string")
    for n, k in rows.select("n", F.expr(statistics.poisson_of("digest"))).collect():
        assert k == (8 if n is None else next((i for i, c in enumerate(statistics.POISSON) if n / 268435456.0 < c), 8))


def test_grams_are_counted_without_a_row_each(spark):
    plan = registry.QUERIES["a4_document_frequency"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
    rnd = random.Random(5)
    lines = [" ".join(rnd.choice("abcdefgh") * 3 for _ in range(9)) for _ in range(30)]
    texts = [" ".join(rnd.choices(lines, k=rnd.randint(0, 4))) for _ in range(200)] + [None, "", "a b c"]
    of = collections.Counter(g for t in texts for w in [(t or "").split()] for g in {tuple(w[i : i + 8]) for i in range(len(w) - 7)})
    want = collections.Counter(k for k in of.values() if k > 1)
    rows = spark.createDataFrame([(t,) for t in texts], "norm string").repartition(3)
    for chars in (0, 40 * decontaminate.RANGE):  # one range and many
        assert {r.df: r.n for r in decontaminate.frequencies(rows, chars).collect()} == want
    assert decontaminate.frequencies(rows.limit(0), 0).count() == 0


def test_letters_are_judged_without_matching_forms_that_no_text_has():
    from lexispark.functions import respelling as Y

    class Never:
        def finditer(self, text):
            raise AssertionError(text)

    tables = {"forms": [("forms", "usk", "USK"), ("forms", "it's", "its")], "lexicon": {"NASA": (9, 20)}}
    rules, plain = Y.Rules(**tables), Y.Rules(**tables)
    plain.__dict__["_forms"] = Never()
    told = lambda r, text: [(x[1], x[2]) for x in r.judged(text, [])]
    text = "we say N A S A, nasb B A S B, then C D E F G for masks' sake"
    assert told(plain, text) == told(rules, text) == [("spelling", "echo"), ("spelling", "echo"), ("other", "notes")]
    for written in ("the usk", "the USK", "the US\u212a"):  # a letter that is equal to k but for case
        assert bool(rules.tables(written, [])) == (written != "the USK")


def test_shingles_are_made_once(spark):
    for name, step in (("x7_minhash_signature", "md5("), ("x5_ngrams", "array_distinct(")):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(step) == 1


def test_pairs_that_are_alike_are_all_told(spark, tmp_path):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    line, texts = " ".join(word() for _ in range(40)), ["a b c d", "", None, "one two three four five"]
    for _ in range(60):  # families: their members are less alike one another than each is its first
        w = [word() for _ in range(rnd.randint(30, 90))]
        texts.append(" ".join(w))
        for _ in range(rnd.randint(1, 6)):
            v = list(w)
            for at in rnd.sample(range(len(v)), rnd.randint(0, 3)):
                v[at] = word()
            texts.append(" ".join(v))
    texts += [line + " " + " ".join(word() for _ in range(rnd.randint(4, 30))) for _ in range(40)] + [texts[4]] * 3
    rnd.shuffle(texts)
    rows = list(enumerate(texts)) + [(None, texts[7]), (3, texts[3]), (5, texts[9])]
    shingles = [(k, {tuple(w[i : i + 5]) for i in range(len(w) - 4)}) for k, t in rows for w in [(t or "").split()]]
    want = collections.Counter()
    for i, (a, s) in enumerate(shingles):
        for b, x in shingles[i + 1 :]:
            if s and x and None not in (a, b) and a != b and 10 * len(s & x) >= 7 * len(s | x):
                want[min(a, b), max(a, b), round(len(s & x) / len(s | x), 9)] += 1
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda: collections.Counter(map(tuple, registry.QUERIES["j14_minhash_bands"](spark, str(tmp_path)).collect()))
    assert run() == want and len(want) > 200
    duckdb.sql(f"create or replace view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert collections.Counter(duckdb.sql(registry.ORACLE["j14_minhash_bands"]).fetchall()) == want


def test_frequent_shingles_and_parts_change_no_pair(spark, monkeypatch):
    rnd = random.Random(3)
    sets = [(i, rnd.sample(range(10**15, 10**15 + 12), rnd.randint(1, 12)) + [i // 5 * 3 + j for j in range(rnd.randint(0, 3))]) for i in range(120)]
    rows = spark.createDataFrame(sets + [(200 + i, sets[0][1][::-1] * 2) for i in range(9)], "id long, s array<bigint>").repartition(2)
    told = lambda: sorted(map(tuple, alike.pairs(rows, "id", "s").collect()))
    before = told()
    for name, value in (("FREQUENT", 6), ("RANGE", 40), ("GROUP", 30), ("PAIRS", 7), ("COPIES", 2)):
        monkeypatch.setattr(alike, name, value)
    monkeypatch.setattr(alike, "MOST_FREQUENT", 10**9)
    assert told() == before and len(before) > 100
    for a, b in [(rnd.sample(range(10**6), rnd.randint(1, 90)), rnd.sample(range(10**6), rnd.randint(1, 90))) for _ in range(200)]:
        b = a[: rnd.randint(0, len(a))] + b[: rnd.randint(0, 20)] or b
        like = 10 * len({*a} & {*b}) >= 7 * len({*a} | {*b})
        one, two = (np.array(sorted({*x})) for x in (a, b))
        assert alike.may_be_alike(len(one), alike.marks(one), len(two), alike.marks(two)) >= like
