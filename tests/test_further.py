"""Duplicates, quotas, segments and rewriting rules against plain models; streams, readers and reports on small files."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.functions import cleaning as C
from lexispark.functions import respelling as Y
from lexispark.functions import text as T
from lexispark.operators import duplicates, greedy, statistics
from lexispark.sources import readers, writers
from lexispark.streaming import mixer


def test_first_of_near_duplicates_stays(spark):
    rnd = random.Random(5)
    word = lambda: f"w{rnd.randrange(500)}"
    texts, prior = ["", "", "one", "one"], [" ".join(word() for _ in range(30)) for _ in range(5)]
    for family in range(25):
        base = [word() for _ in range(30)]
        texts += [" ".join(base), " ".join(base)]
        for _ in range(6):  # one word less at an end keeps all other pairs of words
            base = base[1:] if rnd.random() < 0.5 else base[:-1]
            texts.append(" ".join(base))
    texts += [prior[0], " ".join(prior[1].split()[1:])]
    rnd.shuffle(texts)
    sets = lambda t: set(zip(t.split(), t.split()[1:])) or {t}
    kept, want = [(p, sets(p)) for p in prior], {}
    for i, t in enumerate(texts):
        s = sets(t)
        copy = any(t == k for k, _ in kept)
        near = any(len(s & x) >= 0.7 * len(s | x) for _, x in kept)
        want[i] = "duplicate" if copy else "near_duplicate" if near else None
        if want[i] is None:
            kept.append((t, s))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, norm string")
    got = {r.id: r.reason for r in duplicates.keep_first(df, "id", "norm", spark.createDataFrame([(p,) for p in prior], "norm string")).collect()}
    assert sum(got[i] != want[i] for i in want) <= 0.03 * len(want)  # a pair at the limit may share no bucket
    assert {i for i in want if want[i] == "duplicate"} <= {i for i in got if got[i]}
    assert duplicates.keep_first(df.limit(0), "id", "norm").count() == 0


def test_quotas_fill_in_order(spark):
    rnd = random.Random(2)
    rows = [(i, f"{rnd.random():.12f}", rnd.choice("abcde"), rnd.sample("abcdef", rnd.randint(0, 4))) for i in range(300)]
    quotas, counts = {"a": 5, "b": 40, "c": 20, "d": 0}, {"b": 3}
    have, want = dict(counts), {}
    for i, _, target, groups in sorted(rows, key=lambda r: r[1]):
        ok = have.get(target, 0) < quotas.get(target, 0)
        want[i] = "missing_target" if target not in groups else "selected" if ok else "over_target"
        if want[i] == "selected":
            for g in groups:
                have[g] = have.get(g, 0) + 1
    df = spark.createDataFrame(rows, "id long, place string, target string, groups array<string>")
    table = lambda d: spark.createDataFrame(list(d.items()), "group string, n int")
    assert {r.id: r.decision for r in greedy.quota_fill(df, table(quotas), "id", "place", "target", "groups", table(counts)).collect()} == want
    pairs = df.withColumn("needs", F.array(F.lit("a"), F.lit("b"))).withColumn("pair", F.lit("p"))
    told = greedy.contrast_fill(pairs, "id", "place", "pair", "needs", "groups", 7).groupBy("decision").count().collect()
    whole = sum({"a", "b"} <= set(g) for *_, g in rows)
    assert {r["decision"]: r["count"] for r in told} == {"selected": 7, "contrast_full": whole - 7, "missing_member": 300 - whole}


def test_segments():
    start = np.array([0.0, 2, 4, 10, 12, 40])
    end = np.array([1.0, 3, 5, 11, 13, 41])
    assert greedy.cut_segments(start, end, 100, 100, 0) == [(0, 6)]
    assert greedy.cut_segments(start, end, 13, 15, 0) == [(0, 5), (5, 6)]  # the largest pause; the last is alone
    assert greedy.cut_segments(start, end, 5, 6, 0) == [(0, 3), (3, 5), (5, 6)]
    assert greedy.cut_segments(start, end, 5, 13, 4) == [(0, 5), (5, 6)]  # 3 seconds join their neighbour, 1 second can't
    assert greedy.cut_segments(start[:1], end[:1], 5, 6, 3) == [(0, 1)]


def edited(spark, udf, *rows):
    df = spark.createDataFrame(list(rows), ", ".join(f"c{i} string" for i in range(len(rows[0]))))
    return [tuple(r.x) for r in df.select(udf(*df.columns).alias("x")).collect()]


def test_rewriting(spark):
    swap = Y.table_replacer({"colour": "color", "colour bar": "color bar", "goin'": "going", "'tis": "it is", "per cent": "%"})
    got = edited(spark, swap, ("Colour bars, COLOUR bar; discolour",), ("he's goin' on",), ("'he is goin' she said",), ("'Tis so, ten per cent",), (None,))
    assert got == [("Color bars, Color bar; discolour", 2), ("he's going on", 1), ("'he is goin' she said", 0), ("It is so, ten %", 2), (None, 0)]
    say = C.pronouncer({"sql": "sequel", "http": None})
    assert edited(spark, say, ("SQL over HTTPs by the FBI, XIV times; UPSs",)) == [("sequel over aitch tee tee pees by the ef bee eye, XIV times; you pee esses", 4)]
    rows = [("it rains he said and left", "It rains. He said, and left!"), ("one two three", "four, five. six?"), ("a e.g b", "a e.g. b"), ("same. here", "same, here"), ("x", None)]
    assert edited(spark, Y.punctuation_transfer, *rows) == [("it rains. He said, and left!", 4), ("one two three", 0), ("a e.g b", 0), ("same. here", 0), ("x", 0)]
    text = spark.createDataFrame([("“A” – b ;  (c) & 5°  .5 !",)], "t string")
    a, b = text.select(T.label_text(F.col("t")), T.label_text(F.col("t"), 1)).first()
    assert a == "A - b, c and 5 degrees .5!" and b == '"A" - b ;  (c) & 5°  .5 !'


def test_aligned_reports(spark):
    df = spark.createDataFrame([("Hello, World. Is it?", "hello World, is it?")], "r string, h string")
    c = df.select(C.formatted_counts("r", "h").alias("c")).select("c.*").first().asDict()
    assert (c["matched"], c["miscased"], c["case_errors"], c["case_words"], c["format_words"]) == (4, 2, 2, 4, 7)
    assert (c["ref_any"], c["hyp_any"], c["both_any"], c["ref_stop"], c["hyp_stop"], c["both_question"]) == (3, 2, 2, 1, 0, 1)
    rows = [("take the pill box now", "take the pill box now"), ("take the pill box now", "take the pill red box now"), ("take the pill box now", "take the pillbox now"), ("take the pill box now", "take it now")]
    spans = F.array(F.struct(F.lit(2).alias("start"), F.lit(4).alias("end"), F.lit("pill box").alias("phrase")))
    out = spark.createDataFrame(rows, "r string, h string").select(C.reproduced({"pill box": ["pillbox"]})("r", "h", spans).alias("x")).collect()
    assert [(r.x[0].reproduced, r.x[0].span) for r in out][:3] == [(True, "pill box"), (False, "pill red box"), (True, "pillbox")] and not out[3].x[0].reproduced


def test_variance_components(spark):
    y = np.random.default_rng(1).normal(size=(4, 6)) + np.arange(4)[:, None]
    df = spark.createDataFrame([(i, j, float(y[i, j])) for i in range(4) for j in range(6)], "r int, c int, y double")
    got = statistics.variance_components(df, "r", "c", "y").first()
    row, col, m = y.mean(1), y.mean(0), y.mean()
    noise = y - row[:, None] - col + m
    assert np.allclose(list(got), [row.std(ddof=1), col.std(ddof=1), np.sqrt((noise**2).sum() / 15)])


def test_mixture_goes_round(spark):
    items = spark.createDataFrame([("a", i) for i in range(3)] + [("b", i) for i in range(50)], "source string, id int")
    shares = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "source string, share double")
    got = sorted(mixer.mixed(items, shares, "source", "id", 400, block=16).collect())
    assert [r.draw for r in got] == list(range(400)) and 60 < sum(r.source == "a" for r in got) < 140
    for name, n in (("a", 3), ("b", 50)):
        drawn = [r for r in got if r.source == name]
        assert [r["pass"] for r in drawn] == [i // n for i in range(len(drawn))]
        assert len({(r["pass"], r.id) for r in drawn}) == len(drawn)


def test_runs_resume(spark, tmp_path):
    mixer.bind(spark, str(tmp_path), {"seed": 1, "files": ["x"]})
    mixer.bind(spark, str(tmp_path), {"files": ["x"], "seed": 1})
    with pytest.raises(mixer.ResumeMismatch):
        mixer.bind(spark, str(tmp_path), {"seed": 2, "files": ["x"]})
    rows = spark.range(3)
    held = rows.withColumn("epoch", F.lit(7))
    mixer.verify_epoch(rows, held, 7)
    with pytest.raises(mixer.ResumeMismatch):
        mixer.verify_epoch(spark.range(4), held, 7)


def test_pools_across_micro_batches(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(i, "u" if i % 3 else "v", rnd.uniform(0.5, 32)) for i in range(600)]
    where, fails = f"{tmp_path}/in", f"{tmp_path}/failed"
    for k in range(3):
        spark.createDataFrame(rows[200 * k : 200 * k + 200], "id long, worker string, seconds double").coalesce(1).write.mode("append").parquet(where)

    def write(df, epoch):
        import os

        if epoch == 1 and not os.path.exists(fails):
            open(fails, "w").close()
            raise RuntimeError("lost")
        df.write.mode("overwrite").parquet(f"{tmp_path}/out/epoch={epoch}")

    def start():
        stream = spark.readStream.schema("id long, worker string, seconds double").option("maxFilesPerTrigger", 1).parquet(where)
        out = mixer.pooled(stream, "worker", "id", "seconds", 60.0, 4)
        return out.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()

    assert mixer.restarting(start) == 1
    got, size = spark.read.parquet(f"{tmp_path}/out").collect(), {i: s for i, _, s in rows}
    assert len({r.id for r in got}) == len(got) > 300
    for worker in "uv":
        pools = {}
        for r in got:
            if r.worker == worker:
                pools.setdefault(r.pool, {}).setdefault(r.batch, []).append(r)
        assert sorted(pools) == list(range(len(pools)))
        seen = []
        for p in sorted(pools):
            ids = sorted(r.id for b in pools[p].values() for r in b)
            assert sum(size[i] for i in ids) >= 240 > sum(size[i] for i in ids[:-1])
            assert all(len(b) * max(size[r.id] for r in b) <= 60 or len(b) == 1 for b in pools[p].values())
            assert all(sorted(r.pos for r in b) == list(range(len(b))) for b in pools[p].values())
            seen += ids
        want = [i for i, w, s in rows if w == worker and 1 <= s <= 30]
        assert seen == want[: len(seen)]


def test_readers_and_report(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "1.trans.txt").write_text("1-2-3 HELLO THERE\n\n1-2-4 SO\n")
    (tmp_path / "a" / "other.txt").write_text("x\n")
    assert sorted((r.id, r.text) for r in readers.utterance_lists(spark, f"{tmp_path}/a").collect()) == [("1-2-3", "HELLO THERE"), ("1-2-4", "SO")]
    (tmp_path / "t.TextGrid").write_text(
        'File type = "ooTextFile"\nitem []:\n  item [1]:\n    class = "IntervalTier"\n    name = "words"\n    intervals: size = 2\n'
        '    intervals [1]:\n      xmin = 0\n      xmax = 0.5\n      text = "say ""hi"""\n    intervals [2]:\n      xmin = 0.5\n      xmax = 2\n      text = ""\n'
    )
    got = readers.interval_tiers(spark, f"{tmp_path}/t.TextGrid").orderBy("start").drop("file").collect()
    assert [tuple(r) for r in got] == [("words", 0.0, 0.5, 'say "hi"'), ("words", 0.5, 2.0, "")]
    spark.range(2).select("id", F.struct(F.lit("p").alias("path"), F.lit("b").alias("bytes")).alias("audio")).write.parquet(f"{tmp_path}/n")
    df = readers.nested(spark, f"{tmp_path}/n", "id", "audio.path")
    assert df.columns == ["id", "audio_path"] and "bytes" not in df._jdf.queryExecution().executedPlan().toString()
    text = writers.report(spark.createDataFrame([("a|b", 1)], "k string, n int"), f"{tmp_path}/report", "Counts")
    assert text.splitlines()[-1] == "| a\\|b | 1 |" and "\n".join(r[0] for r in spark.read.text(f"{tmp_path}/report").collect()) == text
    with pytest.raises(ValueError):
        writers.report(spark.range(3), f"{tmp_path}/more", "More", most=2)


def test_sums_and_fronts_over_parts(spark):
    import hashlib

    from lexispark.operators import sequences

    rnd = np.random.default_rng(3)
    df = spark.range(20_000, numPartitions=7).select("id", (F.xxhash64("id") % 1000 + 1000).alias("s"), F.concat(F.lit("x"), "id").alias("payload"))
    rows = sorted((r.id, r.s) for r in df.collect())
    before = dict(zip((i for i, _ in rows), np.cumsum([0, *(s for _, s in rows)])[:-1].tolist(), strict=True))
    assert {r.id: r.v for r in sequences.running(df, "s", "v", "id").collect()} == before
    x = rnd.integers(0, 30, (500, 3))
    points = spark.createDataFrame([(i, *map(int, p)) for i, p in enumerate(x)], "k int, a int, b int, c int").repartition(5)
    front = {i for i, p in enumerate(x) if not any((q >= p).all() and (q > p).any() for q in x)}
    assert {r.k for r in statistics.pareto(points, "k", "a", "b", "c").collect()} == front
    got = {r.g: r.identity for r in statistics.set_identity(df.withColumn("g", F.col("id") % 3), "g", "id").collect()}
    assert got == {g: hashlib.sha256("\n".join(str(i) for i in range(g, 20_000, 3)).encode()).hexdigest() for g in range(3)}
