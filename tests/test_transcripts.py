"""Normal forms and style of transcripts, teacher's reasons, generated sentences, and the stream that stops itself."""

import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from lexispark.functions import english as E
from lexispark.operators import decontaminate, filters
from lexispark.streaming import journal


def said(spark, column, *texts):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(column).collect()]


def test_normal_english(spark):
    got = said(spark, E.normal_english(F.col("t"), {"colour": "color"}), "Um, I can't [noise] go (cough)!", "It's  $1,250.50, 5% café.", "The colour, Mr. Smith's been", None, "", "a_b – c")
    assert got == ["i can not go", "it is $1250.50 5% cafe", "the color mister smith has been", "", "", "a b c"]


def test_style(spark):
    f = E.style_neutral("acr unit cmp dis", {"per cent": "%", "km": "km", "hours": "h", "hour": "h"}, {"any one": "anyone"}, ("ah",))
    got = said(spark, f("t"), "the f b i i i", "i i", "0 0", "a 0 1", "5 km per hour", "5 km per dose", "5 hours", "any one any one said", "a1 ah a1 a1 b1", None, "")
    assert got == ["the fbiii", "i", "0", "ao 1", "5 km h", "5 km per dose", "5 h", "anyone said", "a1 b1", None, ""]
    with pytest.raises(ValueError):
        E.style_neutral("acr loud")


def without_repeats(tokens):
    while True:
        out, i = [], 0
        while i < len(tokens):
            n = next((n for n in (3, 2, 1) if len(tokens) - i >= 2 * n and tokens[i : i + n] == tokens[i + n : i + 2 * n]), 0)
            out += tokens[i : i + max(n, 1)]
            i += 2 * n or 1
        if out == tokens:
            return out
        tokens = out


def test_repeats_against_model(spark):
    draw = random.Random(3)
    texts = [" ".join(draw.choice(["aa", "b7", "aaa"]) for _ in range(draw.randint(1, 14))) for _ in range(300)]
    assert said(spark, E.style_neutral("dis")("t"), *texts) == [" ".join(without_repeats(t.split())) for t in texts]


def test_teacher_reasons(spark):
    rows = [(0.5, "a", "a", 0.0, False), (2.0, " ", "a", 1.0, False), (2.0, "a", "b", 0.6, False), (2.0, "a", None, None, True), (2.0, "a", "a", 0.5, False), (None, "a", "a", 0.0, False)]
    df = spark.createDataFrame(rows, "s double, said string, human string, rate double, inf boolean")
    got = [r[0] for r in df.select(filters.teacher_drop_reason(*(F.col(c) for c in df.columns))).collect()]
    assert got == ["duration_out_of_range", "empty_teacher_text", "teacher_human_wer_gt_0.5", None, None, "duration_out_of_range"]


def test_generated_sentences(spark):
    words = "a b c d e f g h i j k l".split()
    made = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[::-1])), (3, "a b")], "id int, norm string")
    corpus = spark.createDataFrame([(7, " ".join(words[:10])), (8, " ".join(words[1:11]))], "rec int, norm string")
    got = {tuple(r) for r in decontaminate.sentences_held(made, corpus, "id", "rec").collect()}
    assert got == {(1, 5, 4, True), (2, 5, 0, False), (3, 0, 0, False)}


def test_stream_stops_at_excessive_rejection(spark, tmp_path):
    src, out, at = (str(tmp_path / x) for x in ("src", "out", "at"))
    rows = lambda ids: spark.createDataFrame([(i, "bad" if i % 4 else None) for i in ids], "id int, reason string")
    rows(range(0, 8)).coalesce(1).write.parquet(src)
    stream = lambda: spark.readStream.schema("id int, reason string").parquet(src)
    journal.guarded(stream(), "reason", out, at, least=10).awaitTermination()
    assert {tuple(r) for r in journal.counters(spark, out).collect()} == {("kept", 2), ("bad", 6)}
    rows(range(8, 16)).coalesce(1).write.mode("append").parquet(src)
    with pytest.raises(StreamingQueryException, match="12 of 16 rows rejected"):
        journal.guarded(stream(), "reason", out, at, least=10).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(f"{out}/rows").collect()) == [0, 4, 8, 12]
    assert {tuple(r) for r in journal.counters(spark, out).collect()} == {("kept", 4), ("bad", 12)}
