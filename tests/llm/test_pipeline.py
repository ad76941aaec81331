"""The pipeline on a small fixture with a planted case for each stage."""

import random

import compare  # noqa: F401
import corpus_pipeline
from pyspark.sql import functions as F

from lexispark.llm import common


def test_stages(spark, tmp_path):
    rnd = random.Random(6)
    words = [f"plain{i}" for i in range(900)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    texts = [text(60) for _ in range(120)]
    toxic = set(range(0, 60, 2))
    for i in toxic:
        texts[i] += " " + " ".join(rnd.choice(["vilewretch", "foulscum", "rottenpig"]) for _ in range(6))
    item = " ".join(f"item{i}" for i in range(40))
    texts += [texts[71] + " added", f"{text(20)} {item} {text(20)}", f"{text(30)} password = abcdefgh12345678 {text(5)}", "", "long " * 5000]
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(len(texts), None, "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept, at = {}, common.table(spark, str(tmp_path), "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = common.stored(stage(spark, at, str(tmp_path)))
        assert at.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r.doc_id: r.text for r in at.collect()}
    every = {d[0] for d in docs}
    assert set(kept["toxicity"]) == every - toxic
    assert set(kept["ngram_jaccard_join"]) == every - toxic - {120}
    assert set(kept["benchmark_decontamination"]) == every - toxic - {120, 121}
    masked = kept["secret_scans"]
    assert set(masked) == every - toxic - {120, 121} and "[SECRET]" in masked[122] and "abcdefgh" not in masked[122]
    assert all(masked[i] == kept["benchmark_decontamination"][i] for i in masked if i != 122)
    packed = corpus_pipeline.run(spark, str(tmp_path))
    by_doc = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("piece").alias("last")).collect()
    assert {r.doc_id for r in by_doc} == set(masked) and max(r.last for r in by_doc) >= 2
    for r in packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.count_distinct("offset").alias("k"), F.count("*").alias("c")).collect():
        assert r.n == r.end <= 2048 and r.k == r.c
