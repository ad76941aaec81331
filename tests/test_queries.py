"""Each of the engine's queries against its SQL on the smallest tables."""

import compare
import pytest

from lexispark.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    if name in registry.ORACLE:
        assert compare.differences(df, con, registry.ORACLE[name]) == []
    else:
        assert df.count() > 0


def test_confusable_pairs_meet_without_a_block(spark, tmp_path):
    texts = ["kitten mitten", "phone fone", "therapy therapist", "gene genome", "electron electrode", "walk walked", "stone"]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.a, r.b): r.rule for r in registry.QUERIES["j13_confusable_sounds"](spark, str(tmp_path)).collect()}
    assert got[("kitten", "mitten")] == "edit" and got[("fone", "phone")] == "same-sound" and got[("electrode", "electron")] == "shared-prefix"
    assert ("walk", "walked") not in got
