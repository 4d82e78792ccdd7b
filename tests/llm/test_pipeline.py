"""The pipeline's stages on odd rows and empty tables."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("veranda.llm")
import corpus_pipeline as p  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_take_odd_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = docs.where("length(text) between 300 and 600").orderBy("doc_id").limit(1)
    text = good.first().text
    odd = spark.createDataFrame([(10**7, None), (10**7 + 1, ""), (10**7 + 2, " 12 ... "), (10**7 + 3, text + " entirely new closing words"), (10**7 + 3, text + " entirely new closing words"), (None, text)], "doc_id long, text string")
    folder = tmp_path / "sf"
    folder.mkdir()
    docs.unionByName(odd, allowMissingColumns=True).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    kept = spark.read.parquet(f"{folder}/documents.parquet").withColumn("fake", F.lit("clash")).withColumn("kinds", F.lit("clash"))
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, kept, str(folder))
        assert out.columns == kept.columns
        kept = out
        ids = [r.doc_id for r in kept.select("doc_id").collect()]
        assert not {10**7, 10**7 + 1, 10**7 + 2} & set(ids) and ids.count(None) == 1
    assert 10**7 + 3 not in ids and good.first().doc_id in ids  # a near copy goes, both of its rows
    assert kept.where("fake <> 'clash' or kinds <> 'clash' or fake is null").count() == 0
    pieces = p.run(spark, str(folder))
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == set(ids)


def test_stages_take_empty_tables(spark):
    kept = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, kept, SF)
        assert out.columns == kept.columns and out.count() == 0
    assert p.STAGES[-1][1](spark, kept, SF).count() == 0
