"""The pipeline's stages, one after the other, on a small table."""

import corpus_pipeline
from sparkmere.llm.near_dedup import near_duplicates


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    docs = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(9000, None, None, None, 0), (9001, "123 456", "en", "s", 7)], docs.schema))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.count()
        if name != "bpe":
            assert docs.columns == before.columns
        if name == "language_id":
            assert seen[name] == 63
        if name == "exact_dedup":
            assert docs.select("doc_id").distinct().count() == seen[name] <= 60
        if name == "near_dedup":
            assert near_duplicates(docs).where("not kept").count() == 0
    assert seen["bpe"] == seen["mixing"] and "ids_sha256" in docs.columns
