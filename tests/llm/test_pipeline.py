import corpus_pipeline as cp
from pyspark.sql import functions as F


def test_stages_on_the_small_table(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "substring_dedup", "best_fit_packing"]
    before = docs
    for i, (_, stage) in enumerate(cp.STAGES):
        stage(spark, before, sf).write.parquet(f"{tmp_path}/{i}")
        after = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 3:
            assert after.schema == docs.schema
            assert after.join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
        if i == 1:  # no exact copy is left, and every text that went has one like it that stayed
            assert after.select("text").distinct().count() == after.count()
        if i == 2:
            assert after.count() == before.count()
        before = after
    assert before.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048
    assert cp.run(spark, sf).count() == before.count()
