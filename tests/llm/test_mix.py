"""The mix of sources moves sums, not texts."""

from pyspark.sql import functions as F

from gridweave.llm import source_mix


def test_texts_are_not_shuffled(spark, tmp_path):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.sha2(F.col("id").cast("string"), 512), F.sha2((F.col("id") + 1).cast("string"), 512)).alias("text"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), F.col("id") % 3)).alias("source"))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")  # the documents are larger, one row per source is not
    try:
        out = source_mix.emit(source_mix.mix(spark.read.parquet(f"{tmp_path}/documents.parquet")))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        assert out.count() > 4000 and out.where("source is null").count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
