"""A micro-batch of one file is scored by all cores, every row once."""

from pyspark.sql import functions as F

from tessera.streaming.scoring import complete_epochs, write_epoch


def test_one_file_is_scored_by_all_cores(spark, tmp_path):
    source, sink = f"file://{tmp_path}/source", f"file://{tmp_path}/sink"
    rows = [(i if i % 7 else None, f"t{i % 5}") for i in range(300)] + [(3, "t3")] * 4
    spark.createDataFrame(rows, "row_id long, text string").coalesce(1).write.parquet(source)
    tasks = []

    def score(batch, version):
        tasks.append(batch.rdd.getNumPartitions())
        return batch.withColumn("task", F.spark_partition_id())
    assert write_epoch(spark.read.parquet(source), 0, score, lambda: 1, sink) == 1
    assert tasks == [spark.sparkContext.defaultParallelism]
    out = complete_epochs(spark, sink)
    assert out.select("task").distinct().count() == spark.sparkContext.defaultParallelism
    got = [(r["row_id"], r["text"]) for r in out.collect()]
    assert sorted(got, key=str) == sorted(rows, key=str)
