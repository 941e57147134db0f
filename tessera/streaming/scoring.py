"""ST1: raw rows scored as they arrive, with a model that may change while the stream runs.

Each micro-batch reads the newest published version of the model (``bundle.py``) and scores
its rows with the same DataFrame -> DataFrame function as a batch job. When the rows of an
epoch are written, a manifest of the epoch is created, which names the version. An epoch
with a manifest is complete and is left alone when it is replayed, whatever is newest by
then; one without is written anew. Readers take complete epochs only, so each row comes out once.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.io import create_text, list_names, read_text


def dealt(batch: DataFrame) -> DataFrame:
    """The rows of a micro-batch over all cores; a file that arrives is often one task, however many rows it has."""
    return batch.repartition(max(1, batch.sparkSession.sparkContext.defaultParallelism))


def write_epoch(batch: DataFrame, epoch: int, score: Callable[[DataFrame, int], DataFrame], newest: Callable[[], int],
                sink_dir: str) -> int:
    """Scores and writes an epoch unless it is complete; returns the version it was scored with."""
    spark = batch.sparkSession
    manifest = os.path.join(sink_dir, "epochs", f"{epoch:012d}.json")
    held = read_text(spark, manifest)
    if held is None:
        version = newest()
        rows = score(dealt(batch), version).withColumn("model_version", F.lit(version))
        rows.write.mode("overwrite").parquet(os.path.join(sink_dir, "rows", f"epoch={epoch}"))
        create_text(spark, manifest, json.dumps({"epoch": epoch, "version": version}))
        held = read_text(spark, manifest)
    return json.loads(held)["version"]


def score_stream(spark: SparkSession, source_dir: str, schema, score: Callable[[DataFrame, int], DataFrame],
                 newest: Callable[[], int], sink_dir: str, checkpoint: str, available_now: bool = True, files: int | None = None):
    """readStream parquet -> ``write_epoch``; ``files`` bounds the files of a micro-batch."""
    reader = spark.readStream.schema(schema)
    stream = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(source_dir)
    w = stream.writeStream.foreachBatch(lambda batch, epoch: write_epoch(batch, epoch, score, newest, sink_dir) and None)
    w = w.option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def complete_epochs(spark: SparkSession, sink_dir: str) -> DataFrame:
    """The rows of all complete epochs, with the column epoch."""
    epochs = [int(n.split(".")[0]) for n in list_names(spark, os.path.join(sink_dir, "epochs")) if n.endswith(".json")]
    rows = os.path.join(sink_dir, "rows")
    return spark.read.option("basePath", rows).parquet(*[os.path.join(rows, f"epoch={e}") for e in sorted(epochs)])
