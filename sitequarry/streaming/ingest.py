"""Validation of a drop folder as a stream: each micro-batch of files goes through the batch plan.

Files are read once, as the checkpoint remembers them; no state is kept between batches. A batch that is run again after a failure
writes its findings to the same place, by batch number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.validate import validate
from ..sources import documents as S
from ..storage import Workspace


def watch(spark: SparkSession, folder: str, output: str, checkpoint: str, *, mode: str = "strict", files_per_batch: int = 1000, once: bool = True) -> StreamingQuery:
    """Findings of the files that appear in ``folder``, as Parquet under ``output``/batch=N. ``once``: what is there now, then stop."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_batch).load(folder)
    docs = files.select(
        F.col("path").alias("doc_id"), F.col("path").alias("requested_url"), F.lit(None).cast("string").alias("final_url"), "path", "content", F.col("length").alias("byte_size"),
        F.lit(None).cast("int").alias("status"), F.lit(None).cast("string").alias("content_type"), F.lit(None).cast("timestamp").alias("fetched_at"), F.lit(None).cast("string").alias("error_class"),
    )

    def batch(rows: DataFrame, number: int) -> None:
        ws = Workspace(rows.sparkSession, "ingest")
        parsed = ws.table(S.with_base(S.parse(rows)), "parsed")
        validate(parsed, mode, ordered=False).write.mode("overwrite").parquet(f"{output}/batch={number}")
        ws.drop("parsed")

    writer = docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
