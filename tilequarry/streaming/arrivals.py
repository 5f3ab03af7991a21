"""A workflow over arriving images.  Images are independent of one another, so each
micro-batch is a batch job of its own and no state is kept; a batch that is
repeated after a failure replaces its own output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.workflow import Workflow


def pixel_stream(spark: SparkSession, path: str, files_a_batch: int = 64) -> DataFrame:
    """Parquet files of whole images (image_id, width, height, y, x, v) as they land."""
    schema = "image_id long, width long, height long, y long, x long, v double"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def process(stream: DataFrame, workflow: Workflow, out: str, checkpoint: str) -> StreamingQuery:
    """Append the objects of each micro-batch under ``out``/batch=<id>."""

    def one(batch: DataFrame, batch_id: int) -> None:
        images = batch.groupBy("image_id").agg(F.max("width").alias("width"), F.max("height").alias("height"))
        found = workflow.process(images, batch.select("image_id", "y", "x", "v"))
        found.objects.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
