"""Images that arrive over time: each batch of a file stream is added to the catalog and described once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, describe: Callable[[DataFrame], DataFrame], id_col: str = "image_id") -> StreamingQuery:
    """Describe new rows of the Parquet folder ``source`` into ``sink/batch=N``; started, to run until nothing is left.

    A batch is written into its own folder in overwrite mode, so a batch that is repeated after a failure leaves one
    copy. Ids that earlier batches hold are skipped by an anti-join; repeats within a batch count once.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.filter(F.col(id_col).isNotNull()).dropDuplicates([id_col])
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(sink)
        if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            before = spark.read.option("basePath", sink).parquet(sink).filter(F.col("batch") < number)
            rows = rows.join(before.select(id_col), id_col, "left_anti")
        describe(rows).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def album_counts(stream: DataFrame, late: str = "1 day", window: str = "1 day") -> DataFrame:
    """Images per album and window of ``taken_at``; rows later than ``late`` behind the stream are dropped by the watermark."""
    return stream.withWatermark("taken_at", late).groupBy(F.window("taken_at", window), "album").agg(F.count("*").alias("n"))
