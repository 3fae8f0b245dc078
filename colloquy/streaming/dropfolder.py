"""A folder into which archives are dropped, as a stream of messages.

One archive is one row of the stream and a message never leaves its file, so no state is kept:
each batch is folded like any other table and appended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from colloquy.operators.messages import messages
from colloquy.sources.exports import ZIP_GLOB, unzip


def watch_folder(spark: SparkSession, folder: str, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append the messages of every new archive to a Parquet table; by default of those there now.

    A batch that is run again replaces what it wrote before: each has a folder of its own.
    """
    archives = spark.readStream.format("binaryFile").option("pathGlobFilter", ZIP_GLOB).schema("path string, modificationTime timestamp, length long, content binary").load(folder)

    def write(batch: DataFrame, number: int) -> None:
        messages(unzip(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return archives.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def streamed_messages(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).withColumn("batch", F.col("batch").cast("long"))
