"""Detection over a folder that grows: each file is scored once, whenever it comes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from verdigris.config import Watermark
from verdigris.operators.detection import csv_bits, scored_texts


def text_stream(spark: SparkSession, path: str) -> DataFrame:
    """(filename, text) of text files as they arrive."""
    rows = spark.readStream.format("text").option("wholetext", "true").load(path)
    return rows.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("filename"), F.col("value").alias("text"))


def detect_stream(texts: DataFrame, mark: Watermark, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append the scores of new texts to Parquet at ``out``; ``checkpoint`` remembers what is done.

    The query keeps no state but the list of files; a restart goes on where it
    stopped and appends no file twice.
    """
    rows = csv_bits(scored_texts(texts, mark, "text")).drop("bits", "text")
    writer = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
