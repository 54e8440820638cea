"""Shared folders, CSV with prose in it, text files, zip archives, JSON state, file digests."""

from __future__ import annotations

import hashlib
import io
import json
import tempfile
import uuid
import zipfile
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Prose holds quotes and line breaks; a quote inside a field is doubled.
CSV = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'}


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which the driver and all executors see.

    Only where all run in one process, as in tests, is a temporary folder made
    if none is set; on a cluster that would scatter data over machines, so it
    is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            base = known.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            base = "file://" + tempfile.mkdtemp(prefix="verdigris-")
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return base.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to shared storage and read again: cuts the lineage, survives executors, and has a known size."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with an explicit schema; types are never guessed."""
    return spark.read.options(**CSV).schema(schema).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", single: bool = False) -> None:
    """``single`` gathers an export into one file; leave it off for anything large."""
    (df.coalesce(1) if single else df).write.mode(mode).options(**CSV).csv(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(filename, text) of the text files of a folder or glob."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("filename"), F.col("value").alias("text"))


def read_zipped_texts(spark: SparkSession, path: str, prefix: str = "", suffix: str = ".txt") -> DataFrame:
    """(filename, text) of the matching members of zip archives, a member at a time."""

    def members(batches):
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for name in archive.namelist():
                        if prefix in name and name.endswith(suffix):
                            yield pd.DataFrame([(name.rsplit("/", 1)[-1], archive.read(name).decode("utf-8", "ignore"))], columns=["filename", "text"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(members, "filename string, text string")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out evenly if its scan has fewer partitions than there are cores.

    A small table often lies in one file that one task would read. A scan
    with enough partitions, as any large table's, stays as it is, unshuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Parts in which each partition of a scan is dealt by a key.
PARTS = 16


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys``, so that grouping by them, and by more that is made of its rows, shuffles nothing again.

    Into several parts for each partition of the scan, so that what a task
    makes of its rows and counts stays in its memory however large the table.
    """
    return df.repartition(df.rdd.getNumPartitions() * PARTS, *keys)


def remaining(todo: DataFrame, done: DataFrame, key: str | list[str] = "id") -> DataFrame:
    """What a resumed job still has to do; a null key is done if a null one is there."""
    keys = [key] if isinstance(key, str) else key
    known = done.select(*[F.col(k).alias(f"_done_{n}") for n, k in enumerate(keys)])
    return todo.join(known, [F.col(k).eqNullSafe(F.col(f"_done_{n}")) for n, k in enumerate(keys)], "left_anti")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at ``path``, in whatever store it lies."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    return found is not None and len(found) > 0


def append_new(todo: DataFrame, path: str, work, key: str | list[str] = "id", by: tuple[str, ...] = ()) -> None:
    """Run ``work`` on the rows whose key is not yet at ``path`` and append its result there, in folders ``by`` columns."""
    if exists(todo.sparkSession, path):
        todo = remaining(todo, todo.sparkSession.read.parquet(path), key)
    work(todo).write.mode("append").partitionBy(*by).parquet(path)


def save_state(state: dict, path: str | Path) -> None:
    Path(path).write_text(json.dumps(state), encoding="utf-8")


def load_state(path: str | Path) -> dict | None:
    """A saved state, or None where there is none or it is damaged."""
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return None


def file_md5(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "md5").hexdigest()
