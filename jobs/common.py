"""What the jobs share: settings files, logging, reading what may not be there yet."""

from __future__ import annotations

import logging
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from verdigris.config import Settings, load

log = logging.getLogger("jobs")


def settings_of(path: str | Path, section: str) -> tuple[Settings, dict]:
    """The library's settings of a YAML file, and the job's own section of it."""
    import yaml

    return load(path), dict(yaml.safe_load(Path(path).read_text(encoding="utf-8")).get(section) or {})


def read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet of a given schema, partition columns included; no rows where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def start_logging() -> None:
    logging.basicConfig(format="%(asctime)s %(name)s %(message)s")
    log.setLevel(logging.INFO)
