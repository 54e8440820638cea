"""Screens a growing feed of documents for the watermark; each run takes only the files that are new.

    python -m jobs.screen_feed --feed s3://…/documents --out s3://…/screened --checkpoint s3://…/state [--config FILE]

The feed is a folder, file or glob of Parquet files with doc_id, text, lang and
source. A file stream with ``availableNow`` hands over files that the
checkpoint doesn't know, ``files_per_batch`` at a time, and ends. For each
batch the job writes

* ``scores/batch=N/lang=L``: a row per document with its score over the whole
  text, and where in the text the mark is strongest: how many local windows are
  hot, and score and extent (in scored words) of the strongest one;
* ``totals/batch=N``: counts and sums by language and source.

At the end ``report/lang=L`` is made anew of all totals, a few rows a batch, so
no run reads scores of earlier ones. A batch that failed halfway is run again
by Spark under its old number with the same files, and overwrites that number's
folders, so nothing is lost or counted twice; a run that finds nothing new
changes nothing. Each row of each file is screened once: a document that is
delivered again in another file is another row.

Nothing but the totals is shuffled by key: scores and windows are made inside a
document's row, and written files are evened out by a rebalance that splits
large languages. Null texts count as empty ones.
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, read_if_there, settings_of, start_logging
from verdigris.config import Settings
from verdigris.functions import scores as S
from verdigris.functions.text import words
from verdigris.operators import detection, windows

CONFIG = Path(__file__).with_suffix(".yaml")
FEED = "doc_id bigint, text string, lang string, source string"
#: Without the partition columns; columns that a writer partitions by come last.
_SCORES = "doc_id bigint, source string, num_tokens_scored bigint, num_green_tokens bigint, green_fraction double, z_score double, p_value double, prediction boolean, n_windows bigint, hot_windows bigint, peak_z double, peak_start bigint, peak_end bigint"
SCORES = f"{_SCORES}, batch bigint, lang string"
TOTALS = "lang string, source string, n bigint, n_scored bigint, n_flagged bigint, n_hot bigint, sum_z double, sum_fraction double, batch bigint"
REPORT = "source string, n bigint, n_scored bigint, n_flagged bigint, n_hot bigint, mean_z double, mean_green_fraction double, lang string"


@dataclass(frozen=True)
class Feed:
    hot_window_z: float = 4.0
    files_per_batch: int = 256


def screened(docs: DataFrame, settings: Settings, feed: Feed) -> DataFrame:
    """A row per document: its scores, its prediction and its strongest window."""
    mark = settings.watermark
    tokens = F.coalesce(words(F.col("text")), F.array().cast("array<string>"))
    rows = detection.scored(docs.select("doc_id", "lang", "source", tokens.alias("words")), mark).drop("words")
    rows = detection.predicted(rows.withColumn("p_value", S.p_value("z_score")), mark)
    rows = rows.withColumn("bits", F.array_join(F.col("bits").cast("array<string>"), ""))
    return windows.peaks(rows, settings.windows, mark.gamma, feed.hot_window_z)


def totals(scores: DataFrame) -> DataFrame:
    """Counts and sums by language and source, added up in tasks before they are shuffled."""
    return scores.groupBy("lang", "source").agg(
        F.count("*").alias("n"), F.count_if(F.col("num_tokens_scored") > 0).alias("n_scored"), F.count_if("prediction").alias("n_flagged"), F.count_if(F.col("hot_windows") > 0).alias("n_hot"),
        F.sum("z_score").alias("sum_z"), F.sum("green_fraction").alias("sum_fraction"),
    )


def report(sums: DataFrame) -> DataFrame:
    """All batches' totals in one row per language and source."""
    add = [F.sum(c).alias(c) for c in ("n", "n_scored", "n_flagged", "n_hot")]
    return sums.groupBy("lang", "source").agg(*add, (F.sum("sum_z") / F.sum("n")).alias("mean_z"), (F.sum("sum_fraction") / F.sum("n")).alias("mean_green_fraction"))


def as_pattern(path: str) -> str:
    """A path as a pattern that only it matches: a stream takes a pattern of a file as well as one of a folder."""
    path = path.rstrip("/")
    return path if set("*?[{") & set(path) else f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, feed: str, out: str, checkpoint: str, settings: Settings | None = None, options: Feed | None = None) -> None:
    """Screen what is new at ``feed``; returns when all of it is written."""
    if settings is None:
        settings, own = settings_of(CONFIG, "feed")
        options = options or Feed(**own)
    options = options or Feed()

    def save(batch: DataFrame, number: int) -> None:
        rows = screened(batch, settings, options).hint("rebalance", "lang")
        rows.write.mode("overwrite").partitionBy("lang").parquet(f"{out}/scores/batch={number}")
        saved = read_if_there(batch.sparkSession, f"{out}/scores/batch={number}", f"{_SCORES}, lang string")
        totals(saved).write.mode("overwrite").parquet(f"{out}/totals/batch={number}")
        read.append(saved.count())  # from the files' own counts
        log.info("batch %s: wrote %s rows to %s/scores, and totals", number, read[-1], out)

    read: list[int] = []
    files = spark.readStream.schema(FEED).option("maxFilesPerTrigger", options.files_per_batch).parquet(as_pattern(feed))
    log.info("reading what is new at %s", feed)
    query = files.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    report(read_if_there(spark, f"{out}/totals", TOTALS)).hint("rebalance", "lang").write.mode("overwrite").partitionBy("lang").parquet(f"{out}/report")
    log.info("read %s new rows in %s batches, wrote %s/report", sum(read), len(read), out)


def read_back(spark: SparkSession, out: str) -> DataFrame:
    """The whole output as it stands: ``part`` tells scores from rows of the report."""
    scores = read_if_there(spark, f"{out}/scores", SCORES).drop("batch").withColumn("part", F.lit("score"))
    return scores.unionByName(read_if_there(spark, f"{out}/report", REPORT).withColumn("part", F.lit("report")), allowMissingColumns=True)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="jobs.screen_feed", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for flag in ("--feed", "--out", "--checkpoint"):
        p.add_argument(flag, required=True)
    p.add_argument("--config", default=str(CONFIG))
    a = p.parse_args(argv)
    start_logging()
    settings, own = settings_of(a.config, "feed")
    spark = SparkSession.builder.appName("screen_feed").getOrCreate()
    try:
        run(spark, a.feed, a.out, a.checkpoint, settings, Feed(**own))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
