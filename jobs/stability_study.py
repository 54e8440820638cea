"""Studies how watermark evidence lasts over rounds of paraphrase.

    python -m jobs.stability_study --documents PATH --labels PATH --out PATH [--config FILE]

Documents that the labels call toxic or poor are left out. Of the others, the
human and the machine half of each sample are paraphrased round by round and
scored at each depth, and the local scores' spread over the depths is summed up
for each experiment. The job writes

* ``scores/depth=D``: a row per text and depth, with bits and scores;
* ``texts/experiment=E``: a row per text, with mean and largest spread;
* ``depths/depth=D``: by language, how well the score tells the halves apart;
* ``experiments/experiment=E``: by language, how well the spread does.

The last two hold AUC, the threshold at the wanted false positive rate and the
rates there, exactly, for all groups in one pass.

Each table is written by dynamic partition overwrite and read back before it is
used, so a run that is repeated, or follows one that broke off, replaces the
partitions that it makes and gives the same result. No text is exploded into
windows; the shuffles are one by document and text type over arrays of local
scores, an anti-join with the labels, and counts by distinct score.
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, read_if_there, settings_of, start_logging
from verdigris.config import EXPERIMENTS, Settings
from verdigris.functions import scores as S
from verdigris.operators import corpus, detection, metrics, stability, windows

CONFIG = Path(__file__).with_suffix(".yaml")
_RATES = "lang string, n_pos bigint, n_neg bigint, auc double, threshold double, tpr double, fpr double"
TABLES = {
    "scores": "doc_id bigint, text_type string, label int, lang string, bits string, num_tokens_scored bigint, num_green_tokens bigint, green_fraction double, z_score double, depth int",
    "texts": "doc_id bigint, text_type string, label int, lang string, n_windows bigint, mean_pss double, max_pss double, experiment string",
    "depths": f"{_RATES}, depth int",
    "experiments": f"{_RATES}, experiment string",
}


@dataclass(frozen=True)
class Study:
    most_false: float = 0.05


def studied(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that no label calls toxic or poor; repeated labels count if any of them does."""
    bad = labels.where("quality = 0 OR toxic = 1").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti")


def run(spark: SparkSession, documents: str, labels: str, out: str, settings: Settings | None = None, study: Study | None = None) -> None:
    """The whole study; returns when all tables are written."""
    if settings is None:
        settings, own = settings_of(CONFIG, "study")
        study = study or Study(**own)
    study, mark = study or Study(), settings.watermark

    def save(rows: DataFrame, name: str, by: str) -> DataFrame:
        rows.hint("rebalance", by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{out}/{name}")
        saved = read_if_there(spark, f"{out}/{name}", TABLES[name])
        log.info("%s/%s has %s rows", out, name, saved.count())  # from the files' own counts
        return saved

    docs = studied(spark.read.parquet(documents).select("doc_id", "text", "lang"), spark.read.parquet(labels).select("doc_id", "quality", "toxic"))
    log.info("reading %s, without what %s rules out", documents, labels)
    rows = detection.scored_rounds(corpus.halves(docs, settings.corpus, ("lang",)), settings.paraphrase, mark)
    scores = save(rows, "scores", "depth")

    own = windows.local_scores(scores.select("doc_id", "text_type", "label", "lang", "depth", "bits"), settings.windows, mark.gamma)
    spread = stability.summary_of_arrays(own, ("doc_id", "text_type", "label", "lang"), settings.experiments or EXPERIMENTS)
    spread = spread.withColumns({c: S.places(S.places(c, 9), 6) for c in ("mean_pss", "max_pss")})  # ties of scores are then ties
    spread = save(spread, "texts", "experiment")

    for table, score, name, by in ((scores, "z_score", "depths", "depth"), (spread, "mean_pss", "experiments", "experiment")):
        save(metrics.operating_points(metrics.roc_curves(table, score, by, "lang"), by, "lang", most_false=study.most_false), name, by)


def read_back(spark: SparkSession, out: str) -> DataFrame:
    """The whole output as it stands: ``part`` names the table of each row."""
    parts = [read_if_there(spark, f"{out}/{name}", schema).withColumn("part", F.lit(name)) for name, schema in TABLES.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="jobs.stability_study", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for flag in ("--documents", "--labels", "--out"):
        p.add_argument(flag, required=True)
    p.add_argument("--config", default=str(CONFIG))
    a = p.parse_args(argv)
    start_logging()
    settings, own = settings_of(a.config, "study")
    spark = SparkSession.builder.appName("stability_study").getOrCreate()
    try:
        run(spark, a.documents, a.labels, a.out, settings, Study(**own))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
