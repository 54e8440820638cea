"""How parameters were chosen: on training rows alone, one part of them held out at a time.

``python -m verdigris.llm.tuning FOLDER`` prints a line for each choice. Rows
that ``op4`` or ``op5`` holds out are dropped before anything is learned or judged.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import ngram_lm, quality_model
from verdigris.llm.common import crc_mod, materialise


def classifiers(docs: DataFrame, labels: DataFrame, hidden: tuple[int, ...] = (4, 12, 24), margins: tuple[float, ...] = (0.0, 0.5, 1.0)) -> Iterator[dict]:
    """Balanced accuracy of each choice on labelled training rows, learned from the other half of them."""
    folds = [k for k in range(quality_model.FOLDS) if k != quality_model.HELD_OUT]
    parts = {k: (docs.where(crc_mod(F.col("doc_id"), quality_model.FOLDS) == k), labels.where(crc_mod(F.col("doc_id"), quality_model.FOLDS) == k)) for k in folds}
    samples = {k: quality_model.sampled(*parts[k]) for k in folds}
    for h in hidden:
        for m in margins:
            rates = []
            for k in folds:
                model = quality_model.fit(*samples[next(x for x in folds if x != k)], hidden=h, margin=m)
                judged = quality_model.score(parts[k][0], model).join(parts[k][1], "doc_id")
                rates += [r[1] for r in judged.groupBy("quality").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).collect()]
            yield {"hidden": h, "margin": m, "balanced_accuracy": round(sum(rates) / len(rates), 4)}


def language_models(docs: DataFrame, priors: tuple[float, ...] = (5.0, 20.0, 50.0, 100.0, 200.0), orders: tuple[int, ...] = (2, 3), fold: int = 3) -> Iterator[dict]:
    """Mean log10 probability of a token in one seventh of the corpus, learned from the training rows but that seventh."""
    rows = materialise(docs.where(crc_mod(F.col("doc_id"), ngram_lm.FOLDS) != ngram_lm.HELD_OUT).select("doc_id", "text"), "tuning-rows")
    for n in orders:
        for k in priors:
            judged = ngram_lm.score(rows, n, k, held_out=fold).where("held_out").agg(F.sum("score") / F.sum("n_tokens"), F.avg("mean_score")).first()
            yield {"order": n, "prior": k, "a_token": round(judged[0], 4), "a_text": round(judged[1], 4)}


def main(folder: str) -> None:
    spark = SparkSession.builder.getOrCreate()
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    for found in (*classifiers(docs, labels), *language_models(docs)):
        print(found, flush=True)


if __name__ == "__main__":
    main(sys.argv[1])
