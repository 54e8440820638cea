"""Binary classification metrics as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.operators.order import running_total, running_totals
from verdigris.sources.storage import stored


def _cell(label: int, prediction: int) -> Column:
    return F.coalesce(F.sum(((F.col("label") == label) & (F.col("prediction") == prediction)).cast("bigint")), F.lit(0))


def cells(table: DataFrame, *by: str) -> DataFrame:
    """(by..., tn, fp, fn, tp) of columns label and prediction."""
    picks = [_cell(0, 0).alias("tn"), _cell(0, 1).alias("fp"), _cell(1, 0).alias("fn"), _cell(1, 1).alias("tp")]
    return table.groupBy(*by).agg(*picks) if by else table.agg(*picks)


def confusion(table: DataFrame) -> DataFrame:
    """[[TN, FP], [FN, TP]]"""
    return cells(table).select(F.array(F.array("tn", "fp"), F.array("fn", "tp")).alias("confusion_matrix"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / F.greatest(b, F.lit(1))).otherwise(F.lit(0.0))


def rates(counted: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 beside the cells; a zero divisor gives 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    found = {"accuracy": _ratio(tp + tn, tp + tn + fp + fn), "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn)}
    return counted.withColumns(found)


def roc_auc(table: DataFrame, score: str) -> DataFrame:
    """(auc): the chance that a positive scores above a negative, ties counting half.

    Scores are first counted by value, then negatives are summed up along the
    sorted values, so no task holds the whole order.
    """
    values = table.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.sum((F.col("label") == 1).cast("bigint")).alias("pos"), F.sum((F.col("label") == 0).cast("bigint")).alias("neg"))
    summed = running_total(values, [F.col("s").asc()], F.col("neg"), "upto")
    pairs = F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2))
    both = F.sum("pos").cast("double") * F.sum("neg")
    return summed.agg(F.when(both > 0, pairs / F.when(both > 0, both)).alias("auc"))


def roc_curves(table: DataFrame, score: str, *by: str) -> DataFrame:
    """(by..., threshold, pos, neg, tp, fp, all_pos, all_neg): one ROC curve per group, a row per distinct score.

    ``pos`` and ``neg`` have exactly that score, ``tp`` and ``fp`` that score or
    more. All groups' curves come from one pass: scores are counted by value
    before they are shuffled, running totals go on across groups, and each group
    takes off what was there where it began. So no task holds a group, however
    many rows or distinct scores it has. Null scores are left out; a null group
    is a group.
    """
    values = table.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("threshold")).agg(F.sum((F.col("label") == 1).cast("bigint")).alias("pos"), F.sum((F.col("label") == 0).cast("bigint")).alias("neg"))
    summed = running_totals(values, [*[F.col(c).asc() for c in by], F.col("threshold").asc()], {"_pos": F.col("pos"), "_neg": F.col("neg")})
    summed = stored(summed, "curves")
    totals = summed.groupBy(*by).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"), F.max("_pos").alias("_pos_end"), F.max("_neg").alias("_neg_end"))
    totals = totals.withColumnsRenamed({c: f"_by_{c}" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    rows = summed.join(totals, same, "inner") if by else summed.crossJoin(F.broadcast(totals))  # one row
    tp, fp = F.col("_pos_end") - F.col("_pos") + F.col("pos"), F.col("_neg_end") - F.col("_neg") + F.col("neg")
    return rows.select(*by, "threshold", "pos", "neg", tp.alias("tp"), fp.alias("fp"), "all_pos", "all_neg")


def operating_points(curves: DataFrame, *by: str, most_false: float = 0.05) -> DataFrame:
    """(by..., n_pos, n_neg, auc, threshold, tpr, fpr) of each group of ``roc_curves``.

    ``threshold`` is the least score from which at most the share ``most_false``
    of the negatives is flagged, null where even the highest flags more. ``auc``
    is null where a group has only one class, and so is the rate of the class it lacks.
    """
    fits = F.col("fp") <= F.col("all_neg") * F.lit(most_false)
    pairs = F.sum((F.col("pos").cast("decimal(18,0)") * (2 * (F.col("all_neg") - F.col("fp")) + F.col("neg")).cast("decimal(19,0)")).cast("decimal(38,0)"))
    best = F.min_by(F.struct("threshold", "tp", "fp"), F.when(fits, F.col("threshold")))
    rows = curves.groupBy(*by).agg(F.max("all_pos").alias("n_pos"), F.max("all_neg").alias("n_neg"), pairs.cast("double").alias("_pairs"), best.alias("_best"))
    share = lambda a, n: F.when(F.col(n) > 0, F.col(a) / F.greatest(F.col(n), F.lit(1)))
    both = F.col("n_pos").cast("double") * F.col("n_neg")
    auc = F.when(both > 0, F.col("_pairs") / 2 / F.when(both > 0, both))
    return rows.select(*by, "n_pos", "n_neg", auc.alias("auc"), "_best.threshold", share("_best.tp", "n_pos").alias("tpr"), share("_best.fp", "n_neg").alias("fpr"))


def formatted(results: DataFrame) -> DataFrame:
    """Results in the columns of a results file: AUC with three places as text, rates with four, the matrix as text."""
    cell = lambda c: F.col(c).cast("string")
    matrix = F.concat(F.lit("[["), cell("tn"), F.lit(", "), cell("fp"), F.lit("], ["), cell("fn"), F.lit(", "), cell("tp"), F.lit("]]"))
    rates = [F.round(c, 4).alias(name) for c, name in (("precision", "Precision"), ("recall", "Recall"), ("f1", "F1"))]
    return results.select(F.col("experiment").alias("Experiment"), F.format_string("%.3f", "auc").alias("AUC"), *rates, matrix.alias("ConfusionMatrix"), F.round("accuracy", 4).alias("Accuracy"))


def summarised(results: DataFrame) -> str:
    """A few lines for each experiment of ``formatted`` results, and the one of best accuracy."""
    rows = results.collect()  # a row per experiment
    lines = [f"{r.Experiment}: AUC {r.AUC}, F1 {r.F1:.4f}, precision {r.Precision:.4f}, recall {r.Recall:.4f}, accuracy {r.Accuracy:.4f}, {r.ConfusionMatrix}" for r in rows]
    top = max(rows, key=lambda r: r.Accuracy, default=None)
    return "\n".join([*lines, *([f"best: {top.Experiment} ({top.Accuracy:.4f})"] if top else [])])


def best(results: DataFrame, by: str, name: str = "experiment", order: str = "position") -> DataFrame:
    """The row of the largest ``by``; the first among equals."""
    ahead = F.struct(F.col(by), -F.col(order))
    return results.agg(F.max_by(name, ahead).alias(name), F.max(by).alias(by))
