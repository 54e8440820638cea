"""Cross-depth stability: the spread of local z-scores over paraphrase depths, and classifiers on it."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.config import EXPERIMENTS, Classifier
from verdigris.operators.order import ranked
from verdigris.operators.windows import STATIC


def common_windows(wins: DataFrame) -> DataFrame:
    """(n_windows): each depth's largest number of windows, the least over depths."""
    return wins.groupBy("depth").agg((F.max("win_idx") + 1).alias("n")).agg(F.min("n").alias("n_windows"))


def common_windows_of_arrays(scores: DataFrame) -> DataFrame:
    """``common_windows`` of rows (depth, zs) that hold a text's local scores as an array: no window is a row."""
    return scores.groupBy("depth").agg(F.max(F.size("zs")).alias("n")).where("n > 0").agg(F.min("n").alias("n_windows"))


def _deviation(values: list[Column]) -> Column:
    """Population deviation of columns of a row."""
    n = len(values)
    mean = reduce(add, values) / n
    return F.sqrt(reduce(add, [(v - mean) * (v - mean) for v in values]) / n)


def matrix(wins: DataFrame, sets=EXPERIMENTS) -> DataFrame:
    """(experiment, id, win_idx, pss): population deviation of z over the experiment's depths.

    A window's z-scores of all depths are brought into one row once; the
    experiments are columns made of that row. A window that some depth of an
    experiment lacks has 0 there, and one that all its depths lack no row.
    """
    depths = sorted({d for _, ds in sets for d in ds})
    rows = wins.where(F.col("depth").isin(*depths)).groupBy("id", "win_idx").agg(*[F.max(F.when(F.col("depth") == d, F.col("z"))).alias(f"_z{d}") for d in depths])
    return _by_experiment(rows, ("id",), sets)


def _by_experiment(rows: DataFrame, keys: tuple[str, ...], sets) -> DataFrame:
    """(experiment, keys, win_idx, pss) of rows with a column ``_z{d}`` for each depth."""
    made = []
    for name, ds in sets:
        own = [F.col(f"_z{d}") for d in ds]
        pss = F.coalesce(_deviation(own), F.lit(0.0))  # null if any z is
        made.append(F.when(F.coalesce(*own).isNotNull(), F.struct(F.lit(name).alias("experiment"), pss.alias("pss"))))
    return rows.select(*keys, "win_idx", F.inline(F.array_compact(F.array(*made)))).select("experiment", *keys, "win_idx", "pss")


def matrix_of_arrays(scores: DataFrame, keys: tuple[str, ...], sets=EXPERIMENTS) -> DataFrame:
    """``matrix`` of rows (keys, depth, zs) that hold a text's local scores at a depth as an array.

    The arrays of a text's depths meet in one row, so a shuffle moves a row per
    text and depth where windows as rows would be many times as many. Of rows
    that repeat a key and depth the longest array counts.
    """
    rows = _zipped(scores, keys, sets).select(*keys, F.posexplode("_zipped").alias("win_idx", "_w")).select(*keys, "win_idx", "_w.*")
    return _by_experiment(rows, keys, sets)


def _zipped(scores: DataFrame, keys: tuple[str, ...], sets) -> DataFrame:
    """(keys, _zipped): for each window of a text a struct of its scores at all depths."""
    depths = sorted({d for _, ds in sets for d in ds})
    longest = lambda d: F.max_by("zs", F.when(F.col("depth") == d, F.struct(F.size("zs"), "zs")))
    rows = scores.where(F.col("depth").isin(*depths)).groupBy(*keys).agg(*[longest(d).alias(f"_z{d}") for d in depths])
    names = [f"_z{d}" for d in depths]
    return rows.select(*keys, F.arrays_zip(*[F.coalesce(n, F.array().cast("array<double>")).alias(n) for n in names]).alias("_zipped"))


def summary_of_arrays(scores: DataFrame, keys: tuple[str, ...], sets=EXPERIMENTS) -> DataFrame:
    """(experiment, keys, n_windows, mean_pss, max_pss): ``matrix_of_arrays`` summed up inside a text's row, where no window becomes a row."""
    rows, made = _zipped(scores, keys, sets), []
    for name, ds in sets:
        own = lambda w, ds=ds: [w[f"_z{d}"] for d in ds]
        there = F.filter("_zipped", lambda w: F.coalesce(*own(w)).isNotNull())
        pss = F.transform(there, lambda w: F.coalesce(_deviation(own(w)), F.lit(0.0)))
        made.append(F.struct(F.lit(name).alias("experiment"), pss.alias("pss")))
    rows = rows.select(*keys, F.inline(F.array(*made))).where(F.size("pss") > 0)
    total = F.aggregate("pss", F.lit(0.0), lambda a, x: a + x)
    return rows.select("experiment", *keys, F.size("pss").cast("bigint").alias("n_windows"), F.try_divide(total, F.size("pss")).alias("mean_pss"), F.array_max("pss").alias("max_pss"))


def features(pss: DataFrame, static: DataFrame, n: int, names: tuple[str, ...] = STATIC) -> DataFrame:
    """(id, label, pss_win1.., the static figures ``names``) of one experiment; nulls are 0."""
    picks = [F.max(F.when(F.col("win_idx") == i, F.col("pss"))).alias(f"pss_win{i + 1}") for i in range(n)]
    return static.select("id", "label", *names).join(pss.groupBy("id").agg(*picks), "id", "left").na.fill(0.0)


def split(table: DataFrame, settings: Classifier) -> DataFrame:
    """``table`` (id, label, ...) with ``is_test``: of each label exactly the first ceil(share n) by keyed hash."""
    order = F.md5(F.concat_ws(":", F.lit(str(settings.seed)), F.col("id").cast("string")))
    keys = ranked(table.select("id", "label", order.alias("_h")), [F.col("label"), F.col("_h"), F.col("id")], "_rank")
    per = keys.groupBy("label").agg(F.min("_rank").alias("_from"), F.count("*").alias("_n"))
    inside = keys.join(F.broadcast(per), "label")  # a row per label
    test = (F.col("_rank") - F.col("_from") + 1) <= F.ceil(F.col("_n") * F.lit(settings.test_size))
    return table.join(inside.select("id", test.alias("is_test")), "id")


def classified(table: DataFrame, settings: Classifier) -> DataFrame:
    """(id, label, prediction, probability) of the test part by gradient-boosted trees fitted on the rest."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    inputs = [c for c in table.columns if c not in ("id", "label", "is_test")]
    rows = VectorAssembler(inputCols=inputs, outputCol="features").transform(table.withColumn("label", F.col("label").cast("double")))
    model = GBTClassifier(maxIter=settings.trees, maxDepth=settings.depth, stepSize=settings.step, subsamplingRate=settings.subsample, featureSubsetStrategy=str(settings.features_per_node), seed=settings.seed)
    out = model.fit(rows.where("NOT is_test")).transform(rows.where("is_test"))
    return out.select("id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"), vector_to_array("probability")[1].alias("probability"))
