"""Quality classifier from positive and unlabelled texts.

Trusted positives are training rows labelled 1; everything else in the
training part is unlabelled, rows labelled 0 included. The share of positives
among the unlabelled (the class prior) is estimated first, then a classifier
minimises the non-negative unbiased risk

    prior * R_p(+)  +  max(0, R_u(-) - prior * R_p(-))

with sigmoid loss (the negative part is not allowed below zero; where it falls
below, the step undoes it instead of following it).

Features are figures of the whole text, made by built-in functions inside the
JVM; the model is a network of one small hidden layer over them, so scoring is
one projection over the scan, without shuffle and without Python. The model is
fitted on the driver on a bounded sample of rows: at most ``SAMPLE`` positives
and twice as many unlabelled, those of smallest hash of (doc_id, text), each
different pair once; so neither null or repeated ids nor copies fill it.

Defined results: null texts count as empty; an empty text gets the score of
its (all zero) features; a null doc_id counts as empty text for the split;
repeated labels of one doc_id count as positive if any is 1; without positives
or unlabelled rows every score is the prior 0.5. Labels, language, source and
doc_id are no features; columns of those names clash with nothing, and input
columns named like an output column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import count_of, crc_mod, materialise, packed, unpacked, words_of

#: The documented bound of the training sample: rows of each kind.
SAMPLE = 20_000
#: Rows whose crc32(doc_id) modulo 3 is this are never learned from.
FOLDS, HELD_OUT = 3, 1

FEATURES = ("length", "word_length", "capitals", "symbols", "exclamations", "bars", "digits", "punctuation", "repeats", "variety", "line_words")


def features(text: Column, words: Column) -> list[Column]:
    """The figures of a text; all between 0 and about 10.

    ``words`` should be a column of the table: functions over arrays would
    split the text again each time if it were an expression.
    """
    t = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.length(t), F.lit(1))
    n = F.greatest(F.size(words), F.lit(1))

    def share(characters: str) -> Column:
        return count_of(t, characters) / chars

    repeats = F.size(F.filter(words, lambda w, i: w == F.get(words, i - 1)))
    return [
        F.log1p(F.size(words).cast("double")),
        F.log1p(F.length(F.array_join(words, "")) / n),
        share(r"\p{Lu}"),
        share(r"#*$%&<>=@\^~_\\{}"),
        share("!?"),
        share("|"),
        share("0-9"),
        share(",.;:'\"()"),
        repeats / n,
        F.size(F.array_distinct(words)) / n,
        F.log1p(n / (share("\n") * chars + 1)),
    ]


@dataclass(frozen=True)
class Model:
    """A network of one hidden layer over standardised figures."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    hidden: tuple[tuple[float, ...], ...]  # for each hidden unit the weights of the figures, its bias last
    out: tuple[float, ...]  # weights of the hidden units, the bias last
    prior: float

    def score(self, values: Column) -> Column:
        """Probability of a positive as a column over the array of figures."""
        x = [F.greatest(F.least((values[i] - m) / s, F.lit(CLIP)), F.lit(-CLIP)) for i, (m, s) in enumerate(zip(self.mean, self.scale, strict=True))]
        total = F.lit(self.out[-1])
        for weights, w in zip(self.hidden, self.out, strict=False):
            inner = F.lit(weights[-1])
            for v, column in zip(weights, x, strict=False):
                inner = inner + column * v
            total = total + F.tanh(inner) * w
        return 1 / (1 + F.exp(-F.greatest(F.least(total, F.lit(40.0)), F.lit(-40.0))))


#: Standardised figures are kept within this many deviations.
CLIP = 6.0
#: Hidden units, and the margin of the class prior in standard errors; chosen by ``tuning.classifiers`` on training rows alone.
HIDDEN, MARGIN = 12, 0.5


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def risk(gp: np.ndarray, gu: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The non-negative risk of outputs for positives and unlabelled, and the steps' slopes by them.

    Where the unlabelled rows' share of negatives comes out below zero, the
    slopes are those that undo it.
    """
    sp, su = _sigmoid(gp), _sigmoid(gu)
    steep_p, steep_u = sp * (1 - sp) / len(gp), su * (1 - su) / len(gu)
    negative = su.mean() - prior * sp.mean()
    value = prior * (1 - sp).mean() + max(0.0, negative)
    if negative >= 0:
        return value, -2 * prior * steep_p, steep_u
    return value, prior * steep_p, -steep_u


def _trained(p: np.ndarray, u: np.ndarray, slopes, steps: int, hidden: int = HIDDEN, rate: float = 0.02, decay: float = 1e-4) -> list[np.ndarray]:
    """Full-batch Adam; ``slopes(gp, gu)`` are the risk's derivatives by the outputs."""
    rng = np.random.default_rng(0)
    theta = [rng.normal(0, 0.5, (p.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.3, hidden), np.zeros(1)]
    first, second = [np.zeros_like(a) for a in theta], [np.zeros_like(a) for a in theta]
    for t in range(1, steps + 1):
        hp, hu = np.tanh(p @ theta[0] + theta[1]), np.tanh(u @ theta[0] + theta[1])
        dp, du = slopes(hp @ theta[2] + theta[3], hu @ theta[2] + theta[3])
        bp, bu = np.outer(dp, theta[2]) * (1 - hp * hp), np.outer(du, theta[2]) * (1 - hu * hu)
        g = [p.T @ bp + u.T @ bu + decay * theta[0], bp.sum(0) + bu.sum(0), hp.T @ dp + hu.T @ du + decay * theta[2], np.array([dp.sum() + du.sum()])]
        for i in range(4):
            first[i], second[i] = 0.9 * first[i] + 0.1 * g[i], 0.999 * second[i] + 0.001 * g[i] ** 2
            theta[i] = theta[i] - rate * (1 - t / (steps + 1)) * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    return theta


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, steps: int = 600, hidden: int = HIDDEN, margin: float = MARGIN) -> Model:
    """Minimise the non-negative risk. ``prior`` None: estimated."""
    both = np.vstack([positive, unlabelled])
    mean, scale = both.mean(0), np.maximum(both.std(0), 1e-3)
    p, u = (np.clip((x - mean) / scale, -CLIP, CLIP) for x in (positive, unlabelled))
    if prior is None:
        prior = class_prior(p, u, hidden, margin)
    w, b, out, bias = _trained(p, u, lambda gp, gu: risk(gp, gu, prior)[1:], steps, hidden, decay=max(1e-4, 1 / len(p)))
    return Model(tuple(mean.tolist()), tuple(scale.tolist()), tuple((*w[:, k].tolist(), float(b[k])) for k in range(hidden)), (*out.tolist(), float(bias[0])), float(prior))


def class_prior(p: np.ndarray, u: np.ndarray, hidden: int = HIDDEN, margin: float = MARGIN) -> float:
    """Share of positives among the unlabelled.

    A classifier of positive against unlabelled gives each row a score. Where
    nearly all rows are positives, the unlabelled are as frequent as the prior
    times the positives; the estimate is the smallest such ratio over upper
    parts of the scores, with ``margin`` standard errors added.
    """

    def slopes(gp: np.ndarray, gu: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return -_sigmoid(-gp) / len(p), _sigmoid(gu) / len(u)

    found = []
    for k in (0, 1):  # scores come from a classifier of the other half, so overfitting can't part the two
        w, b, out, _ = _trained(p[k::2], u[k::2], slopes, 200, hidden, decay=max(1e-4, 1 / len(p)))
        sp, su = (np.sort(np.tanh(x[1 - k :: 2] @ w + b) @ out) for x in (p, u))
        if not len(sp) or not len(su):
            continue
        best = 1.0
        for q in np.linspace(0.02, 0.5, 25):
            cut = sp[int(q * (len(sp) - 1))]
            above_p, above_u = 1 - np.searchsorted(sp, cut) / len(sp), 1 - np.searchsorted(su, cut) / len(su)
            if above_p > 0:
                best = min(best, (above_u + margin * (above_u * (1 - above_u) / len(su)) ** 0.5) / above_p)
        found.append(best)
    return float(np.clip(np.mean(found or [0.5]), 0.01, 0.99))


def sampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Figures of at most ``sample`` positives and 2 ``sample`` other training rows, those of smallest hash of (doc_id, text).

    A row that is trusted is no unlabelled one. What goes to the driver is
    bounded by ``sample`` whatever repeats in the tables.
    """
    spark = docs.sparkSession
    training = crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT
    positives = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id")).where(training).distinct()
    trusted = [r[0] for r in positives.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]
    ids = spark.createDataFrame([(i,) for i in trusted], "trusted_id bigint")  # at most ``sample`` ids
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(training)
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text", F.lit("sample")))
    rows = rows.join(F.broadcast(ids), F.col("doc_id") == F.col("trusted_id"), "left").withColumn("trusted", F.col("trusted_id").isNotNull())
    share = min(1.0, 4.0 * sample / max(docs.count(), 1))  # more than are wanted; the smallest keys of them are the smallest of all
    rows = rows.withColumn("key", F.shiftrightunsigned("key", 11)).where(F.col("trusted") | (F.col("key") / F.lit(2.0**53) < share))
    found = []
    keys = materialise(rows.select("trusted", "key").distinct(), "quality-keys")
    for trusted, n in ((True, sample), (False, 2 * sample)):
        last = keys.where(F.col("trusted") == trusted).orderBy("key").limit(n).agg(F.max("key")).first()[0]
        found.append(-1 if last is None else last)
    # copies are dropped before their figures are made
    chosen = rows.where(F.col("key") <= F.when(F.col("trusted"), found[0]).otherwise(found[1])).groupBy("trusted", "key").agg(F.first("text").alias("text"))
    chosen = chosen.withColumn("words", words_of(F.col("text")))
    table = chosen.select("trusted", "key", F.array(*features(F.col("text"), F.col("words"))).alias("x")).collect()  # at most 3 ``sample`` rows
    table.sort(key=lambda r: r.key)
    return tuple(np.array([r.x for r in table if r.trusted == trusted]) for trusted in (True, False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, hidden: int = HIDDEN, margin: float = MARGIN) -> Model | None:
    """Fit on a bounded sample of the training rows of ``docs`` and ``labels``."""
    positive, unlabelled = sampled(docs, labels, sample)
    return fit(positive, unlabelled, hidden=hidden, margin=margin) if len(positive) and len(unlabelled) else None


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """The columns of ``docs`` with ``held_out``, ``score`` and ``predicted``."""
    rows = packed(docs, (crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("_out"), F.col("text").alias("_text"), words_of(F.col("text")).alias("_words"))
    rows = rows.select("_row", "_out", F.array(*features(F.col("_text"), F.col("_words"))).alias("_x"))
    rows = rows.withColumn("_score", F.lit(0.5) if model is None else model.score(F.col("_x")))
    predicted = F.when(F.col("_score") >= 0.5, 1).otherwise(0)
    return unpacked(rows, F.col("_out").alias("held_out"), F.col("_score").alias("score"), predicted.alias("predicted"), replacing=("held_out", "score", "predicted"))
