"""Mixing sources to target weights by Poisson replication (native).

Each source gets a mean repetition rate that brings its characters to its
share of the mixture. A document's number of copies is Poisson distributed
with that mean, found by inverting the distribution function at a number that
a hash of seed and doc_id gives; so a rerun, or a task that runs twice, makes
the same copies. A Poisson number is the sum of independent ones whose means
add up to its own, so a rate above ``MOST`` is drawn in equal parts of at most
that, each at its own hash: the table of the distribution function has at most
76 entries whatever the rate, and a document's work grows with its copies. The copies are exploded and dealt out by a hash of
(seed, document, copy): one shuffle, after which any prefix of the output is
a random sample of the mixture.

Only per-source totals are gathered, by a partially aggregated group-by, so a
source with a third of all rows costs no more than any other. The table of
rates goes through Parquet; Catalyst broadcasts it if its measured size
allows that and joins by shuffle, with skew splitting, if not.

Defined results: a null source is a source of its own; a null text counts no
characters; a source without characters keeps the rate 1; a null doc_id draws
by the text's hash; repeated rows draw alike; an empty table gives an empty
one. Input columns named ``copy_no`` or ``mix_key`` are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import materialise, packed, unpacked

#: Production weights: a source counts 1 unless named here.
WEIGHTS = {"src0": 4.0}
SEED = 17
#: Largest mean that is drawn by one inversion.
MOST = 16


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) of 52 bits from a hash."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("bigint") / F.lit(2.0**52)


def parts_of(rate: Column) -> Column:
    """Into how many equal parts a rate is split."""
    return F.greatest(F.ceil(rate / MOST), F.lit(1)).cast("int")


def copies(seed: int, who: Column, parts: Column, cdf: Column) -> Column:
    """A document's number of copies: inversions of ``cdf``, a part's distribution function, added up."""

    def drawn(part: Column) -> Column:
        # the first part's hash is that of a document drawn whole
        name = F.when(part == 0, who).otherwise(F.concat_ws(":", who, F.lit("part"), part.cast("string")))
        return F.array(_uniform(F.lit(str(seed)), name))  # in an array: the filter below then reads it instead of hashing again for each entry

    def below(u: Column) -> Column:
        return F.size(F.filter(cdf, lambda c: c <= u)).cast("bigint")

    def add(total: Column, part: Column) -> Column:
        return total + F.aggregate(F.transform(drawn(part), below), F.lit(0).cast("bigint"), lambda a, b: a + b)

    return F.aggregate(F.sequence(F.lit(0), parts - 1), F.lit(0).cast("bigint"), add)


def poisson_table(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... as an array that reaches far into the tail; for rates up to ``MOST``."""
    last = F.ceil(rate + 10 * F.sqrt(rate) + 20).cast("int")
    first = F.struct((-rate).alias("log_p"), F.exp(-rate).alias("total"), F.array(F.exp(-rate)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        log_p = acc["log_p"] + F.ln(rate) - F.ln(k.cast("double"))
        total = acc["total"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("total"), F.concat(acc["cdf"], F.array(total)).alias("cdf"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), first, step, lambda acc: acc["cdf"])).otherwise(F.array(F.lit(1.0)))


def rates(docs: DataFrame, weights: Mapping[str, float], default_weight: float = 1.0) -> DataFrame:
    """(source, size, rate, parts, cdf): one row per source, from the counts of all documents."""
    sizes = materialise(
        docs.groupBy(F.col("source").alias("source")).agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("bigint")).alias("size")), "mix-sizes"
    )
    weight = F.lit(float(default_weight))
    for name, w in weights.items():
        weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    sizes = sizes.withColumn("weight", weight)
    total = sizes.where("size > 0").agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    rate = F.when(F.col("size") > 0, F.col("weight") / F.lit(total["weight"] or 1.0) * F.lit(float(total["size"] or 0)) / F.col("size")).otherwise(F.lit(1.0))
    table = sizes.select("source", "size", rate.alias("rate")).withColumn("parts", parts_of(F.col("rate")))
    return table.withColumn("cdf", poisson_table(F.col("rate") / F.col("parts")))


def mix(docs: DataFrame, weights: Mapping[str, float] = WEIGHTS, default_weight: float = 1.0, seed: int = SEED) -> DataFrame:
    """The mixture: the columns of ``docs``, ``copy_no`` from 1, and ``mix_key``, by which partitions are sorted."""
    table = rates(docs, weights, default_weight).select(F.col("source").alias("_source"), F.col("parts").alias("_parts"), F.col("cdf").alias("_cdf"))
    who = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    rows = packed(docs, F.col("source").alias("_key"), who.alias("_who"))
    rows = rows.join(table, F.col("_key").eqNullSafe(F.col("_source")))
    rows = rows.withColumn("_n", copies(seed, F.col("_who"), F.col("_parts"), F.col("_cdf")))
    rows = rows.where("_n > 0").select("_row", "_who", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"))).alias("_copy"))
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "_who", F.col("_copy").cast("string"))), 1, 15), 16, 10).cast("bigint")
    rows = rows.withColumn("_mix", key).repartition("_mix").sortWithinPartitions("_mix")
    return unpacked(rows, F.col("_copy").alias("copy_no"), F.col("_mix").alias("mix_key"), replacing=("copy_no", "mix_key"))


def oracle_sql(documents: str = "documents", weights: Mapping[str, float] = WEIGHTS, seed: int = SEED, columns: str = "d.doc_id, d.text, d.lang, d.source, d.n_chars") -> str:
    """The same mixture in DuckDB's SQL, for default weight 1."""
    cases = " ".join(f"WHEN source = '{s}' THEN {float(w)!r}::DOUBLE" for s, w in weights.items())
    return f"""
WITH RECURSIVE sizes AS (
  SELECT source, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS size, CASE {cases} ELSE 1.0::DOUBLE END AS weight
  FROM {documents} GROUP BY source),
total AS (SELECT sum(size)::DOUBLE AS size, sum(weight) AS weight FROM sizes WHERE size > 0),
rates AS (
  SELECT source, CASE WHEN sizes.size > 0 THEN sizes.weight / total.weight * total.size / sizes.size ELSE 1.0::DOUBLE END AS rate
  FROM sizes, total),
parted AS (SELECT source, greatest(ceil(rate / {MOST}), 1)::INTEGER AS parts, rate / greatest(ceil(rate / {MOST}), 1)::INTEGER AS rate FROM rates),
cdf AS (
  SELECT source, parts, rate, 0 AS k, -rate AS log_p, exp(-rate) AS total FROM parted
  UNION ALL
  SELECT source, parts, rate, k + 1, log_p + ln(rate) - ln((k + 1)::DOUBLE), total + exp(log_p + ln(rate) - ln((k + 1)::DOUBLE))
  FROM cdf WHERE rate > 0 AND k < ceil(rate + 10 * sqrt(rate) + 20)),
tables AS (SELECT source, parts, list(total ORDER BY k) AS cdf FROM cdf GROUP BY source, parts),
drawn AS (
  SELECT {columns}, coalesce(CAST(d.doc_id AS VARCHAR), md5(coalesce(d.text, ''))) AS who, t.parts, t.cdf
  FROM {documents} d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source),
numbers AS (
  SELECT *, list_transform(range(parts), lambda p: ('0x' || substr(md5('{seed}:' || who || CASE WHEN p = 0 THEN '' ELSE ':part:' || p END), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE) AS us
  FROM drawn),
counted AS (
  SELECT * EXCLUDE (cdf, us, parts), list_sum(list_transform(us, lambda u: len(list_filter(cdf, lambda c: c <= u)))) AS n
  FROM numbers),
copies AS (SELECT * EXCLUDE (n), unnest(range(1, n::BIGINT + 1)) AS copy_no FROM counted WHERE n > 0)
SELECT * EXCLUDE (who), ('0x' || substr(md5('{seed}:' || who || ':' || copy_no), 1, 15))::BIGINT AS mix_key FROM copies
"""
