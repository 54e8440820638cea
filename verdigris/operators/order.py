"""Ranks and running totals over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.sources.storage import stored


def running_totals(df: DataFrame, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """``df`` with, by each name, the sum of its value over all rows up to this one in the total order ``order``.

    Rows are dealt by ranges of the order and stored; each partition sums by
    itself and adds the totals of the partitions before it. The driver sees one
    row per partition.
    """
    inner = {n: f"_value{k}" for k, n in enumerate(values)}
    rows = stored(df.repartitionByRange(*order).select("*", F.spark_partition_id().alias("_part"), *[v.alias(inner[n]) for n, v in values.items()]), "ordered")
    before, offsets = [0] * len(inner), []
    for part, *totals in sorted(tuple(r) for r in rows.groupBy("_part").agg(*[F.sum(c) for c in inner.values()]).collect()):
        offsets.append((part, *before))
        before = [b + (t or 0) for b, t in zip(before, totals, strict=True)]
    schema = ", ".join(["_at int", *[f"_before{k} bigint" for k in range(len(inner))]])
    table = df.sparkSession.createDataFrame(offsets or [(-1, *before)], schema)
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({f"_inside{k}": F.sum(c).over(inside) for k, c in enumerate(inner.values())})
    rows = rows.join(F.broadcast(table), F.col("_part") == F.col("_at"))  # a row per partition
    return rows.select(*df.columns, *[(F.col(f"_inside{k}") + F.col(f"_before{k}")).alias(n) for k, n in enumerate(inner)])


def running_total(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """``running_totals`` of one value."""
    return running_totals(df, order, {name: value})


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with its row number, from 1, in a total order."""
    return running_total(df, order, F.lit(1).cast("bigint"), name)
