"""Depth families as one long table: unpivoting, tagging, labelling, ids, checks, merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.operators.order import ranked


def unpivoted(wide: DataFrame, iterations: int, ids: tuple[str, ...] = ("doc_id", "text_type")) -> DataFrame:
    """(ids..., depth, text) of the text columns that are there; null texts stay as rows."""
    names = ["original_text", *[f"paraphrase_iter_{k}" for k in range(1, iterations + 1)]]
    found = [F.struct(F.lit(k).alias("depth"), F.col(n).alias("text")) for k, n in enumerate(names) if n in wide.columns]
    return wide.select(*ids, F.inline(F.array(*found)))


def tagged(frames: list[DataFrame], text_type: str) -> DataFrame:
    """The union of detection tables with ``depth``, their place in the list, and ``text_type``."""
    parts = [f.withColumns({"depth": F.lit(k), "text_type": F.lit(text_type)}) for k, f in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def labelled(ai: DataFrame, human: DataFrame) -> DataFrame:
    """Both sides with label 1 and 0, for depths that both have."""
    common = ai.select("depth").distinct().join(human.select("depth").distinct(), "depth", "left_semi")
    both = ai.withColumn("label", F.lit(1)).unionByName(human.withColumn("label", F.lit(0)))
    return both.join(F.broadcast(common), "depth", "left_semi")  # a row per depth


def sequential_ids(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """``texts`` with ``id`` from 1: machine texts first, then by key. One id serves all depths."""
    keys = ranked(texts.select(key, "text_type", "label").distinct(), [F.col("label").desc(), F.col(key).asc(), F.col("text_type").asc()], "id")
    return keys.select(key, "text_type", "label", "id")


def counts_by_depth(table: DataFrame) -> DataFrame:
    """(depth, n, n_ai, n_human) and whether all depths have as many rows."""
    per = table.groupBy("depth").agg(F.count("*").alias("n"), F.sum((F.col("label") == 1).cast("bigint")).alias("n_ai"), F.sum((F.col("label") == 0).cast("bigint")).alias("n_human"))
    sizes = per.agg((F.countDistinct("n") <= 1).alias("consistent"))
    return per.join(F.broadcast(sizes))  # one row


def validated(tables: dict[str, tuple[DataFrame | None, tuple[str, ...]]]) -> DataFrame:
    """(name, present, n_rows, n_columns, valid): each table against the columns that it must have."""
    parts = []
    for name, (df, wanted) in tables.items():
        if df is None:
            parts.append(f"SELECT '{name}' AS name, false AS present, 0L AS n_rows, 0 AS n_columns, false AS valid")
            continue
        valid = all(c in df.columns for c in wanted)
        parts.append(df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), F.lit(True).alias("present"), "n_rows", F.lit(len(df.columns)).alias("n_columns"), (F.lit(valid) & (F.col("n_rows") > 0)).alias("valid")))
    spark = next(df for df, _ in tables.values() if df is not None).sparkSession
    return reduce(lambda a, b: a.unionByName(b), [spark.sql(p) if isinstance(p, str) else p for p in parts])


def merged(frames: list[DataFrame], on: str | list[str] | None = None) -> DataFrame | None:
    """Full outer joins from left to right on ``on``, or a union that fills missing columns with null.

    Columns that clash in a join get the endings ``_x`` and ``_y``.
    """
    if not frames:
        return None
    if on is None:
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    keys = [on] if isinstance(on, str) else on

    def outer(a: DataFrame, b: DataFrame) -> DataFrame:
        clash = {c for c in a.columns if c in b.columns and c not in keys}
        a = a.withColumnsRenamed({c: f"{c}_x" for c in clash})
        return a.join(b.withColumnsRenamed({c: f"{c}_y" for c in clash}), keys, "full_outer")

    return reduce(outer, frames)
