"""Compression of vectors to codes of a byte a part, by partial-distance search.

A vector's components become integers and are cut into ``PARTS`` equal
consecutive parts; a part is coded by the nearest of its codebook's entries.
The codebooks start as the vectors of smallest id and are refined by rounds of
assignment and averaging, all in integers, so a result doesn't depend on how
rows lie in partitions.

The search for the nearest entry walks the dimensions in descending variance
over the codebook's entries, where entries differ most. After a few of them the
most promising entry of each vector is completed; masks then drop each entry
whose accumulated distance strictly exceeds the best complete one, and the rest
of the walk is done for what is left. Nothing that could still be nearest, or
tie with the nearest, is dropped, so the result is that of the full search.

A round is one scan: a task sums up its vectors by entry and emits a row for
each component of each entry it has used, Spark adds these up, and the driver
sees ``PARTS * ENTRIES`` entries, whatever the number of vectors. The last scan
writes the codes; sums by label are aggregated before they are shuffled and
matched with the rows by ``matched``, so a label may hold any share of them.

Defined results: rows whose vector is null, empty, holds null, NaN or infinite
components, or has not the length of the vector of smallest id among those
whose length the parts divide, are dropped. A null id is kept but begins no
codebook. Vectors that share an id are taken in the order of their components.
With fewer vectors than ``ENTRIES`` the codebooks are as short. Integer
components saturate where squared distances would leave 64 bits (at 2**27 for
64 components). ``label_error`` is null where its sum would. An empty table
gives no rows. Columns other than id, vector and label are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.llm.common import materialise
from verdigris.llm.near_duplicates import matched

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Dimensions walked before the first entry is completed, and between two maskings.
OPENING, STRIDE = 4, 3
#: Vectors searched at once.
AT_ONCE = 1024


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are numbers."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~F.coalesce(odd, F.lit(True)), F.lit(False))


def largest(width: int) -> int:
    """The largest component with which no sum of ``width`` squared differences leaves 62 bits."""
    return int(2**30 / width**0.5)


def integers(values: np.ndarray, width: int) -> np.ndarray:
    """floor(SCALE * x), saturated, a row per vector."""
    most = largest(width)
    return np.clip(np.floor(values.astype(np.float64).reshape(-1, width) * SCALE), -most, most).astype(np.int64)


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point its nearest entry, the first among equals, and the squared distance."""
    order = np.argsort(-book.var(0), kind="stable")
    points, book = points[:, order], book[:, order]
    reach = int(max(np.abs(points).max(initial=0), np.abs(book).max(initial=0)))
    if (2 * reach) ** 2 * len(order) < 2**31:
        points, book = points.astype(np.int32), book.astype(np.int32)
    index, distance = np.empty(len(points), np.int64), np.empty(len(points), np.int64)
    for at in range(0, len(points), AT_ONCE):
        index[at : at + AT_ONCE], distance[at : at + AT_ONCE] = _walk(points[at : at + AT_ONCE], book)
    return index, distance


def _walk(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sums = np.zeros((len(points), len(book)), points.dtype)
    for d in range(min(OPENING, book.shape[1])):
        step = points[:, d, None] - book[None, :, d]
        step *= step
        sums += step
    best = ((points - book[sums.argmin(1)]) ** 2).sum(1)
    row, entry = np.nonzero(sums <= best[:, None])  # in order of rows, then entries
    left = sums[row, entry]
    for begin in range(OPENING, book.shape[1], STRIDE):
        for d in range(begin, min(begin + STRIDE, book.shape[1])):
            step = points[row, d] - book[entry, d]
            left += step * step
        stays = left <= best[row]
        row, entry, left = row[stays], entry[stays], left[stays]
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])  # the completed entry is left in each row
    least = np.minimum.reduceat(left, starts)
    hit = np.flatnonzero(left == np.repeat(least, np.diff(np.r_[starts, len(row)])))
    _, first = np.unique(row[hit], return_index=True)
    return entry[hit[first]], least


def coded(points: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each part of each point."""
    found = [nearest(part, book) for part, book in zip(np.split(points, PARTS, axis=1), books, strict=True)]
    return np.stack([i for i, _ in found], 1), np.stack([d for _, d in found], 1)


_SUMS = "part int, entry int, place int, total bigint, n bigint"


def refined(kept: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round: the floor of the mean of each entry's parts; unused entries stay."""
    width = sum(b.shape[1] for b in books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = [np.zeros(b.shape, np.int64) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            points = integers(batch.column(0).flatten().to_numpy(zero_copy_only=False), width)
            chosen, _ = coded(points, books)
            for p, part in enumerate(np.split(points, PARTS, axis=1)):
                counts[p] += np.bincount(chosen[:, p], minlength=len(books[p]))
                for d in range(part.shape[1]):  # a batch's sums are exact in doubles
                    totals[p][:, d] += np.bincount(chosen[:, p], part[:, d], len(books[p])).astype(np.int64)
        for p in range(PARTS):
            entry = np.flatnonzero(counts[p])
            own = totals[p].shape[1]
            columns = [np.full(len(entry) * own, p, np.int32), np.repeat(entry, own).astype(np.int32), np.tile(np.arange(own, dtype=np.int32), len(entry)), totals[p][entry].ravel(), np.repeat(counts[p][entry], own)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["part", "entry", "place", "total", "n"])

    sums = kept.select("vector").mapInArrow(run, _SUMS).groupBy("part", "entry", "place")
    made = [b.copy() for b in books]
    for r in sums.agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total"), F.sum("n").alias("n")).collect():  # a row per component of the codebooks
        made[r.part][r.entry, r.place] = int(r.total) // r.n
    return made


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per kept vector: the key, code (two hex digits a part), error, label_error, codebooks_sha256."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    rows = rows.where(finite(F.col("vector")) & (F.size("vector") % PARTS == 0))
    first = lambda df: [r.vector for r in df.where("key IS NOT NULL").orderBy("key", "vector").select("vector").limit(ENTRIES).collect()]
    start = first(rows)
    width = len(start[0]) if start else 0
    kept = rows.where(F.size("vector") == width)
    if any(len(v) != width for v in start):
        start = first(kept)
    books = np.split(integers(np.array(start), width), PARTS, axis=1) if start else []
    for _ in range(ROUNDS if start else 0):
        books = refined(kept, books)
    sha = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen, far = coded(integers(batch.column("vector").flatten().to_numpy(zero_copy_only=False), width), books)
            text = chosen.astype(np.uint8).tobytes().hex()
            codes = [text[k : k + 2 * PARTS] for k in range(0, len(text), 2 * PARTS)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), pa.array(codes, pa.string()), pa.array(far.sum(1), pa.int64())], names=["key", "label", "code", "error"])

    schema = T.StructType([rows.schema["key"], rows.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    found = kept.mapInArrow(run, schema) if start else spark.createDataFrame([], schema)
    found = found.select("key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null")).alias("by"), "code", "error")
    found = materialise(found, "vector-codes")
    sums = found.groupBy("by").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("n")).withColumnRenamed("by", "b")
    sums = materialise(sums, "vector-labels")
    total = sums.agg(F.sum("n")).first()[0] or 0
    out = matched(found, "by", sums, "b", "n", total, "inner")
    return out.select(F.col("key").alias(key), "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def oracle_sql() -> str:
    """The compression in DuckDB's SQL: full search, a CTE for each assignment and each codebook."""
    steps = [f"""
rows AS MATERIALIZED (
  SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id, embedding) AS n,
    list_transform(embedding, lambda x: floor({SCALE}::DOUBLE * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS MATERIALIZED (SELECT n, p, v[p * len(v) // {PARTS} + 1:(p + 1) * len(v) // {PARTS}] AS v FROM rows, range({PARTS}) t(p)),
book0 AS MATERIALIZED (SELECT p, n - 1 AS e, v AS c FROM cut WHERE n <= {ENTRIES})"""]
    for k in range(ROUNDS + 1):
        steps.append(f"""
far{k} AS (SELECT n, cut.p, e, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM cut JOIN book{k} b ON cut.p = b.p),
near{k} AS MATERIALIZED (SELECT n, p, arg_min(e, d * {ENTRIES} + e) AS e, min(d) AS d FROM far{k} GROUP BY n, p)""")
        if k < ROUNDS:
            steps.append(f"""
sums{k} AS (SELECT p, e, i, sum(v[i + 1])::HUGEINT AS s, count(*)::HUGEINT AS m FROM cut JOIN near{k} USING (n, p), range(len(v)) t(i) GROUP BY p, e, i),
means{k} AS (SELECT p, e, list(((s - ((s % m) + m) % m) // m)::BIGINT ORDER BY i) AS c FROM sums{k} GROUP BY p, e),
book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN means{k} m ON b.p = m.p AND b.e = m.e)""")
    return f"""WITH {','.join(steps)},
found AS (SELECT n, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{ROUNDS} GROUP BY n),
named AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS sha FROM book{ROUNDS})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, sha AS codebooks_sha256 FROM rows JOIN found USING (n), named"""
