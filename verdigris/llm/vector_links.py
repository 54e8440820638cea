"""Near duplicates among vectors: randomised-rotation binary codes with correction factors.

A vector of unit length is rotated at random (three rounds of random signs and
a Walsh-Hadamard transform) and coded by the signs of the result, a bit a
dimension. Stored beside the code is the correction factor f, the inner product
of the vector with its code's own unit vector. The code's inner product with
another rotated vector, divided by f, is an unbiased estimate of the two
vectors' cosine c; its error has the deviation
``sqrt(1 - c*c) * sqrt(1 - f*f) / f / sqrt(D - 1)``. A pair is dropped only if
even a pair at the wanted cosine would be estimated so low with less than a
chance of 10**-9 (``DEVIATIONS``); all others are computed again exactly, in
double precision, so no pair below the threshold is ever linked.

Pairs meet by the codes: ``tables`` bands of ``bits`` sign bits, from as many
independent rotations as it takes. Vectors at the wanted cosine agree in a bit
with probability 1 - arccos(0.9) / pi, and there are as many bands as it takes
for ``RECALL`` of them to agree in one. A band has more bits, and there are more
bands, the more vectors there are, so a bucket holds about ``BUCKET`` of them.
A larger bucket is dealt into blocks of ``BLOCK`` vectors, pairs of blocks are
units of work, and no task holds more than one unit. A pair that agreed in an
earlier band was judged there and is skipped. What leaves a unit is a row per
vector: its links counted, and the smallest vector it hangs together with; no
pair is listed. Components of those rows are the result.

Equal vectors are one node with a weight, whatever their number. Different near
copies of one thing are compared pair by pair, as ``n_links`` asks, so a group
of m of them costs m * m estimates, spread over its units.

Defined results: a vector that is null, empty, zero, or holds null, NaN or
infinite components links with nothing and is a component of its own, as is a
row without id (its component_id is null, and it is kept). Vectors of different
lengths don't link. Rows that repeat an id are vectors of their own. Vectors
are scaled before they are multiplied, so none over- or underflows. Nodes are
named by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import materialise
from verdigris.llm.near_duplicates import Union, components, matched
from verdigris.llm.vector_codes import finite

COSINE = 0.9
#: Share of the pairs at exactly COSINE that meet in some band; closer ones meet more often.
RECALL = 0.9999
#: Deviations of an estimate below which a pair is dropped.
DEVIATIONS = 6.0
#: Vectors of a bucket that the number of bits aims at, and of a block of a larger one.
BUCKET, BLOCK = 1024, 2048
SEED = 23


def plan(n: int, cosine: float = COSINE, recall: float = RECALL, bucket: int = BUCKET) -> tuple[int, int]:
    """(bits, tables): the bits of a band for ``n`` vectors, and how many bands reach the recall."""
    bits = max(4, math.ceil(math.log2(max(n, 2) / bucket)))
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def padded(width: int) -> int:
    """Dimensions of the rotated space: a power of two, 64 at least."""
    return max(64, 1 << (width - 1).bit_length())


def unit(values: np.ndarray) -> np.ndarray:
    """Rows scaled by a power of two, which is exact, and then to unit length."""
    _, exponent = np.frexp(np.abs(values).max(1))
    scaled = np.ldexp(values, -exponent[:, None])
    return scaled / np.sqrt((scaled * scaled).sum(1))[:, None]


def rotated(units: np.ndarray, rotation: int) -> np.ndarray:
    """Unit vectors, filled up with zeros, in the space of the given rotation."""
    n, width = units.shape
    d = padded(width)
    signs = np.random.default_rng([SEED, rotation, d]).integers(0, 2, (3, d)) * 2.0 - 1
    x = np.zeros((n, d))
    x[:, :width] = units
    for flips in signs:
        x *= flips
        half = 1
        while half < d:
            pairs = x.reshape(n, -1, 2, half)
            x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(n, d)
            half *= 2
        x /= math.sqrt(d)
    return x


def codes(units: np.ndarray, n_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(packed sign bits of as many rotations as ``n_bits`` takes, correction factor of the first one)."""
    signs, factor = [], None
    for k in range(max(1, math.ceil(n_bits / padded(units.shape[1])))):
        x = rotated(units, k)
        factor = np.abs(x).sum(1) / math.sqrt(x.shape[1]) if factor is None else factor
        signs.append(x >= 0)
    return np.packbits(np.concatenate(signs, 1), axis=1), factor


def bands(packed: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The value of each band, a row per vector."""
    flat = np.unpackbits(packed, axis=1)[:, : bits * tables].reshape(len(packed), tables, bits)
    return flat.astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))


def linked(vectors: np.ndarray, packed: np.ndarray, factor: np.ndarray, earlier: np.ndarray, block: np.ndarray, within: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a, b) of rows at COSINE or more that share none of the ``earlier`` bands; ``within`` false: of two blocks only."""
    units = unit(vectors)
    n, d = len(units), padded(units.shape[1])
    x = rotated(units, 0).astype(np.float32)
    signs = (np.unpackbits(packed, axis=1)[:, :d].astype(np.float32) * 2 - 1) / math.sqrt(d)
    slack = DEVIATIONS * math.sqrt(1 - COSINE**2) / math.sqrt(d - 1) * np.sqrt(np.maximum(1 - factor**2, 0)) / factor + 1e-5
    least = ((COSINE - slack) * factor).astype(np.float32)  # what the estimate must reach, times the factor
    slice_ = max(1, 2_000_000 // units.shape[1])
    for at in range(0, n, 256):
        a, b = np.nonzero(signs[at : at + 256] @ x[at:].T >= least[at : at + 256, None])
        a, b = a + at, b + at
        keep = a < b
        if not within:
            keep &= block[a] != block[b]
        a, b = a[keep], b[keep]
        for k in range(0, len(a), slice_):
            i, j = a[k : k + slice_], b[k : k + slice_]
            new = ~(earlier[i] == earlier[j]).any(1)
            i, j = i[new], j[new]
            close = np.einsum("ij,ij->i", units[i], units[j]) >= COSINE
            yield i[close], j[close]


_LINKS = "node bigint, links bigint, root bigint"
_FIELDS = ("t", "band", "width", "i", "j", "node", "copies", "vector", "code", "factor", "block")


def _judged(bits: int, tables: int):
    """Over rows sorted by unit: links and the smallest node it hangs together with, for each node that has any."""

    def done(unit_: tuple, rows: list[tuple]) -> pa.RecordBatch:
        node = np.array([r[0] for r in rows], np.int64)
        copies = np.array([r[1] for r in rows], np.int64)
        packed = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), -1)
        earlier = bands(packed, bits, tables)[:, : unit_[0]]
        links, union = np.zeros(len(rows), np.int64), Union(len(rows))
        root = np.arange(len(rows))
        pairs = linked(np.array([r[2] for r in rows], np.float64), packed, np.array([r[4] for r in rows]), earlier, np.array([r[5] for r in rows]), unit_[3] == unit_[4])
        for a, b in pairs:
            links += np.bincount(a, copies[b], len(rows)).astype(np.int64) + np.bincount(b, copies[a], len(rows)).astype(np.int64)
            apart = root[a] != root[b]
            if apart.any():
                for p, q in np.unique(np.stack([root[a[apart]], root[b[apart]]], 1), axis=0).tolist():
                    union.join(p, q)
                root = np.array([union.find(k) for k in range(len(rows))])
        least: dict[int, int] = {}
        for k, r in enumerate(root.tolist()):
            least[r] = min(least.get(r, int(node[k])), int(node[k]))
        some = np.flatnonzero(links)
        roots = [least[r] for r in root[some].tolist()]
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some]), pa.array(roots, pa.int64())], names=["node", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for *unit_, node, copies, vector, code, factor, block in zip(*(batch.column(c).to_pylist() if c != "vector" else batch.column(c) for c in _FIELDS), strict=True):
                if tuple(unit_) != now:
                    if len(rows) > 1:
                        yield done(now, rows)
                    now, rows = tuple(unit_), []
                rows.append((node, copies, vector.values.to_numpy(zero_copy_only=False), code, factor, block))
        if len(rows) > 1:
            yield done(now, rows)

    return run


def _coded(nodes: DataFrame, bits: int, tables: int) -> DataFrame:
    """``nodes`` (node, copies, first_id, vector) with width, code, factor and the bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            widths = np.diff(column.offsets.to_numpy())
            values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
            starts = column.offsets.to_numpy()[:-1]
            code, factor, band = [None] * len(widths), np.zeros(len(widths)), [None] * len(widths)
            for width in np.unique(widths).tolist():
                at = np.flatnonzero(widths == width)
                packed, own = codes(unit(values[starts[at][:, None] + np.arange(width)]), bits * tables)
                factor[at] = own
                for k, c, b in zip(at.tolist(), packed, bands(packed, bits, tables).tolist(), strict=True):
                    code[k], band[k] = c.tobytes(), b
            arrays = [*batch.columns, pa.array(widths.astype(np.int32)), pa.array(code, pa.binary()), pa.array(factor), pa.array(band, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "width", "code", "factor", "bands"])

    kind = nodes.schema["vector"].dataType.simpleString()
    return nodes.mapInArrow(run, f"node bigint, copies bigint, first_id bigint, vector {kind}, width int, code binary, factor double, bands array<bigint>")


def link(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors``: the key, n_links, component_id, kept."""
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("vector"))
    able = F.col("id").isNotNull() & finite(F.col("vector")) & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("node", F.when(able, F.xxhash64("vector")))
    nodes = rows.where("node IS NOT NULL").groupBy("node", "vector").agg(F.count("*").alias("copies"), F.min("id").alias("first_id"))
    nodes = materialise(nodes.select("node", "copies", "first_id", "vector"), "vector-nodes")
    n, total = nodes.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    bits, tables = plan(n, bucket=bucket)
    coded = materialise(_coded(nodes, bits, tables), "vector-coded")

    # narrow rows first: which buckets have company, and how many blocks they need
    met = coded.select("node", "width", F.posexplode("bands").alias("t", "band"))
    shared = met.groupBy("t", "band", "width").agg(F.count("*").alias("n")).where("n > 1")
    shared = shared.select("t", "band", "width", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    placed = met.join(shared, ["t", "band", "width"]).groupBy("node").agg(F.collect_list(F.struct("t", "band", "parts")).alias("places"))  # at most a place per band
    wide = coded.drop("bands", "first_id").join(placed, "node").withColumn("place", F.explode("places"))
    at = F.pmod(F.xxhash64("node", "place.t"), F.col("place.parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("place.parts") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    units = wide.withColumn("block", at).withColumn("pair", F.explode(pairs)).select("place.t", "place.band", "width", "pair.i", "pair.j", "node", "copies", "vector", "code", "factor", "block")
    units = units.repartition("t", "band", "width", "i", "j").sortWithinPartitions("t", "band", "width", "i", "j")
    found = materialise(units.mapInArrow(_judged(bits, tables), _LINKS), "vector-links")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), "vector-components")
    names = nodes.select(F.col("node").alias("m"), "copies", "first_id")
    named = materialise(roots.join(names, F.col("node") == F.col("m")).select("node", "root", "first_id"), "vector-named")
    least = named.groupBy(F.col("root").alias("r")).agg(F.min("first_id").alias("component_id"), F.count("*").alias("members"))
    told = matched(named.drop("first_id"), "root", least, "r", "members", n, "inner").select(F.col("node").alias("c"), "component_id")
    table = names.join(told, F.col("m") == F.col("c"), "left").join(links.withColumnRenamed("node", "l"), F.col("m") == F.col("l"), "left")
    n_links = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("bigint")
    table = materialise(table.select("m", n_links.alias("n_links"), F.coalesce("component_id", "first_id").alias("component_id"), "copies"), "vector-table")

    ids = rows.select("id", "node")
    alone = ids.where("node IS NULL").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    out = matched(ids.where("node IS NOT NULL"), "node", table, "m", "copies", total, "inner").select("id", "n_links", "component_id").union(alone)
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


#: The links in DuckDB's SQL: all pairs, compared exactly.
ORACLE_SQL = f"""
WITH RECURSIVE rows AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, embedding::DOUBLE[] AS v,
    coalesce(vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS able FROM embeddings),
pairs AS MATERIALIZED (SELECT a.n AS a, b.n AS b FROM rows a JOIN rows b ON a.n <> b.n AND len(a.v) = len(b.v) WHERE a.able AND b.able AND list_cosine_similarity(a.v, b.v) >= {COSINE}),
reached(n, other) AS (SELECT n, n FROM rows UNION SELECT reached.n, pairs.b FROM reached JOIN pairs ON reached.other = pairs.a),
least AS (SELECT reached.n, min(rows.vec_id) AS component_id FROM reached JOIN rows ON rows.n = reached.other GROUP BY reached.n)
SELECT vec_id, (SELECT count(*) FROM pairs WHERE pairs.a = rows.n) AS n_links, component_id, coalesce(vec_id = component_id, true) AS kept FROM rows JOIN least USING (n)
"""
