"""Strided windows that never cut a run of ones, and features of window sequences.

A window starts at each multiple of the stride, is as long as the size (or
ends with the text), and grows in both directions while it cuts into a run of
ones; to the left it takes the character before the run as well. The last
window is the first one that reaches the end before it grows.

Windows are found from the boundaries of runs: a task holds the sequences of a
batch as one array of characters, looks up the last and the next character that
is no one by binary search, and takes counts of ones from running sums. The
time is linear in the text and the windows, however long a sequence or its runs
are, and only ``windows`` makes strings. A sequence that is too long for a row
may come in chunk rows of any size: ``windows_of_chunks`` deals it by tiles,
each with what its windows need of the neighbours, so tasks share one sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.config import Windows
from verdigris.functions import scores as S

#: Characters that are worked on at once.
AT_ONCE = 4_000_000
#: Characters of a tile of a sequence that comes in chunks.
TILE = 65_536
NONE = np.iinfo(np.int64).max
_ONE, _ZERO = ord("1"), ord("0")


def literal(bits: Column) -> Column:
    """A digit string as comma-joined text, as files hold it; null becomes ``nan``."""
    return F.coalesce(F.regexp_replace(bits, r"(?<=.)(?=.)", ","), F.lit("nan"))


def _characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' characters in one array, and where each text begins and the last one ends; null texts are empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    begins = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[begins[0] : begins[-1]] if data is not None else np.empty(0, np.uint8)
    begins = begins - begins[0]
    if (raw < 128).all():
        return raw, begins
    before = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]  # characters before each byte
    return np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32), before[begins]


def _window_count(length: np.ndarray, size: int, stride: int) -> np.ndarray:
    return np.where(length > 0, np.minimum(-(-length // stride), 1 - (-np.maximum(length - size, 0) // stride)), 0)


class Cut:
    """The windows of several sequences, or of tiles of sequences, as arrays.

    ``row`` is the place of a window's sequence, ``index`` its number there,
    ``first`` and ``last`` its extent in the sequence, ``ones`` how many ones it
    has, ``run`` its longest stretch without a zero and ``freq`` how often it
    has one. A tile begins at ``base`` of a sequence of ``total`` characters;
    ``left`` and ``right`` are the nearest characters before and after what the
    tile holds that are no ones (-1 and NONE without one); it owns the windows
    that start among its first ``own`` characters.
    """

    def __init__(self, texts: pa.Array, settings: Windows, base=None, total=None, left=None, right=None, own: int | None = None):
        chars, begins = _characters(texts)
        n = len(begins) - 1
        size, stride = settings.size, settings.stride
        lo, hi = begins[:-1], begins[1:]
        base = np.zeros(n, np.int64) if base is None else base
        total = hi - lo if total is None else total
        left = np.full(n, -1) if left is None else left
        right = np.full(n, NONE) if right is None else right
        if own is None:
            from_, to = np.zeros(n, np.int64), _window_count(total, size, stride)
        else:
            from_, to = -(-base // stride), np.minimum(-(-(base + own) // stride), _window_count(total, size, stride))
        counts = np.maximum(to - from_, 0)
        self.row = row = np.repeat(np.arange(n), counts)
        self.index = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + from_[row]
        shift = (lo - base)[row]  # from places in a sequence to places in chars
        start = self.index * stride
        end = np.minimum(start + size, total[row])
        apart = np.flatnonzero(chars != _ONE)
        k = np.searchsorted(apart, start + shift, "right") - 1
        found = apart[np.maximum(k, 0)] if len(apart) else np.zeros(len(row), np.int64)
        self.first = np.where((k >= 0) & (found >= lo[row]), found - shift, np.maximum(left[row], 0))
        k = np.searchsorted(apart, end - 1 + shift, "left")
        found = apart[np.minimum(k, len(apart) - 1)] if len(apart) else np.zeros(len(row), np.int64)
        here = (k < len(apart)) & (found < hi[row])
        stop = np.where(here, found - shift, right[row])
        self.last = np.where(stop == end - 1, end, np.minimum(np.where(stop == NONE, total[row], stop + 1), total[row]))
        self.length = self.last - self.first
        # what lies before or after the characters at hand is all ones but for the bounding zero
        inner, outer = np.maximum(self.first + shift, lo[row]), np.minimum(self.last + shift, hi[row])
        before, after = inner - shift - self.first, self.last - (outer - shift)
        ones = np.r_[0, np.cumsum(chars == _ONE)]
        self.ones = ones[outer] - ones[inner] + before - (before > 0) * (left[row] >= 0) + after - (after > 0) * (right[row] != NONE)
        self._runs(np.flatnonzero(chars == _ZERO), inner, outer, before - (before > 0) * (left[row] >= 0), after - (after > 0) * (right[row] != NONE))

    def _runs(self, zeros: np.ndarray, inner: np.ndarray, outer: np.ndarray, before: np.ndarray, after: np.ndarray) -> None:
        a, b = np.searchsorted(zeros, inner, "left"), np.searchsorted(zeros, outer, "left")
        none = a == b
        head = np.where(none, outer - inner + before + after, 0)
        tail = np.zeros(len(a), np.int64)
        if len(zeros):
            head = np.where(none, head, zeros[np.minimum(a, len(zeros) - 1)] - inner + before)
            tail = np.where(none, 0, outer - zeros[b - 1] - 1 + after)
        gaps = np.diff(zeros) - 1
        width = np.maximum(b - a - 1, 0)
        self.run = np.maximum(head, tail)
        some = np.flatnonzero(width)
        many = np.zeros(len(a), np.int64)
        for at in range(0, len(some), 100_000):
            w = some[at : at + 100_000]
            begins = np.cumsum(width[w]) - width[w]
            flat = gaps[np.arange(width[w].sum()) + np.repeat(a[w] - begins, width[w])]
            self.run[w] = np.maximum(self.run[w], np.maximum.reduceat(flat, begins))
            many[w] = np.add.reduceat((flat == np.repeat(self.run[w], width[w])).astype(np.int64), begins)
        self.freq = np.where(self.run > 0, many + (head == self.run) + (~none & (tail == self.run)), 0)

    def z(self, gamma: float) -> np.ndarray:
        return (self.ones - gamma * self.length) / np.sqrt(self.length * (gamma * (1 - gamma)))


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about AT_ONCE bytes of text, a row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    piece = (np.cumsum(sizes) - sizes) // AT_ONCE
    edges = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1], True]) if len(piece) else []
    for lo, hi in zip(edges, edges[1:]):
        yield batch.slice(lo, hi - lo)


_PLACE = "win_idx int, win_start int, win_end int"
_FIGURES = "z double, run int, freq int"


def _schema(table: DataFrame, without: tuple[str, ...], more: str) -> T.StructType:
    return T.StructType([f for f in table.schema if f.name not in without] + T.StructType.fromDDL(more).fields)


def _prepared(table: DataFrame, settings: Windows, bits: str) -> DataFrame:
    text = literal(F.col(bits)) if settings.mode == "literal" else F.col(bits)
    return table.withColumn("_s", text).drop(bits)


def _each(table: DataFrame, settings: Windows, bits: str, gamma: float | None) -> DataFrame:
    """A row per window: with its string, or with its figures if there is a gamma."""
    rows = _prepared(table, settings, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, "_s"):
                cut = Cut(batch.column("_s"), settings)
                kept = batch.drop_columns(["_s"])
                texts = batch.column("_s").to_pylist() if gamma is None else ()
                for at in range(0, len(cut.row), 100_000):
                    part = slice(at, at + 100_000)
                    more = [pa.array(c[part].astype(np.int32)) for c in (cut.index, cut.first, cut.last)]
                    if gamma is None:
                        more.append(pa.array([texts[r][a:b] for r, a, b in zip(cut.row[part].tolist(), cut.first[part].tolist(), cut.last[part].tolist())], pa.string()))
                    else:
                        more += [pa.array(cut.z(gamma)[part]), *(pa.array(c[part].astype(np.int32)) for c in (cut.run, cut.freq))]
                    taken = kept.take(pa.array(cut.row[part]))
                    yield pa.RecordBatch.from_arrays([*taken.columns, *more], names=names)

    schema = _schema(rows, ("_s",), f"{_PLACE}, " + ("win string" if gamma is None else _FIGURES))
    names = schema.names
    return rows.mapInArrow(run, schema)


def windows(table: DataFrame, settings: Windows, bits: str = "bits") -> DataFrame:
    """``table``'s other columns with win_idx, win_start, win_end (0-based, end exclusive) and win.

    An empty sequence gives no row.
    """
    return _each(table, settings, bits, None)


def features(wins: DataFrame, gamma: float) -> DataFrame:
    """With z, run (longest) and freq (how often) of each window, from its string."""
    longest, often = S.longest_run(F.col("win"))
    z = S.z_score(S.ones(F.col("win")), F.length("win"), gamma)
    return wins.withColumns({"z": z, "run": longest, "freq": often})


def figures(table: DataFrame, settings: Windows, gamma: float, bits: str = "bits") -> DataFrame:
    """``windows`` and ``features`` in one, without the strings: their length may be the square of a sequence's."""
    return _each(table, settings, bits, gamma)


def local_scores(table: DataFrame, settings: Windows, gamma: float, bits: str = "bits", name: str = "zs") -> DataFrame:
    """``table`` with the z-scores of a sequence's windows as an array in place of its bits."""
    rows = _prepared(table, settings, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, "_s"):
                cut = Cut(batch.column("_s"), settings)
                ends = np.r_[0, np.cumsum(np.bincount(cut.row, minlength=len(batch)))].astype(np.int32)
                zs = pa.ListArray.from_arrays(pa.array(ends), pa.array(cut.z(gamma)))
                yield pa.RecordBatch.from_arrays([*batch.drop_columns(["_s"]).columns, zs], names=schema.names)

    schema = _schema(rows, ("_s",), f"{name} array<double>")
    return rows.mapInArrow(run, schema)


def peaks(table: DataFrame, settings: Windows, gamma: float, threshold: float, bits: str = "bits") -> DataFrame:
    """``table`` with what its windows say where a sequence is marked, in place of its bits.

    n_windows, hot_windows (how many score above ``threshold``), and z and
    extent of the window of highest score, the first among equals (null where
    there is none). Made inside the row.
    """
    rows = _prepared(table, settings, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, "_s"):
                cut, n = Cut(batch.column("_s"), settings), len(batch)
                z = cut.z(gamma)
                order = np.lexsort((cut.index, -z, cut.row))
                top = order[np.flatnonzero(np.r_[True, cut.row[1:] != cut.row[:-1]])] if len(z) else order  # rows keep their places in any order of their windows
                at, none = np.zeros(n, np.int64), np.ones(n, bool)
                at[cut.row[top]], none[cut.row[top]] = top, False
                pick = lambda a: pa.array(a[at] if len(z) else np.zeros(n, a.dtype), mask=none)
                counts = np.bincount(cut.row, minlength=n), np.bincount(cut.row[z > threshold], minlength=n)
                more = [pa.array(c.astype(np.int64)) for c in counts] + [pick(z), pick(cut.first.astype(np.int64)), pick(cut.last.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([*batch.drop_columns(["_s"]).columns, *more], names=schema.names)

    schema = _schema(rows, ("_s",), "n_windows bigint, hot_windows bigint, peak_z double, peak_start bigint, peak_end bigint")
    return rows.mapInArrow(run, schema)


MOMENTS = ("mean", "var", "min", "max", "skew", "kurtosis")
STATIC = tuple([f"z_{m}" for m in MOMENTS] + ["z_autocorr_lag1", "z_autocorr_lag2"] + [f"{p}_{m}" for p in ("run", "freq") for m in MOMENTS])


def _moments(row: np.ndarray, n: int, value: np.ndarray) -> dict[str, np.ndarray]:
    """Mean, variance, extremes, skewness and excess kurtosis of each row's values; 0 where there are none or too few, or they are all equal."""
    count = np.bincount(row, minlength=n)
    some = np.maximum(count, 1)
    mean = np.bincount(row, value, n) / some
    apart = value - mean[row]
    powers = [np.bincount(row, apart**k, n) / some for k in (2, 3, 4)]
    low, high = np.zeros(n), np.zeros(n)
    begins = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.empty(0, np.int64)
    if len(row):
        low[row[begins]], high[row[begins]] = np.minimum.reduceat(value, begins), np.maximum.reduceat(value, begins)
    spread_ = (high > low) & (powers[0] > 0)
    var = np.where(spread_, powers[0], 1.0)
    skew = np.where(spread_ & (count > 2), powers[1] / var**1.5, 0.0)
    kurtosis = np.where(spread_ & (count > 3), powers[2] / var**2 - 3.0, 0.0)
    return dict(zip(MOMENTS, (mean, powers[0], low, high, skew, kurtosis), strict=True)) | {"_apart": apart}


def _autocorrelation(row: np.ndarray, n: int, apart: np.ndarray, lag: int) -> np.ndarray:
    below = np.bincount(row, apart * apart, n)
    same = row[lag:] == row[:-lag]
    above = np.bincount(row[lag:][same], (apart[lag:] * apart[:-lag])[same], n)
    return np.where((np.bincount(row, minlength=n) > lag) & (below > 1e-18), above / np.maximum(below, 1e-18), 0.0)


def statistics(cut: Cut, n: int, gamma: float) -> dict[str, np.ndarray]:
    """The twenty figures of each of the ``n`` sequences; those without windows have zeros."""
    out: dict[str, np.ndarray] = {}
    for p, value in (("z", cut.z(gamma)), ("run", cut.run.astype(float)), ("freq", cut.freq.astype(float))):
        found = _moments(cut.row, n, value)
        out |= {f"{p}_{m}": found[m] for m in MOMENTS}
        if p == "z":
            out |= {f"z_autocorr_lag{k}": _autocorrelation(cut.row, n, found["_apart"], k) for k in (1, 2)}
    return out


def rolling(table: DataFrame, settings: Windows, gamma: float, key: str | None = None, bits: str = "bits") -> DataFrame:
    """Every sequence of ``table`` with its figures in place of its bits; sequences without windows have zeros.

    A sequence is summarised inside its row, so nothing is shuffled and rows
    that repeat each other stay apart. ``key`` is not needed.
    """
    rows = _prepared(table, settings, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, "_s"):
                found = statistics(Cut(batch.column("_s"), settings), len(batch), gamma)
                yield pa.RecordBatch.from_arrays([*batch.drop_columns(["_s"]).columns, *(pa.array(found[c]) for c in STATIC)], names=schema.names)

    schema = _schema(rows, ("_s",), ", ".join(f"{c} double" for c in STATIC))
    return rows.mapInArrow(run, schema)


def windows_of_chunks(chunks: DataFrame, settings: Windows, gamma: float, key: str = "id", at: str = "chunk", bits: str = "bits", tile: int = TILE) -> DataFrame:
    """(key, win_idx, win_start, win_end, z, run, freq) of sequences that come in rows: ``at`` orders the chunks of a key.

    The windows are those of the whole sequence, wherever it is cut. Chunks are
    told apart by (key, at); null and empty ones count as nothing. What a chunk
    tells about its neighbours is three numbers (its length, its first and its
    last character that is no one), and running sums and extremes of these,
    over narrow rows, give each chunk its place and the ends of the runs that
    reach into it. Characters are then dealt by tiles of the sequence, each
    with the ``size`` characters that follow.
    """
    if settings.mode != "clean":
        raise ValueError("chunks are of bits, not of comma-joined text")
    rows = chunks.select(F.col(key).alias("_k"), F.col(at).alias("_at"), F.coalesce(bits, F.lit("")).alias("_s")).where("_s <> ''")
    length = F.length("_s")
    lead = length - F.length(F.ltrim("_s", F.lit("1")))  # ones at the beginning
    trail = length - F.length(F.rtrim("_s", F.lit("1")))
    narrow = rows.select("_k", "_at", length.cast("bigint").alias("n"), F.when(lead < length, lead).alias("head"), F.when(trail < length, length - trail - 1).alias("tail"))
    order = Window.partitionBy("_k").orderBy("_at")
    earlier, later = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    narrow = narrow.withColumn("b", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    narrow = narrow.withColumns({"before": F.max(F.col("b") + F.col("tail")).over(earlier), "after": F.min(F.col("b") + F.col("head")).over(later), "total": F.max(F.col("b") + F.col("n")).over(Window.partitionBy("_k"))})
    narrow = narrow.withColumnsRenamed({"_k": "_nk", "_at": "_nat"})
    placed = rows.join(narrow, F.col("_k").eqNullSafe(F.col("_nk")) & F.col("_at").eqNullSafe(F.col("_nat")))

    reach = tile + settings.size
    e = F.col("b") + F.col("n")
    tiles = F.sequence(F.greatest(F.floor((F.col("b") - settings.size) / tile), F.lit(0)), F.floor((e - 1) / tile))
    dealt = placed.withColumn("tile", F.explode(tiles)).withColumns({"from": F.col("tile") * tile, "to": F.least(F.col("tile") * tile + reach, F.col("total"))})
    cut = lambda a, z: F.substring(F.col("_s"), (a - F.col("b") + 1).cast("int"), (z - a).cast("int"))
    # the piece in which the tile begins knows what ends a run to the left, the piece in which it stops what ends one to the right
    head, rest = cut(F.col("b"), F.col("from")), cut(F.col("to"), e)
    kept, ones = F.length(F.rtrim(head, F.lit("1"))), F.length(rest) - F.length(F.ltrim(rest, F.lit("1")))
    left = F.when((F.col("b") <= F.col("from")) & (F.col("from") < e), F.when(kept > 0, F.col("b") + kept - 1).otherwise(F.col("before")))
    right = F.when((F.col("b") < F.col("to")) & (F.col("to") <= e), F.when(ones < F.length(rest), F.col("to") + ones).otherwise(F.col("after")))
    a, z = F.greatest("b", "from"), F.least(e, F.col("to"))
    pieces = dealt.where(a < z).select("_k", "tile", "total", F.struct(a.alias("a"), cut(a, z).alias("s")).alias("piece"), left.alias("left"), right.alias("right"))
    whole = pieces.groupBy("_k", "tile").agg(F.sort_array(F.collect_list("piece")).alias("pieces"), F.max("left").alias("left"), F.min("right").alias("right"), F.max("total").alias("total"))
    whole = whole.select("_k", (F.col("tile") * tile).alias("base"), F.array_join(F.col("pieces.s"), "").alias("_s"), F.coalesce("left", F.lit(-1)).cast("bigint").alias("left"), F.coalesce("right", F.lit(int(NONE))).cast("bigint").alias("right"), "total")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in _slices(big, "_s"):
                base, total, left, right = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("base", "total", "left", "right"))
                found = Cut(batch.column("_s"), settings, base, total, left, right, tile)
                figures_ = [*(pa.array(c) for c in (found.index, found.first, found.last)), pa.array(found.z(gamma)), *(pa.array(c) for c in (found.run, found.freq))]
                yield pa.RecordBatch.from_arrays([batch.column("_k").take(pa.array(found.row)), *figures_], names=names)

    kind = chunks.schema[key].dataType.simpleString()
    names = [key, "win_idx", "win_start", "win_end", "z", "run", "freq"]
    return whole.mapInArrow(run, f"`{key}` {kind}, win_idx bigint, win_start bigint, win_end bigint, z double, run bigint, freq bigint")


def wide(wins: DataFrame, n: int, *by: str) -> DataFrame:
    """z_score_i, run_i, freq_i for the first ``n`` windows; absent ones are null."""
    picks = [F.max(F.when(F.col("win_idx") == i, F.col(c))).alias(f"{name}_{i + 1}") for i in range(n) for c, name in (("z", "z_score"), ("run", "run"), ("freq", "freq"))]
    return wins.groupBy(*by).agg(*picks)
