"""Benchmark decontamination by SimHash windows and multi-index Hamming search.

A document's text is cut into windows as long as a benchmark item, one at
each word, and at the text's ends also shorter ones of any length. A window's fingerprint
is the 128-bit SimHash of its five-word shingles, each weighted by the square
root of how often it occurs. With these weights the squared length of a
window's vector is its number of shingles, so two windows at weighted Jaccard
similarity J have a cosine of at least 2 J / (1 + J), whatever repeats in
them: 8/9 at 0.8, and 19.4 differing bits of 128 give or take 4.1. A radius of
31 bits misses a single window at exactly 0.8 about once in 400 times; a
passage that is more alike, or alike in several windows, less often.

Fingerprints are cut into eight blocks of 16 bits. If two differ in at most
31 bits, some block differs in at most three. Each item is kept under all 697
values within three bits of each of its blocks, and a window is looked up by
its eight values, so every item within the radius is found; of unrelated items
one in twelve is met and dropped by its whole distance. Candidates are then
compared exactly: weighted Jaccard of the shingle counts, at least 0.8.

Most windows need no fingerprint: one at similarity 0.8 or more has at least
0.8 times the item's number of shingles in common with the item, so fewer
shingles that occur in any item rule it out. Running sums over a text give
that bound for all windows of a length at once. No true match is lost by it.

An item of fewer than five words is a single shingle of its own width, and
similar to a window only if equal; such items are looked up by the hash of
each of a text's windows of that width.

The documents are only scanned; nothing is shuffled. The benchmark is the
small side: it is sent to the workers in slices of at most ``SLICE`` items and
``SLICE_CHARS`` characters. One scan of the documents walks as many slices as
have ``SCAN_CHARS`` characters together, and a worker holds the indexes of at
most ``HELD`` of them, so what it holds is bounded whatever the benchmark's
size; only a benchmark beyond ``SCAN_CHARS`` takes a further scan.

Defined results: null and empty texts and items match nothing; a text of
fewer than five words is a single shingle; words are compared with A-Z in
lower case; rows with one item_id are items of their own, each listed;
repeated rows are judged alike; rows without doc_id are judged too.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations, repeat
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import SHINGLE_WORDS, WordHashes, byte_words, mixed, packed, shingle_hashes, unpacked

BITS, BLOCK_BITS, RADIUS = 128, 16, 31
#: Similarity of at least NUMERATOR / DENOMINATOR.
NUMERATOR, DENOMINATOR = 4, 5
#: Items and characters that a worker holds at once.
SLICE, SLICE_CHARS = 4096, 32_000_000
#: Indexes of slices that a worker holds at once, and characters of items that one scan looks for.
HELD, SCAN_CHARS = 4, 128_000_000
#: Windows that are fingerprinted at once.
AT_ONCE = 4096


#: Middle values of 256 equal parts of the normal distribution.
QUANTILES = np.array([NormalDist().inv_cdf((k + 0.5) / 256) for k in range(256)])


def projections(shingles: np.ndarray) -> np.ndarray:
    """A normally distributed number for each bit of the fingerprint and each shingle, by its hash.

    Sums of such numbers differ in sign with a probability that depends on the
    cosine of two bags alone, for small bags as for large ones; sums of plain
    plus and minus ones would often be zero for small bags.
    """
    steps = np.arange(BITS // 8, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    words = mixed(shingles[:, None] + steps)
    return QUANTILES[words.view(np.uint8).reshape(len(shingles), BITS)]


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """The signs of sums as bytes."""
    return np.packbits(sums >= 0, axis=1)


def similar(a: Counter, b: Counter) -> tuple[int, int]:
    """Numerator and denominator of the weighted Jaccard similarity."""
    shared = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return shared, a.total() + b.total() - shared


def shingles_at(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """``shingle_hashes`` at the positions ``at`` only."""
    windows = words[at[:, None] + np.arange(width)]
    out = np.zeros(len(at), np.uint64)
    for k in range(width):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + windows[:, k] + np.uint64(k + 1))
    return out


def window_sums(values: np.ndarray, shingles: np.ndarray, size: int) -> np.ndarray:
    """Weighted sums of ``values`` over all windows of ``size`` shingles, from the one that holds the first shingle alone to the one that holds the last alone.

    Row k is the window that begins at shingle k - size + 1. The c-th
    occurrence of a shingle in a window adds sqrt(c) - sqrt(c - 1) times its
    values when the window reaches it, and the first takes as much away, for as
    many as there are then, when the window leaves it.
    """
    n = len(shingles)
    order = np.argsort(shingles, kind="stable")
    begins = np.r_[True, shingles[order][1:] != shingles[order][:-1]]
    rank = np.empty(n, np.int64)
    place = np.arange(n) - np.maximum.accumulate(np.where(begins, np.arange(n), 0))  # how many of the same stand before
    rank[order] = place
    group = np.cumsum(begins) - 1
    keys = group * np.int64(4 * n + 4) + order  # by shingle, then place in the text
    own = np.empty(n, np.int64)
    own[order] = group
    at = np.arange(n)
    since = np.searchsorted(keys, own * np.int64(4 * n + 4) + np.maximum(at - size + 1, 0))  # first occurrence in the window that ends here
    until = np.searchsorted(keys, own * np.int64(4 * n + 4) + np.minimum(at + size, n))  # end of those in the window that begins here
    mine = np.empty(n, np.int64)
    mine[order] = np.arange(n)
    come, go = mine - since + 1, until - mine
    root = np.sqrt(np.arange(size + 1))
    change = np.zeros((n + size, values.shape[1]))
    change[:n] += (root[come] - root[come - 1])[:, None] * values
    change[size:] -= (root[go] - root[go - 1])[:, None] * values
    return np.cumsum(change, 0)[:-1]


class HammingIndex:
    """Finds all stored fingerprints within RADIUS of a given one, by the values of their blocks."""

    def __init__(self, stored: np.ndarray):
        self.halves = np.ascontiguousarray(stored).view(np.uint64)
        blocks = np.ascontiguousarray(stored).view(np.uint16)
        apart = RADIUS // blocks.shape[1]
        masks = np.array([sum(1 << k for k in c) for r in range(apart + 1) for c in combinations(range(BLOCK_BITS), r)], np.uint16)
        # items[b][starts[b][value] : starts[b][value + 1]]: items whose block b is near the value
        self.starts, self.items = [], []
        for b in range(blocks.shape[1]):
            values = (blocks[:, b, None] ^ masks).ravel()
            self.items.append((np.argsort(values, kind="stable") // len(masks)).astype(np.uint16))
            self.starts.append(np.r_[0, np.cumsum(np.bincount(values, minlength=1 << BLOCK_BITS))])

    def candidates(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``wanted``, stored item), each once, for each pair that some block brings together."""
        met = np.zeros((len(wanted), len(self.halves)), bool)
        blocks = np.ascontiguousarray(wanted).view(np.uint16)
        for b, (starts, items) in enumerate(zip(self.starts, self.items, strict=True)):
            first = starts[blocks[:, b]]
            n = starts[blocks[:, b].astype(np.int64) + 1] - first
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            met[np.repeat(np.arange(len(n)), n), items[np.repeat(first, n) + inside]] = True
        return np.nonzero(met)

    def search(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``wanted``, stored item) for each pair within the radius."""
        row, item = self.candidates(wanted)
        apart = np.bitwise_count(np.ascontiguousarray(wanted).view(np.uint64)[row] ^ self.halves[item])
        keep = apart.sum(1, dtype=np.int64) <= RADIUS
        return row[keep], item[keep]


class Benchmark:
    """Items with their shingles, fingerprints and index; judges texts.

    ``sizes`` are those of windows that other items bring in: each window of an
    item's size is compared with every item, whatever slice either is in.
    """

    def __init__(self, items: list[tuple[int, str]], sizes: Iterable[int] = ()):
        hashes = WordHashes(limit=1 << 40)
        self.ids, self.bags = [], []
        self.short: dict[int, dict[int, list[int]]] = {}  # words: hash of the item: item ids
        for item_id, text in items:
            words = byte_words(text)
            if not words:
                continue
            shingles = shingle_hashes(hashes.of(words))
            if len(words) < SHINGLE_WORDS:
                self.short.setdefault(len(words), {}).setdefault(int(shingles[0]), []).append(item_id)
                continue
            self.ids.append(item_id)
            self.bags.append(Counter(shingles.tolist()))
        self.words = {w: k + 1 for k, w in enumerate(hashes)}  # 0: in no item
        self.hash_of = np.array([0, *hashes.values()], np.uint64)
        self.shingles = np.array(sorted({s for b in self.bags for s in b}), np.uint64)
        self.sizes = sorted({b.total() for b in self.bags}.union(sizes))
        self.places = [np.searchsorted(self.shingles, np.fromiter(b, np.uint64)) for b in self.bags]
        if self.bags:
            sums = np.array([(projections(np.fromiter(b, np.uint64)) * np.sqrt(list(b.values()))[:, None]).sum(0) for b in self.bags])
            self.index = HammingIndex(fingerprints(sums))

    def judge(self, text: str | None) -> list[dict]:
        """The items that the text contains: for each its most similar, first window."""
        if not text or not self.words:
            return []
        words = byte_words(text)
        number = np.fromiter(map(self.words.get, words, repeat(0)), np.int64, len(words))
        known = number > 0
        found = self.judge_short(number, known)
        if len(words) >= SHINGLE_WORDS and self.bags:
            found += self.judge_long(words, number, known)
        return sorted(found, key=lambda x: x["item_id"])

    def _places(self, number: np.ndarray, known: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the shingles of which all words occur in the benchmark, and their hashes; only they can be an item's."""
        n = len(number) - width + 1
        whole = known[:n].copy()
        for k in range(1, width):
            whole &= known[k : n + k]
        at = np.flatnonzero(whole)
        return at, shingles_at(self.hash_of[number], at, width)

    def judge_short(self, number: np.ndarray, known: np.ndarray) -> list[dict]:
        """Items of fewer than five words that stand in the text; the first place of each."""
        found = []
        for width, items in self.short.items():
            if width > len(number):
                continue
            at, hashes = self._places(number, known, width)
            _, first = np.unique(hashes, return_index=True)
            for k in first.tolist():
                lo = int(at[k])
                found += [{"item_id": i, "similarity": 1.0, "first_word": lo, "last_word": lo + width - 1} for i in items.get(int(hashes[k]), ())]
        return found

    def judge_long(self, words: list[bytes], number: np.ndarray, known: np.ndarray) -> list[dict]:
        width = SHINGLE_WORDS
        at, shingles = self._places(number, known, width)
        if len(at) * DENOMINATOR < NUMERATOR * self.sizes[0]:
            return []
        place = np.minimum(np.searchsorted(self.shingles, shingles), len(self.shingles) - 1)
        hit = self.shingles[place] == shingles
        at, place = at[hit], place[hit]
        if len(at) * DENOMINATOR < NUMERATOR * self.sizes[0]:
            return []
        # the text around each run of anchors that are at most the longest item apart is judged by itself
        found: dict[int, tuple] = {}
        for run in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > self.sizes[-1]) + 1):
            if len(run) * DENOMINATOR >= NUMERATOR * self.sizes[0]:
                self.around(words, at[run], place[run], width, found)
        return [{"item_id": self.ids[i], "similarity": n / d, "first_word": lo, "last_word": hi + width - 2} for i, (n, d, lo, hi) in sorted(found.items())]

    def around(self, words: list[bytes], at: np.ndarray, place: np.ndarray, width: int, found: dict[int, tuple]) -> None:
        """Judge the windows that hold anchors ``at``, which are the shingles ``place`` of the benchmark."""
        last_shingle = len(words) - width + 1
        first, last = max(0, int(at[0]) - self.sizes[-1]), min(last_shingle, int(at[-1]) + self.sizes[-1] + 1)
        n = last - first
        member = np.full(n, -1, np.int64)
        member[at - first] = place
        upto = np.r_[0, np.cumsum(member >= 0)]
        own = values = None
        for size in self.sizes:
            # the ends of the text cut windows off to any length up to the longest
            cut = size == self.sizes[-1]
            start = np.arange(1 - size if cut and first == 0 else 0, n if cut and last == last_shingle else n - size + 1)
            lo, hi = np.maximum(start, 0), np.minimum(start + size, n)
            keep = (upto[hi] - upto[lo]) * DENOMINATOR >= NUMERATOR * (hi - lo)
            start, lo, hi = start[keep], lo[keep], hi[keep]
            if not len(start):
                continue
            if own is None:
                own = shingle_hashes(WordHashes().of(words[first : last - 1 + width]), width)
                values = projections(own)
                # where no shingle comes twice, all weights are one and running sums serve windows of every size
                plain = np.vstack([np.zeros((1, BITS)), np.cumsum(values, 0)]) if len(np.unique(own)) == len(own) else None
            for part in np.split(np.arange(len(start)), np.flatnonzero(np.diff(start) > size) + 1):  # windows near each other
                if plain is not None:
                    sums = plain[hi[part]] - plain[lo[part]]
                else:
                    a, b = int(lo[part[0]]), int(hi[part[-1]])
                    sums = window_sums(values[a:b], own[a:b], size)[start[part] + size - 1 - a]
                for k in range(0, len(part), AT_ONCE):
                    self.compare(own, sums[k : k + AT_ONCE], member, lo[part[k : k + AT_ONCE]], hi[part[k : k + AT_ONCE]], first, found)

    def compare(self, own, sums, member, low, high, first: int, found: dict[int, tuple]) -> None:
        """Look windows up in the index and verify what it returns, the most promising first."""
        rows, items = self.index.search(fingerprints(sums))
        by = np.argsort(items, kind="stable")
        rows, items = rows[by], items[by]
        for part in np.split(np.arange(len(items)), np.flatnonzero(np.diff(items)) + 1):
            if not len(part):
                continue
            i, row = int(items[part[0]]), rows[part]
            bag = self.bags[i]
            inside = np.r_[0, np.cumsum(np.isin(member, self.places[i]))]
            lo, hi = low[row], high[row]
            most = inside[hi] - inside[lo]  # shares at most these
            bound = most / (hi - lo + bag.total() - most)
            for k in np.lexsort((hi, lo, -bound)):
                if bound[k] * DENOMINATOR < NUMERATOR - 1e-9:
                    break
                place = int(lo[k]) + first, int(hi[k]) + first
                if i in found:
                    best = found[i][0] / found[i][1]
                    if bound[k] < best:
                        break
                    if bound[k] == best and place > found[i][2:]:
                        continue
                n, d = similar(Counter(own[lo[k] : hi[k]].tolist()), bag)
                if n * DENOMINATOR < NUMERATOR * d:
                    continue
                ahead = n * found[i][1] - found[i][0] * d if i in found else 1
                if ahead > 0 or (ahead == 0 and place < found[i][2:]):
                    found[i] = (n, d, *place)


_HIT = pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())])
HITS = "array<struct<item_id: bigint, similarity: double, first_word: bigint, last_word: bigint>>"
_held: dict[str, Benchmark] = {}


def hits(text: Column, slices: list, sizes: list[int]) -> Column:
    """The items that each text contains; ``slices`` are broadcast lists of (id, text), ``sizes`` all items' shingles.

    One pass over the texts: each batch walks the slices, every other batch
    backwards, so that the indexes a worker holds serve the next batch first.
    """
    name = uuid.uuid4().hex

    def index(k: int) -> Benchmark:
        key = f"{name}-{k}"
        held = _held.pop(key, None) or Benchmark(slices[k].value, sizes)
        while len(_held) >= HELD:
            _held.pop(next(iter(_held)))
        _held[key] = held  # the one used last goes last
        return held

    @F.arrow_udf(HITS)
    def judge(texts: pa.Array) -> pa.Array:
        out: list[list] = [[] for _ in range(len(texts))]
        order = range(len(slices))
        for k in order if f"{name}-{len(slices) - 1}" not in _held else reversed(order):
            benchmark = index(k)
            for row, t in zip(out, texts, strict=True):
                row += benchmark.judge(t.as_py())
        return pa.array(out, pa.list_(_HIT))

    return judge(text)


def slices(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in pieces that a worker can hold, streamed through the driver."""
    now, chars = [], 0
    for item_id, text in benchmark.select(F.col("item_id").cast("bigint"), F.col("text")).where("text IS NOT NULL").toLocalIterator():
        if now and (len(now) >= SLICE or chars + len(text) > SLICE_CHARS):
            yield now
            now, chars = [], 0
        now.append((item_id, text))
        chars += len(text)
    if now:
        yield now


def scans(benchmark: DataFrame) -> tuple[list[list], list[int]]:
    """The broadcast slices of each scan of the documents, one unless the benchmark is beyond ``SCAN_CHARS``, and the sizes of all items."""
    context = benchmark.sparkSession.sparkContext
    out, chars, sizes = [[]], 0, set()
    for items in slices(benchmark):
        size = sum(len(text) for _, text in items)
        if out[-1] and chars + size > SCAN_CHARS:
            out.append([])
            chars = 0
        out[-1].append(context.broadcast(items))
        chars += size
        sizes.update(n - SHINGLE_WORDS + 1 for n in (len(byte_words(text)) for _, text in items) if n >= SHINGLE_WORDS)
    return out, sorted(sizes)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, last_word) for each item in a document."""
    doc_id, text = F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text")
    parts, sizes = scans(benchmark)
    found = [docs.select(doc_id, F.explode(hits(text, held, sizes)).alias("hit")).select("doc_id", "hit.*") for held in parts]
    return reduce(DataFrame.union, found)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that contain an item."""
    rows = packed(docs, F.col("text").alias("_text"))
    parts, sizes = scans(benchmark)
    for held in parts:
        rows = rows.where(F.size(hits(F.col("_text"), held, sizes)) == 0)
    return unpacked(rows)


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
#: The search in DuckDB's SQL: each window around an item's shingles, compared exactly.
ORACLE_SQL = f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS doc, doc_id, {_WORDS} AS w FROM documents),
items AS MATERIALIZED (SELECT row_number() OVER () AS item, item_id, {_WORDS} AS w FROM benchmark),
item_shingles AS (SELECT item, item_id, array_to_string(w[i:i + {SHINGLE_WORDS - 1}], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - {SHINGLE_WORDS - 2})) AS i FROM items WHERE len(w) >= {SHINGLE_WORDS})),
bags AS MATERIALIZED (SELECT item, item_id, s, count(*) AS c FROM item_shingles GROUP BY ALL),
totals AS MATERIALIZED (SELECT item, item_id, sum(c)::BIGINT AS total FROM bags GROUP BY ALL),
sizes AS MATERIALIZED (SELECT DISTINCT total AS size FROM totals),
longest AS (SELECT max(size) AS most FROM sizes),
doc_shingles AS (SELECT doc, n, i - 1 AS pos, array_to_string(w[i:i + {SHINGLE_WORDS - 1}], ' ') AS s FROM (SELECT *, len(w) - {SHINGLE_WORDS - 1} AS n, unnest(range(1, len(w) - {SHINGLE_WORDS - 2})) AS i FROM docs WHERE len(w) >= {SHINGLE_WORDS})),
anchors AS MATERIALIZED (SELECT doc, n, item, item_id, pos, s, c FROM doc_shingles JOIN bags USING (s)),
counted AS (SELECT doc, n, item, c, count(*) AS found, min(pos) AS low, max(pos) AS high FROM anchors GROUP BY doc, n, item, s, c),
likely AS MATERIALIZED (
  SELECT doc, n, item, total, min(low) AS low, max(high) AS high FROM counted JOIN totals USING (item)
  GROUP BY doc, n, item, total HAVING {DENOMINATOR} * sum(least(found, c)) >= {NUMERATOR} * total),
spans AS (
  SELECT doc, item, total, lo, lo + size AS hi FROM (SELECT *, unnest(range(greatest(0, low - size + 1), least(n - size, high) + 1)) AS lo FROM likely, sizes)
  UNION SELECT doc, item, total, 0, hi FROM (SELECT *, unnest(range(1, least(n, most) + 1)) AS hi FROM likely, longest)
  UNION SELECT doc, item, total, lo, n FROM (SELECT *, unnest(range(greatest(0, n - most), n)) AS lo FROM likely, longest)),
fitting AS MATERIALIZED (SELECT * FROM spans WHERE {DENOMINATOR} * (hi - lo) >= {NUMERATOR} * total AND {NUMERATOR} * (hi - lo) <= {DENOMINATOR} * total),
met AS (SELECT f.doc, f.item, total, lo, hi, least(count(*), c) AS shared FROM fitting f JOIN anchors a ON a.doc = f.doc AND a.item = f.item AND a.pos >= lo AND a.pos < hi GROUP BY f.doc, f.item, total, lo, hi, s, c),
compared AS (SELECT doc, item, total, lo, hi, sum(shared)::BIGINT AS shared FROM met GROUP BY ALL),
best AS (
  SELECT doc, item, shared::DOUBLE / (hi - lo + total - shared) AS similarity, lo AS first_word, hi + {SHINGLE_WORDS - 2} AS last_word FROM compared
  WHERE {DENOMINATOR} * shared >= {NUMERATOR} * (hi - lo + total - shared)
  QUALIFY row_number() OVER (PARTITION BY doc, item ORDER BY shared::DOUBLE / (hi - lo + total - shared) DESC, lo, hi) = 1),
short AS (
  SELECT doc, item, 1.0::DOUBLE AS similarity, min(i) - 1 AS first_word, min(i) - 2 + k AS last_word
  FROM (SELECT doc, w, unnest(range(1, len(w) + 1)) AS i FROM docs WHERE EXISTS (FROM items WHERE len(w) BETWEEN 1 AND {SHINGLE_WORDS - 1})) d
  JOIN (SELECT item, len(w) AS k, w AS words FROM items WHERE len(w) BETWEEN 1 AND {SHINGLE_WORDS - 1}) t ON d.w[i:i + k - 1] = words GROUP BY doc, item, k)
SELECT doc_id, item_id, similarity, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word
FROM (FROM best UNION ALL FROM short) JOIN docs USING (doc) JOIN items USING (item)
"""
