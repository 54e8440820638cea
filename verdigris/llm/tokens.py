"""Token counts by rank-synchronous array merging.

The counts are those of a sentencepiece BPE model, without running its
encoder. A pre-token is a run of word marks with the characters up to the
next mark; no piece of the vocabulary crosses that boundary (checked when the
model is loaded), so pre-tokens merge apart from each other. The distinct
pre-tokens of a batch are held as one flat array of symbols with offsets; in
each round every sequence that still can applies its pair of lowest rank
wherever it occurs, from left to right, and all sequences do so at once. An
occurrence whose merged symbol makes a pair of as low a rank with a neighbour
is the sequence's last one in its round, as the library would go on with that
pair. The symbols that survive are counted; a character outside the
vocabulary counts its UTF-8 bytes. A sequence of more than ``LONG`` symbols,
such as a text of one endless word, goes the same way, but its places wait in
lists by rank, so that a round touches only the places that it merges and
their neighbours.

The model must take texts as they are: one whose normaliser changes them is
refused when it is loaded.

Defined results: null counts as the empty text; an empty text has no tokens;
control strings inside a text are ordinary text, as is the library's default.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.llm.common import packed, unpacked

MARK = "▁"
#: Symbols that are merged at once; a longer sequence is a batch of its own.
AT_ONCE = 1 << 21
#: Distinct pre-tokens whose counts a worker remembers before it starts anew.
REMEMBERED = 300_000
NONE = np.int64(1) << np.int64(30)
#: Symbols from which a sequence is merged by lists of its places.
LONG = 4096
#: Texts that the usual normalisers change.
PROBES = ("ﬁne ＡＢ①", "e\u0301 \u00c5\u212b", "a  b   c ", "  lead", "x\ty\r\nz\u00a0w", "ABC Straße İ", "\u200bq\u00adr", "a\u0000b")


class PieceModel:
    """The vocabulary of a sentencepiece BPE model as arrays of mergeable pairs."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        plain = [i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        pieces = {m.id_to_piece(i): m.get_score(i) for i in plain}
        if any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in pieces):
            raise ValueError("pieces cross the boundary of pre-tokens")
        rank = {s: r for r, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        self.symbol = {p: k for k, p in enumerate(pieces)}
        self.known = len(pieces)
        for p in pieces:  # characters that are no piece themselves can still merge
            for c in p:
                self.symbol.setdefault(c, len(self.symbol))
        self.base = np.int64(len(self.symbol) + 1)
        pairs = {}
        for p, score in pieces.items():
            for k in range(1, len(p)):
                a, b = self.symbol.get(p[:k]), self.symbol.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * int(self.base) + b] = (rank[score], self.symbol[p])
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in sorted(pairs)], np.int64)
        self.into = np.array([pairs[k][1] for k in sorted(pairs)], np.int64)
        self.other = len(self.symbol)  # any other character
        self.library = m
        #: Bytes beyond one of each symbol that is no piece: what a merge takes off its count.
        self.surplus = np.zeros(len(self.symbol) + 1, np.int64)
        for c, k in self.symbol.items():
            if k >= self.known:
                self.surplus[k] = len(c.encode("utf-8")) - 1

    def ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of merging each pair; NONE where the pair doesn't merge."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), self.into[at]

    def counts(self, sequences: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        out = np.zeros(len(sequences), np.int64)
        at = 0
        while at < len(sequences):  # bounds the arrays
            size, to = 0, at
            while to < len(sequences) and (to == at or size + len(sequences[to]) <= AT_ONCE):
                size += len(sequences[to])
                to += 1
            short = [k for k in range(at, to) if len(sequences[k]) <= LONG]
            out[short] = self.merged([sequences[k] for k in short])
            for k in range(at, to):
                if len(sequences[k]) > LONG:
                    out[k] = self.merged_long(sequences[k])
            at = to
        return out

    def merged(self, sequences: list[str]) -> np.ndarray:
        """Tokens of each sequence, all merged round by round together."""
        if not sequences:
            return np.zeros(0, np.int64)
        lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
        get, other = self.symbol.get, self.other
        flat = "".join(sequences)
        sym = np.fromiter((get(c, other) for c in flat), np.int64, len(flat))
        total = lengths.copy()
        seq = np.repeat(np.arange(len(sequences)), lengths)
        if (odd := np.flatnonzero(sym >= self.known)).size:  # bytes beyond one for each unknown character
            extra = np.fromiter((len(flat[i].encode("utf-8", "surrogatepass")) - 1 for i in odd), np.int64, odd.size)
            np.add.at(total, seq[odd], extra)
        rank, into = self.ranked(sym[:-1], sym[1:])
        rank, into = np.append(rank, NONE), np.append(into, 0)
        rank[:-1][seq[:-1] != seq[1:]] = NONE
        while sym.size:
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            best, sizes = np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, sym.size])
            live = best < NONE
            if not live.all():  # finished sequences leave
                stay = np.repeat(live, sizes)
                sym, seq, rank, into = sym[stay], seq[stay], rank[stay], into[stay]
                if not sym.size:
                    break
                best, sizes = best[live], sizes[live]
            at = np.flatnonzero(rank == np.repeat(best, sizes))
            if at.size > 1:
                at = self.chosen(at, sym, seq, rank, into)
            # unknown characters never merge, so a merge always takes one symbol away; characters that
            # counted by their bytes and merge after all lose the surplus
            lost = 1 + self.surplus[sym[at]] + self.surplus[sym[at + 1]]
            np.subtract.at(total, seq[at], lost)
            sym[at] = into[at]
            stay = np.ones(sym.size, bool)
            stay[at + 1] = False
            at = at - np.arange(at.size)  # each merge before took one symbol away
            sym, seq, rank, into = sym[stay], seq[stay], rank[stay], into[stay]
            for i in (at, at[at > 0] - 1):
                i = i[i < sym.size - 1]
                rank[i], into[i] = self.ranked(sym[i], sym[i + 1])
                rank[i[seq[i] != seq[i + 1]]] = NONE
            rank[-1] = NONE
        return total

    def merged_long(self, sequence: str) -> int:
        """Tokens of one sequence; its symbols are linked, its places wait in lists by rank."""
        get, other = self.symbol.get, self.other
        sym = np.fromiter((get(c, other) for c in sequence), np.int64, len(sequence))
        n = sym.size
        total = n + sum(len(sequence[i].encode("utf-8", "surrogatepass")) - 1 for i in np.flatnonzero(sym >= self.known))
        rank, into = np.full(n, NONE), np.zeros(n, np.int64)
        after, before = np.minimum(np.arange(1, n + 2), n), np.arange(-1, n)  # n: none
        heap: list[int] = []
        waiting: dict[int, list[np.ndarray]] = {}

        def wait(places: np.ndarray) -> None:
            places = places[rank[places] < NONE]
            places = places[np.argsort(rank[places], kind="stable")]
            for part in np.split(places, np.flatnonzero(np.diff(rank[places])) + 1) if places.size else ():
                low = int(rank[part[0]])
                if low not in waiting:
                    waiting[low] = []
                    heapq.heappush(heap, low)
                waiting[low].append(part)

        def look(places: np.ndarray) -> None:
            rank[places] = NONE
            places = places[after[places] < n]
            rank[places], into[places] = self.ranked(sym[places], sym[after[places]])
            wait(places)

        look(np.arange(n))
        while heap:
            low = heapq.heappop(heap)
            there = np.unique(np.concatenate(waiting.pop(low)))
            there = there[rank[there] == low]  # others have gone or changed
            if not there.size:
                continue
            at = self.chosen_linked(there, sym, into, low, after, before)
            right = after[at]
            total -= int((1 + self.surplus[sym[at]] + self.surplus[sym[right]]).sum())
            sym[at], rank[right] = into[at], NONE
            after[at] = after[right]
            before[after[at]] = at
            left = before[at]
            look(np.unique(np.r_[at, left[left >= 0]]))
            wait(there[there > at[-1]])
        return total

    def chosen_linked(self, at: np.ndarray, sym: np.ndarray, into: np.ndarray, low: int, after: np.ndarray, before: np.ndarray) -> np.ndarray:
        """As ``chosen``, for the places of one linked sequence."""
        touching = after[at[:-1]] == at[1:]
        if touching.any():
            run = np.maximum.accumulate(np.where(np.r_[True, ~touching], np.arange(at.size), 0))
            at = at[(np.arange(at.size) - run) % 2 == 0]
        n, new = sym.size, into[at]
        beside = after[after[at]]
        right, _ = self.ranked(new, sym[np.minimum(beside, n - 1)])
        stops = (beside < n) & (right <= low)
        beside = before[at]
        left = np.where(np.r_[False, after[after[at[:-1]]] == at[1:]], np.r_[0, new[:-1]], sym[np.maximum(beside, 0)])
        there, _ = self.ranked(left, new)
        stops |= (beside >= 0) & (there <= low)
        return at[: int(np.argmax(stops)) + 1] if stops.any() else at

    def chosen(self, at: np.ndarray, sym: np.ndarray, seq: np.ndarray, rank: np.ndarray, into: np.ndarray) -> np.ndarray:
        """Of the places of each sequence's lowest rank those that are merged in this round."""
        if (np.diff(at) == 1).any():  # of places that overlap every second one, from the left
            run = np.maximum.accumulate(np.where(np.r_[True, np.diff(at) != 1], np.arange(at.size), 0))
            at = at[(np.arange(at.size) - run) % 2 == 0]
        new, low, own = into[at], rank[at], seq[at]
        beside = np.minimum(at + 2, sym.size - 1)
        right, _ = self.ranked(new, sym[beside])
        stops = (at + 2 < sym.size) & (seq[beside] == own) & (right <= low)
        beside = np.maximum(at - 1, 0)
        left = sym[beside]
        close = np.r_[False, np.diff(at) == 2]  # the neighbour is itself merged just before
        left = np.where(close, np.r_[0, new[:-1]], left)
        there, _ = self.ranked(left, new)
        stops |= (at > 0) & (seq[beside] == own) & (there <= low)
        if not stops.any():
            return at
        # places after a sequence's first stop wait for a later round
        before = np.cumsum(stops) - stops
        first = np.flatnonzero(np.r_[True, np.diff(own) != 0])
        base = np.repeat(before[first], np.diff(np.r_[first, at.size]))
        return at[before == base]


_RUNS = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")


def pre_tokens(text: str) -> list[str]:
    """The text with its leading mark, cut where no piece can cross."""
    if not text:
        return []
    t = MARK + text.replace(" ", MARK)
    if MARK + MARK in t:
        return _RUNS.findall(t)
    return [w for w in t.replace("\n", " \n ").replace(MARK, " " + MARK).split(" ") if w]


class Counter:
    """Counts texts in batches; remembers the counts of pre-tokens it has met."""

    def __init__(self, path: str):
        self.model, self.known = PieceModel(path), {}
        own, theirs = self(list(PROBES)), [len(ids) for ids in self.model.library.encode(list(PROBES))]
        if own != theirs:
            raise ValueError(f"the model at {path} changes texts before it cuts them: {dict(zip(PROBES, zip(own, theirs, strict=True), strict=True))}")

    def __call__(self, texts: list[str]) -> list[int]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        out: list[int] = []
        at = 0
        while at < len(texts):  # a slice of about 8 million characters at a time
            size, to = 0, at
            while to < len(texts) and (to == at or size < 8_000_000):
                size += len(texts[to])
                to += 1
            parts = [pre_tokens(t) for t in texts[at:to]]
            fresh = list({w for p in parts for w in p if w not in known})
            known.update(zip(fresh, self.model.counts(fresh).tolist(), strict=True))
            out += [sum(map(known.__getitem__, p)) for p in parts]
            at = to
        return out


@lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(path)


def token_count(text: Column, path: str) -> Column:
    """Number of tokens of each text under the model file at ``path``, which every executor has."""

    @F.pandas_udf(T.LongType())
    def count(batch: pd.Series) -> pd.Series:
        return pd.Series(_counter(path)(batch.tolist()), dtype="int64")

    return count(F.coalesce(text, F.lit("")))


def count_tokens(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """The columns of ``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit``."""
    rows = packed(docs, F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("bigint").alias("_bytes"), token_count(F.col("text"), path).alias("_tokens"))
    return unpacked(rows, F.col("_bytes").alias("n_bytes"), F.col("_tokens").alias("n_tokens"), (F.col("_tokens") > limit).alias("over_limit"), replacing=("n_bytes", "n_tokens", "over_limit"))
