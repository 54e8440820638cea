"""Subword tokens: longest-match segmentation of words over a given vocabulary of pieces.

A piece vocabulary is a table (piece, id); nothing is trained here. The pieces
form a trie that is kept as one sorted array of (node, character) keys, and all
distinct words of a batch walk it together, a character a step, by binary
search. A word is cut from left to right, each time by the longest piece that
fits; a character that no piece has is unknown (``UNKNOWN``).

A token is ``2 * id`` at the beginning of a word and ``2 * id + 1`` inside one,
so ids can be joined to the words again exactly (``joined``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.operators.vocabulary import vocabulary
from verdigris.sources.storage import stored

UNKNOWN = -1
_SHIFT = 21  # bits of a character
#: Words of a corpus that serve as pieces besides the characters; bounds what is sent to each worker.
WORDS = 5000


class PieceTrie:
    """Longest matches over ``pieces``, whose ids are their places."""

    def __init__(self, pieces: list[str]):
        child: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for k, piece in enumerate(pieces):
            node = 0
            for c in map(ord, piece):
                node = child.setdefault((node, c), len(child) + 1)
            if node:
                ends.setdefault(node, k)
        keys = np.array([(node << _SHIFT) | c for node, c in child], np.int64)
        order = np.argsort(keys)
        self._keys, self._nodes = keys[order], np.array(list(child.values()), np.int64)[order] if child else np.empty(0, np.int64)
        self._ends = np.full(len(child) + 1, UNKNOWN, np.int64)
        self._ends[list(ends)] = list(ends.values())

    def _longest(self, chars: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, length) of the longest piece at each place ``at``; UNKNOWN and 1 where none fits."""
        found, length = np.full(len(at), UNKNOWN, np.int64), np.ones(len(at), np.int64)
        alive, node, depth = np.arange(len(at)), np.zeros(len(at), np.int64), 0
        while len(self._keys):
            more = at[alive] + depth < end[alive]
            alive, node = alive[more], node[more]
            key = (node << _SHIFT) | chars[at[alive] + depth]
            k = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
            hit = self._keys[k] == key
            alive, node, depth = alive[hit], self._nodes[k[hit]], depth + 1
            if not len(alive):
                break
            whole = self._ends[node] != UNKNOWN
            found[alive[whole]], length[alive[whole]] = self._ends[node[whole]], depth
        return found, length

    def tokens(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all words in one array, and where each word's begin and the last one's end."""
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(sizes)
        at, live = end - sizes, np.flatnonzero(sizes)
        steps, inside = [], 0
        at, end = at[live], end[live]
        while len(live):
            found, length = self._longest(chars, at, end)
            steps.append((live, np.where(found == UNKNOWN, UNKNOWN, 2 * found + inside)))
            at, inside = at + length, 1
            goes = at < end
            live, at, end = live[goes], at[goes], end[goes]
        owner = np.concatenate([o for o, _ in steps]) if steps else np.empty(0, np.int64)
        value = np.concatenate([v for _, v in steps]) if steps else np.empty(0, np.int64)
        order = np.argsort(owner, kind="stable")  # steps are in order of places
        return value[order], np.r_[0, np.cumsum(np.bincount(owner, minlength=len(words)))]


def joined(tokens: list[int], pieces: list[str]) -> list[str]:
    """The words that known tokens stand for."""
    out: list[str] = []
    for t in tokens:
        if t % 2 == 0 or not out:
            out.append(pieces[t // 2])
        else:
            out[-1] += pieces[t // 2]
    return out


def corpus_pieces(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """(piece, id) of rows with ``words``: every single character and the most frequent words, counted over all texts, in the order of pieces.

    Characters make each word of the corpus segmentable; their number is
    bounded by Unicode, that of the words by ``words``.
    """
    frequent = vocabulary(texts).where(F.col("tok_id") < words).select(F.col("token").alias("piece"))
    characters = texts.select(F.explode("words").alias("w")).distinct().select(F.explode(F.split("w", "")).alias("piece")).where("piece <> ''").distinct()
    pieces = stored(frequent.union(characters).distinct(), "pieces")
    listed = sorted((r.piece for r in pieces.collect()), key=str.encode)  # bounded as said
    return texts.sparkSession.createDataFrame(list(zip(listed, range(len(listed)), strict=True)), "piece string, id int")


def segmented(texts: DataFrame, pieces: DataFrame, words: str = "words", name: str = "tokens") -> DataFrame:
    """``texts`` with the tokens of its array of words; null stays null, null words are empty ones.

    ``pieces`` is held by each worker whole, so it must be a bounded table.
    """
    listed = [r.piece for r in sorted(pieces.collect(), key=lambda r: r.id)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PieceTrie(listed)
        for batch in batches:
            column = batch.column(words)
            own = pc.fill_null(column.flatten(), "").dictionary_encode()
            tokens, begins = trie.tokens(own.dictionary.to_pylist())
            sizes = np.diff(begins)
            word = own.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            count = sizes[word]
            first = np.cumsum(count) - count
            flat = tokens[np.repeat(begins[:-1][word] - first, count) + np.arange(count.sum())]
            per = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.r_[0, np.cumsum(count)][np.r_[0, np.cumsum(per)]]
            made = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.int32)))
            made = pc.if_else(column.is_valid(), made, pa.scalar(None, made.type))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=schema.names)

    schema = T.StructType([*texts.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))])
    return texts.mapInArrow(run, schema)


#: What stands in place of the tokens of a text that failed.
_TRIED = "tokens array<string>, error string"


def tried(df: DataFrame, make: Callable[[], Callable[[list[str]], list[list]]], text: str) -> DataFrame:
    """``df`` with ``tokens`` of a tokenizer that may fail, and ``error``: of each row one is null.

    ``make`` loads the tokenizer, once per worker: a function from a list of
    texts to a list of tokens or ids each. Where a batch fails it is halved,
    down to the texts that fail by themselves, so each costs its own row only.
    A null text is the word ``nan``, as files hold it.
    """
    rows = df.withColumn("_text", F.coalesce(F.col(text).cast("string"), F.lit("nan")))

    def asked(tokenizer, texts: list[str]) -> list[tuple[list[str] | None, str | None]]:
        try:
            got = tokenizer(texts)
            if len(got) != len(texts):
                raise ValueError(f"{len(got)} answers to {len(texts)} texts")
            return [([str(t) for t in ts], None) for ts in got]
        except Exception as e:
            if len(texts) == 1:
                return [(None, f"{type(e).__name__}: {e}")]
            half = len(texts) // 2
            return asked(tokenizer, texts[:half]) + asked(tokenizer, texts[half:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = make()
        for batch in batches:
            found = asked(tokenizer, batch.column("_text").to_pylist()) if len(batch) else []
            more = pa.array([t for t, _ in found], pa.list_(pa.string())), pa.array([e for _, e in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.drop_columns(["_text"]).columns, *more], names=schema.names)

    schema = T.StructType([*df.schema.fields, *T.StructType.fromDDL(_TRIED).fields])
    return rows.mapInArrow(run, schema)
