"""Watermarked decoding by a language model, a step for all rows of a batch at once.

The model gives scores over its vocabulary for every row that still runs; the
bias adds delta to the scores of each row's green tokens, on arrays; a token is
drawn for each row; rows that are done leave the batch. What is drawn depends on
the row's own seed and step alone, so a row's text doesn't depend on which rows
it shares a batch with.

Tokens are drawn by the largest sum of score and noise, and noise takes two
logarithms. A bound that takes none leaves the few tokens that may have the
largest sum, and only their sums are made. What depends on the latest token
alone (its green list; its scores, if the model is one of pairs) is made once.
"""

from __future__ import annotations

import hashlib
import math
from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.config import Watermark
from verdigris.functions.permutation import permute
from verdigris.functions.scores import neighbours
from verdigris.operators import generation, vocabulary

#: Rows that are decoded together, so that rows times vocabulary stays small.
ROWS = 64
#: Green masks that are kept, one per token that came before.
MASKS = 4096
#: Bytes of scores that are kept, of models whose scores depend on the latest token alone.
SCORES = 64_000_000


class StepModel(Protocol):
    """A language model, loaded once per task. A token's id is its place in ``vocabulary``.

    A model that says ``of_pairs = True`` gives logits that depend on the latest
    token alone; it is asked for them once, not for each row and step.
    """

    vocabulary: Sequence[str]
    #: The id that ends a text, if there is one.
    end: int | None
    #: The id of words that the vocabulary lacks, if there is one; without it they are left out of prompts.
    unknown: int | None

    def begin(self, prompts: list[np.ndarray]) -> None:
        """A new batch: ids of each row's prompt, which may be empty. Rows are numbered from 0."""

    def step(self, rows: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Logits (rows, vocabulary) of what follows ``tokens``, the latest token of each of ``rows``."""


class Bias:
    """Adds delta to the logits of green tokens.

    ``exact``: the list of a token is the front (or the end) of the permutation
    of all ids that it seeds, of exactly int(gamma V) ids, as
    ``vocabulary.exact_green`` has it; otherwise the tokens whose keyed hash is
    below gamma, as the detector of words has it. Lists are masks, made once for
    each token that comes before and forgotten in the order of their use.
    """

    def __init__(self, mark: Watermark, vocabulary: Sequence[str], exact: bool = False):
        self.mark, self.vocabulary, self.exact = mark, vocabulary, exact
        self._encoded = [t.encode() for t in vocabulary]
        self._masks: OrderedDict[int, np.ndarray] = OrderedDict()

    def mask(self, token: int) -> np.ndarray:
        """Which tokens are green after ``token``."""
        if token in self._masks:
            self._masks.move_to_end(token)
            return self._masks[token]
        n, mark = len(self.vocabulary), self.mark
        if self.exact:
            place, length = permute(np.arange(n), n, f"{mark.hash_key}:{self.vocabulary[token]}"), int(n * mark.gamma)
            found = place < length if mark.select_green_tokens else place >= n - length
        else:
            start = hashlib.md5(f"{mark.hash_key}:{self.vocabulary[token]}:".encode())
            u = np.zeros(n, np.int64)
            for k, t in enumerate(self._encoded):
                h = start.copy()
                h.update(t)
                u[k] = int.from_bytes(h.digest()[:4])
            found = u < mark.gamma * 2**32 if mark.select_green_tokens else u >= (1 - mark.gamma) * 2**32
        self._masks[token] = found
        if len(self._masks) > MASKS:
            self._masks.popitem(last=False)
        return found

    def masks(self, tokens: np.ndarray) -> np.ndarray:
        """A row per token."""
        known, at = np.unique(tokens, return_inverse=True)
        return np.stack([self.mask(int(t)) for t in known])[at]

    def __call__(self, logits: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """The logits of each row, biased by the list of its latest token."""
        return logits + self.mark.delta * self.masks(tokens)


def _noise(seed: int, step: int, n: int) -> np.ndarray:
    """Gumbel noise of one row and step."""
    return _gumbel(np.random.Generator(np.random.Philox(key=np.array([seed, step], np.uint64))).random(n))


def _gumbel(u: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(np.maximum(u, 1e-300)))


class Scores:
    """Scores of what follows one row, and what bounds their sums with noise: exp(top - score)."""

    def __init__(self, scores: np.ndarray, temperature: float):
        self.of = scores / temperature if temperature else scores
        self.best = int(self.of.argmax())
        with np.errstate(over="ignore"):
            self.weights = np.exp(self.of[self.best] - self.of) if temperature and np.isfinite(self.of[self.best]) else None


class Draws:
    """The token of largest score + ``_noise``, the first among equals."""

    def __init__(self, n: int):
        self._bits = np.random.Philox(key=np.zeros(2, np.uint64))
        self._begin = self._bits.state
        self._key = self._begin["state"]["key"]
        self._random = np.random.Generator(self._bits).random
        self._u, self._least = np.empty(n), np.empty(n)

    def __call__(self, scores: Scores, seed: int, step: int) -> int:
        self._key[:] = seed, step
        self._bits.state = self._begin
        u, least = self._u, self._least
        self._random(out=u)
        if scores.weights is None:
            return int((scores.of + _gumbel(u)).argmax())
        # the largest score - log(-log u) has the smallest -log(u) * weight, which is never below (1 - u) * weight
        np.subtract(1.0, u, out=least)
        np.multiply(least, scores.weights, out=least)
        at = int(least.argmin())
        bound = -math.log(max(u[at], 1e-300)) * scores.weights[at]
        few = np.flatnonzero(least <= bound * (1 + 1e-9))
        return int(few[(scores.of[few] + _gumbel(u[few])).argmax()])


class Asked:
    """The biased scores of each row, those of a model of pairs kept by the latest token."""

    def __init__(self, model: StepModel, bias: Callable[[np.ndarray, np.ndarray], np.ndarray] | None, temperature: float):
        self.model, self.bias, self.temperature = model, bias, temperature
        self._most = SCORES // (16 * len(model.vocabulary)) if getattr(model, "of_pairs", False) else 0
        self._kept: OrderedDict[int, Scores] = OrderedDict()

    def _made(self, rows: np.ndarray, tokens: np.ndarray) -> list[Scores]:
        scores = np.asarray(self.model.step(rows, tokens), np.float64)
        if self.bias is not None:
            scores = self.bias(scores, tokens)
        return [Scores(s, self.temperature) for s in scores]

    def __call__(self, rows: np.ndarray, tokens: np.ndarray) -> list[Scores]:
        if not self._most:
            return self._made(rows, tokens)
        known, first = np.unique(tokens, return_index=True)
        new = np.array([k for k, t in enumerate(known.tolist()) if t not in self._kept], np.int64)
        if len(new):
            self._kept |= zip(known[new].tolist(), self._made(rows[first[new]], known[new]), strict=True)
        found = [self._kept[t] for t in tokens.tolist()]
        for t in known.tolist():
            self._kept.move_to_end(t)
        while len(self._kept) > self._most:
            self._kept.popitem(last=False)
        return found


def decode(model: StepModel, prompts: list[np.ndarray], length: int, bias: Callable[[np.ndarray, np.ndarray], np.ndarray] | None, seeds: list[int], temperature: float = 1.0, asked: Asked | None = None) -> list[np.ndarray]:
    """What follows each prompt: at most ``length`` ids, up to but without the end.

    A prompt without tokens has nothing to follow. Temperature 0 takes the best
    token, the first among equals, and else tokens are drawn from the softmax.
    ``asked`` keeps scores from one batch to the next.
    """
    out = np.zeros((len(prompts), max(length, 0)), np.int64)
    sizes = np.zeros(len(prompts), np.int64)
    live = np.array([k for k, p in enumerate(prompts) if len(p)] if length > 0 else [], np.int64)
    if not len(live):
        return [out[k, :0] for k in range(len(prompts))]
    model.begin(prompts)
    last = np.array([prompts[k][-1] for k in live], np.int64)
    asked, draw = asked or Asked(model, bias, temperature), None
    for step in range(length):
        scores = asked(live, last)
        draw = draw or Draws(len(scores[0].of))
        pick = np.array([draw(s, seeds[k], step) if temperature else s.best for s, k in zip(scores, live.tolist(), strict=True)], np.int64)
        goes_on = pick != model.end if model.end is not None else np.ones(len(pick), bool)
        out[live[goes_on], step] = pick[goes_on]
        sizes[live[goes_on]] += 1
        live, last = live[goes_on], pick[goes_on]
        if not len(live):
            break
    return [out[k, : sizes[k]] for k in range(len(prompts))]


_BIAS: dict[tuple, Bias] = {}


def bias_of(mark: Watermark, vocabulary: Sequence[str], exact: bool = False) -> Bias:
    """A bias whose masks a worker keeps from task to task; that of the latest mark and vocabulary only."""
    key = mark, exact, tuple(vocabulary)
    if key not in _BIAS:
        _BIAS.clear()
        _BIAS[key] = Bias(mark, vocabulary, exact)
    return _BIAS[key]


def seed_of(key) -> int:
    """64 bits of a row's key."""
    return int.from_bytes(hashlib.md5(str(key).encode()).digest()[:8])


def decoded(prompts: DataFrame, make: Callable[[], StepModel], length: int, mark: Watermark, exact: bool = False, temperature: float = 1.0, key: str = "doc_id") -> DataFrame:
    """``prompts`` (key, words) continued by a model, in the columns of ``generation.generated``.

    A null prompt is an empty one and is continued by nothing. Detection in the
    result is by the hash predicate, over prompt and continuation together; with
    ``exact`` lists it shows chance, and ``vocabulary.exact_green`` detects.
    """
    rows = prompts.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.slice("words", F.lit(1), F.lit(generation.MOST_WORDS)), F.array().cast("array<string>")).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        ids = {t: k for k, t in enumerate(model.vocabulary)}
        asked = Asked(model, bias_of(mark, model.vocabulary, exact), temperature)
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                batch = whole.slice(at, ROWS)
                known = [[ids.get(w, model.unknown) for w in words] for words in batch.column("words").to_pylist()]
                begun = [np.array([i for i in row if i is not None], np.int64) for row in known]
                new = decode(model, begun, length, asked.bias, [seed_of(k) for k in batch.column("doc_id").to_pylist()], temperature, asked)
                texts = [[model.vocabulary[i] for i in row.tolist()] for row in new]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.list_(pa.string()))], names=["doc_id", "words", "new"])

    return generation.finished(rows.mapInArrow(run, "doc_id bigint, words array<string>, new array<string>"), mark)


class BigramModel:
    """Logits from counts of pairs: log of the share of followers, backed off to the words' own shares."""

    end = None
    of_pairs = True

    def __init__(self, vocabulary: list[str], shares: np.ndarray, follow: dict[int, tuple[np.ndarray, np.ndarray]], weight: float = 0.9):
        self.vocabulary, self.follow, self.weight = vocabulary, follow, weight
        self.unknown = None
        self.shares = shares / shares.sum()

    def begin(self, prompts: list[np.ndarray]) -> None:
        pass

    def step(self, rows: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        p = np.tile(self.shares, (len(tokens), 1))
        for k, t in enumerate(tokens.tolist()):
            if t in self.follow:
                p[k] *= 1 - self.weight
                ids, share = self.follow[t]
                p[k, ids] += self.weight * share
        return np.log(p)


def corpus_model(texts: DataFrame, words: int = 2000, followers: int = 50) -> BigramModel:
    """A model of a corpus (rows with ``words``) for decoding without a model file.

    Counts go over all texts; the model knows the ``words`` most frequent words
    and of each the ``followers`` most frequent ones after it, which bounds what
    the driver and the workers hold, whatever the corpus.
    """
    if words < 1 or followers < 1:
        raise ValueError("a model knows a word and a follower at least")
    counts = vocabulary.counted(texts).orderBy(F.col("n").desc(), "token").limit(words)
    listed = [(i, r.token, r.n) for i, r in enumerate(counts.collect())]  # at most ``words``
    if not listed:
        return BigramModel(["nothing"], np.ones(1), {})
    ids = texts.sparkSession.createDataFrame([(t, i) for i, t, _ in listed], "known string, id int")
    few = lambda c: F.broadcast(ids.select(F.col("known").alias(c), F.col("id").alias(f"{c}_id")))  # noqa: E731  at most ``words`` rows
    # pairs are counted as ids: what a task sends is bounded by the model, not by its texts
    met = texts.select(F.inline(neighbours(F.col("words")))).join(few("prev"), "prev").join(few("token"), "token")
    pairs = met.groupBy(F.col("prev_id").alias("a"), F.col("token_id").alias("b")).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.col("n").desc(), "b"))  # at most ``words`` rows to a word
    follow: dict[int, list[tuple[int, int]]] = {}
    for r in pairs.select("a", "b", "n", place.alias("place")).where(F.col("place") <= followers).collect():  # words * followers at most
        follow.setdefault(r.a, []).append((r.b, r.n))
    shares = {a: (np.array([b for b, _ in sorted(f)]), np.array([n for _, n in sorted(f)]) / sum(n for _, n in f)) for a, f in follow.items()}
    return BigramModel([t for _, t, _ in listed], np.array([n for *_, n in listed], np.float64), shares)


def perplexity(model: StepModel, texts: list[np.ndarray]) -> float:
    """Of ids that follow each other, by the model's own scores; what a bias costs shows in it."""
    total = n = 0
    for k, ids in enumerate(texts):
        if len(ids) < 2:
            continue
        model.begin([ids[:1]])
        for a, b in zip(ids[:-1], ids[1:], strict=True):
            scores = np.asarray(model.step(np.array([0]), np.array([a])), np.float64)[0]
            top = scores.max()
            total += scores[b] - top - math.log(np.exp(scores - top).sum())
            n += 1
    return math.exp(-total / n) if n else 1.0
