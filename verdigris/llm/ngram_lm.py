"""Scores of an n-gram language model by a weighted backoff automaton.

The model is smoothed by Dirichlet priors: p(w | h) = (c(hw) + k p(w | h')) /
(c(h) + k), with h' the context one word shorter and add-one unigrams at the
bottom. As an automaton: a context seen in training is a state; a trained
n-gram is an arc that carries its log-probability; the failure arc to the
shorter context carries log k / (c(h) + k). A text is one traversal from left
to right that carries the state and adds up weights.

Nothing holds the whole model. The corpus is cut into blocks of about
``BLOCK`` characters. A worker reads a block's texts once and numbers its words; of a block so
numbered the distinct n-grams are found with their training counts, so a word
that makes up a third of the corpus is one row per block. Each block sends the
64-bit hashes of its n-grams, sorted and cut into hash buckets; a bucket's
worker adds the counts of equal n-grams over all blocks and sends each block
its totals back, in the order in which they came. So each block gets exactly
the part of the automaton that its own texts can reach, builds that and
traverses it. Messages are packed arrays: about six bytes for an n-gram on
the way there, one on the way back. Workers hold one block or one bucket.

There are as many buckets as hold ``BUCKET_BYTES`` each. A block sends at most
2 ** ``COARSE`` messages of each length all the same, or messages would grow with
the square of the corpus: where more buckets are needed, blocks send to coarse
ones, a worker for a coarse bucket and a group of blocks merges what they sent
and passes it on to the buckets inside, and takes their totals back to its
blocks.

Numbered blocks and totals are written to shared storage, and only there:
all later steps read the same blocks, whichever task runs again.

Defined results: null and empty texts consist of the end token alone; a null
doc_id counts as empty text for the split; repeated rows count each; with no
training text every probability is that of an empty model.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import WordHashes, byte_words, crc_mod, materialise, mixed

FOLDS, HELD_OUT = 7, 2
#: Words of an n-gram (1 to 3), and the weight of the shorter context.
ORDER, PRIOR = 2, 200.0  # chosen by ``tuning.language_models`` on training rows alone
#: Characters of text per block.
BLOCK = 4_000_000
#: Bytes of messages for a bucket, and for a group of blocks at a coarse one; what an n-gram takes in a message, about.
BUCKET_BYTES, GROUP_BYTES, GRAM_BYTES = 4 << 20, 64 << 20, 6
#: Bits of hash that tell the messages of a block apart; least bits, for small corpora.
COARSE, LEAST_BITS = 10, 3
#: No text holds this word; it stands for the end, and before the first word for the start.
END = b"\n"


def pack(a: np.ndarray) -> bytes:
    """Integers as compressed byte planes; sorted ones should come as differences."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T)
    return np.int64(planes.size).tobytes() + pa.compress(planes.tobytes(), "zstd", asbytes=True) if len(a) else b""


def unpack(data: bytes, kind: type) -> np.ndarray:
    if not data:
        return np.empty(0, kind)
    size = int(np.frombuffer(data[:8], np.int64)[0])
    planes = np.frombuffer(pa.decompress(data[8:], size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=a.dtype.type(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


class Block:
    """Texts as numbered words, and their distinct n-grams.

    ``grams[n]`` has, sorted by (context, word), a row for each distinct
    n-gram: the number of its context among the shorter grams, and its word.
    """

    def __init__(self, tokens: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, order: int):
        self.tokens, self.lengths, self.hashes = tokens, lengths, hashes
        v = np.int64(len(hashes))
        ends = np.cumsum(lengths)
        starts = ends - lengths
        self.starts = starts
        end = tokens[ends[0] - 1] if len(ends) else 0
        level = tokens.astype(np.int64)  # number of the gram that ends at each position
        self.contexts: list[np.ndarray] = [np.zeros(v, np.int64)]
        self.words: list[np.ndarray] = [np.arange(v, dtype=np.int64)]
        self.at: list[np.ndarray] = [level]
        self.hashed: list[np.ndarray] = [hashes]
        for n in range(2, order + 1):
            before = np.empty_like(level)
            before[1:] = level[:-1]
            # before a text stands the end token; longer contexts don't reach beyond it
            before[starts] = end if n == 2 else -1
            key = np.where(before >= 0, before * v + tokens, -1)
            grams, level = np.unique(key, return_inverse=True)
            if len(grams) and grams[0] < 0:
                grams, level = grams[1:], level - 1
            self.contexts.append(grams // v)
            self.words.append(grams % v)
            self.at.append(level)
            self.hashed.append(mixed(self.hashed[-1][grams // v] * np.uint64(0x9E3779B97F4A7C15) + hashes[grams % v] + np.uint64(n)))

    def counts(self, n: int, counted: np.ndarray) -> np.ndarray:
        """Occurrences of the n-grams at the positions where ``counted``."""
        at = self.at[n - 1]
        use = counted & (at >= 0)
        return np.bincount(at[use], minlength=len(self.words[n - 1])).astype(np.int64)


class Automaton:
    """The part of the model that a block reaches.

    A state is a trained context, numbered as in ``Block``; the root is -1.
    """

    def __init__(self, block: Block, counts: list[np.ndarray], total: int, distinct: int, prior: float):
        v = len(block.hashes)
        p = (counts[0] + 1.0) / (total + distinct + 1.0)
        self.base = np.log10(p)
        self.root = self.base.tolist()
        self.arcs: list[dict[int, float]] = []  # by length of context: state * v + word -> log-probability
        self.fail: list[list[float]] = []
        self.target: list[dict[int, int]] = []  # the state that such an arc leads to
        self.v, self.order = v, len(counts)
        lower = p
        for n in range(2, len(counts) + 1):
            context, word = block.contexts[n - 1], block.words[n - 1]
            seen = counts[n - 2][context].astype(float)
            shorter = lower[word] if n == 2 else self._shorter(block, n, lower)
            lower = (counts[n - 1] + prior * shorter) / (seen + prior)
            trained = np.flatnonzero(counts[n - 1] > 0)
            keys = (context[trained] * v + word[trained]).tolist()
            self.arcs.append(dict(zip(keys, np.log10(lower[trained]).tolist(), strict=True)))
            self.target.append(dict(zip(keys, trained.tolist(), strict=True)) if n < len(counts) else {})
            self.fail.append(np.log10(prior / (counts[n - 2] + prior)).tolist())

    @staticmethod
    def _shorter(block: Block, n: int, lower: np.ndarray) -> np.ndarray:
        """Probability of each n-gram's word after the context without its first word."""
        v = np.int64(len(block.hashes))
        context, word = block.contexts[n - 1], block.words[n - 1]
        suffix = block.words[n - 2][context]
        keys = block.contexts[1] * v + block.words[1]
        return lower[np.searchsorted(keys, suffix * v + word)]

    def walk(self, words: list[int], start: int) -> float:
        """Log-probability of a text given as words, the end token last."""
        if self.order == 1:
            return sum(map(self.root.__getitem__, words))
        if self.order > 2:
            return self._walk_long(words, start)
        arcs, fail, root, v = self.arcs[0].get, self.fail[0], self.root, self.v
        state, total = start, 0.0
        for w in words:
            weight = arcs(state * v + w)
            total += fail[state] + root[w] if weight is None else weight
            state = w  # an untrained word's failure arc weighs nothing, so its state is the root
        return total

    def _walk_long(self, words: list[int], start: int) -> float:
        states, total = [start], 0.0  # states[k]: the context of k + 1 words that is still alive
        for w in words:
            weight, below = None, 0.0
            for k in range(len(states) - 1, -1, -1):
                weight = self.arcs[k].get(states[k] * self.v + w)
                if weight is not None:
                    break
                below += self.fail[k][states[k]]
            total += below + (self.root[w] if weight is None else weight)
            longer = [w]
            for k in range(min(len(states), self.order - 2)):
                if (to := self.target[k].get(states[k] * self.v + w)) is None:
                    break
                longer.append(to)
            states = longer
        return total


_FOUND = "block string, n bigint, doc_id array<bigint>, known_id binary, held binary, lengths binary, tokens binary, hashes binary"
_SCHEMA = pa.schema([("block", pa.string()), ("n", pa.int64()), ("doc_id", pa.list_(pa.int64())), *((n, pa.binary()) for n in ("known_id", "held", "lengths", "tokens", "hashes"))])


class _Numbers(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word):
        value = self[word] = len(self)
        return value


def _blocks(limit: int):
    """Function over (doc_id, text, held_out): a row for each block of numbered texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes_of = WordHashes(limit=100_000)
        ids, held, lengths, tokens, numbers, size = [], [], [], [], _Numbers(), 0

        def emit():
            known = np.array([i is not None for i in ids], bool)
            row = {
                "block": uuid.uuid4().hex,
                "n": size,
                "doc_id": [0 if i is None else i for i in ids],
                "known_id": known.tobytes(),
                "held": np.array(held, bool).tobytes(),
                "lengths": pack(np.array(lengths, np.int64)),
                "tokens": pack(np.concatenate(tokens)),
                "hashes": hashes_of.of(list(numbers)).tobytes(),
            }
            return pa.RecordBatch.from_pylist([row], _SCHEMA)

        for batch in batches:
            for doc_id, text, out in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = byte_words(text.as_py())
                words.append(END)
                ids.append(doc_id)
                held.append(out)
                lengths.append(len(words))
                tokens.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
                size += len(words)
                if size * 6 >= limit or len(ids) >= 200_000:  # six bytes to a word, about
                    yield emit()
                    ids, held, lengths, tokens, numbers, size = [], [], [], [], _Numbers(), 0
        if ids:
            yield emit()

    return run


def _block(row: dict, order: int) -> Block:
    return Block(unpack(row["tokens"], np.uint32).astype(np.int64), unpack(row["lengths"], np.int64), np.frombuffer(row["hashes"], np.uint64), order)


_SENT = "block string, part int, bucket int, data binary, hashes binary"


def _frame(rows: list[tuple], ddl: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[f.split()[0] for f in ddl.split(", ")])


def _cut(h: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted hashes, without empty buckets."""
    cuts = np.searchsorted(h >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)).tolist()
    return [(b, i, j) for b, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if j > i]


def _sent(order: int, bits: int):
    """Function over blocks: their n-grams and training counts, a row for each part (length) and bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                block, out = _block(row, order), []
                counted = np.repeat(~np.frombuffer(row["held"], bool), block.lengths)
                for n in range(1, order + 1):
                    h, c = block.hashed[n - 1], block.counts(n, counted)
                    by = np.argsort(h)
                    h, c = h[by], c[by]
                    out += [(row["block"], n, b, pack(c[i:j]), pack_sorted(h[i:j])) for b, i, j in _cut(h, bits)]
                yield _frame(out, _SENT)

    return run


def _merged(rows: list[dict]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct hashes of messages, and for each message where its own are among them."""
    hashes = [unpack_sorted(r["hashes"]) for r in rows]
    distinct, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    return distinct, np.split(inverse, np.cumsum([len(h) for h in hashes])[:-1])


def _passed_on(bits: int):
    """Function over messages sorted by (part, bucket, grp): what a group of blocks sends to the finer buckets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (part, bucket, group), rows in _groups(batches, ("part", "bucket", "grp")):
            distinct, places = _merged(rows)
            total = np.zeros(len(distinct), np.int64)
            for r, at in zip(rows, places, strict=True):
                total[at] += unpack(r["data"], np.int64)
            yield _frame([(f"{group}/{bucket}", part, b, pack(total[i:j]), pack_sorted(distinct[i:j])) for b, i, j in _cut(distinct, bits)], _SENT)

    return run


_BACK = "block string, part int, bucket int, data binary"


def _taken_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over rows sorted by (part, bucket, grp, fine): a group's totals, then its blocks' messages; the totals of each block."""
    for (part, bucket, _), rows in _groups(batches, ("part", "bucket", "grp")):
        total = np.concatenate([unpack(r["data"], np.int64) for r in rows if r["fine"] >= 0])
        sent = [r for r in rows if r["fine"] < 0]
        _, places = _merged(sent)
        yield _frame([(r["block"], part, bucket, pack(total[at])) for r, at in zip(sent, places, strict=True)], _BACK)


_TOTALS = "block string, part int, bucket int, data binary, total bigint, distinct_words bigint"


def _totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over rows sorted by (part, bucket): the totals of each row's n-grams over all blocks."""
    for (part, bucket), rows in _groups(batches, ("part", "bucket")):
        distinct, places = _merged(rows)
        total = np.zeros(len(distinct), np.int64)
        for r, at in zip(rows, places, strict=True):
            total[at] += unpack(r["data"], np.int64)
        out = [(r["block"], part, bucket, pack(total[at]), 0, 0) for r, at in zip(rows, places, strict=True)]
        if part == 1:
            out[0] = (*out[0][:4], int(total.sum()), int((total > 0).sum()))
        yield _frame(out, _TOTALS)


def _groups(batches: Iterator[pd.DataFrame], keys: tuple[str, ...]) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of rows with equal keys, over all batches."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_dict("records"):
            key = tuple(row[k] for k in keys)
            if key != now and rows:
                yield now, rows
                rows = []
            now = key
            rows.append(row)
    if rows:
        yield now, rows


_SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, mean_score double"


def _scores(order: int, prior: float, total: int, distinct: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, rows in _groups(batches, ("block",)):
            first = next(r for r in rows if r["part"] == 0)
            block = _block(first, order)
            tokens, lengths = block.tokens, block.lengths
            counts = []
            for n in range(1, order + 1):
                by = np.argsort(block.hashed[n - 1])
                parts = sorted((r["bucket"], r["data"]) for r in rows if r["part"] == n)
                c = np.empty(len(by), np.int64)
                c[by] = np.concatenate([unpack(d, np.int64) for _, d in parts]) if parts else np.empty(0, np.int64)
                counts.append(c)
            model = Automaton(block, counts, total, distinct, prior)
            known = np.add.reduceat((counts[0] > 0)[tokens].astype(np.int64), block.starts)
            base = np.add.reduceat(model.base[tokens], block.starts)
            end = int(tokens[lengths[0] - 1])
            score = [model.walk(tokens[i : i + n].tolist(), end) for i, n in zip(block.starts.tolist(), lengths.tolist(), strict=True)]
            ids = pd.array(np.asarray(first["doc_id"], np.int64), "Int64")
            ids[~np.frombuffer(first["known_id"], bool)] = pd.NA
            yield pd.DataFrame(
                {"doc_id": ids, "held_out": np.frombuffer(first["held"], bool), "n_tokens": lengths, "n_known": known, "train_tokens": total, "base_score": base, "score": score, "mean_score": np.array(score) / lengths}
            )

    return run


def bucket_bits(tokens: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Bits of hash, so that a bucket's messages take about ``bucket_bytes``."""
    return max(LEAST_BITS, (-(-tokens * GRAM_BYTES // bucket_bytes) - 1).bit_length())


def _totalled(sent: DataFrame, order: int, bits: int) -> DataFrame:
    dealt = sent.repartition(order << bits, "part", "bucket").sortWithinPartitions("part", "bucket")
    return materialise(dealt.mapInPandas(_totals, _TOTALS), "lm-totals")


def _in_two_steps(sent: DataFrame, order: int, bits: int, coarse: int, groups: int) -> tuple[DataFrame, DataFrame]:
    """``_totalled`` over finer buckets than blocks send to: (totals for each block, totals for each group)."""
    sent = materialise(sent, "lm-sent").withColumn("grp", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    tasks = (order << coarse) * groups
    dealt = sent.repartition(tasks, "part", "bucket", "grp").sortWithinPartitions("part", "bucket", "grp", "block")
    totals = _totalled(dealt.mapInPandas(_passed_on(bits), _SENT), order, bits)
    named = F.split("block", "/")
    back = totals.select("part", named[1].cast("int").alias("bucket"), named[0].cast("int").alias("grp"), F.col("bucket").alias("fine"), "data")
    both = back.unionByName(sent.select("part", "bucket", "grp", F.lit(-1).alias("fine"), "block", "hashes"), allowMissingColumns=True)
    both = both.repartition(tasks, "part", "bucket", "grp").sortWithinPartitions("part", "bucket", "grp", "fine", "block")
    return materialise(both.mapInPandas(_taken_back, _BACK), "lm-back"), totals


def score(docs: DataFrame, order: int = ORDER, prior: float = PRIOR, block_chars: int = BLOCK, held_out: int = HELD_OUT, bucket_bytes: int = BUCKET_BYTES, coarse: int = COARSE) -> DataFrame:
    """Train on the rows of ``docs`` that aren't held out; score all.

    ``mean_score`` is the score of a token.
    """
    if order not in (1, 2, 3):
        raise ValueError("order must be 1, 2 or 3")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", (crc_mod(F.col("doc_id"), FOLDS) == held_out).alias("held_out"))
    blocks = materialise(rows.mapInArrow(_blocks(block_chars), _FOUND), "lm-blocks")
    n, tokens = blocks.agg(F.count("*"), F.sum("n")).first()
    bits = bucket_bits(tokens or 0, bucket_bytes)
    if bits <= coarse:
        totals = back = _totalled(blocks.mapInPandas(_sent(order, bits), _SENT), order, bits)
    else:
        groups = max(1, -(-tokens * GRAM_BYTES // (GROUP_BYTES << coarse)))
        back, totals = _in_two_steps(blocks.mapInPandas(_sent(order, coarse), _SENT), order, bits, coarse, groups)
    sums = totals.agg(F.sum("total"), F.sum("distinct_words")).first()
    texts = blocks.drop("n").select("*", F.lit(0).alias("part"), F.lit(-1).alias("bucket"), F.lit(None).cast("binary").alias("data"))
    both = texts.unionByName(back.select("block", "part", "bucket", "data"), allowMissingColumns=True)
    both = both.repartition(max(1, n), "block").sortWithinPartitions("block", "part", "bucket")
    return both.mapInPandas(_scores(order, prior, int(sums[0] or 0), int(sums[1] or 0)), _SCORES)


def crc32_sql(text: str) -> str:
    """crc32 of a string of ASCII characters in DuckDB's SQL, from the table ``crc_table(entries)``."""
    step = "xor(c >> 8, crc_table.entries[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: {step}), 4294967295::BIGINT)"


#: The table is made by its rule: eight steps of the reversed polynomial for each byte.
CRC_TABLE = """crc_table AS MATERIALIZED (SELECT list(entry ORDER BY byte) AS entries FROM (
  SELECT byte, list_reduce(list_concat([byte], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS entry FROM range(256) t(byte)))"""

#: Bigram scores in DuckDB's SQL; scores to six places.
ORACLE_SQL = f"""
WITH {CRC_TABLE},
docs AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text, CASE WHEN doc_id IS NULL THEN false ELSE {crc32_sql("doc_id::VARCHAR")} % {FOLDS} = {HELD_OUT} END AS held_out
  FROM documents, crc_table),
words AS (
  SELECT row_id, held_out, list_concat([chr(10)], list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> ''), [chr(10)]) AS w
  FROM docs),
tokens AS MATERIALIZED (SELECT row_id, held_out, w[i] AS before, w[i + 1] AS word FROM (SELECT row_id, held_out, w, unnest(range(1, len(w))) AS i FROM words)),
unigrams AS MATERIALIZED (SELECT word, sum((NOT held_out)::BIGINT)::BIGINT AS c FROM tokens GROUP BY word),
bigrams AS MATERIALIZED (SELECT before, word, sum((NOT held_out)::BIGINT)::BIGINT AS c FROM tokens GROUP BY before, word),
sizes AS (SELECT sum(c)::BIGINT AS n, count(*) FILTER (c > 0) AS v FROM unigrams),
base AS MATERIALIZED (SELECT word, c, (c + 1.0::DOUBLE) / (n + v + 1.0::DOUBLE) AS p FROM unigrams, sizes),
weights AS MATERIALIZED (
  SELECT b.before, b.word, log10((b.c + {PRIOR!r}::DOUBLE * w.p) / (h.c + {PRIOR!r}::DOUBLE)) AS weight, log10(w.p) AS base, w.c > 0 AS known
  FROM bigrams b JOIN base w USING (word) JOIN unigrams h ON h.word = b.before),
scored AS (
  SELECT row_id, count(*) AS n_tokens, sum(known::BIGINT)::BIGINT AS n_known, sum(base) AS base_score, sum(weight) AS score
  FROM tokens JOIN weights USING (before, word) GROUP BY row_id)
SELECT doc_id, held_out, n_tokens, n_known, n AS train_tokens, round(round(base_score, 9), 6) AS base_score, round(round(score, 9), 6) AS score, round(round(score / n_tokens, 9), 6) AS mean_score
FROM docs JOIN scored USING (row_id), sizes
"""
