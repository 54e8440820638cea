"""Vocabularies, token ids, green lists, bigrams and biased logits.

Green lists come in three forms. The hash predicate of ``functions.scores``
needs no vocabulary and gives lists of about gamma V tokens. ``exact_green``
gives lists of exactly int(gamma V) tokens by a keyed permutation of the token
ids: a pair costs the same few operations whatever the vocabulary, no list is
made and the number of contexts has no limit; ``exact_lists`` writes such lists
out. ``greenlists`` ranks a whole vocabulary by hash for stated contexts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from verdigris.config import Watermark
from verdigris.functions.permutation import permute_by, permuted
from verdigris.functions.scores import is_green, neighbours, uniform
from verdigris.operators.order import ranked
from verdigris.sources.storage import stored

#: Contexts for which exact lists are made at once; a stated query set against the vocabulary.
MOST_CONTEXTS = 100_000
#: Ranges of hash values by which a context's tokens are counted.
RANGES = 1024
#: Places of an exact list that are turned back at once, and places to a task, in MOST_PARTS tasks at most (then each has more).
BLOCK, PART, MOST_PARTS = 1 << 14, 1 << 18, 10_000


def counted(texts: DataFrame) -> DataFrame:
    """(token, n) of the ``words``."""
    return texts.select(F.explode("words").alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def vocabulary(texts: DataFrame) -> DataFrame:
    """(token, n, tok_id) of the ``words``: ids from 0 by falling frequency, then by token."""
    return ranked(counted(texts), [F.col("n").desc(), F.col("token").asc()], "rank").select("token", "n", (F.col("rank") - 1).alias("tok_id"))


def token_ids(texts: DataFrame, vocab: DataFrame) -> DataFrame:
    """``texts`` as (doc_id, text_type, pos, tok_id).

    A word can be a large share of all tokens; the join is left to Catalyst,
    which broadcasts a small vocabulary and splits skewed keys otherwise.
    """
    rows = texts.select("doc_id", "text_type", F.posexplode("words").alias("pos", "token"))
    return rows.join(vocab.select("token", "tok_id"), "token").select("doc_id", "text_type", "pos", "tok_id")


def greenlists(contexts: DataFrame, vocab: DataFrame, mark: Watermark) -> DataFrame:
    """(prev, token) of the exact lists: for each context the ``int(gamma V)`` tokens of least keyed hash.

    With ``select_green_tokens`` false the last ones. Each vocabulary row meets
    the stated contexts; tokens are counted by ranges of hash values, which
    shows the range in which a context's list ends, and only that range's
    tokens are sorted. So a vocabulary of any size is spread over all tasks.
    """
    n = vocab.count()
    names = [r.prev for r in contexts.select("prev").where("prev IS NOT NULL").distinct().limit(MOST_CONTEXTS + 1).collect()]
    if len(names) > MOST_CONTEXTS:
        raise ValueError(f"more than {MOST_CONTEXTS} contexts; use exact_green or exact_lists, which have no such limit")
    if not n or not names:
        return vocab.select(F.col("token").alias("prev"), "token").limit(0)
    size = int(n * mark.gamma)
    first = size if mark.select_green_tokens else n - size  # tokens of least hash that are, or are not, on a list
    u = uniform(F.lit(mark.hash_key), F.col("prev"), F.col("token"))
    pairs = vocab.select("token", F.explode(F.lit(sorted(names))).alias("prev")).withColumn("u", u).withColumn("range", F.floor(F.col("u") * RANGES).cast("int"))
    counts = pairs.groupBy("prev", "range").agg(F.count("*").alias("k"))  # at most RANGES rows to a context
    upto = F.sum("k").over(Window.partitionBy("prev").orderBy("range"))
    ends = counts.withColumn("upto", upto).where((F.col("upto") >= first) & (F.col("upto") - F.col("k") < first))
    ends = ends.select(F.col("prev").alias("p"), F.col("range").alias("last"), (first - F.col("upto") + F.col("k")).alias("left"))
    rows = pairs.join(F.broadcast(ends), F.col("prev") == F.col("p"), "left")  # a row per context
    inside = rows.where(F.col("range") == F.col("last")).withColumn("at", F.row_number().over(Window.partitionBy("prev").orderBy("u", "token")))
    low = rows.where(F.col("range") < F.col("last")).select("prev", "token", F.lit(True).alias("low"))
    high = rows.where((F.col("range") > F.col("last")) | F.col("last").isNull()).select("prev", "token", F.lit(False).alias("low"))
    both = low.union(high).union(inside.select("prev", "token", (F.col("at") <= F.col("left")).alias("low")))
    return both.where("low" if mark.select_green_tokens else "NOT low").select("prev", "token")


def _seed(prev: Column, mark: Watermark) -> Column:
    return F.concat(F.lit(f"{mark.hash_key}:"), prev.cast("string"))


def exact_place(prev: Column, tok_id: Column, size: int, mark: Watermark) -> Column:
    """Where the context's permutation sends a token of a vocabulary of ``size``."""
    return permuted(tok_id, size, _seed(prev, mark))


def on_list(place: Column, size: int, mark: Watermark) -> Column:
    """Whether a place in a permutation is on the list: at the front, or without ``select_green_tokens`` at the end."""
    length = int(size * mark.gamma)
    return place < length if mark.select_green_tokens else place >= size - length


def exact_green(prev: Column, tok_id: Column, size: int, mark: Watermark) -> Column:
    """Whether a token is among the context's exactly ``int(gamma size)`` green ones; null for a null context or an unknown token."""
    return on_list(exact_place(prev, tok_id, size, mark), size, mark)


def exact_lists(contexts: DataFrame, vocab: DataFrame, mark: Watermark) -> DataFrame:
    """(prev, token): the exact list of each distinct, not null ``prev`` of ``contexts``, written out.

    The places on a list are turned back into token ids, so a context costs as
    much as its list is long, and only that is joined with the vocabulary. A
    list is dealt to the tasks in blocks of places, which the task that has a
    block counts out; the plan and the driver hold no place. Spark takes the
    rows that are made of blocks for as few as the blocks and would broadcast
    them, so the join is asked to merge.
    """
    size = vocab.count()
    length = int(size * mark.gamma)
    if not length:
        return vocab.select(F.col("token").alias("prev"), "token").limit(0)
    first = 0 if mark.select_green_tokens else size - length
    names = stored(contexts.select("prev").where("prev IS NOT NULL").distinct(), "contexts")
    parts = min(-(-names.count() * length // PART), MOST_PARTS)
    blocks = vocab.sparkSession.range(0, length, BLOCK).select((F.col("id") + first).alias("start"))
    rows = names.select("prev", F.md5(_seed(F.col("prev"), mark)).alias("digest")).crossJoin(blocks)
    listed = _listed(rows.repartition(max(parts, 1), "prev", "start"), size, first + length, BLOCK)
    return listed.hint("merge").join(vocab.select("tok_id", "token"), "tok_id").select("prev", "token")


def _listed(rows: DataFrame, size: int, end: int, block: int) -> DataFrame:
    """(prev, tok_id): which token the permutation of ``digest`` sends to each place from ``start`` on, ``block`` of them, before ``end``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prev, ids, n = [], [], 0
            for k, (digest, start) in enumerate(zip(batch.column("digest").to_pylist(), batch.column("start").to_pylist(), strict=True), 1):
                ids.append(permute_by(np.arange(start, min(start + block, end)), size, digest, backwards=True))
                prev.append(np.full(len(ids[-1]), k - 1))
                n += len(ids[-1])
                if n >= block or k == len(batch):  # short lists share a batch
                    yield pa.RecordBatch.from_arrays([batch.column("prev").take(pa.array(np.concatenate(prev))), pa.array(np.concatenate(ids))], names=["prev", "tok_id"])
                    prev, ids, n = [], [], 0

    return rows.mapInArrow(run, StructType([rows.schema["prev"], StructField("tok_id", LongType())]))


def bigrams(texts: DataFrame) -> DataFrame:
    """(doc_id, text_type, prev, token, n): how often each pair of neighbours occurs in a text.

    Of texts that are ``storage.dealt`` by doc_id no pair is shuffled.
    """
    rows = texts.select("doc_id", "text_type", F.explode(neighbours(F.col("words"))).alias("pair"))
    return rows.groupBy("doc_id", "text_type", F.col("pair.prev").alias("prev"), F.col("pair.token").alias("token")).agg(F.count("*").alias("n"))


def corpus_bigrams(texts: DataFrame) -> DataFrame:
    """(prev, token, n) over all texts, counted in each task before they are shuffled."""
    return texts.select(F.inline(neighbours(F.col("words")))).groupBy("prev", "token").agg(F.count("*").alias("n"))


def biased_logits(pairs: DataFrame, mark: Watermark) -> DataFrame:
    """(prev, token, logit, biased): log counts, and delta more on green tokens."""
    green = is_green(F.col("prev"), F.col("token"), mark.hash_key, mark.gamma, mark.select_green_tokens)
    logit = F.ln(F.col("n").cast("double"))
    return pairs.select("prev", "token", logit.alias("logit"), (logit + F.when(green, mark.delta).otherwise(0.0)).alias("biased"))
