"""Rounds of paraphrase, each over the one before; resuming; a stand-in without a model."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from verdigris.config import Paraphrase
from verdigris.functions import text as T
from verdigris.functions.digests import below as below_share, heads
from verdigris.functions.scores import below
from verdigris.sources.storage import exists, remaining, stored


class Paraphraser(Protocol):
    """A model, loaded once per worker: batches of (prompt, target, max_tokens) to answers."""

    def transform(self, batch: pd.DataFrame) -> pd.Series: ...


def stand_in(words: Column, doc_id: Column, text_type: Column, depth: int, rate: float) -> Column:
    """Words of the next round: each is replaced with probability ``rate``, by a keyed hash of its place."""

    def one(word: Column, pos: Column) -> Column:
        swap = below(rate, F.lit("p"), doc_id, text_type, pos, F.lit(depth))
        new = F.concat(F.lit("w"), F.substring(F.md5(F.concat_ws(":", F.lit("r"), doc_id.cast("string"), text_type, pos.cast("string"), F.lit(str(depth)))), 1, 4))
        return F.when(swap, new).otherwise(word)

    return F.transform(words, one)


#: Words of texts whose rounds are made at once.
AT_ONCE = 250_000
#: Words that the stand-in can put in a word's place: one for each beginning of a digest.
_NEW = pa.array([f"w{k:04x}" for k in range(2**16)])
_NAME, _WORDS = "_name", "_words"


class Rounds:
    """The stand-in's rounds of several texts, in arrays: ``stand_in`` for all their words at once.

    ``words`` has every word that occurs; a text's words at a depth are places
    in it. ``begins`` says where each text begins and the last one ends. After
    ``each`` gives a depth, ``at`` are the places and ``changed`` the words that
    this round replaced.
    """

    def __init__(self, names: pa.Array, texts: pa.Array, settings: Paraphrase):
        texts = texts.cast(pa.large_list(pa.string()))
        self.settings = settings
        self.none = texts.is_null()
        self.begins = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False))].astype(np.int64)
        sizes = np.diff(self.begins)
        row = np.repeat(np.arange(len(texts)), sizes)
        self.place = np.arange(self.begins[-1]) - self.begins[row]
        known = texts.flatten().dictionary_encode(null_encoding="encode")
        self.known = len(known.dictionary)
        self.words = pa.concat_arrays([known.dictionary, _NEW])
        self.at = known.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.stems = pc.binary_join_element_wise(names.take(pa.array(row)), pa.array(self.place).cast(pa.string()), "", ":")  # name:place:

    def each(self) -> Iterator[int]:
        """The depths from 0, the originals, to the last round."""
        tails = tuple(str(k).encode() for k in range(1, self.settings.iterations + 1))
        swaps = [below_share(self.settings.rate, h) for h in heads(pc.binary_join_element_wise("p", self.stems, ":"), tails)]
        self.changed = np.ones(len(self.at), bool)
        yield 0
        for depth, tail, swap in zip(range(1, len(tails) + 1), tails, swaps, strict=True):
            here = np.flatnonzero(swap)
            self.at, self.changed = self.at.copy(), swap
            self.at[here] = self.known + (heads(pc.binary_join_element_wise("r", self.stems.take(pa.array(here)), ":"), (tail,))[0] >> 16)
            yield depth

    def lists(self) -> pa.Array:
        """The texts' words at the present depth."""
        return pa.ListArray.from_arrays(pa.array(self.begins.astype(np.int32)), self.words.take(pa.array(self.at)), mask=self.none)


def each_rounds(texts: DataFrame, settings: Paraphrase, columns: str, made: Callable[[pa.RecordBatch, Rounds], Iterator[list[pa.Array]]]) -> DataFrame:
    """``texts`` without ``words`` and with the columns (DDL) that ``made`` makes of a batch's rounds.

    ``made`` gives, for each batch of rows it is to return, the arrays of the
    new columns, a row per text. Rounds are made inside a text's row.
    """
    kept = [c for c in texts.columns if c != "words"]
    name = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("text_type"))
    rows = texts.select(*kept, name.alias(_NAME), F.col("words").cast("array<string>").alias(_WORDS))
    schema = StructType([*(texts.schema[c] for c in kept), *StructType.fromDDL(columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = pc.fill_null(pc.list_value_length(whole.column(_WORDS)), 0).to_numpy(zero_copy_only=False)
            piece = (np.cumsum(sizes) - sizes) // AT_ONCE
            edges = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1], True]) if len(piece) else []
            for lo, hi in zip(edges, edges[1:]):
                batch = whole.slice(lo, hi - lo)
                rest = batch.drop_columns([_NAME, _WORDS])
                for more in made(rest, Rounds(batch.column(_NAME), batch.column(_WORDS), settings)):
                    yield pa.RecordBatch.from_arrays([*rest.columns, *more], names=schema.names)

    return rows.mapInArrow(run, schema)


def _depth(depth: int, n: int) -> pa.Array:
    return pa.array(np.full(n, depth, np.int32))


def rounds(texts: DataFrame, settings: Paraphrase) -> DataFrame:
    """``texts`` (doc_id, text_type, words and any more) with ``depth`` and its words, from depth 0, the original, to the last round."""

    def made(rest: pa.RecordBatch, found: Rounds) -> Iterator[list[pa.Array]]:
        for depth in found.each():
            yield [_depth(depth, len(rest)), found.lists()]

    return each_rounds(texts, settings, "depth int, words array<string>", made)


def _joined(lists: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Texts of words, and how many words they have."""
    return pc.binary_join(lists, " "), pc.list_value_length(lists).cast(pa.int64())


def round_texts(texts: DataFrame, settings: Paraphrase) -> DataFrame:
    """``rounds`` with the words as ``text``, and their number as ``word_count``."""

    def made(rest: pa.RecordBatch, found: Rounds) -> Iterator[list[pa.Array]]:
        for depth in found.each():
            yield [_depth(depth, len(rest)), *_joined(found.lists())]

    return each_rounds(texts, settings, "depth int, text string, word_count bigint", made)


def _wide_names(iterations: int) -> list[tuple[str, str]]:
    return [("original_text", "original_word_count")] + [(f"paraphrase_iter_{k}", f"word_count_iter_{k}") for k in range(1, iterations + 1)]


def wide_rounds(texts: DataFrame, settings: Paraphrase) -> DataFrame:
    """``wide`` of the rounds of ``texts``, made inside a text's row: nothing is shuffled, and rows that share a key stay apart."""

    def made(rest: pa.RecordBatch, found: Rounds) -> Iterator[list[pa.Array]]:
        yield [column for _ in found.each() for column in _joined(found.lists())]

    columns = ", ".join(f"{text} string, {count} bigint" for text, count in _wide_names(settings.iterations))
    return each_rounds(texts.select(*KEY, "words"), settings, columns, made)


def wide(deep: DataFrame, iterations: int) -> DataFrame:
    """original_text and its count, then paraphrase_iter_k and word_count_iter_k for each round."""
    text, count = F.array_join("words", " "), F.size("words").cast("bigint")
    names = _wide_names(iterations)
    picks = [p for k, (a, b) in enumerate(names) for p in (F.max(F.when(F.col("depth") == k, text)).alias(a), F.max(F.when(F.col("depth") == k, count)).alias(b))]
    return deep.groupBy("doc_id", "text_type").agg(*picks)


#: What stands in place of a paraphrase that failed, with the reason; its word count is 0.
ERROR = "ERROR: "


def answered(model: Paraphraser, asked: pd.DataFrame) -> pd.Series:
    """The model's answers; where a batch fails, row by row, so that one text's failure is one text's ``ERROR``."""
    try:
        return model.transform(asked)
    except Exception as whole:
        if len(asked) == 1:
            return pd.Series([f"{ERROR}{whole}"], index=asked.index)
        return pd.concat([answered(model, asked.iloc[[k]]) for k in range(len(asked))])


def text_and_count(df: DataFrame, text: str = "text", count: str = "word_count") -> tuple[str, str | None]:
    """The text column, else the first of the names that files of this kind use; and the count column if there is one."""
    if text not in df.columns:
        text = next((c for c in ("text", "generated_text", "text_cleaned") if c in df.columns), None)
        if text is None:
            raise ValueError(f"no text column among {df.columns}")
    return text, count if count in df.columns else None


def asked(df: DataFrame, make: Callable[[], Paraphraser], settings: Paraphrase, source: str, target: Column, name: str, count: str, batch_size: int = 0) -> DataFrame:
    """``df`` with the model's answer to ``source`` in ``name`` and its words in ``count``; a null source stays null.

    The model sees at most ``batch_size`` rows at once (0: what Spark sends at
    once). Other columns pass through untouched.
    """
    least, _, tokens = T.budget(target, settings.tolerance)
    rows = df.withColumns({"_prompt": T.paraphrase_prompt(F.col(source), least), "_target": target, "_tokens": tokens})
    schema = StructType([*(StructField(f.name, f.dataType) for f in df.schema), StructField(name, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for whole in batches:  # other columns as Arrow columns, so ids stay integers beside nulls
            for at in range(0, len(whole), batch_size or max(len(whole), 1)):
                batch = whole.slice(at, batch_size or len(whole))
                texts = batch.select(["_prompt", "_target", "_tokens"]).to_pandas()
                some = texts["_prompt"].notna()
                answers = pd.Series([None] * len(texts), dtype=object)
                if some.any():
                    answers[some] = answered(model, texts[some].rename(columns=lambda c: c[1:]))
                kept = batch.drop_columns(["_prompt", "_target", "_tokens"])
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(answers, pa.string())], names=[*kept.schema.names, name])

    failed = F.col(name).startswith(ERROR)
    rows = rows.mapInArrow(run, schema).withColumn(name, F.when(failed, F.col(name)).otherwise(T.cleaned_output(F.col(name))))
    return rows.withColumn(count, F.when(failed, F.lit(0).cast("bigint")).when(F.col(name).isNotNull(), T.word_count(F.col(name))))


def with_model(df: DataFrame, make: Callable[[], Paraphraser], settings: Paraphrase, text: str = "text", count: str | None = None) -> DataFrame:
    """Rounds by a real model; each is stored before the next reads it, null inputs stay null."""
    text, count = text_and_count(df, text, count or "")
    rows = df.withColumn("original_text", F.col(text)).withColumn("original_word_count", F.col(count) if count else T.word_count(F.col(text)))
    source, target = "original_text", "original_word_count"
    for k in range(1, settings.iterations + 1):
        name, words = f"paraphrase_iter_{k}", f"word_count_iter_{k}"
        rows = stored(asked(rows, make, settings, source, F.col(target), name, words), f"round-{k}")
        source, target = name, words
    return rows


#: Key of a row of rounds, and the slices in which a round is saved: what a job that breaks off loses is one slice of one round.
KEY, SLICES = ("doc_id", "text_type"), 16


def resumed_rounds(texts: DataFrame, path: str, make: Callable[[], Paraphraser], settings: Paraphrase, batch_size: int = 0, slices: int = SLICES) -> DataFrame:
    """(doc_id, text_type, label, depth, text, word_count) of all rounds, kept at ``path`` and returned from there.

    ``texts`` has doc_id, text_type, label and text. Each round asks for what
    the round before has and the table lacks, slice by slice, and appends each
    slice by itself. So a job that broke off goes on where it stopped when it is
    called again: the model is not asked again for a row that was saved, new
    texts are taken up in all rounds, and a finished table is only read. Rows
    that share a key share a slice. A null text has null rounds.
    """
    spark = texts.sparkSession
    schema = StructType([texts.schema[c] for c in ("doc_id", "label")] + [StructField("text", StringType()), StructField("word_count", LongType()), StructField("text_type", StringType()), StructField("depth", IntegerType())])

    def save(rows: DataFrame, depth: int) -> None:
        if exists(spark, f"{path}/text_type=*/depth={depth}"):
            rows = remaining(rows, spark.read.schema(schema).parquet(path).where(F.col("depth") == depth), list(KEY))
        if depth:
            rows = asked(rows.drop("depth"), make, settings, "source", F.col("source_count"), "text", "word_count", batch_size).drop("source", "source_count")
        rows.withColumn("depth", F.lit(depth)).write.mode("append").partitionBy("text_type", "depth").parquet(path)

    save(texts.select(*KEY, "label", "text", T.word_count(F.col("text")).alias("word_count")), 0)
    for depth in range(1, settings.iterations + 1):
        before = spark.read.schema(schema).parquet(path).where(F.col("depth") == depth - 1)
        before = before.withColumnsRenamed({"text": "source", "word_count": "source_count"})
        for k in range(slices):
            save(before.where(F.pmod(F.xxhash64(*KEY), F.lit(slices)) == k), depth)
    return spark.read.schema(schema).parquet(path).where(F.col("depth") <= settings.iterations)


def wide_texts(deep: DataFrame, iterations: int) -> DataFrame:
    """``wide`` of rows that hold their text and its count."""
    names = _wide_names(iterations)
    return deep.groupBy(*KEY).agg(*[F.max(F.when(F.col("depth") == k, F.col(c))).alias(n) for k, pair in enumerate(names) for c, n in zip(("text", "word_count"), pair, strict=True)])


def resume_point(df: DataFrame, iterations: int, key: str = "doc_id") -> DataFrame:
    """(iteration, first_key): the first round with a missing text and the smallest key that lacks it.

    With nothing missing: (iterations, null).
    """
    first = df.agg(*[F.min(F.when(F.col(f"paraphrase_iter_{k}").isNull(), F.col(key))).alias(f"k{k}") for k in range(1, iterations + 1)])
    at, where = F.lit(iterations), F.lit(None).cast(df.schema[key].dataType)
    for k in range(iterations, 0, -1):
        at, where = F.when(F.col(f"k{k}").isNotNull(), k - 1).otherwise(at), F.when(F.col(f"k{k}").isNotNull(), F.col(f"k{k}")).otherwise(where)
    return first.select(at.cast("bigint").alias("iteration"), where.alias("first_key"))


def words_per_round(deep: DataFrame) -> DataFrame:
    """Of rows that hold their ``words``, or their text and its ``word_count``."""
    n = F.col("word_count") if "word_count" in deep.columns else F.size("words")
    return deep.groupBy("text_type", "depth").agg(F.avg(n).alias("mean_words"), F.count("*").alias("n"))
