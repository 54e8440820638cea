"""Corpus preparation: which documents will do, what is cut from them, length variations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.config import Corpus
from verdigris.functions import text as T


def viable(docs: DataFrame, corpus: Corpus) -> Column:
    """Whether a text has the lines to skip and enough words after them."""
    t = docs["text"]
    return (F.size(T.lines(t)) >= corpus.skip_lines) & (F.size(T.body(t, corpus.skip_lines)) >= corpus.words_per_sample)


def extracted(docs: DataFrame, corpus: Corpus, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keep..., words, success): the first words after the skipped lines; short texts give what they have."""
    enough_lines = F.size(T.lines(F.col("text"))) >= corpus.skip_lines
    rows = docs.select("doc_id", *keep, enough_lines.alias("enough"), T.body(F.col("text"), corpus.skip_lines).alias("body"))
    got = F.when(F.col("enough"), F.slice("body", F.lit(1), F.lit(corpus.words_per_sample))).otherwise(F.array().cast("array<string>"))
    return rows.select("doc_id", *keep, got.alias("words")).withColumn("success", F.size("words") >= corpus.words_per_sample)


def samples(docs: DataFrame, corpus: Corpus, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keep..., words) of viable documents; the first ``num_samples`` by doc_id if that is set."""
    rows = extracted(docs, corpus, keep).where("success").drop("success")
    return rows.orderBy("doc_id").limit(corpus.num_samples) if corpus.num_samples else rows


def _sides(middle: Column) -> Column:
    """Both sides of the array ``words`` as rows to inline: ``middle`` words as human text, the rest for the machine side."""
    return F.array(
        F.struct(F.lit("human").alias("text_type"), F.lit(0).alias("label"), F.slice("words", F.lit(1), middle).alias("words")),
        F.struct(F.lit("ai").alias("text_type"), F.lit(1).alias("label"), F.slice("words", middle + 1, F.greatest(F.size("words"), F.lit(1))).alias("words")),
    )


def halves(docs: DataFrame, corpus: Corpus, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keep..., text_type, label, words): the first half of each sample as human text, the rest for the machine side."""
    return samples(docs, corpus, keep).select("doc_id", *keep, F.inline(_sides(F.lit(corpus.words_per_sample // 2))))


def whole_halves(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``halves`` of all words of all documents, however few they are; of an odd number the machine side has one more.

    A document without words, or with a null text, has two empty sides.
    """
    words = F.coalesce(T.words(F.col("text")), F.array().cast("array<string>"))
    return docs.select("doc_id", *keep, words.alias("words")).select("doc_id", *keep, F.inline(_sides(F.floor(F.size("words") / 2).cast("int"))))


def dataset(docs: DataFrame, corpus: Corpus) -> DataFrame:
    """(text_type, text, filename, word_count): both input tables of the later steps in one."""
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    return halves(docs, corpus).select("text_type", F.array_join("words", " ").alias("text"), name.alias("filename"), F.size("words").cast("bigint").alias("word_count"))


def with_trimmed(df: DataFrame, n: int, text_column: str = "text", output_column: str = "text_cleaned") -> DataFrame:
    """``df`` with the text cut to ``n`` words, and its count beside it."""
    text, count = T.trimmed(F.col(text_column), n)
    count_name = "new_word_count" if output_column == "text_cleaned" else f"{output_column}_word_count"
    return df.withColumns({output_column: text, count_name: count})


#: Words of the usual length variations.
LENGTHS = (1500, 1000, 500, 300)


def length_variations(df: DataFrame, lengths: tuple[int, ...] = LENGTHS, text_column: str = "text") -> DataFrame:
    """A row for each wanted length: ``target_words``, the cut text and its count."""
    rows = df.withColumn("target_words", F.explode(F.array(*map(F.lit, lengths))))
    text, count = T.trimmed(F.col(text_column), F.col("target_words"))
    return rows.withColumns({"text_cleaned": text, "new_word_count": count})
