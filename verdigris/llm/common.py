"""What the corpus operators share: the word rule, safe column names, shared storage."""

from __future__ import annotations

import re
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.sources.storage import shared_folder

#: A word is a run of characters other than space, tab, LF, VT, FF and CR.
SEPARATOR = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
_WORD = re.compile(WORD)
#: Words per shingle, and the similarity from which two texts count as near duplicates.
SHINGLE_WORDS = 5
SIMILARITY = (4, 5)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder that the driver and all executors see.

    It lies in the session's checkpoint folder.
    """
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to shared storage and read it again.

    This cuts the lineage: what follows reads files that outlive any executor,
    and Catalyst knows their size when it picks a join strategy.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, *extra: Column) -> DataFrame:
    """All columns of ``df`` in one struct ``_row`` beside ``extra``.

    Whatever the caller's columns are called, they can't clash with an
    operator's own; ``select("_row.*", ...)`` brings them back.
    """
    return df.select(F.struct(*[df[_quoted(c)] for c in df.columns]).alias("_row"), *extra)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def unpacked(df: DataFrame, *extra: Column, replacing: tuple[str, ...] = ()) -> DataFrame:
    """Undo ``packed``; input columns named as in ``replacing`` give way to the operator's."""
    gone = {c.lower() for c in replacing}
    names = [f.name for f in df.schema["_row"].dataType.fields if f.name.lower() not in gone]
    return df.select(*[F.col("_row").getField(n).alias(n) for n in names], *extra)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def words_of(text: Column) -> Column:
    """Array of the words of a whole text; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATOR), "")


def count_of(text: Column, characters: str) -> Column:
    """How many characters of a regular expression's class the text has; much cheaper than ``translate``, which makes a string of each."""
    return F.regexp_count(text, F.lit(f"[{characters}]"))


class WordHashes(dict):
    """64-bit hash of a word's bytes, remembered; forgets all beyond ``limit`` words."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def byte_words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case. ``bytes.split`` splits at exactly the six separators."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (the well-known xor-shift-multiply form)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_hashes(words: np.ndarray, size: int = SHINGLE_WORDS) -> np.ndarray:
    """A hash for each window of ``size`` words; a shorter text is one shingle, an empty text none."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    size = min(size, n)
    out = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[k : n - size + 1 + k] + np.uint64(k + 1))
    return out
