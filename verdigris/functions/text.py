"""Words, lines and the text expressions of corpus preparation and paraphrase."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Words of a text, split at white space; null stays null."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column, null: int = 0) -> Column:
    """Number of words; a null text counts ``null`` (1 where files hold it as the word ``nan``)."""
    return F.coalesce(F.size(words(text)), F.lit(null)).cast("bigint")


def lines(text: Column) -> Column:
    """Lines of a text; a final line break ends the last line and begins none."""
    raw = F.split(text, "\n", -1)
    return F.when(F.element_at(raw, -1) == "", F.slice(raw, F.lit(1), F.size(raw) - 1)).otherwise(raw)


def body(text: Column, skip: int) -> Column:
    """Words after the first ``skip`` lines."""
    found = lines(text)
    return words(F.array_join(F.slice(found, F.lit(skip + 1), F.greatest(F.size(found), F.lit(1))), "\n"))


def trimmed(text: Column, n: int | Column) -> tuple[Column, Column]:
    """The text cut to ``n`` words, and its count: a null gives '' and 0, a short text stays as it is."""
    n = F.lit(n) if isinstance(n, int) else n
    w = words(text)
    cut = F.when(text.isNull(), "").when(F.size(w) <= n, text).otherwise(F.array_join(F.slice(w, F.lit(1), n), " "))
    return cut, F.when(text.isNull(), 0).otherwise(F.least(F.size(w), n)).cast("bigint")


def cleaned_output(text: Column) -> Column:
    """A model's answer without a leading ``output:`` and without outer white space."""
    return F.regexp_replace(F.regexp_replace(text, r"^(?i:output:)\s*", ""), r"^\s+|\s+$", "")


def budget(target: Column, tolerance: int = 50) -> tuple[Column, Column, Column]:
    """Least and most words of a paraphrase, and its token limit."""
    most = target + tolerance
    return target - tolerance, most, F.floor(most * 1.5).cast("bigint")


def paraphrase_prompt(text: Column, least: Column) -> Column:
    """Instruction for a paraphrasing model."""
    return F.concat(F.lit("[INST] Rewrite the following passage in your own words. Keep its meaning and write at least "), least.cast("string"), F.lit(" words.\n\n"), text, F.lit(" [/INST]"))
