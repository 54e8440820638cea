"""Quality rules as weak supervision (native).

Rules over figures of the whole text vote good, bad or abstain. Expectation
maximisation over the counts of vote patterns of all documents estimates how
reliable each rule is, and a document stays if the posterior probability of
good quality is at least one half, unless it fails the base: fewer than 50
words, or more than half of its words in repeated three-word windows.

The figures are made by array functions inside a row, so nothing is exploded
and no text is shuffled; they are computed once and written to shared
storage, from where the pattern counts and the verdicts are read.

Defined results: a null text has no words and all figures 0; it fails the
base, as an empty one does. Rows without doc_id and repeated rows are judged
like any other. Input columns named like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm import weak
from verdigris.llm.common import count_of, materialise, packed, unpacked, words_of

LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """``_row`` (the columns of ``docs`` but ``drop``) and the figures of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = packed(docs, text.alias("_text"))
    if drop:
        kept = [n for n in docs.columns if n not in drop]
        rows = rows.select(F.struct(*[F.col("_row").getField(n).alias(n) for n in kept]).alias("_row"), "_text")
    # each array is a column of its own: lambdas then read it instead of making it again
    rows = rows.withColumn("_words", words_of(F.col("_text")))
    rows = rows.withColumn("n_words", F.size("_words").cast("bigint"))
    windows = F.transform("_words", lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)))
    rows = rows.withColumn("_windows", F.slice(windows, F.lit(1), F.greatest(F.size("_words") - 2, F.lit(0))))
    # windows sorted with their places, only where some window occurs twice
    placed = F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    twice = F.size(F.array_distinct("_windows")) < F.size("_windows")
    rows = rows.withColumn("_sorted", F.when(twice, F.sort_array(placed)))
    repeated = F.filter("_sorted", lambda x, k: (x["h"] == F.get("_sorted", k + 1)["h"]) | ((k > 0) & (x["h"] == F.get("_sorted", k - 1)["h"])))
    inside = F.flatten(F.transform(repeated, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    rows = rows.withColumn("n_repeat_words", F.coalesce(F.size(F.array_distinct(inside)), F.lit(0)).cast("bigint"))
    rows = rows.withColumn("n_repeat_words", F.when(F.col("_sorted").isNull(), F.lit(0).cast("bigint")).otherwise(F.col("n_repeat_words")))
    rows = rows.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))))
    text = F.col("_text")
    return rows.select(
        "_row",
        "n_words",
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        count_of(text, SYMBOLS).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("_lines").cast("bigint").alias("n_lines"),
        count_of(text, r"\p{Lu}").cast("bigint").alias("n_capitals"),
        count_of(text, "!?").cast("bigint").alias("n_shouts"),
        count_of(text, ".!?:;。").cast("bigint").alias("n_stops"),
        count_of(text, "0-9").cast("bigint").alias("n_digits"),
    )


RULES = ("symbols", "repeats", "lines", "capitals", "shouts", "digits", "words", "sentences", "prose", "length")


def rules() -> dict[str, Column]:
    """The votes, over the figures.

    A text can be bad in one way and fine in all others, so a rule that looks
    for one fault abstains where it finds none; what speaks for a text is the
    shape of prose and enough length.
    """
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    symbols, repeats = F.col("n_symbols") / n, F.col("n_repeat_words") / n
    lines, capitals = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), F.col("n_capitals") / chars
    shouts, stops, digits, length = F.col("n_shouts") / n, F.col("n_stops") / n, F.col("n_digits") / chars, F.col("word_chars") / n
    prose = (symbols < 0.1) & (repeats < 0.3) & (capitals < 0.2) & (shouts < 0.1) & (stops > 0.01) & (stops < 0.5)

    def fault(found: Column) -> Column:
        return F.when(found, -1).otherwise(0)

    return {
        "symbols": fault(symbols > 0.2),
        "repeats": fault(repeats > 0.3),
        "lines": fault(lines > 0.3),
        "capitals": fault(capitals > 0.3),
        "shouts": fault(shouts > 0.2),
        "digits": fault(digits > 0.3),
        "words": fault((length < 2.5) | (length > 14)),
        "sentences": fault(stops < 0.005),
        "prose": F.when(prose, 1).otherwise(0),
        "length": F.when(n < 20, -1).when(n >= 100, 1).otherwise(0),
    }


def judged(docs: DataFrame, drop: tuple[str, ...] = ()) -> tuple[DataFrame, weak.VoteModel]:
    """``docs`` without ``drop``, with the base columns, ``kept`` and ``posterior``; and the fitted model."""
    votes = rules()
    rows = materialise(measured(docs, drop).select("*", *[v.cast("int").alias(f"_vote_{k}") for k, v in votes.items()]), "quality-figures")
    counts = rows.groupBy(*[F.col(f"_vote_{k}").alias(k) for k in RULES]).agg(F.count("*").alias("n"))
    model = weak.estimate(counts, RULES)
    n = F.col("n_words")
    failed = (n < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * n)
    rows = rows.withColumn("_failed", failed).withColumn("_good", model.posterior({k: F.col(f"_vote_{k}") for k in RULES}))
    more = [*(F.col(c) for c in BASE), F.col("_failed").alias("base_failed"), (~F.col("_failed") & (F.col("_good") >= 0.5)).alias("kept"), F.col("_good").alias("posterior")]
    return unpacked(rows, *more, replacing=(*BASE, "base_failed", "kept", "posterior")), model


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that the rules reject."""
    whole = docs.select(F.struct(*[docs["`" + c.replace("`", "``") + "`"] for c in docs.columns]).alias("whole"), F.col("text").alias("text"))
    rows, _ = judged(whole, drop=("text",))
    return rows.where("kept").select("whole.*")


def oracle_sql() -> str:
    """Figures, estimation and verdicts in DuckDB's SQL; the posterior to six places."""
    space, spaces = r"[\x20\x09-\x0D]", "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

    def counted(characters: str) -> str:
        return f"length(text) - length(translate(text, '{characters}', ''))"

    def fault(found: str) -> str:
        return f"CASE WHEN {found} THEN -1 ELSE 0 END"

    n, chars, lines = "greatest(n_words, 1)", "greatest(word_chars, 1)", "greatest(n_lines, 1)"
    symbols, repeats, capitals, shouts, stops = f"n_symbols / {n}", f"n_repeat_words / {n}", f"n_capitals / {chars}", f"n_shouts / {n}", f"n_stops / {n}"
    votes = {
        "symbols": fault(f"{symbols} > 0.2::DOUBLE"),
        "repeats": fault(f"{repeats} > 0.3::DOUBLE"),
        "lines": fault(f"n_dup_lines / {lines} > 0.3::DOUBLE"),
        "capitals": fault(f"{capitals} > 0.3::DOUBLE"),
        "shouts": fault(f"{shouts} > 0.2::DOUBLE"),
        "digits": fault(f"n_digits / {chars} > 0.3::DOUBLE"),
        "words": fault(f"word_chars / {n} < 2.5::DOUBLE OR word_chars / {n} > 14"),
        "sentences": fault(f"{stops} < 0.005::DOUBLE"),
        "prose": f"CASE WHEN {symbols} < 0.1::DOUBLE AND {repeats} < 0.3::DOUBLE AND {capitals} < 0.2::DOUBLE AND {shouts} < 0.1::DOUBLE AND {stops} > 0.01::DOUBLE AND {stops} < 0.5::DOUBLE THEN 1 ELSE 0 END",
        "length": f"CASE WHEN {n} < 20 THEN -1 WHEN {n} >= 100 THEN 1 ELSE 0 END",
    }
    return f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
split AS MATERIALIZED (
  SELECT *, list_filter(regexp_split_to_array(text, '{space}+'), lambda x: x <> '') AS w,
    list_filter(string_split(text, chr(10)), lambda x: length(translate(x, {spaces}, '')) > 0) AS lines FROM docs),
windows AS (SELECT row_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS words FROM (SELECT row_id, w, unnest(range(1, len(w) - 1)) AS i FROM split)),
repeated AS (SELECT row_id, unnest([i, i + 1, i + 2]) AS place FROM (SELECT row_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY row_id, words) > 1)),
places AS (SELECT row_id, count(DISTINCT place) AS n FROM repeated GROUP BY row_id),
figures AS MATERIALIZED (
  SELECT row_id, doc_id, len(w)::BIGINT AS n_words, length(translate(text, {spaces}, ''))::BIGINT AS word_chars, ({counted(SYMBOLS)})::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(places.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
    length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g')) AS n_capitals, {counted('!?')} AS n_shouts, {counted('.!?:;。')} AS n_stops, {counted('0123456789')} AS n_digits
  FROM split LEFT JOIN places USING (row_id)),
voted AS MATERIALIZED (SELECT *, {', '.join(f'{v} AS {k}' for k, v in votes.items())} FROM figures),
patterns AS (SELECT {', '.join(RULES)}, count(*) AS n FROM voted GROUP BY ALL),
{weak.estimate_sql('patterns', RULES)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
  NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND p >= 0.5::DOUBLE AS kept, round(round(p, 9), 6) AS posterior
FROM voted JOIN posteriors USING ({', '.join(RULES)})
"""
