"""Watermarked generation with a pluggable generator; a sampler over the prompt's own words needs no model file."""

from __future__ import annotations

import hashlib
import math
import random
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.config import Watermark
from verdigris.operators.detection import scored


class Generator(Protocol):
    """Continues a prompt given as words; loaded once per worker."""

    def generate(self, prompt: list[str], length: int, seed: str) -> list[str]: ...


def green(before: str, token: str, mark: Watermark) -> bool:
    """The column predicate of ``functions.scores`` for one pair."""
    u = int(hashlib.md5(f"{mark.hash_key}:{before}:{token}".encode()).hexdigest()[:8], 16)
    return u < mark.gamma * 4294967296 if mark.select_green_tokens else u >= (1 - mark.gamma) * 4294967296


class PromptSampler:
    """Samples from the bigrams of the prompt itself, green words favoured by exp(delta); holds no model."""

    def __init__(self, mark: Watermark):
        self.mark = mark

    def generate(self, prompt: list[str], length: int, seed: str) -> list[str]:
        draw, follow = random.Random(seed), {}
        for before, token in zip(prompt, prompt[1:], strict=False):
            follow.setdefault(before, []).append(token)
        out: list[str] = []
        last = prompt[-1] if prompt else None
        while last is not None and len(out) < length:
            # half of the candidates follow the last word somewhere, half come from anywhere
            near = follow.get(last) or prompt
            choices = [draw.choice(near) for _ in range(8)] + [draw.choice(prompt) for _ in range(8)]
            weights = [math.exp(self.mark.delta) if green(last, t, self.mark) else 1.0 for t in choices]
            last = draw.choices(choices, weights)[0]
            out.append(last)
        return out


#: Words of a prompt that a generator sees.
MOST_WORDS = 2000


def finished(rows: DataFrame, mark: Watermark) -> DataFrame:
    """Rows (doc_id, words, new) in the columns of a generation file, with the bits and z of prompt and continuation together."""
    rows = scored(rows.withColumn("full", F.concat("words", "new")), mark, "full")
    return rows.select(
        "doc_id", F.array_join("words", " ").alias("original_text"), F.array_join("new", " ").alias("generated_text"), F.size("words").cast("bigint").alias("original_word_count"),
        F.size("new").cast("bigint").alias("generated_word_count"), F.array_join(F.col("bits").cast("array<string>"), ",").alias("watermark_bits"), "z_score",
    )


def generated(prompts: DataFrame, make: Callable[[], Generator], length: int, mark: Watermark) -> DataFrame:
    """(doc_id, original_text, generated_text, counts) and the bits and z of prompt and continuation together."""
    schema = "doc_id bigint, words array<string>, new array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for batch in batches:
            ids, words = batch.column("doc_id"), batch.column("words")  # as Arrow columns, ids stay integers beside nulls
            new = [model.generate(w or [], length, str(i)) for i, w in zip(ids.to_pylist(), words.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ids, words, pa.array(new, pa.list_(pa.string()))], names=["doc_id", "words", "new"])

    rows = prompts.select("doc_id", F.slice("words", F.lit(1), F.lit(MOST_WORDS)).alias("words")).mapInArrow(run, schema)
    return finished(rows, mark)
