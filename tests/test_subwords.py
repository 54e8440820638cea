"""Subword tokens against a plain longest match, and tokenizers that fail."""

import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from verdigris.config import Watermark
from verdigris.operators import detection, subwords

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def plain(word, pieces):
    out, at, ids = [], 0, {p: k for k, p in reversed(list(enumerate(pieces))) if p}
    while at < len(word):
        size = next((n for n in range(min(len(word) - at, max(map(len, ids), default=0)), 0, -1) if word[at : at + n] in ids), 0)
        out.append(2 * ids[word[at : at + size]] + (at > 0) if size else subwords.UNKNOWN)
        at += size or 1
    return out


def test_trie_against_plain_longest_match():
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcé🙂") for _ in range(rng.randint(0, n)))
    for size in (0, 1, 5, 60, 400):
        pieces = [word(5) for _ in range(size)]
        words = [word(14) for _ in range(300)] + ["", "zzz", "abc" * 3000]
        tokens, begins = subwords.PieceTrie(pieces).tokens(words)
        assert [tokens[a:b].tolist() for a, b in zip(begins, begins[1:])] == [plain(w, pieces) for w in words]
    assert subwords.PieceTrie(["a"]).tokens([])[0].tolist() == []


def test_segmented_rows_join_again(spark):
    rng = random.Random(4)
    texts = [(k, ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 30))], "x") for k in range(50)]
    df = spark.createDataFrame(texts + [(90, None, "x"), (91, [], "x"), (92, ["aa", None, "a"], "x")], "doc_id int, words array<string>, other string").repartition(3)
    pieces = subwords.corpus_pieces(df.where("doc_id < 90"), 40)
    listed = [r.piece for r in pieces.orderBy("id").collect()]
    assert len(listed) == len(set(listed)) <= 45 and listed == sorted(listed)
    got = {r.doc_id: r for r in subwords.segmented(df, pieces).collect()}
    for k, words, _ in texts:
        assert got[k].tokens == [t for w in words for t in plain(w, listed)] and subwords.joined(got[k].tokens, listed) == words
    assert got[90].tokens is None and got[91].tokens == [] and got[92].tokens == plain("aa", listed) + plain("a", listed)
    assert subwords.segmented(df.limit(0), pieces).collect() == []
    assert subwords.corpus_pieces(df.limit(0)).collect() == []
    scored = detection.scored(subwords.segmented(df, pieces), Watermark(), "tokens")
    assert {r.doc_id: r.num_tokens_scored for r in scored.collect()} == {k: max(len(r.tokens or []) - 1, 0) for k, r in got.items()}


class Fragile:
    """A tokenizer that can't do with some texts."""

    def __call__(self, texts):
        if any("poison" in t for t in texts):
            raise RuntimeError("no such text")
        return [t.split("-") for t in texts]


def test_a_text_that_fails_costs_itself_only(spark):
    rows = [(k, "poison" if k % 11 == 4 else f"a-b-{k}") for k in range(60)] + [(100, None), (101, "")]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r.id: r for r in subwords.tried(df, Fragile, "text").collect()}
    assert all((got[k].tokens is None) == (t == "poison") == (got[k].error is not None) for k, t in rows)
    assert got[4].error == "RuntimeError: no such text" and got[100].tokens == ["nan"] and got[0].tokens == ["a", "b", "0"]
    file = {r.id: r for r in detection.detection_file_of_tokens(subwords.tried(df, Fragile, "text"), Watermark()).collect()}
    assert file[4].watermark_bits == "ERROR" and file[4].z_score == 0 and file[0].num_tokens_scored == 2
    short = subwords.tried(df, lambda: lambda texts: [], "text")
    assert all("answers" in r.error for r in short.select(F.col("error")).collect())
