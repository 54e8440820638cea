import math
import zlib
from collections import Counter

import pytest

from verdigris.llm import ngram_lm

SCHEMA = "doc_id bigint, text string, block string"


def brute(rows, order, k):
    """Counts in dictionaries, probabilities by recursion."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    seps = str.maketrans("\t\n\x0b\x0c\r", "     ")
    tokens = [[w for w in (t or "").translate(lower).translate(seps).split(" ") if w] + ["</end>"] for _, t, _ in rows]
    held = [zlib.crc32(str("" if i is None else i).encode()) % 7 == 2 for i, _, _ in rows]
    grams = Counter()
    for t, h in zip(tokens, held):
        if not h:
            for i in range(len(t)):
                padded = ["</end>", *t[: i + 1]]
                for n in range(1, order + 1):
                    if n == 1:
                        grams[(t[i],)] += 1
                    elif len(padded) >= n:
                        grams[tuple(padded[-n:])] += 1
    n_all = sum(c for g, c in grams.items() if len(g) == 1)
    v = sum(1 for g in grams if len(g) == 1)

    def p(gram):
        if len(gram) == 1:
            return (grams[gram] + 1) / (n_all + v + 1)
        return (grams[gram] + k * p(gram[1:])) / (grams[gram[:-1]] + k)

    out = []
    for (i, _, _), t, h in zip(rows, tokens, held):
        score = 0.0
        for j in range(len(t)):
            padded = ["</end>", *t[: j + 1]]
            score += math.log10(p(tuple(padded[-min(order, len(padded)) :])))
        base = sum(math.log10(p((w,))) for w in t)
        out.append((i, h, len(t), sum(grams[(w,)] > 0 for w in t), n_all, base, score))
    return out


ROWS = [(i, t, "x") for i, t in enumerate(["the cat sat", "The CAT sat on\tthe mat\n\nthe end", "", None, "É é the", "the the the the", "unseen words here", " a\x0bb\x0cc\rd "] * 4)] + [
    (None, "the cat", "x"), (3, "the cat", "x"), (100, "w " * 5000 + "the cat", "x")]


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("chars", [40, 10**7])
def test_against_brute_force(spark, order, chars):
    compare(ngram_lm.score(spark.createDataFrame(ROWS, SCHEMA).repartition(3), order, 2.0, chars).collect(), order)


@pytest.mark.parametrize("group_bytes", [1 << 10, 64 << 20])
def test_messages_in_two_steps(spark, monkeypatch, group_bytes):
    """Finer buckets than a block sends to, one or many groups of blocks."""
    monkeypatch.setattr(ngram_lm, "GROUP_BYTES", group_bytes)
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    compare(ngram_lm.score(df, 2, 2.0, 40, bucket_bytes=1 << 10, coarse=2).collect(), 2)


def test_buckets_hold_so_many_bytes():
    assert ngram_lm.bucket_bits(0) == ngram_lm.LEAST_BITS
    for tokens in (10**9, 10**11, 10**13):
        share = tokens * ngram_lm.GRAM_BYTES / 2 ** ngram_lm.bucket_bits(tokens)
        assert ngram_lm.BUCKET_BYTES / 2 < share <= ngram_lm.BUCKET_BYTES


def compare(got, order):
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    want, got = sorted(brute(ROWS, order, 2.0), key=key), sorted(map(tuple, got), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want):
        assert a[5] == pytest.approx(b[5], abs=1e-6) and a[6] == pytest.approx(b[6], abs=1e-6) and a[7] == pytest.approx(b[6] / b[2], abs=1e-6)


def test_no_documents(spark):
    assert ngram_lm.score(spark.createDataFrame([], SCHEMA)).count() == 0


def test_held_out_text_scores_above_unigrams(spark):
    """Bigrams learned from the training part help on the held-out part."""
    import random

    random.seed(3)
    pairs = {w: random.sample("abcdefghijklmnop", 3) for w in "abcdefghijklmnop"}

    def text():
        words = ["a"]
        while len(words) < 40:
            words.append(random.choice(pairs[words[-1]]))
        return " ".join(words)

    got = ngram_lm.score(spark.createDataFrame([(i, text(), "") for i in range(400)], SCHEMA)).where("held_out")
    better, n = got.selectExpr("avg(int(score > base_score))", "count(*)").first()
    assert n > 30 and better == 1.0
