"""Green lists of exact length by keyed permutations."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.config import Watermark
from verdigris.functions import permutation as P
from verdigris.operators import vocabulary


def test_permutations_are_bijections():
    for size in (*range(1, 60), 97, 1009, 5003):
        for seed in ("a", "15485863:the"):
            there = P.permute(np.arange(size), size, seed)
            assert sorted(there.tolist()) == list(range(size)) and (P.permute(there, size, seed, backwards=True) == np.arange(size)).all()
    assert all(a * b >= n for n in (1, 2, 10**6 + 3, 10**9 + 7) for a, b in [P.radices(n)])
    a, b = P.radices(10**6 + 3)
    assert a * b - 10**6 - 3 < 10


@pytest.mark.parametrize("size", [1, 2, 11, 23, 257, 1009])
def test_columns_are_the_arrays(spark, size):
    seeds = ["x", "15485863:é", ""]
    df = spark.range(-1, size + 1).select("id", F.explode(F.array(*map(F.lit, [*seeds, None]))).alias("seed"))
    there = P.permuted(F.col("id"), size, F.col("seed"))
    got = {(r.seed, r.id): (r.a, r.b) for r in df.select("seed", "id", there.alias("a"), P.permuted(there, size, F.col("seed"), backwards=True).alias("b")).collect()}
    for seed in seeds:
        want = P.permute(np.arange(size), size, seed).tolist()
        assert [got[seed, i] for i in range(size)] == [(w, i) for i, w in enumerate(want)]
        assert got[seed, -1] == got[seed, size] == (None, None)
    assert got[None, 0] == (None, None)


@pytest.mark.parametrize("front", [True, False])
@pytest.mark.parametrize("size,gamma", [(37, 0.25), (101, 0.5), (3, 0.25)])
def test_every_list_has_its_exact_length(spark, front, size, gamma):
    mark = replace(Watermark(), gamma=gamma, select_green_tokens=front)
    vocab = spark.range(size).select(F.concat(F.lit("t"), F.col("id")).alias("token"), F.col("id").alias("tok_id"))
    contexts = spark.createDataFrame([("a",), ("b",), ("a",), (None,), *((f"c{k}",) for k in range(30))], "prev string")
    pairs = contexts.distinct().where("prev IS NOT NULL").join(vocab, how="cross")  # small, to count each whole list
    green = pairs.where(vocabulary.exact_green(F.col("prev"), F.col("tok_id"), size, mark)).select("prev", "token")
    listed = vocabulary.exact_lists(contexts, vocab, mark)
    assert sorted(map(tuple, green.collect())) == sorted(map(tuple, listed.collect()))
    sizes = {r["count"] for r in listed.groupBy("prev").count().collect()}
    assert sizes == ({int(size * gamma)} if int(size * gamma) else set())


def test_lists_look_random(spark):
    """A token is on about gamma of the lists, and two tokens on gamma squared of them together."""
    size, n = 2003, 4000
    places = np.array([P.permute(np.array([0, 1, 1999]), size, f"15485863:w{k}") for k in range(n)]) < int(size * 0.25)
    assert np.abs(places.mean(0) - 0.25).max() < 4 * (0.25 * 0.75 / n) ** 0.5
    assert abs((places[:, 0] & places[:, 1]).mean() - 0.0625) < 4 * (0.0625 * 0.9375 / n) ** 0.5


@pytest.mark.parametrize("front", [True, False])
def test_lists_are_never_broadcast(spark, monkeypatch, front):
    """Lists of several blocks, the last one short, that are larger than what may be broadcast."""
    monkeypatch.setattr(vocabulary, "BLOCK", 1000, raising=False)
    monkeypatch.setattr(vocabulary, "PART", 8000, raising=False)
    size, mark = 50_021, replace(Watermark(), select_green_tokens=front)
    length = int(size * mark.gamma)
    vocab = spark.range(size).select(F.concat(F.lit("t"), F.col("id")).alias("token"), F.col("id").alias("tok_id"))
    contexts = spark.createDataFrame([("a",), ("é",), ("a",), (None,), ("",)], "prev string")
    most = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(most)
    spark.conf.set(most, "64k")
    try:
        listed = vocabulary.exact_lists(contexts, vocab, mark)
        rows = listed.collect()
        plan = listed._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(most, before)
    places = np.arange(length) if front else np.arange(size - length, size)
    want = [(p, f"t{t}") for p in ("a", "é", "") for t in P.permute(places, size, f"{mark.hash_key}:{p}", backwards=True)]
    assert sorted(map(tuple, rows)) == sorted(want)
    assert "BroadcastHashJoin" not in plan


def test_contexts_of_any_type_and_none(spark):
    mark = Watermark()
    vocab = spark.range(40).select(F.concat(F.lit("t"), F.col("id")).alias("token"), F.col("id").alias("tok_id"))
    listed = vocabulary.exact_lists(spark.createDataFrame([(7,), (None,), (-1,)], "prev int"), vocab, mark)
    assert listed.dtypes == [("prev", "int"), ("token", "string")]
    assert {r.prev: r["count"] for r in listed.groupBy("prev").count().collect()} == {7: 10, -1: 10}
    assert vocabulary.exact_lists(spark.createDataFrame([(None,)], "prev string"), vocab, mark).collect() == []
