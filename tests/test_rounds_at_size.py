"""Rounds, bits and pairs: that each is made once, in linear time, and shuffled no more than it must be."""

import hashlib
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verdigris.config import Paraphrase, Watermark, Windows
from verdigris.functions.digests import heads
from verdigris.operators import detection, paraphrasing, stability, vocabulary, windows
from verdigris.plans import queries

MARK = Watermark()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("rounds")
    texts = [(i, " ".join(f"w{(k * k + i) % 50}" for k in range(30 * i))) for i in range(5)]
    spark.createDataFrame([*texts, (9, None)], "doc_id bigint, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_beginnings_of_digests():
    rng = random.Random(1)
    texts = [*("".join(rng.choice("abc\u00e9:9") for _ in range(rng.randrange(70))) for _ in range(3000)), "", None]
    for array in (pa.array(texts), pa.array(texts).slice(7, 900), pa.array([], pa.string())):
        tails = (b"", b"1", b"12")
        for tail, found in zip(tails, heads(array, tails), strict=True):
            assert found.tolist() == [int(hashlib.md5((t or "").encode() + tail).hexdigest()[:8], 16) for t in array.to_pylist()]


@pytest.mark.parametrize("settings", [Paraphrase(), Paraphrase(iterations=11, rate=0.6)])
@pytest.mark.parametrize("mark", [MARK, Watermark(gamma=0.4, select_green_tokens=False)])
def test_rounds_in_arrays_equal_columns(spark, settings, mark):
    rows = [(1, "ai", [f"w{k % 37}" for k in range(300)]), (1, "human", ["\u00e9" * 40, "b" * 70, "c", "c"]), (2, "ai", []), (3, "ai", None), (4, "x" * 60, ["one"]), (None, "ai", ["a", "b"]), (5, "ai", ["a", None, "c"])]
    texts = spark.createDataFrame(rows, "doc_id bigint, text_type string, words array<string>")
    wide = texts.withColumn("_w0", F.col("words"))
    for k in range(1, settings.iterations + 1):
        wide = wide.withColumn(f"_w{k}", paraphrasing.stand_in(F.col(f"_w{k - 1}"), F.col("doc_id"), F.col("text_type"), k, settings.rate))
    deep = wide.select("doc_id", "text_type", F.inline(F.array(*[F.struct(F.lit(k).alias("depth"), F.col(f"_w{k}").alias("words")) for k in range(settings.iterations + 1)])))
    same = lambda a, b: sorted(map(repr, a.collect())) == sorted(map(repr, b.select(*a.columns).collect()))
    assert same(deep, paraphrasing.rounds(texts, settings))
    assert same(deep.where("doc_id <> 5").select("doc_id", "text_type", "depth", F.array_join("words", " ").alias("text")), paraphrasing.round_texts(texts, settings).where("doc_id <> 5"))
    bits = F.array_join(F.col("bits").cast("array<string>"), "")
    assert same(detection.scored(deep, mark).drop("words").withColumn("bits", bits), detection.scored_rounds(texts, settings, mark))


@pytest.mark.parametrize("name", ["combine_detections", "combine_labeled"])
def test_detections_are_made_once(spark, folder, name):
    assert "documents.parquet" not in plan(queries.QUERIES[f"{name}_docs"](spark, folder))


@pytest.mark.parametrize("name", ["unpivot_depths", "paraphrase_rounds", "detect_all_depths"])
def test_rounds_are_not_shuffled(spark, folder, name):
    assert "hashpartitioning" not in plan(queries.QUERIES[f"{name}_docs"](spark, folder))


def test_bits_are_hashed_after_they_are_rows(spark, folder):
    lines = plan(queries.QUERIES["green_bits_docs"](spark, folder)).splitlines()
    assert not [x for x in lines if "md5" in x and ("Filter" in x or "Generate" in x)]
    nothing = spark.createDataFrame([(1, None), (2, []), (3, ["a"])], "id int, words array<string>")
    assert detection.exploded_bits(nothing, MARK, "id").count() == 0


def test_distinct_pairs_take_linear_time(spark):
    n = 40_000
    texts = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: k.cast("string")).alias("words"))
    began = time.time()
    assert detection.unique_bigram_scores(texts, MARK).first().num_tokens_scored == n - 1
    assert time.time() - began < 12
    # tokens that hold what joins them
    odd = spark.createDataFrame([(["a:b", "c", "a", "b:c", "a:b", "c"],)], "words array<string>")
    assert detection.unique_bigram_scores(odd, MARK).first().num_tokens_scored == 4


def test_pairs_are_shuffled_once(spark, folder):
    texts = spark.createDataFrame([(1, "ai", ["a", "b", "a", "b"]), (1, "ai", ["a", "b"]), (2, "ai", ["a", "b"])], "doc_id bigint, text_type string, words array<string>")
    assert plan(vocabulary.corpus_bigrams(texts)).count("hashpartitioning") == 1
    own = plan(queries.QUERIES["bigram_counts_docs"](spark, folder))
    assert own.count("hashpartitioning") == 1 and own.index("Generate") < own.index("hashpartitioning")  # texts are dealt, not pairs
    assert {(r.doc_id, r.prev, r.token): r.n for r in vocabulary.bigrams(texts).collect()} == {(1, "a", "b"): 3, (1, "b", "a"): 1, (2, "a", "b"): 1}


def test_common_windows_without_window_rows(spark, folder):
    assert "Join" not in plan(queries.QUERIES["common_windows_docs"](spark, folder))
    bits = spark.createDataFrame([(1, "01" * 60), (1, ""), (2, "1"), (3, "")], "depth int, bits string")
    want = stability.common_windows(windows.figures(bits, Windows(), 0.25)).first().n_windows
    assert stability.common_windows_of_arrays(windows.local_scores(bits, Windows(), 0.25)).first().n_windows == want == 1
