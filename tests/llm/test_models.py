"""Token counts against the library, the classifier by held-out accuracy, the pipeline stage by stage."""

import math
import random
import time
import re
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from verdigris.llm import queries, quality_model, tokens

sentencepiece = pytest.importorskip("sentencepiece")


def test_token_counts_equal_the_library(spark):
    path = queries.tokenizer_path()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(1)
    alphabet = "ab  e\n\t\r▁éßﬁ　漢字𝔘🙂<s>/INST the\u0000́"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.choice((0, 1, 3, 30, 400)))) for _ in range(400)]
    texts += ["a" * 3000, " " * 900, "the" * 500 + "x", "ab" * 5000, "</s> <unk> <0x0A>", "word " * 20_000]
    df = spark.createDataFrame([*enumerate(texts), (None, None), (0, texts[0])], "doc_id bigint, text string").selectExpr("*", "'mine' AS n_tokens")
    got = tokens.count_tokens(df, path, limit=4096).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        want = len(library.encode(r.text or ""))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (want, len((r.text or "").encode()), want > 4096)


def sample(rng, good):
    w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(30, 200))]
    return " ".join(w) + "." if good else rng.choice([" ".join(x + "$$$" for x in w), " ".join(x.upper() + "!!" for x in w), " ".join([w[0]] * 90)])


def test_classifier_on_held_out_rows(spark):
    rng = random.Random(3)
    truth = {i: rng.random() < 0.8 for i in range(1500)}
    docs = spark.createDataFrame([(i, sample(rng, g)) for i, g in truth.items()] + [(2000, None), (2001, ""), (None, "a b"), (2002, "x" * 100_000)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(g)) for i, g in truth.items() if i % 5 < 2], "doc_id bigint, quality int")
    model = quality_model.train(docs, labels)
    rows = quality_model.score(docs, model).collect()
    assert len(rows) == 1504
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 3 == 1)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([p == g for p, g in held]) > 0.95
    other = labels.withColumn("quality", labels.quality)  # labels of held-out rows change nothing
    flipped = other.selectExpr("doc_id", "IF(crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1, 1 - quality, quality) AS quality")
    assert quality_model.train(docs, flipped) == model


def test_classifier_without_positives(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert quality_model.train(docs, labels) is None
    assert quality_model.score(docs, None).first().score == 0.5


def test_prior_of_a_known_mixture():
    rng = np.random.default_rng(0)
    p, u = rng.normal(2, 1, (4000, 2)), np.vstack([rng.normal(2, 1, (2800, 2)), rng.normal(-2, 1, (1200, 2))])
    assert quality_model.class_prior(p, u) == pytest.approx(0.7, abs=0.06)


def test_pipeline(spark, tmp_path):
    rng = random.Random(5)
    text = lambda: ". ".join(" ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(8)).capitalize() for _ in range(12)) + "."
    clean = [text() for _ in range(60)]
    passage = " ".join(clean[7].split()[10:40])
    rows = list(enumerate(clean)) + [(100, clean[3]), (101, clean[4] + " more"), (102, text() + " " + passage), (103, text() + " mail a@b.com"), (104, "X!! " * 80), (105, None), (None, text())]
    docs = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 2}", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, "not in there at all " * 4)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        seen[name] = {r.doc_id: r.text for r in now.collect()}
    assert set(seen["quality rules"]) == {*range(60), 100, 101, 102, 103, None}
    assert set(seen["n-gram Jaccard join"]) == {*range(60), 102, 103, None}
    assert set(seen["benchmark decontamination"]) == {*range(60), 103, None} - {7}
    assert seen["PII"][103].endswith("mail [EMAIL]") and seen["PII"][0] == clean[0]
    mixed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in mixed} <= set(seen["PII"]) and len(mixed) > 20


def figures(text):
    """The classifier's figures by a plain loop."""
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    n, chars = max(len(w), 1), max(len(t), 1)
    share = lambda keep: sum(map(keep, t)) / chars
    letters = lambda s: (lambda c: c in s)
    return [
        math.log1p(len(w)), math.log1p(sum(map(len, w)) / n), share(lambda c: unicodedata.category(c) == "Lu"), share(letters("#*$%&<>=@^~_\\{}")), share(letters("!?")), share(letters("|")),
        share(letters("0123456789")), share(letters(",.;:'\"()")), sum(a == b for a, b in zip(w, w[1:])) / n, len(set(w)) / n, math.log1p(n / (t.count("\n") + 1)),
    ]


def test_figures_by_a_plain_loop(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("aBÉ ß\n\t#$|!?09.,;'\"()\\{}^~_@=<>🙂") for _ in range(rng.choice((0, 1, 5, 200)))) for _ in range(200)] + [None, "", " \n", "x " * 5000]
    rows = spark.createDataFrame([*enumerate(texts)], "i int, text string").withColumn("w", quality_model.words_of(F.col("text")))
    for r in rows.select("text", F.array(*quality_model.features(F.col("text"), F.col("w"))).alias("x")).collect():
        assert list(r.x) == pytest.approx(figures(r.text))


@pytest.mark.parametrize("prior", [0.3, 0.9])
def test_risk_and_its_slopes(prior):
    rng = np.random.default_rng(1)
    gp, gu = rng.normal(1, 2, 40), rng.normal(0, 2, 70)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    negative = lambda p, u: np.mean(sigmoid(u)) - prior * np.mean(sigmoid(p))
    plain = lambda p, u: prior * np.mean(sigmoid(-p)) + max(0, negative(p, u))
    for shift in (0, -8):  # at -8 the unlabelled share of negatives comes out below zero
        u = gu + shift
        value, dp, du = quality_model.risk(gp, u, prior)
        below = negative(gp, u) < 0
        assert value == pytest.approx(plain(gp, u)) and (below if shift else below == (prior == 0.9))
        target = plain if not below else (lambda p, x: -negative(p, x))  # below zero it is undone
        step = 1e-6
        for got, at in ((dp, 0), (du, 1)):
            for k in (0, 7, 39):
                args = [gp.copy(), u.copy()]
                args[at][k] += step
                up = target(*args)
                args[at][k] -= 2 * step
                assert got[k] == pytest.approx((up - target(*args)) / (2 * step), abs=1e-7)


def test_network_follows_the_slopes():
    """One small step of training lowers the risk that brute force computes."""
    rng = np.random.default_rng(4)
    p, u = rng.normal(1, 1, (200, 3)), np.vstack([rng.normal(1, 1, (200, 3)), rng.normal(-1, 1, (200, 3))])

    def after(steps):
        w, b, out, bias = quality_model._trained(p, u, lambda gp, gu: quality_model.risk(gp, gu, 0.5)[1:], steps)
        return quality_model.risk(np.tanh(p @ w + b) @ out + bias, np.tanh(u @ w + b) @ out + bias, 0.5)[0]

    assert after(200) < after(20) < after(1)


def test_sample_stays_bounded(spark):
    """Null ids, one id on many texts and copies neither fill the sample nor leave it empty."""
    own = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 3 != 1)
    rows = spark.range(3000).selectExpr(f"IF(id % 3 = 0, NULL, IF(id % 3 = 1, {own}L, id)) AS doc_id", "concat('text ', id, repeat(' word', int(id % 50))) AS text")
    rows = rows.union(spark.range(500).selectExpr(f"{own}L AS doc_id", "'same text' AS text"))
    labels = spark.range(3000).where("id % 3 = 2").selectExpr("id AS doc_id", "1 AS quality").union(spark.sql(f"SELECT CAST(NULL AS BIGINT), 1 UNION ALL SELECT {own}L, 1"))
    positive, unlabelled = quality_model.sampled(rows, labels, 100)
    assert len(positive) == 100 and 150 < len(unlabelled) <= 200
    same = quality_model.sampled(rows.repartition(7), labels, 100)
    assert (same[0] == positive).all() and (same[1] == unlabelled).all()


def test_classifier_on_empty_and_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "mine", "x"), (1, "other words", "mine", "y"), (None, None, "mine", None)], "doc_id bigint, text string, score string, predicted string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1)], "doc_id bigint, quality int")
    model = quality_model.train(docs, labels)
    rows = quality_model.score(docs, model).collect()
    assert len(rows) == 3 and all(isinstance(r.score, float) and r.predicted in (0, 1) for r in rows)
    assert quality_model.train(docs.limit(0), labels) is None and quality_model.score(docs.limit(0), None).count() == 0


def test_token_counts_of_an_empty_table(spark):
    assert tokens.count_tokens(spark.createDataFrame([], "doc_id bigint, text string"), queries.tokenizer_path()).count() == 0


def test_long_sequences_are_merged_by_ranks():
    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())
    rng = random.Random(6)
    texts = ["".join(rng.choice(s) for _ in range(n)) for s in ("ab", "abcdeinorst", "01-=", "漢字仮名") for n in (257, 3000, 20_000)]
    assert tokens.Counter(queries.tokenizer_path())(texts) == [len(x) for x in library.encode(texts)]


def test_places_by_rank_equal_merging_all_together():
    model = tokens.PieceModel(queries.tokenizer_path())
    rng = random.Random(8)
    for s in ("ab", "the", "abcdeinorst", "01-=", "漢字é🙂a", "a"):
        for n in (1, 2, 3, 50, 700, 4000):
            t = "".join(rng.choice(s) for _ in range(n))
            assert model.merged_long(t) == model.merged([t])[0]


def test_endless_words_take_no_quadratic_time():
    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())
    counter, rng = tokens.Counter(queries.tokenizer_path()), random.Random(4)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (40_000, 320_000)]
    seconds = []
    for t in texts:
        now = time.process_time()
        assert counter([t]) == [len(library.encode(t))]
        seconds.append(time.process_time() - now)
    assert seconds[1] < 24 * seconds[0], seconds


def test_models_that_change_texts_are_refused(monkeypatch):
    class Lowering:
        def encode(self, texts):
            return [[0]] * len(texts)

    real = tokens.PieceModel.__init__

    def loaded(self, path):
        real(self, path)
        self.library = Lowering()

    monkeypatch.setattr(tokens.PieceModel, "__init__", loaded)
    with pytest.raises(ValueError, match="changes texts"):
        tokens.Counter(queries.tokenizer_path())


def test_pipeline_on_odd_tables(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, copy_no string"
    rng = random.Random(9)
    text = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(80)) + "."
    a, b = text(), text()
    rows = [(1, a, "en", "s", 0, "c"), (1, b, "en", "s", 0, "c"), (1, a, "en", "s", 0, "c"), (None, text(), None, None, None, None)]
    items = spark.createDataFrame([], "item_id bigint, text string")
    for name, table in (("empty", []), ("odd", rows)):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(table, schema).write.parquet(f"{folder}/documents.parquet")
        items.write.parquet(f"{folder}/benchmark.parquet")
        now = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, folder)
            assert now.columns == schema.replace(" bigint", "").replace(" string", "").split(", ")
        assert sorted(r.text for r in now.collect() if r.doc_id) == (sorted([a, b]) if table else [])
        out = corpus_pipeline.run(spark, folder)
        assert out.columns.count("copy_no") == 1 and out.where("doc_id IS NULL AND text IS NULL").count() == 0
