from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from verdigris import config
from verdigris.functions import scores as S
from verdigris.functions import text as T
from verdigris.operators import corpus, detection, generation, metrics, order, paraphrasing, reshape, stability, vocabulary, windows

MARK = config.Watermark()


def spread(bits, size, stride):
    """Windows by walking over the characters."""
    out, start, n = [], 0, len(bits)
    while n:
        end = min(start + size, n)
        a, b = start, end
        while a > 0 and bits[a] == "1":
            a -= 1
        while b < n and bits[b - 1] == "1":
            b += 1
        out.append((a, b))
        if end == n:
            break
        start += stride
        if start >= n:
            break
    return out


GOLDEN = {
    ("1101100111", 4, 2): ([(0, 6), (2, 6), (2, 10), (6, 10)], [2.357023, 1.154701, 2.449490, 2.309401], [(2, 2), (2, 1), (3, 1), (3, 1)]),
    ("0000000000", 4, 2): ([(0, 4), (2, 6), (4, 8), (6, 10)], [-1.154701] * 4, [(0, 0)] * 4),
    ("1111111111", 4, 2): ([(0, 10)] * 4, [5.477226] * 4, [(10, 1)] * 4),
    ("0110100", 5, 10): ([(0, 6)], [1.414214], [(2, 1)]),
    ("", 50, 10): ([], [], []),
}


def found(spark, bits, size, stride, mode="clean"):
    df = spark.createDataFrame([(1, bits)], "id int, bits string")
    rows = windows.features(windows.windows(df, config.Windows(size, stride, mode)), 0.25).orderBy("win_idx").collect()
    return [(r.win_start, r.win_end) for r in rows], [round(r.z, 6) for r in rows], [(r.run, r.freq) for r in rows]


@pytest.mark.parametrize("case", GOLDEN)
def test_golden_windows(spark, case):
    assert found(spark, *case) == GOLDEN[case]


def test_literal_mode(spark):
    edges, z, runs = found(spark, "1101100111", 4, 2, "literal")
    assert edges == [(0, 4), (1, 6), (4, 8), (5, 10), (7, 12), (10, 14), (12, 16), (13, 18), (15, 19)]
    assert z == [1.154701, -0.258199, 0, 0.774597, -0.258199, -1.154701, 0, 0.774597, 1.154701]
    assert runs == [(4, 1), (3, 1), (3, 1), (5, 1), (3, 1), (1, 2), (3, 1), (5, 1), (4, 1)]
    assert found(spark, None, 50, 10, "literal") == ([(0, 3)], [-1.0], [(3, 1)])


def test_closed_form_against_walk(spark):
    import random

    rng = random.Random(4)
    rows = [(k, "".join(rng.choice("01") for _ in range(rng.randint(1, 130)))) for k in range(150)]
    df = spark.createDataFrame(rows, "id int, bits string")
    for size, stride in ((50, 10), (40, 5), (60, 15), (5, 10), (1, 1)):
        got = {}
        for r in windows.windows(df, config.Windows(size, stride)).collect():
            got.setdefault(r.id, {})[r.win_idx] = (r.win_start, r.win_end)
        for k, bits in rows:
            assert [got[k][i] for i in range(len(got[k]))] == spread(bits, size, stride)


def test_statistics(spark):
    df = spark.createDataFrame([(1, "1101100111"), (2, "0000000000"), (3, "0110100"), (4, "")], "id int, bits string")
    got = {r.id: r for part, shape in (("id <> 3", (4, 2)), ("id = 3", (5, 10))) for r in windows.rolling(df.where(part), config.Windows(*shape), 0.25, "id").collect()}
    near = lambda r, p, values: [getattr(r, f"{p}_{m}") for m in windows.MOMENTS] == pytest.approx(values, abs=1e-6)
    assert near(got[1], "z", [2.067653, 0.280365, 1.154701, 2.449490, -1.123096, -0.689763])
    assert near(got[1], "run", [2.5, 0.25, 2, 3, 0, -2]) and near(got[1], "freq", [1.25, 0.1875, 1, 2, 1.154701, -0.666667])
    assert (got[1].z_autocorr_lag1, got[1].z_autocorr_lag2) == pytest.approx((-0.464102, -0.098276), abs=1e-6)
    assert near(got[2], "z", [-1.154701, 0, -1.154701, -1.154701, 0, 0]) and near(got[2], "run", [0] * 6) and got[2].z_autocorr_lag1 == 0
    assert near(got[3], "z", [1.414214, 0, 1.414214, 1.414214, 0, 0]) and near(got[4], "z", [0] * 6)


def test_trimming_and_counts(spark):
    df = spark.createDataFrame([(None,), ("a  b",), ("a  b c",), ("",), (" \n",)], "text string")
    cut, n = T.trimmed(F.col("text"), 2)
    assert [tuple(r) for r in df.select(cut, n).collect()] == [("", 0), ("a  b", 2), ("a b", 2), ("", 0), (" \n", 0)]
    assert [r[0] for r in df.select(T.word_count(F.col("text"))).collect()] == [0, 2, 3, 0, 0]
    again, _ = T.trimmed(cut, 2)
    assert df.where(again != cut).count() == 0


def test_samples(spark):
    rows = [(1, "x\ny\na b c d e"), (2, "x\ny"), (3, "x\ny\n"), (4, None), (5, "a"), (6, "x\ny\na b c d")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    cut = config.Corpus(2, 5, None)
    ok = {r.doc_id: r.v for r in docs.select("doc_id", F.coalesce(corpus.viable(docs, cut), F.lit(False)).alias("v")).collect()}
    assert ok == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False}
    got = {(r.text_type, r.label): r.words for r in corpus.halves(docs, cut).collect()}
    assert got == {("human", 0): ["a", "b"], ("ai", 1): ["c", "d", "e"]}
    assert corpus.samples(docs, config.Corpus(0, 1, 2)).count() == 2
    assert corpus.length_variations(docs).count() == 24


def test_output_cleaner_and_budget(spark):
    df = spark.createDataFrame([("output:  x ",), (" OUTPUT: x",), ("a output: b",)], "t string")
    assert [r[0] for r in df.select(T.cleaned_output(F.col("t"))).collect()] == ["x", "OUTPUT: x", "a output: b"]
    assert tuple(df.select(*T.budget(F.lit(101))).first()) == (51, 151, 226)


def test_scores(spark):
    df = spark.createDataFrame([(50, 100), (0, 0)], "k int, n int")
    assert [round(r[0], 6) for r in df.select(S.z_score(F.col("k"), F.col("n"), 0.25)).collect()] == [5.773503, 0.0]
    p = spark.createDataFrame([(0.0,), (1.96,), (4.0,), (None,)], "z double").select(S.p_value("z")).collect()
    assert [r[0] for r in p[:3]] == pytest.approx([0.5, 0.0249979, 3.1671e-5], rel=1e-4) and p[3][0] is None


def test_detection(spark):
    df = spark.createDataFrame([("a", ["x", "y", "x", "y"]), ("b", ["x"]), ("c", []), ("d", None)], "id string, words array<string>")
    got = {r.id: r for r in detection.scored(df, MARK).collect()}
    want = [int(generation.green(a, b, MARK)) for a, b in (("x", "y"), ("y", "x"), ("x", "y"))]
    assert got["a"].bits == want and got["a"].num_green_tokens == sum(want)
    for k in "bcd":
        assert (got[k].bits, got[k].z_score, got[k].green_fraction, got[k].num_tokens_scored) == ([], 0.0, 0.0, 0)
    texts = df.select(F.lit(1).alias("doc_id"), F.col("id").alias("text_type"), "words").where("id = 'a'")
    assert detection.unique_bigram_scores(texts, MARK).first().num_tokens_scored == 2
    same = spark.createDataFrame([(1, "a b c d".split()), (1, "e f g h e f".split()), (1, "e f g h e f".split()), (2, ["x"]), (3, None)], "doc_id int, words array<string>")
    assert sorted(r.num_tokens_scored for r in detection.unique_bigram_scores(same, MARK).collect()) == [0, 0, 3, 4, 4]
    z = spark.createDataFrame([(4.0,), (4.1,)], "z_score double")
    assert [r.prediction for r in detection.predicted(z, MARK).collect()] == [False, True]
    assert [r.prediction for r in detection.predicted(z, MARK, threshold=0).collect()] == [False, True]
    assert detection.text_column(spark.createDataFrame([(1, "")], "id int, my_Text string")) == "my_Text"
    assert detection.text_column(spark.createDataFrame([(1, "")], "doc_id int, paraphrase_iter_3 string")) == "paraphrase_iter_3"
    assert detection.text_column(spark.createDataFrame([(1, "")], "doc_id int, content string")) == "doc_id"
    file = detection.detection_file(spark.createDataFrame([("a b",), (None,)], "original_text string"), MARK).collect()
    assert [(r.watermark_bits, r.num_tokens_scored) for r in file][1] == ("", 0) and file[0].num_tokens_scored == 1  # null is the word nan
    odd = detection.detection_file(spark.createDataFrame([("a b",), ("bad c",)], "text string"), MARK, tokenize=lambda t: F.when(~t.startswith("bad"), F.split(t, " "))).collect()
    assert [(r.watermark_bits == "ERROR", r.num_tokens_scored) for r in odd] == [(False, 1), (True, 0)]
    pieces = detection.detection_file(spark.createDataFrame([("abcd",)], "text string"), MARK, tokenize=lambda t: F.split(t, "")).first()
    assert pieces.num_tokens_scored == 3


def test_upper_end_of_the_lists(spark):
    other = replace(MARK, select_green_tokens=False)
    words = [f"w{k}" for k in range(4000)]
    df = spark.createDataFrame([(words,)], "words array<string>")
    low, high = (detection.scored(df, m).first().bits for m in (MARK, other))
    assert high == [int(generation.green(a, b, other)) for a, b in zip(words, words[1:])] and abs(sum(high) / 3999 - 0.25) < 0.03
    assert not any(a and b for a, b in zip(low, high))


def test_exact_lists_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(vocabulary, "RANGES", 8)
    import hashlib

    tokens = [f"t{k}" for k in range(203)]
    vocab, prev = spark.createDataFrame([(t,) for t in tokens], "token string"), spark.createDataFrame([("p",), ("q",), ("p",), (None,)], "prev string")
    for mark in (MARK, replace(MARK, select_green_tokens=False), replace(MARK, gamma=0.999)):
        got = {(r.prev, r.token) for r in vocabulary.greenlists(prev, vocab, mark).collect()}
        n = int(203 * mark.gamma)
        for p in "pq":
            order = sorted(tokens, key=lambda t: (hashlib.md5(f"{mark.hash_key}:{p}:{t}".encode()).hexdigest()[:8], t))
            assert {t for x, t in got if x == p} == set(order[:n] if mark.select_green_tokens else order[203 - n :])
        assert len(got) == 2 * n
    assert vocabulary.greenlists(prev, vocab.limit(0), MARK).count() == 0


def test_green_share_and_lists(spark):
    pairs = spark.range(20_000).select(S.is_green(F.col("id") % 100, F.col("id"), MARK.hash_key, 0.25).alias("g"))
    assert abs(pairs.where("g").count() / 20_000 - 0.25) < 0.02
    vocab = spark.createDataFrame([(str(k),) for k in range(203)], "token string")
    contexts = spark.createDataFrame([(str(k),) for k in range(5)], "prev string")
    first = vocabulary.greenlists(contexts, vocab, MARK).groupBy("prev").count().collect()
    assert {r["count"] for r in first} == {50}
    last = vocabulary.greenlists(contexts, vocab, replace(MARK, select_green_tokens=False))
    assert last.join(vocabulary.greenlists(contexts, vocab, MARK), ["prev", "token"]).count() == 0 and last.count() == 250


def test_generated_text_is_detected(spark):
    words = [f"w{k % 37}" for k in range(120)]
    prompts = spark.createDataFrame([(1, words), (2, [])], "doc_id bigint, words array<string>")
    plain = detection.scored(prompts, MARK).where("doc_id = 1").first().z_score
    rows = {r.doc_id: r for r in generation.generated(prompts, lambda: generation.PromptSampler(replace(MARK, delta=5.0)), 200, MARK).collect()}
    assert rows[1].generated_word_count == 200 and rows[1].z_score > plain + 5 and rows[2].generated_word_count == 0


def test_rounds_reshape_and_resume(spark):
    texts = spark.createDataFrame([(1, "ai", 1, ["a"] * 50), (1, "human", 0, ["b"] * 50), (2, "ai", 1, ["c"])], "doc_id bigint, text_type string, label int, words array<string>")
    para = config.Paraphrase(3, 50, 0.3)
    deep = paraphrasing.rounds(texts, para)
    changed = {(r.doc_id, r.text_type, r.depth): sum(w.startswith("w") for w in r.words) for r in deep.collect()}
    assert len(changed) == 12 and changed[1, "ai", 0] == 0 < changed[1, "ai", 1] <= changed[1, "ai", 2] <= changed[1, "ai", 3]
    wide = paraphrasing.wide(deep, 3)
    back = reshape.unpivoted(wide, 3).collect()
    assert {(r.doc_id, r.text_type, r.depth, r.text) for r in back} == {(r.doc_id, r.text_type, r.depth, " ".join(r.words)) for r in deep.collect()}
    assert tuple(paraphrasing.resume_point(wide, 3).first()) == (3, None)
    holes = wide.withColumn("paraphrase_iter_2", F.when(F.col("doc_id") == 1, F.col("paraphrase_iter_2")))
    assert tuple(paraphrasing.resume_point(holes, 3).first()) == (1, 2)
    ids = {(r.doc_id, r.text_type): r.id for r in reshape.sequential_ids(texts).collect()}
    assert ids == {(1, "ai"): 1, (2, "ai"): 2, (1, "human"): 3}
    counts = reshape.counts_by_depth(deep.select("depth", "label")).collect()
    assert {(r.n, r.n_ai, r.n_human, r.consistent) for r in counts} == {(3, 2, 1, True)}


def test_model_rounds(spark):
    class Echo:
        def transform(self, batch):
            return "OUTPUT: " + batch["prompt"].str.split("\n\n").str[1].str.replace(" [/INST]", " more", regex=False)

    df = spark.createDataFrame([(1, "one two"), (2, None)], "id int, text string")
    rows = {r.id: r for r in paraphrasing.with_model(df, Echo, config.Paraphrase(2)).collect()}
    assert rows[1].paraphrase_iter_2 == "one two more more" and rows[1].word_count_iter_2 == 4 and rows[2].paraphrase_iter_1 is None


def test_merging_and_labelling(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    b = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    got = {r.k: (r.v_x, r.v_y) for r in reshape.merged([a, b], "k").collect()}
    assert got == {1: ("a", None), 2: ("b", "c"), 3: (None, "d")}
    assert reshape.merged([a, b.withColumn("w", F.lit(1))]).count() == 4 and reshape.merged([]) is None
    deep = spark.createDataFrame([(0,), (1,)], "depth int")
    assert reshape.labelled(deep, deep.where("depth = 1")).count() == 2


def test_stability_and_metrics(spark):
    rows = [(d, 1, 0, float(z)) for d, z in zip((1, 2, 3), (1, 2, 4))] + [(d, 1, 1, 5.0) for d in (1, 2, 3)] + [(d, 1, 2, 1.0) for d in (1, 3)]
    wins = spark.createDataFrame(rows, "depth int, id bigint, win_idx int, z double")
    pss = {r.win_idx: r.pss for r in stability.matrix(wins, [("x", (1, 2, 3))]).collect()}
    assert pss == {0: pytest.approx(1.247219, abs=1e-6), 1: 0.0, 2: 0.0}
    assert stability.common_windows(wins).first().n_windows == 2
    table = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, 0.4), (0, 0.4), (0, 0.3)], "label int, p double")
    auc = metrics.roc_auc(table, "p").first().auc
    assert auc == pytest.approx(0.916667, abs=1e-6)
    assert metrics.roc_auc(table.withColumn("p", -F.col("p")), "p").first().auc == pytest.approx(1 - auc)
    judged = table.withColumn("prediction", (F.col("p") >= 0.4).cast("int"))
    assert metrics.confusion(judged).first()[0] == [[2, 1], [0, 2]]
    r = metrics.rates(metrics.cells(judged)).first()
    assert (r.accuracy, r.recall, round(r.precision, 4), round(r.f1, 4)) == (0.8, 1.0, 0.6667, 0.8)
    none = metrics.rates(metrics.cells(judged.limit(0))).first()
    assert none.f1 == 0.0
    best = spark.createDataFrame([("a", 0, 1.0), ("b", 1, 2.0), ("c", 2, 2.0)], "experiment string, position int, f1 double")
    assert metrics.best(best, "f1").first().experiment == "b"


def test_split_is_stratified(spark):
    table = spark.range(1, 101).select("id", (F.col("id") <= 30).cast("int").alias("label"))
    test = stability.split(table, config.Classifier()).where("is_test").groupBy("label").count().collect()
    assert {r.label: r["count"] for r in test} == {1: 9, 0: 21}


def test_running_totals(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v"))
    assert order.ranked(df, [F.col("v").asc()], "n").where("n <> v + 1").count() == 0
    assert order.ranked(df.limit(0), [F.col("v").asc()], "n").count() == 0



def test_settings(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("dataset:\n  word_per_sample: 7\nwatermark_model:\n  watermark_params:\n    gamma: 0.5\n    seeding_scheme: simple_1\nrolling:\n  window_size: 40\n  stride: 5\n")
    s = config.load(path)
    assert (s.corpus.words_per_sample, s.watermark.gamma, s.windows.size, s.windows.stride) == (7, 0.5, 40, 5)
    config.save(s, tmp_path / "d.yaml")
    assert config.load(tmp_path / "d.yaml") == s
    with pytest.raises(NotImplementedError):
        config.Watermark(scheme="other")
    assert len(config.EXPERIMENTS) == 13 and config.EXPERIMENTS[1] == ("D1-D2-D3", (1, 2, 3)) and config.EXPERIMENTS[-1] == ("D7-D8", (7, 8))
