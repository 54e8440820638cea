"""Decoding in steps: against one row at a time, the biased logits of the columns, marks that show."""

import inspect
import sys
from dataclasses import replace

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from verdigris import cli
from verdigris.config import Watermark
from verdigris.functions import scores as S
from verdigris.operators import decoding, detection, vocabulary

cloudpickle.register_pickle_by_value(sys.modules[__name__])
MARK = Watermark(delta=4.0)
WORDS = [f"t{k}" for k in range(60)]


class Toy:
    """Logits that depend on the whole text so far, which it remembers by row; ends now and then."""

    vocabulary, end, unknown = WORDS, 7, 5

    def begin(self, prompts):
        self.seen = [p.tolist()[:-1] for p in prompts]

    def step(self, rows, tokens):
        out = np.zeros((len(rows), len(WORDS)))
        for k, (r, t) in enumerate(zip(rows.tolist(), tokens.tolist())):
            self.seen[r].append(t)
            out[k] = np.sin(np.arange(len(WORDS)) * (1 + sum(self.seen[r]) % 13)) * 2
            out[k, 7] -= 2
        return out


def toy():
    return Toy()


def one_by_one(model, prompt, length, mark, seed, temperature):
    """Plain decoding of one row, a token at a time, with the lists' own definition."""
    out, text = [], list(prompt)
    green = lambda a, b: decoding.generation.green(WORDS[a], WORDS[b], mark)
    if not prompt:
        return []
    model.begin([np.array(prompt)])
    for step in range(length):
        logits = model.step(np.array([0]), np.array([text[-1]]))[0]
        scores = np.array([x + (mark.delta if green(text[-1], t) else 0.0) for t, x in enumerate(logits)])
        if temperature:
            scores = scores / temperature + decoding._noise(seed, step, len(WORDS))
        best = max(range(len(WORDS)), key=lambda t: (scores[t], -t))
        if best == model.end:
            break
        text.append(best)
        out.append(best)
    return out


@pytest.mark.parametrize("temperature", [0.0, 1.0, 0.7])
@pytest.mark.parametrize("front", [True, False])
def test_batches_against_one_row(temperature, front):
    mark = replace(MARK, select_green_tokens=front)
    rng = np.random.default_rng(2)
    prompts = [rng.integers(0, 60, n) for n in rng.integers(0, 9, 40)]
    seeds = [decoding.seed_of(k) for k in range(40)]
    got = decoding.decode(Toy(), prompts, 25, decoding.Bias(mark, WORDS), seeds, temperature)
    assert [g.tolist() for g in got] == [one_by_one(Toy(), p.tolist(), 25, mark, s, temperature) for p, s in zip(prompts, seeds)]
    assert len({len(g) for g in got}) > 1 and all(7 not in g for g in got)
    assert all(len(g) == 0 for g in decoding.decode(Toy(), prompts, 0, None, seeds))
    assert decoding.decode(Toy(), [], 5, None, []) == []


def test_bias_is_that_of_the_columns(spark):
    df = spark.createDataFrame([("d", "x", WORDS[:20] * 3)], "doc_id string, text_type string, words array<string>")
    rows = vocabulary.biased_logits(vocabulary.corpus_bigrams(df), MARK).collect()
    bias = decoding.Bias(MARK, WORDS)
    for r in rows:
        logits = np.full((1, 60), r.logit)
        assert bias(logits, np.array([WORDS.index(r.prev)]))[0, WORDS.index(r.token)] == pytest.approx(r.biased)
    for front in (True, False):
        mark = replace(MARK, select_green_tokens=front)
        pairs = spark.createDataFrame([(a, b, WORDS.index(b)) for a in WORDS[:9] for b in WORDS], "prev string, token string, id int")
        for exact, column in ((False, S.is_green(F.col("prev"), F.col("token"), mark.hash_key, mark.gamma, front)), (True, vocabulary.exact_green(F.col("prev"), F.col("id"), 60, mark))):
            masks = decoding.Bias(mark, WORDS, exact).masks(np.arange(9))
            assert {(r.prev, r.token): r.g for r in pairs.select("prev", "token", column.alias("g")).collect()} == {(WORDS[a], WORDS[b]): bool(masks[a, b]) for a in range(9) for b in range(60)}
            assert not exact or (masks.sum(1) == 15).all()


def test_masks_are_forgotten(monkeypatch):
    monkeypatch.setattr(decoding, "MASKS", 3)
    bias = decoding.Bias(MARK, WORDS)
    first = bias.masks(np.array([4, 9, 4]))
    bias.masks(np.arange(20))
    assert len(bias._masks) == 3 and (bias.masks(np.array([4, 9, 4])) == first).all()


def test_decoded_rows(spark):
    rows = [(2**53 + 1, ["t1", "other", "t2"]), (None, ["t3"]), (4, []), (5, None), (6, ["none", "of", "these"])]
    rows += [(k, [f"t{k % 60}", "t9"]) for k in range(100, 180)]
    df = spark.createDataFrame(rows, "doc_id bigint, words array<string>")
    alone = {r.doc_id: r for r in decoding.decoded(df.repartition(8), toy, 30, MARK).collect()}
    for r in decoding.decoded(df.coalesce(1), toy, 30, MARK).collect():
        assert alone[r.doc_id] == r
    assert alone[4].generated_text == "" == alone[5].generated_text and alone[6].generated_word_count > 0
    assert alone[2**53 + 1].original_text == "t1 other t2" and set(alone) == {r[0] for r in rows}


def test_marks_show_and_cost_little(spark):
    texts = spark.createDataFrame([(k, [f"w{(k * j * j + j) % 97}" for j in range(80)]) for k in range(40)], "doc_id bigint, words array<string>")
    model = decoding.corpus_model(texts, words=90, followers=20)
    assert len(model.vocabulary) == 90 and max(len(i) for i, _ in model.follow.values()) <= 20
    by = {}
    for name, mark in (("marked", MARK), ("plain", replace(MARK, delta=0.0))):
        rows = decoding.decoded(texts, lambda: model, 80, mark)
        new = detection.scored_texts(rows.select("generated_text"), MARK, "generated_text").collect()
        ids = {t: k for k, t in enumerate(model.vocabulary)}
        by[name] = np.mean([r.z_score for r in new]), decoding.perplexity(model, [np.array([ids[w] for w in r.generated_text.split()]) for r in new])
    assert by["marked"][0] > 4 and abs(by["plain"][0]) < 1.5
    assert by["marked"][1] > by["plain"][1] > 1
    assert decoding.corpus_model(texts.limit(0)).vocabulary == ["nothing"]


def test_command_line_takes_a_model(spark, tmp_path):
    (tmp_path / "step_model.py").write_text(f"import numpy as np\n\nWORDS = {WORDS!r}\n\n\n" + inspect.getsource(Toy))
    spark.sparkContext.addPyFile(str(tmp_path / "step_model.py"))
    spark.createDataFrame([(k, "ai", 1, [f"t{k}"]) for k in range(9)], "doc_id bigint, text_type string, label int, words array<string>").write.parquet(f"{tmp_path}/out/halves")
    cli.main(["watermark", "--output", f"{tmp_path}/out", "--new-words", "12", "--model-path", "step_model:Toy", "--generator-kind", "step"])
    got = {r.doc_id: r.generated_text for r in spark.read.parquet(f"{tmp_path}/out/watermarked").collect()}
    mark = Watermark()
    assert got == {k: " ".join(WORDS[t] for t in one_by_one(Toy(), [k], 12, mark, decoding.seed_of(k), 1.0)) for k in range(9)}


class Pairs:
    """Logits of the latest token alone; counts what it is asked."""

    vocabulary, end, unknown, asked = WORDS, None, 5, 0

    def begin(self, prompts):
        pass

    def step(self, rows, tokens):
        self.asked += len(rows)
        out = np.sin(np.outer(1 + tokens, np.arange(len(WORDS)))) * 3
        out[:, 11], out[:, 12], out[:, 13] = -np.inf, -2000.0, out[:, 14]
        return out


@pytest.mark.parametrize("room", [64_000_000, 16 * len(WORDS) * 5])
def test_a_model_of_pairs_is_asked_once_for_a_token(monkeypatch, room):
    monkeypatch.setattr(decoding, "SCORES", room)
    rng = np.random.default_rng(3)
    prompts, seeds = [rng.integers(0, 60, 4) for _ in range(90)], [decoding.seed_of(k) for k in range(90)]
    expected = [one_by_one(Pairs(), p.tolist(), 20, MARK, s, 0.7) for p, s in zip(prompts, seeds)]
    bias = decoding.Bias(MARK, WORDS)
    plain, known = Pairs(), Pairs()
    known.of_pairs = True
    asked = decoding.Asked(known, bias, 0.7)
    for at in range(0, 90, 30):
        part = slice(at, at + 30)
        assert [g.tolist() for g in decoding.decode(known, prompts[part], 20, bias, seeds[part], 0.7, asked)] == expected[part]
    assert [g.tolist() for g in decoding.decode(plain, prompts, 20, bias, seeds, 0.7)] == expected
    assert plain.asked == 90 * 20 and known.asked <= (60 if room > 10**6 else 90 * 20) and len(asked._kept) <= room // (16 * 60)


def test_draws_are_the_largest_sums():
    rng = np.random.default_rng(4)
    draw = decoding.Draws(500)
    for k in range(400):
        scores = rng.normal(0, rng.choice([0.0, 1.0, 30.0, 2000.0]), 500)
        scores[rng.integers(0, 500, 9)] = rng.choice([-np.inf, scores.max(), 0.0] if k % 50 else [np.inf, np.nan])
        seed = int(rng.integers(0, 2**64, dtype=np.uint64))
        with np.errstate(invalid="ignore"):
            assert draw(decoding.Scores(scores, 1.0), seed, k) == (scores + decoding._noise(seed, k, 500)).argmax()


def test_masks_outlive_a_task_and_pairs_are_counted_as_ids(spark, monkeypatch):
    assert decoding.bias_of(MARK, list(WORDS)) is decoding.bias_of(replace(MARK), tuple(WORDS)) is not decoding.bias_of(MARK, WORDS, exact=True)
    texts = spark.createDataFrame([(k, [f"w{(k * j * j + j) % 97}" for j in range(30)]) for k in range(20)] + [(90, []), (91, ["w1"]), (92, None)], "doc_id bigint, words array<string>")
    count, seen = {}, {}
    for r in texts.collect():
        for w in r.words or []:
            seen[w] = seen.get(w, 0) + 1
        for pair in zip(r.words or [], (r.words or [])[1:]):
            count[pair] = count.get(pair, 0) + 1
    top = sorted(seen, key=lambda w: (-seen[w], w))[:40]
    model = decoding.corpus_model(texts, words=40, followers=3)
    assert model.vocabulary == top
    for a, w in enumerate(top):
        best = sorted((-count[w, x], b) for b, x in enumerate(top) if (w, x) in count)[:3]
        assert (a in model.follow) == bool(best)
        if best:
            total = -sum(n for n, _ in best)
            assert {int(b): float(s) for b, s in zip(*model.follow[a])} == {b: -n / total for n, b in best}
