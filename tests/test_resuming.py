"""Rounds by a model that dies: what was saved is not asked again. A tokenizer on the command line."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from verdigris import cli
from verdigris.config import Paraphrase
from verdigris.operators import paraphrasing

MODEL = """
import os

FOLDER = {folder!r}


class Mortal:
    '''Writes down what it is asked, adds a word, and dies in the third round while told so.'''

    def transform(self, batch):
        texts = batch["prompt"].str.extract(r"(?s)words\\.\\n\\n(.*) \\[/INST\\]")[0]
        with open(FOLDER + "/asked", "a") as f:
            f.write("".join(t + "\\n" for t in texts))
        if os.path.exists(FOLDER + "/die") and any(t.endswith("x x") and int(t.split()[0][1:]) >= 20 for t in texts):
            os._exit(1)
        return texts + " x"


def split_words():
    return lambda texts: [t.split() if "bad" not in t else 1 / 0 for t in texts]
"""


@pytest.fixture
def model(spark, tmp_path):
    name = "mortal_" + re.sub(r"\W", "_", tmp_path.name)
    (tmp_path / f"{name}.py").write_text(MODEL.format(folder=str(tmp_path)).replace("\\\\", "\\"))
    spark.sparkContext.addPyFile(str(tmp_path / f"{name}.py"))
    return name


def asked(tmp_path):
    return Counter((tmp_path / "asked").read_text().split("\n")[:-1])


def texts(spark, n):
    return spark.createDataFrame([(k, "ai" if k % 2 else "human", k % 2, f"t{k} word") for k in range(n)], "doc_id bigint, text_type string, label int, text string").coalesce(2)


def test_rounds_go_on_where_they_stopped(spark, tmp_path, model):
    path, settings = str(tmp_path / "rounds"), Paraphrase(iterations=4)
    run = lambda n: paraphrasing.resumed_rounds(texts(spark, n), path, cli.factory(f"{model}:Mortal"), settings, batch_size=3, slices=4)
    (tmp_path / "die").touch()
    with pytest.raises(Exception):
        run(40)
    saved = {r.text for r in spark.read.parquet(path).collect()}
    assert any(t.endswith("word x x") for t in saved) and not all(f"t{k} word x x x" in saved for k in range(40))
    before = asked(tmp_path)
    (tmp_path / "die").unlink()
    rows = run(40).collect()
    again = asked(tmp_path) - before
    done = {t.removesuffix(" x") for t in saved if t.endswith(" x")}  # what saved answers were asked for
    assert not done & set(again) and max(again.values()) == 1
    assert sorted((r.doc_id, r.depth, r.text, r.word_count) for r in rows) == [(k, d, f"t{k} word" + " x" * d, 2 + d) for k in range(40) for d in range(5)]
    assert all(r.label == (r.text_type == "ai") for r in rows)
    last = asked(tmp_path)
    assert run(40).count() == 200 and asked(tmp_path) == last  # only read
    assert run(44).count() == 220 and sum((asked(tmp_path) - last).values()) == 16  # new texts in all rounds
    wide = {r.doc_id: r for r in paraphrasing.wide_texts(run(44), 4).collect()}
    assert wide[43].paraphrase_iter_4 == "t43 word x x x x" and wide[43].word_count_iter_4 == 6


def test_nulls_in_rounds(spark, tmp_path, model):
    rows = [(None, "ai", 1, "t1 a"), (2**53 + 1, "ai", 1, None), (3, "ai", 1, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text_type string, label int, text string")
    run = lambda: paraphrasing.resumed_rounds(df, str(tmp_path / "r"), cli.factory(f"{model}:Mortal"), Paraphrase(iterations=2), slices=2)
    first = sorted(map(str, run().collect()))
    n = asked(tmp_path)
    assert sorted(map(str, run().collect())) == first and len(first) == 9 and asked(tmp_path) == n
    assert {r.text for r in run().where("doc_id > 5").collect()} == {None}


def test_command_line_with_a_tokenizer(spark, tmp_path, model):
    words = [["a", "b", "c"], ["bad", "d"], ["e"]]
    spark.createDataFrame([(k, "ai", 1, 0, w) for k, w in enumerate(words)], "doc_id bigint, text_type string, label int, depth int, words array<string>").write.partitionBy("text_type", "depth").parquet(f"{tmp_path}/out/depths")
    cli.main(["detect", "--output", f"{tmp_path}/out", "--tokenizer", f"{model}:split_words", "--csv"])
    got = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/out/detected").collect()}
    assert got[0].num_tokens_scored == 2 and got[0].error is None and got[1].error.startswith("ZeroDivisionError") and got[1].bits == ""
    file = {r.doc_id: r.watermark_bits for r in spark.read.options(header="true").csv(f"{tmp_path}/out/csv/AI_D0.csv").collect()}
    assert file["1"] == "ERROR" and file["0"].count(",") == 1


def test_command_line_resumes_rounds(spark, tmp_path, model):
    spark.createDataFrame([(k, "ai", 1, [f"t{k}", "w"]) for k in range(6)], "doc_id bigint, text_type string, label int, words array<string>").write.parquet(f"{tmp_path}/out/halves")
    flags = ["paraphrase", "--output", f"{tmp_path}/out", "--iterations", "2", "--model-path", f"{model}:Mortal"]
    cli.main(flags)
    first = asked(tmp_path)
    cli.main(flags)
    assert asked(tmp_path) == first and sum(first.values()) == 12
    assert spark.read.parquet(f"{tmp_path}/out/depths").where(F.size("words") == F.col("depth") + 2).count() == 18
    cli.main([*flags, "--force-restart"])
    assert sum(asked(tmp_path).values()) == 24 and spark.read.parquet(f"{tmp_path}/out/depths").count() == 18
