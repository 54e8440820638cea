"""The command line from corpus to results, streaming detection, sources and sinks."""

import random
import zipfile

import pytest
from pyspark.sql import functions as F

from verdigris import cli, config, utilities
from verdigris.sources import storage
from verdigris.streaming import ingest


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(1)
    rows = [(i, "head\nhead\n" + " ".join(f"w{rng.randrange(60)}" for _ in range(130))) for i in range(30)]
    path = str(tmp_path_factory.mktemp("c") / "docs")
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(path)
    return path


def test_command_line(spark, corpus, tmp_path):
    (tmp_path / "e.yaml").write_text("skip_lines: 2\nwords_per_sample: 120\nn_estimators: 3\nmax_depth: 3\n")
    common = ["--output", str(tmp_path / "out"), "--exp-config", str(tmp_path / "e.yaml")]
    cli.main(["pipeline", *common, "--input", corpus, "--window-size", "20", "--stride", "5", "--iterations", "3", "--new-words", "20", "--create-variations"])
    out = lambda name: spark.read.parquet(f"{tmp_path}/out/{name}")
    assert out("halves").count() == 60 and out("depths").count() == 240 and out("combined").count() == 240
    assert out("watermarked").count() == 30 and out("variations").count() == 240
    results = spark.read.options(header="true").csv(f"{tmp_path}/out/results").collect()
    assert results[0].asDict().keys() == {"Experiment", "AUC", "Precision", "Recall", "F1", "ConfusionMatrix", "Accuracy"} and results[0].ConfusionMatrix.startswith("[[")
    assert {r.Experiment for r in results} == {n for n, d in config.EXPERIMENTS if len([x for x in d if x <= 3]) > 1}
    cli.main(["watermark", *common, "--new-words", "20"])  # nothing is left to do
    assert spark.read.parquet(f"{tmp_path}/out/watermarked").count() == 30
    cli.main(["analyze", *common, "--skip-combine", "--skip-rolling"])
    cli.main(["detect", *common, "--csv"])  # nothing is left to do, too
    assert out("detected").count() == 240
    cli.main(["pipeline", *common, "--csv", "--input", corpus, "--window-size", "20", "--stride", "5", "--steps", "combine", "rolling"])
    back = cli.read_combined(spark, str(tmp_path / "out" / "csv"), [0, 1, 2, 3])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, out("combined").select(*back.columns).collect()))
    files = {p.name for p in (tmp_path / "out" / "csv").iterdir()}
    assert {"AI_D0.csv", "Human_D3.csv", "combined_D2.csv", "rolling_D1.csv"} <= files
    assert "z_score_1" in spark.read.options(header="true").csv(str(tmp_path / "out" / "csv" / "rolling_D1.csv")).columns


FAILING = '''
class Failing:
    """A paraphraser that can't do with texts that hold a certain word."""

    def transform(self, batch):
        if batch["prompt"].str.contains("poison").any():
            raise RuntimeError("no such text")
        return batch["prompt"].str.len().map(lambda n: f"Output: {n} words")
'''


def test_paraphrase_by_a_model(spark, tmp_path):
    (tmp_path / "failing_model.py").write_text(FAILING)
    spark.sparkContext.addPyFile(str(tmp_path / "failing_model.py"))
    rows = [(2**53 + 1, "ai", 1, ["good", "text"]), (None, "ai", 1, ["poison"]), (3, "human", 0, ["fine"])]
    spark.createDataFrame(rows, "doc_id bigint, text_type string, label int, words array<string>").write.parquet(f"{tmp_path}/out/halves")
    cli.main(["paraphrase", "--output", f"{tmp_path}/out", "--iterations", "2", "--text-type", "ai", "--model-path", "failing_model:Failing", "--csv"])
    got = spark.read.parquet(f"{tmp_path}/out/depths").collect()
    assert {r.doc_id for r in got} == {2**53 + 1, None} and len(got) == 6
    assert " ".join(next(r.words for r in got if r.depth == 1 and r.doc_id is None)) == "ERROR: no such text"


def test_missing_input_and_helpers(tmp_path, spark, capsys):
    cli.main(["dataset", "--output", str(tmp_path / "o"), "--input", str(tmp_path / "none" / "*")])
    assert "nothing at" in capsys.readouterr().err and not (tmp_path / "o").exists()
    log = utilities.setup_logging(tmp_path / "logs", name="test")
    log.info("hello")
    assert "hello" in next((tmp_path / "logs").iterdir()).read_text()
    utilities.ensure_directories(tmp_path / "a" / "b", tmp_path / "c")
    assert (tmp_path / "a" / "b").is_dir() and utilities.cleanup_temp_files(tmp_path / "a") and not utilities.cleanup_temp_files(tmp_path / "a")
    assert utilities.get_device() in ("cpu", "cuda") and utilities.get_memory_usage()["rss_mb"] > 1
    (tmp_path / "k.json").write_text('{"username": "u", "key": "k"}')
    assert utilities.setup_download_credentials(tmp_path / "k.json", tmp_path).stat().st_mode & 0o777 == 0o600


def test_streaming_detection(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    run = lambda: ingest.detect_stream(ingest.text_stream(spark, str(folder)), config.Watermark(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    (folder / "a.txt").write_text("one two three")
    run()
    (folder / "b.txt").write_text("four five")
    run()
    run()
    got = {r.filename: r.num_tokens_scored for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a.txt": 2, "b.txt": 1} and spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_prose_survives_csv(spark, tmp_path):
    rows = [(1, 'say "hi",\nthen go'), (2, "plain"), (3, "a,b\n\n\"c\"")]
    df = spark.createDataFrame(rows, "id bigint, text string")
    storage.write_csv(df, str(tmp_path / "x"), single=True)
    assert sorted(map(tuple, storage.read_csv(spark, str(tmp_path / "x"), df.schema).collect())) == rows


def test_sources(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("train/a.txt", "A\nb")
        z.writestr("test/b.txt", "B")
    got = storage.read_zipped_texts(spark, str(tmp_path / "z.zip"), "train/").collect()
    assert [(r.filename, r.text) for r in got] == [("a.txt", "A\nb")]
    (tmp_path / "t.txt").write_text("x\ny")
    assert tuple(storage.read_texts(spark, str(tmp_path / "*.txt")).first()) == ("t.txt", "x\ny")
    storage.save_state({"row": 3}, tmp_path / "s.json")
    assert storage.load_state(tmp_path / "s.json") == {"row": 3} and storage.load_state(tmp_path / "none") is None
    assert storage.file_md5(tmp_path / "t.txt") == spark.range(1).select(F.md5(F.lit("x\ny"))).first()[0]


def test_resumed_appends(spark, tmp_path):
    df, path = spark.range(10), str(tmp_path / "done")
    storage.append_new(df.where("id < 4"), path, lambda d: d)
    seen = []
    storage.append_new(df, path, lambda d: seen.append(d.count()) or d)
    assert seen == [6] and spark.read.parquet(path).count() == 10
