"""The two jobs: a growing feed, a broken batch, repeated runs, the command line; and the operators that they added."""

import logging
import os
import subprocess
import sys
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import screen_feed, stability_study
from jobs.common import settings_of
from verdigris.config import Corpus, Paraphrase, Settings, Watermark, Windows
from verdigris.operators import metrics, stability, windows

REPO = Path(__file__).resolve().parents[1]
FEED = Settings(watermark=Watermark(z_threshold=1.0), windows=Windows(10, 3))
HOT = screen_feed.Feed(hot_window_z=1.0, files_per_batch=2)


def docs(spark, ids):
    texts = lambda i: None if i % 7 == 3 else " ".join(f"w{(i * k) % 31}" for k in range(i * 5 % 160))
    return spark.createDataFrame([(i, texts(i), None if i % 5 == 0 else "en" if i % 2 else "10", f"s{i % 3}") for i in ids], screen_feed.FEED)


def add(spark, folder, ids):
    docs(spark, ids).coalesce(1).write.mode("append").parquet(folder)


def output(spark, out):
    return sorted(map(str, screen_feed.read_back(spark, out).select([F.round(c, 9).alias(c) if t == "double" else c for c, t in screen_feed.read_back(spark, out).dtypes]).collect()))


def files(folder):
    return {str(p): p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}


def test_a_feed_that_grows(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO)
    feed, out, state = (str(tmp_path / n) for n in ("feed", "out", "state"))
    run = lambda o=out, s=state: screen_feed.run(spark, feed, o, s, FEED, HOT)
    run()  # nothing is there yet
    assert output(spark, out) == []
    for ids in (range(0, 20), range(20, 40), range(40, 60)):
        add(spark, feed, ids)
    run()
    first, scores = output(spark, out), files(f"{out}/scores")
    assert sum("part='score'" in r for r in first) == 60
    run()  # nothing new
    assert output(spark, out) == first and files(f"{out}/scores") == scores
    add(spark, feed, range(60, 75))
    run()
    grown = files(f"{out}/scores")
    assert scores.items() < grown.items() and "read 15 new rows" in caplog.text
    run(str(tmp_path / "all"), str(tmp_path / "fresh"))
    assert output(spark, out) == output(spark, str(tmp_path / "all"))
    rows = screen_feed.read_back(spark, out).where("part = 'score'").collect()
    assert len(rows) == 75 and {r.lang for r in rows} == {None, "en", "10"}
    assert all(r.peak_z is None and r.num_tokens_scored == 0 for r in rows if r.doc_id % 7 == 3)


def test_a_batch_that_breaks_is_run_again(spark, tmp_path, monkeypatch):
    feed, out, state = (str(tmp_path / n) for n in ("feed", "out", "state"))
    for ids in (range(0, 10), range(10, 20), range(20, 30)):
        add(spark, feed, ids)
    kept, calls = screen_feed.totals, []

    def breaking(scores):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return kept(scores)

    monkeypatch.setattr(screen_feed, "totals", breaking)
    with pytest.raises(Exception, match="lost"):
        screen_feed.run(spark, feed, out, state, FEED, HOT)
    screen_feed.run(spark, feed, out, state, FEED, HOT)
    monkeypatch.setattr(screen_feed, "totals", kept)
    screen_feed.run(spark, feed, str(tmp_path / "all"), str(tmp_path / "fresh"), FEED, HOT)
    assert output(spark, out) == output(spark, str(tmp_path / "all")) and len(calls) == 3


def test_empty_files_of_a_feed(spark, tmp_path):
    add(spark, str(tmp_path / "feed"), [])
    screen_feed.run(spark, str(tmp_path / "feed"), str(tmp_path / "out"), str(tmp_path / "state"), FEED, HOT)
    assert output(spark, str(tmp_path / "out")) == []
    assert screen_feed.as_pattern("/a/b.parquet/") == "/a/b.parque[t]" and screen_feed.as_pattern("/a/*") == "/a/*"


STUDY = Settings(Corpus(1, 40, None), Watermark(), Paraphrase(iterations=3), Windows(10, 3), experiments=(("D1-D2", (1, 2)), ("D1-D3", (1, 2, 3))))


def test_study_again_and_again(spark, tmp_path):
    rows = [(i, "head\n" + " ".join(f"w{(i * k + k * k) % 37}" for k in range(60)), None if i % 4 == 0 else "en") for i in range(30)] + [(90, None, "en"), (91, "", None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/docs")
    labels = [(1, 0, 0), (2, 1, 1), (3, 1, 0), (3, 0, 0), (4, None, None), (None, 0, 1)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels")
    run = lambda: stability_study.run(spark, f"{tmp_path}/docs", f"{tmp_path}/labels", f"{tmp_path}/out", STUDY)
    get = lambda: sorted(map(str, stability_study.read_back(spark, f"{tmp_path}/out").collect()))
    run()
    first = get()
    table = lambda n: spark.read.schema(stability_study.TABLES[n]).parquet(f"{tmp_path}/out/{n}").collect()
    assert {r.doc_id for r in table("scores")} == set(range(30)) - {1, 2, 3} and len(table("scores")) == 27 * 2 * 4
    assert {(r.experiment, r.lang) for r in table("experiments")} == {(e, g) for e in ("D1-D2", "D1-D3") for g in (None, "en")}
    assert all(r.n_pos == r.n_neg and 0 <= r.auc <= 1 and (r.fpr is None or r.fpr <= 0.05) for n in ("depths", "experiments") for r in table(n))
    run()
    assert get() == first


def test_study_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/docs")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels")
    stability_study.run(spark, f"{tmp_path}/docs", f"{tmp_path}/labels", f"{tmp_path}/out", STUDY)
    assert stability_study.read_back(spark, f"{tmp_path}/out").collect() == []


@pytest.mark.parametrize("job,flags", [("screen_feed", ["--feed", "feed", "--checkpoint", "state"]), ("stability_study", ["--documents", "feed", "--labels", "labels"])])
def test_command_line_of_jobs(spark, tmp_path, job, flags):
    add(spark, f"{tmp_path}/feed", range(40))
    spark.createDataFrame([(1, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels")
    (tmp_path / "own.yaml").write_text("skip_lines: 0\nwords_per_sample: 30\nnum_samples: null\niterations: 8\nwindow_size: 5\nstride: 2\n")
    flags = [*flags, "--config", "own.yaml"]
    flags = [x if x.startswith("--") else f"{tmp_path}/{x}" for x in flags]
    done = subprocess.run([sys.executable, "-m", f"jobs.{job}", *flags, "--out", f"{tmp_path}/out"], cwd=REPO, env=os.environ | {"PYTHONPATH": str(REPO)}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "reading" in done.stderr and "rows" in done.stderr and any((tmp_path / "out").rglob("*.parquet"))


def test_config_files():
    settings, own = settings_of(screen_feed.CONFIG, "feed")
    assert settings.windows == Windows(50, 10) and screen_feed.Feed(**own).files_per_batch > 0
    settings, own = settings_of(stability_study.CONFIG, "study")
    assert settings.corpus == Corpus(2, 120, None) and stability_study.Study(**own).most_false == 0.05
    assert replace(settings.windows, size=20) == settings.windows


def plain_points(rows, most_false):
    """AUC and operating point of (label, score) by all pairs and all thresholds."""
    pos, neg = [s for k, s in rows if k == 1], [s for k, s in rows if k == 0]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else None
    fits = [t for t in {s for _, s in rows} if sum(n >= t for n in neg) <= most_false * len(neg)]
    t = min(fits, default=None)
    rate = lambda a: sum(x >= t for x in a) / len(a) if a and t is not None else None
    return len(pos), len(neg), auc, t, rate(pos), rate(neg)


@pytest.mark.parametrize("most_false", [0.0, 0.05, 0.5, 1.0])
def test_grouped_curves_against_all_pairs(spark, most_false):
    import random

    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(2), rng.choice([rng.random(), 0.5, 0.25])) for _ in range(300)]
    rows += [("one", 1, 0.3), ("one", 1, 0.7), ("none", 0, 0.1), ("gone", 1, None)]
    df = spark.createDataFrame(rows, "g string, label int, s double").repartition(5)
    got = {r.g: tuple(r)[1:] for r in metrics.operating_points(metrics.roc_curves(df, "s", "g"), "g", most_false=most_false).collect()}
    for g in {r[0] for r in rows} - {"gone"}:
        want = plain_points([(k, s) for h, k, s in rows if h == g], most_false)
        assert [x if x is None else pytest.approx(x) for x in want] == list(got[g])
    assert "gone" not in got
    whole = metrics.operating_points(metrics.roc_curves(df, "s"), most_false=most_false).first()
    assert whole.auc == pytest.approx(metrics.roc_auc(df, "s").first().auc)


def test_peaks_and_summaries(spark):
    rows = [(k, d, "".join("01"[(k * j * (d + 1) + j * j // 3) % 7 < 3] for j in range(k * 3))) for k in range(25) for d in (1, 2, 3)]
    df = spark.createDataFrame(rows + [(50, 1, None)], "id int, depth int, bits string")
    shape, wins = Windows(10, 3), {}
    for r in windows.figures(df, shape, 0.25).collect():
        wins.setdefault((r.id, r.depth), []).append(r)
    for r in windows.peaks(df.repartition(3), shape, 0.25, 0.5).collect():
        own = sorted(wins.get((r.id, r.depth), []), key=lambda w: (-w.z, w.win_idx))
        assert (r.n_windows, r.hot_windows) == (len(own), sum(w.z > 0.5 for w in own))
        assert (r.peak_z, r.peak_start, r.peak_end) == ((own[0].z, own[0].win_start, own[0].win_end) if own else (None, None, None))
    sets = [("x", (1, 2)), ("y", (1, 2, 3))]
    listed = stability.matrix(windows.figures(df, shape, 0.25), sets).groupBy("experiment", "id").agg(F.count("*").alias("n"), F.avg("pss").alias("m"), F.max("pss").alias("x"))
    summed = stability.summary_of_arrays(windows.local_scores(df, shape, 0.25), ("id",), sets)
    got, want = {(r[0], r[1]): tuple(r)[2:] for r in summed.collect()}, {(r[0], r[1]): tuple(r)[2:] for r in listed.collect()}
    assert got.keys() == want.keys() and all(g == pytest.approx(want[k]) for k, g in got.items())
    rows_ = stability.matrix_of_arrays(windows.local_scores(df, shape, 0.25), ("id",), sets).collect()
    plain = stability.matrix(windows.figures(df, shape, 0.25), sets).collect()
    key = lambda r: (r.experiment, r.id, r.win_idx)
    assert {key(r): pytest.approx(r.pss) for r in plain} == {key(r): r.pss for r in rows_}
