"""Windows in linear time: against the strings' own definition, over chunks, with repeated rows, on long sequences."""

import random
import time

import pytest
from pyspark.sql import functions as F

from verdigris.config import Windows
from verdigris.operators import windows

SHAPES = [(50, 10), (40, 5), (60, 15), (5, 10), (1, 1), (4, 2)]


def sequences(seed, n=120):
    rng = random.Random(seed)
    rows = [(k, "".join(rng.choice("0111"[: rng.randint(2, 4)]) for _ in range(rng.randint(0, 300)))) for k in range(n)]
    return rows + [(n, "1" * 200), (n + 1, "0" * 200), (n + 2, "1"), (n + 3, "0"), (n + 4, None), (n + 5, ""), (n + 6, "1" * 99 + "0"), (n + 7, "0" + "1" * 99)]


@pytest.mark.parametrize("mode", ["clean", "literal"])
def test_figures_are_those_of_the_strings(spark, mode):
    df = spark.createDataFrame(sequences(1) + [(900, "ERROR"), (901, "1é1🙂0111")], "id int, bits string").repartition(3)
    for size, stride in SHAPES:
        shape = Windows(size, stride, mode)
        plain = windows.features(windows.windows(df, shape), 0.25)
        columns = ["id", "win_idx", "win_start", "win_end", F.round("z", 9), "run", "freq"]
        assert sorted(map(tuple, windows.figures(df, shape, 0.25).select(*columns).collect())) == sorted(map(tuple, plain.select(*columns).collect()))
        assert all(len(r.win) == r.win_end - r.win_start for r in plain.collect())


@pytest.mark.parametrize("length,tile", [(1, 16), (7, 16), (7, 100), (1000, 33), (1000, windows.TILE)])
def test_chunks_give_the_windows_of_the_whole(spark, length, tile):
    rows = sequences(2, 40) + [(500, "1" * 400 + "0" + "1" * 300), (501, "0" + "1" * 500 + "0" * 60)]
    chunks = [(k, at, bits[at : at + length]) for k, bits in rows for at in range(0, len(bits or ""), length)] + [(0, 10**6, None), (1, 10**6, "")]
    df = spark.createDataFrame(chunks, "id int, chunk int, bits string").repartition(4)
    for size, stride in ((50, 10), (5, 10), (4, 2)):
        shape = Windows(size, stride)
        columns = ["id", "win_idx", "win_start", "win_end", F.round("z", 9), "run", "freq"]
        want = windows.figures(spark.createDataFrame(rows, "id int, bits string"), shape, 0.25).select(*columns)
        got = windows.windows_of_chunks(df, shape, 0.25, tile=tile).select(*columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(ValueError):
        windows.windows_of_chunks(df, Windows(4, 2, "literal"), 0.25)


def test_rows_that_repeat_stay_apart(spark):
    bits = "1101100111" * 9
    once = windows.rolling(spark.createDataFrame([(1, bits)], "id int, bits string"), Windows(4, 2), 0.25).first()
    twice = windows.rolling(spark.createDataFrame([(1, bits)] * 2, "id int, bits string"), Windows(4, 2), 0.25).collect()
    assert twice == [once, once]


def test_a_million_bits(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("0001") for _ in range(500_000)) + "1" * 250_000 + "0" * 250_000
    df = spark.createDataFrame([(1, long), (2, "1" * 1_000_000)], "id int, bits string")
    windows.figures(df.limit(0), Windows(), 0.25).count()
    began = time.time()
    got = {r.id: r for r in windows.figures(df, Windows(), 0.25).groupBy("id").agg(F.count("*").alias("n"), F.max("run").alias("run"), F.sum("freq").alias("freq")).collect()}
    assert time.time() - began < 10
    assert got[1].n == got[2].n == 99_996 and got[1].run >= 250_000 and got[2].freq == 99_996
    stats = windows.rolling(df, Windows(), 0.25).collect()
    assert stats[1].run_var == 0 and stats[1].run_mean == 1_000_000


def test_scores_as_arrays(spark):
    df = spark.createDataFrame(sequences(3, 20), "id int, bits string")
    rows = {r.id: r.zs for r in windows.local_scores(df, Windows(4, 2), 0.25).collect()}
    for r in windows.figures(df, Windows(4, 2), 0.25).collect():
        assert rows[r.id][r.win_idx] == r.z
    assert rows[24] == [] and len(rows) == 28
