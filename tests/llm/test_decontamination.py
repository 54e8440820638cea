import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from verdigris.llm import decontamination as dc

DOCS, ITEMS = "doc_id bigint, text string, item_id string", "item_id bigint, text string, doc_id bigint"


def bag(words):
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def brute(docs, items):
    """Every window of an item's size, also cut off at the ends, against that item; items of few words by equality at their width."""
    out = {}
    for doc_id, text in docs:
        words = (text or "").lower().split()
        shingles = [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []
        for item_id, item in items:
            wanted = (item or "").lower().split()
            if 0 < len(wanted) < 5:
                if any(words[i : i + len(wanted)] == wanted for i in range(len(words))):
                    out[(doc_id, item_id)] = 1.0
                continue
            b = bag(wanted)
            for size in {bag((i or "").lower().split()).total() for _, i in items} - {0}:
                for lo in range(-size, len(shingles) + 1):
                    a = Counter(shingles[max(lo, 0) : max(lo + size, 0)])
                    if not a or not b:
                        continue
                    n = (a & b).total()
                    d = (a | b).total()
                    if 5 * n >= 4 * d:
                        out[(doc_id, item_id)] = max(out.get((doc_id, item_id), 0), n / d)
    return out


def make(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("ab") + str(rng.randrange(40))
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 12, 14, 30, 31, 60])))) for i in range(12)] + [(50, None), (51, "")]
    docs = []
    for i in range(60):
        w = [word() for _ in range(rng.choice([0, 1, 4, 20, 150]))]
        for _ in range(rng.choice([0, 1, 1, 2])):
            passage = (rng.choice(items)[1] or "").split()
            cut = rng.choice([0, 0, 1, 2])
            passage = passage[cut:] if rng.random() < 0.5 else passage[: len(passage) - cut]
            if len(passage) > 40 and rng.random() < 0.5:
                passage[20] = "changed"
            at = rng.randint(0, len(w))
            w[at:at] = passage
        docs.append((i, " ".join(w).replace("a1", "A1")))
    return docs + [(100, None), (None, items[3][1]), (3, docs[3][1])], items


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    docs, items = make(seed)
    got = dc.leaks(spark.createDataFrame([(i, t, "x") for i, t in docs], DOCS), spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS)).collect()
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id) for r in got} == set(want)
    for r in got:
        assert r.similarity == pytest.approx(want[(r.doc_id, r.item_id)])


def test_many_slices_in_one_scan(spark, monkeypatch):
    docs, items = make(3)
    df, held = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id bigint, text string")
    want = sorted(map(str, dc.leaks(df, held).collect()))
    dirty = {r.doc_id for r in dc.leaks(df, held).collect()}
    monkeypatch.setattr(dc, "SLICE", 2)
    assert len(list(dc.slices(held))) > dc.HELD and len(dc.scans(held)[0]) == 1
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "7")
    try:
        for chars in (dc.SCAN_CHARS, 300):
            monkeypatch.setattr(dc, "SCAN_CHARS", chars)
            assert sorted(map(str, dc.leaks(df, held).collect())) == want and want
            assert {r.doc_id for r in dc.decontaminate(df, held).collect()} == {d for d, _ in docs} - dirty
        assert len(dc.scans(held)[0]) > 1
    finally:
        spark.conf.set(batch, before)


def test_places_against_sql(spark):
    con = duckdb.connect()
    for seed in (1, 4):
        docs, items = make(seed)
        items += [(60, "a1 b2"), (60, items[4][1])]
        con.execute("CREATE OR REPLACE TABLE documents(doc_id BIGINT, text VARCHAR)"), con.execute("CREATE OR REPLACE TABLE benchmark(item_id BIGINT, text VARCHAR)")
        con.executemany("INSERT INTO documents VALUES (?, ?)", docs), con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
        got = dc.leaks(spark.createDataFrame([(i, t, "x") for i, t in docs], DOCS), spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS))
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, con.sql(dc.ORACLE_SQL).fetchall()))


def test_short_items_inside_texts(spark):
    items = [(1, "Secret answer here"), (2, "here"), (3, "four words make one"), (4, "secret answer here and more words"), (4, "no")]
    docs = [(10, "the secret ANSWER here stands among eleven other words of a text"), (11, "four words make"), (12, "four words make one"), (13, "no")]
    got = dc.leaks(spark.createDataFrame([(i, t, "x") for i, t in docs], DOCS), spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS)).collect()
    assert sorted((r.doc_id, r.item_id, r.first_word, r.last_word) for r in got) == [(10, 1, 1, 3), (10, 2, 3, 3), (12, 3, 0, 3), (13, 4, 0, 0)]


def test_repeated_item_ids(spark):
    passages = [" ".join(f"{a}{k}" for k in range(20)) for a in "xy"]
    docs = spark.createDataFrame([(1, passages[0], ""), (2, passages[1], ""), (3, "a b c d e f g", "")], DOCS)
    items = spark.createDataFrame([(7, p, 0) for p in passages], ITEMS)
    assert sorted((r.doc_id, r.item_id) for r in dc.leaks(docs, items).collect()) == [(1, 7), (2, 7)]
    assert [r.doc_id for r in dc.decontaminate(docs, items).collect()] == [3]


def test_window_sums_weigh_by_the_root_of_counts():
    rng = np.random.default_rng(1)
    for n, size in ((1, 1), (5, 9), (40, 7), (60, 60)):
        shingles = rng.integers(0, 6, n).astype(np.uint64)
        values = dc.projections(shingles)
        got = dc.window_sums(values, shingles, size)
        assert len(got) == n + size - 1
        for k, row in enumerate(got):
            c = Counter(shingles[max(0, k - size + 1) : k + 1].tolist())
            want = sum(np.sqrt(v) * dc.projections(np.array([s], np.uint64))[0] for s, v in c.items())
            assert np.allclose(row, want)


def test_index_selects():
    rng = np.random.default_rng(2)
    index = dc.HammingIndex(rng.integers(0, 256, (5000, 16), dtype=np.uint8))
    rows, _ = index.candidates(rng.integers(0, 256, (100, 16), dtype=np.uint8))
    assert len(rows) < 0.09 * 500_000


def test_recall_at_the_least_similarity():
    rng = np.random.default_rng(3)
    near = 0
    for _ in range(1000):
        a = rng.integers(0, 2**63, 90).astype(np.uint64)
        b = np.r_[a[10:], rng.integers(0, 2**63, 10).astype(np.uint64)]  # Jaccard 0.8
        x, y = (dc.fingerprints(dc.projections(s).sum(0)[None])[0] for s in (a, b))
        near += int(np.unpackbits(x ^ y).sum()) <= dc.RADIUS
    assert near >= 993


def test_matches_with_a_repeated_shingle():
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(10**9)}"
    items = [(i, " ".join(word() for _ in range(204))) for i in range(12)]
    docs = []
    for i, text in items:
        w = text.split()
        w[90:108] = ["same"] * 18  # 178 of 200 shingles stay: similarity 0.80, with one shingle fourteen times
        docs.append((i, " ".join([word() for _ in range(rng.choice([0, 40]))] + w + [word() for _ in range(rng.choice([0, 40]))])))
    want, judge = brute(docs, items), dc.Benchmark(items).judge
    got = {(i, x["item_id"]): x["similarity"] for i, t in docs for x in judge(t)}
    assert len(want) == 12 and got == pytest.approx(want)


def test_repeated_shingles_and_cut_windows():
    rng = random.Random(3)
    for _ in range(150):
        items = [(i, " ".join(rng.choice("ab") for _ in range(rng.choice([3, 9, 20, 40])))) for i in range(4)]
        docs = [(0, " ".join(rng.choice("aab") for _ in range(rng.choice([2, 8, 30, 60])))), (1, rng.choice(items)[1] + " a b" * rng.randrange(9)), (2, "b " * rng.randrange(4) + rng.choice(items)[1][6:])]
        got = {(i, x["item_id"]): x["similarity"] for i, t in docs for x in dc.Benchmark(items).judge(t)}
        assert got == pytest.approx(brute(docs, items))


def test_documents_that_stay(spark):
    docs, items = make(1)
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], DOCS)
    stay = dc.decontaminate(df, spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS))
    assert stay.columns == df.columns
    gone = {d for d, _ in brute(docs, items)}
    assert sorted(str(r.doc_id) for r in stay.collect()) == sorted(str(i) for i, _ in docs if i not in gone)


def test_empty_tables(spark):
    none, docs = spark.createDataFrame([], ITEMS), spark.createDataFrame([(1, "a b c d e f", "x")], DOCS)
    assert dc.leaks(docs, none).count() == 0 and dc.decontaminate(docs, none).count() == 1
    assert dc.leaks(docs.limit(0), spark.createDataFrame([(1, "a b c d e f", 0)], ITEMS)).count() == 0


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(5)
    stored = rng.integers(0, 256, (100, 16), dtype=np.uint8)
    wanted = np.repeat(stored[:40], 5, 0)
    for row in wanted:
        for bit in rng.choice(128, rng.integers(0, 42), replace=False):
            row[bit // 8] ^= np.uint8(1 << (bit % 8))
    got = set(zip(*(x.tolist() for x in dc.HammingIndex(stored).search(wanted))))
    distance = np.unpackbits(wanted[:, None] ^ stored[None], axis=2).sum(2)
    assert got == set(zip(*(x.tolist() for x in np.nonzero(distance <= dc.RADIUS))))
