import random

import numpy as np
import pytest

from verdigris.llm import near_duplicates as nd

SCHEMA = "doc_id bigint, text string, node string, class_id bigint"


def brute(rows):
    """All pairs of shingle sets, and components by repeated relabelling."""

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) if i is not None else set() for i, t in rows]
    links, label = [0] * len(rows), [i for i, _ in rows]
    pairs = []
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                pairs.append((a, b))
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return sorted(((i is None, i or 0, label[k] or 0, links[k]) for k, (i, _) in enumerate(rows)))


def corpus(seed, groups=12, size=9):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([3, 30, 80, 200]))]
        for _ in range(rng.randint(1, size)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = word()
            rows.append(" ".join(w))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("blocks", [1024, 3])
def test_against_brute_force(spark, blocks):
    rows = corpus(1) + [(1000, None), (1001, ""), (1002, "  \n"), (None, "a b c d e f"), (1003, "one two"), (1004, "ONE  two"), (5, corpus(1)[5][1]), (1005, "z " * 40_000)]
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], SCHEMA)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.class_id or 0, r.n_links) for r in nd.join(df, block_nodes=blocks).collect())
    assert got == brute(rows)


def test_hot_group_of_near_copies(spark):
    rng = random.Random(2)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(150)] = f"x{rng.random()}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], SCHEMA)
    got = sorted((False, r.doc_id, r.class_id, r.n_links) for r in nd.join(df, block_nodes=64).collect())
    assert got == brute(rows)


@pytest.mark.parametrize("dense", [1e-9, 4, 1e9])
def test_links_of_a_block_by_all_pairs(dense, monkeypatch):
    monkeypatch.setattr(nd, "DENSE", dense)
    monkeypatch.setattr(nd, "COLUMNS", 37)
    rng = np.random.default_rng(4)
    base = rng.choice(10_000, 120, replace=False)
    sets = [np.unique(np.r_[base[rng.random(120) < rng.choice([0.8, 0.93, 1.0])], rng.choice(10_000, rng.integers(1, 12))]) for _ in range(70)]
    blocks = rng.integers(0, 2, 70)
    for within in (True, False):
        found, labels = set(), nd.Labels(70)
        for a, others in nd.close(sets, blocks, within):
            found |= {(a, int(b)) for b in others}
            labels.join(a, others)
        want = {(a, b) for a in range(70) for b in range(a + 1, 70) if (within or blocks[a] != blocks[b]) and 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))}
        assert found == want and 10 < len(want) < 70 * 69 / 2
        union = nd.Union(70)
        for a, b in want:
            union.join(a, b)
        assert labels.of.tolist() == [union.find(k) for k in range(70)]


def test_one_per_class(spark):
    rows = corpus(4) + [(None, "a b"), (None, "a b"), (2, corpus(4)[2][1])]
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], SCHEMA)
    kept = nd.one_per_class(df)
    assert kept.columns == ["doc_id", "text", "node", "class_id"]
    leaders = sorted({r[2] for r in brute(rows) if not r[0]})
    got = [r.doc_id for r in kept.collect()]
    assert got.count(None) == 2 and sorted(i for i in got if i is not None) == leaders


def test_one_per_class_where_ids_repeat(spark):
    rng = random.Random(6)
    text = lambda n=60: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    near = lambda w: [*w[:-1], "other"]
    a, own = text(), [text() for _ in range(20)]
    rows = [(1, a)] + [(5, w) for w in own]  # texts that resemble nothing, under one doc_id
    rows += [(5, near(a)), (5, own[0]), (9, near(own[3])), (None, own[4])]  # copies: one of a row of smaller doc_id, the others of rows of doc_id 5
    df = spark.createDataFrame([(i, " ".join(w), "x", 7) for i, w in rows] + [(5, "", "x", 7), (5, "", "x", 7), (6, None, "x", 7)], SCHEMA)
    want = sorted([(1, " ".join(a))] + [(5, " ".join(w)) for w in own] + [(5, ""), (6, "None")] + [(0, " ".join(own[4]))])
    for parts in (1, 7):
        assert sorted((r.doc_id or 0, str(r.text)) for r in nd.one_per_class(df.repartition(parts)).collect()) == want


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert nd.join(df).count() == 0 and nd.one_per_class(df).count() == 0


def pairs_at(rng, n, shared, own):
    """Sets of hashes with so many in common."""
    for _ in range(n):
        all_ = rng.integers(0, 1 << 63, shared + 2 * own).astype(np.uint64)
        yield all_[: shared + own], np.r_[all_[:shared], all_[shared + own :]]


def test_recall_and_selection_of_the_forest():
    k = nd.prefix_length()
    assert 1 - (1 - 0.8**k) ** nd.TREES >= nd.RECALL > 1 - (1 - 0.8 ** (k + 1)) ** nd.TREES
    rng, forest = np.random.default_rng(0), nd.Forest()

    def tied(a, b):
        both = np.stack([forest.signature(a), forest.signature(b)])
        values = both.reshape(2, nd.TREES, nd.DEEPEST)
        trees = np.flatnonzero((values[0, :, :k] == values[1, :, :k]).all(1))
        labels = [nd.hanging_together(both, int(t)) for t in trees]
        return bool(len(trees)), any(x[0] == x[1] for x in labels)

    at_80 = [tied(a, b) for a, b in pairs_at(rng, 400, 80, 10)]  # Jaccard 0.8
    assert sum(t for _, t in at_80) >= 397
    at_50 = [tied(a, b) for a, b in pairs_at(rng, 400, 100, 50)]  # texts that share half: many meet, none is tied
    assert sum(m for m, _ in at_50) > 40 and not any(t for _, t in at_50)


def test_walk_of_a_subtrie_equals_all_pairs():
    rng = np.random.default_rng(3)
    for size in (2, 3, 40):
        for _ in range(20):
            base = rng.integers(0, 256, (4, nd.TREES * nd.DEEPEST), dtype=np.uint8)
            rows = base[rng.integers(0, 4, size)]
            noise = rng.random(rows.shape) < rng.choice([0.02, 0.1, 0.2], (size, 1))
            rows = np.where(noise, rng.integers(0, 256, rows.shape, dtype=np.uint8), rows)
            rows[:, 5 * nd.DEEPEST : 5 * nd.DEEPEST + nd.SHORTEST] = 9  # all share the tree's shortest prefix
            got = nd.hanging_together(rows, 5)
            label = list(range(size))
            for a in range(size):
                for b in range(a):
                    if (rows[a] == rows[b]).sum() >= nd.least_agreeing():
                        label = [label[b] if x == label[a] else x for x in label]
            assert len(set(zip(got.tolist(), label))) == len(set(got.tolist())) == len(set(label))


def test_hot_sets_and_many_empty_texts(spark, monkeypatch):
    monkeypatch.setattr(nd, "HOT_ROWS", 5)
    same, near = " ".join(f"s{k}" for k in range(40)), [" ".join(f"s{k}" for k in range(40)) + f" n{i}" for i in range(30)]
    texts = [same] * 40 + near + [""] * 20 + ["alone " * 9]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], SCHEMA)
    got = sorted((False, r.doc_id, r.class_id, r.n_links) for r in nd.join(df, block_nodes=8).collect())
    assert got == brute(rows)
    assert sorted(r.doc_id for r in nd.one_per_class(df).collect()) == [0, *range(70, 91)]


@pytest.mark.parametrize("nodes", [3, 64])
def test_large_subtries_in_blocks(spark, nodes):
    rows = corpus(8, groups=6, size=20)
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], SCHEMA)
    found = nd.sketches(df).where("node IS NOT NULL").groupBy("node").agg({"signature": "first"}).toDF("node", "signature")
    roots = {r.node: r.root for r in nd.candidates(found, subtrie_nodes=nodes).collect()}
    assert roots == {r.node: r.root for r in nd.candidates(found).collect()}


def test_a_step_of_components_is_a_small_plan(spark, monkeypatch):
    rng = random.Random(5)
    edges = [(k, k - 1) for k in range(1, 60)] + [(100, 100 + k) for k in range(1, 50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    label = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in range(len(label)):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    read, store = [], nd.materialise

    def storing(df, name):
        read.append(str(df._jdf.queryExecution().analyzed().toString()).count("Relation ["))
        return store(df, name)

    monkeypatch.setattr(nd, "materialise", storing)
    monkeypatch.setattr(nd, "HOT_ROWS", 20)
    found = nd.components(spark.createDataFrame(edges, "a bigint, b bigint"), "test")
    assert {r.node: r.root for r in found.collect()} == label
    assert len(read) > 5 and max(read) <= 5  # two of rows, three of what is joined; a step in one plan read 100
