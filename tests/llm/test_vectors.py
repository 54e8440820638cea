"""Codes and links of vectors against plain loops."""

import hashlib
import math

import numpy as np
import pytest

from verdigris.llm import vector_codes as vc
from verdigris.llm import vector_links as vl

SCHEMA = "vec_id bigint, embedding array<float>, label int, key string, node string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, k, "x", "y") for i, v, k in rows], SCHEMA).repartition(5)


def plain_compression(rows):
    """The contract by loops over Python integers."""
    ok = lambda v: v and len(v) % 4 == 0 and all(x is not None and math.isfinite(x) for x in v)
    kept = sorted(((i, v, k) for i, v, k in rows if ok(v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    w = len(kept[0][1]) // 4
    cut = [[[math.floor(1024 * float(np.float32(x))) for x in v[p * w : p * w + w]] for p in range(4)] for _, v, _ in kept]
    books = [[cut[n][p] for n, r in enumerate(kept[:256]) if r[0] is not None] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min((far(parts[p], c), e) for e, c in enumerate(books[p])) for p in range(4)] for parts in cut]
    for _ in range(4):
        found = assign()
        for p in range(4):
            for e in range(len(books[p])):
                own = [cut[n][p] for n in range(len(cut)) if found[n][p][1] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    found = assign()
    errors = [sum(d for d, _ in f) for f in found]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    by = {}
    for (_, _, k), e in zip(kept, errors):
        by[k] = by.get(k, 0) + e
    return sorted(((i is None, i or 0), "".join(f"{e:02x}" for _, e in f), err, by[k], sha) for (i, _, k), f, err in zip(kept, found, errors))


def vectors(seed, n, width=16):
    rng = np.random.default_rng(seed)
    return [(int(i), [float(x) for x in np.float32(rng.normal(0, 0.2, width))], int(rng.integers(0, 3)) if rng.random() < 0.9 else None) for i in rng.permutation(n)]


ODD = [
    (900, None, 1), (901, [], 1), (902, [0.1, None] * 8, 1), (903, [float("nan")] * 16, 1), (904, [float("inf")] * 16, 2), (905, [0.5] * 15, 1),
    (906, [0.5] * 12, 1), (907, [0.0] * 16, None), (3, [-0.3] * 16, 7), (3, [-0.3] * 16, 7), (None, [0.2] * 16, 0), (908, [50.0, -60.0] * 8, 4),
]


@pytest.mark.parametrize("n", [0, 3, 40, 400])
def test_compression_against_plain_loops(spark, n):
    rows = vectors(n, n) + (ODD if n else [])
    got = sorted(((r.vec_id is None, r.vec_id or 0), r.code, r.error, r.label_error, r.codebooks_sha256) for r in vc.compress(table(spark, rows)).collect())
    assert got == (plain_compression(rows) if n else [])


def test_nearest_drops_no_tie():
    rng = np.random.default_rng(3)
    for width in (1, 2, 5, 16, 40):
        book, points = rng.integers(-3, 4, (256, width)), rng.integers(-4, 5, (3000, width))
        far = ((points[:, None, :] - book[None]) ** 2).sum(2)
        index, distance = vc.nearest(points, book)
        assert (index == far.argmin(1)).all() and (distance == far.min(1)).all()


def test_large_components_saturate(spark):
    rows = [(i, [3e38 * (-1) ** i, 1.0, 2.0, 3.0], 1) for i in range(4)]
    got = vc.compress(table(spark, rows)).collect()
    assert {r.error for r in got} == {0} and len(got) == 4
    assert vc.largest(64) == 2**27 and (2 * vc.largest(1000)) ** 2 * 1000 < 2**63


def plain_links(rows):
    """All pairs, and components by repeated relabelling."""
    able = lambda v: v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    units = [np.array(v) / np.linalg.norm(np.array(v) / max(map(abs, v))) / max(map(abs, v)) if i is not None and able(v) else None for i, v in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if units[a] is not None and units[b] is not None and len(units[a]) == len(units[b]) and units[a] @ units[b] >= 0.9]
    label, links = [i for i, _ in rows], [0] * len(rows)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return sorted(((i is None, i or 0), n, (c is None, c or 0), i is None or i == c) for (i, _), n, c in zip(rows, links, label))


def near(seed, groups, size, width=64, noise=(0.01, 0.04)):
    """Groups around random directions: many pairs on either side of the threshold."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        base = rng.normal(0, 1, width) / width**0.5
        out += [base + rng.normal(0, 1, width) * rng.uniform(*noise) for _ in range(rng.integers(1, size))]
    return [(int(i), [float(np.float32(x)) for x in v]) for i, v in zip(rng.permutation(len(out)), out)]


@pytest.mark.parametrize("width,bucket,block", [(64, 1024, 2048), (64, 8, 5), (3, 16, 7), (100, 4, 2048)])
def test_links_against_all_pairs(spark, width, bucket, block):
    rows = near(width + block, 30, 14, width) + [(5000, None), (5001, []), (5002, [0.0] * width), (5003, [float("nan")] * width), (None, [0.5] * width), (5004, [0.5] * width), (5005, [5e37] * width), (5005, [1e-38] * width)]
    rows += [(6000 + k, rows[0][1]) for k in range(20)] + [(5004, [-0.5] * width), (5006, [0.25] * (width + 1)), (5007, [0.5] * (width + 1))]
    got = vl.link(table(spark, [(i, v, 0) for i, v in rows]), bucket=bucket, block=block).collect()
    assert sorted(((r.vec_id is None, r.vec_id or 0), r.n_links, (r.component_id is None, r.component_id or 0), r.kept) for r in got) == plain_links(rows)


def test_no_vectors(spark):
    assert vl.link(table(spark, [])).collect() == []
    assert [tuple(r) for r in vl.link(table(spark, [(1, [0.0], 0)])).collect()] == [(1, 0, 1, True)]


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(8)
    a = vl.unit(rng.normal(0, 1, (3000, 64)))
    other = vl.unit(rng.normal(0, 1, (3000, 64)))
    b = 0.9 * a + math.sqrt(1 - 0.81) * vl.unit(other - (other * a).sum(1)[:, None] * a)
    packed, factor = vl.codes(a, 64)
    signs = (np.unpackbits(packed, axis=1) * 2.0 - 1) / 8
    estimate = (signs * vl.rotated(b, 0)).sum(1) / factor
    assert abs(estimate.mean() - 0.9) < 0.004
    deviation = math.sqrt(0.19) * np.sqrt(1 - factor**2) / factor / math.sqrt(63)
    assert 0.85 < ((estimate - 0.9) / deviation).std() < 1.15
    assert np.abs((estimate - 0.9) / deviation).max() < vl.DEVIATIONS


def test_pairs_at_the_threshold_meet():
    bits, tables = vl.plan(10**6)
    rng = np.random.default_rng(9)
    a = vl.unit(rng.normal(0, 1, (4000, 64)))
    other = vl.unit(rng.normal(0, 1, (4000, 64)))
    b = 0.9 * a + math.sqrt(1 - 0.81) * vl.unit(other - (other * a).sum(1)[:, None] * a)
    met = (vl.bands(vl.codes(a, bits * tables)[0], bits, tables) == vl.bands(vl.codes(b, bits * tables)[0], bits, tables)).any(1)
    assert met.mean() > 0.998
    assert vl.plan(10)[0] == 4 and vl.plan(10**9)[0] == 20
