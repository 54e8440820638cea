"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

A document is the set of its five-word shingles (a shorter text is one
shingle). Documents with equal sets are copies: one node with a weight. Each
node has a signature of ``TREES`` times ``DEEPEST`` MinHash values of a byte
each; a tree of the forest is the trie over its share of the values, in sorted
order. Nodes meet in a tree if they share a prefix.

A tree's trie is dealt out by its subtries at the shortest prefix that is
needed: the longest one at which two nodes at the wanted similarity meet in
some tree with probability ``RECALL``. Inside such a subtrie the matched prefix
is shortened adaptively, from ``DEEPEST`` values on: at each length the nodes of
a subtrie that meet anew and don't hang together yet are compared by their
whole signatures, and the walk ends as soon as all hang together, at the latest
at the shortest prefix. Near copies are thus joined after about as many
comparisons as there are nodes, while texts that only share a passage are told
apart by their signatures and never tied: of 320 values pairs at similarity
0.8 agree in 256 give or take 7, and less than 210 rule a pair out.

What leaves a subtrie is a row per node, tied to the smallest node that it
hangs together with, never the pairs. A subtrie of many nodes is dealt into
blocks, and pairs of blocks are units of work. Connected components of the
ties are clusters of candidates; every pair that meets and is similar by
signature is inside one. Each cluster's texts are brought together once and
compared exactly (9 |A n B| >= 4 (|A| + |B|), that is Jaccard >= 0.8), a large
cluster in units of two blocks again, so no task holds more; links are counted
where they are found and never listed. What leaves a unit is a row per node:
its links and the smallest node it hangs together with. Components of those
rows are the classes.

Rows are matched with what is known of their node or class by a join that
broadcasts the few most frequent keys, fewer than ``HOT_KEYS``, and shuffles
the rest, so a set or class that makes up a third of the rows is no hot task.

Sketches, ties and units go through shared storage.

Defined results: null and empty texts and rows without doc_id link to nothing
and are classes of their own (``class_id`` is their doc_id, which may be
null); repeated rows are copies of each other; words are compared with A-Z in
lower case. Equal 64-bit hashes count as equal shingles, and as equal sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.llm.common import SHINGLE_WORDS, WordHashes, byte_words, materialise, shingle_hashes

TREES, DEEPEST, RECALL = 32, 10, 0.999
SIMILARITY = 0.8
#: Standard deviations below its mean at which a pair's agreement of signatures rules it out.
DEVIATIONS = 6.5
#: Nodes of a block of a large subtrie.
SUBTRIE_NODES = 1024
#: Nodes, and shingles, of a block of a large cluster.
BLOCK_NODES, BLOCK_SHINGLES = 1024, 4_000_000
#: A key is hot if it has more than this many rows and more than one in HOT_KEYS of all rows, so fewer than HOT_KEYS keys are.
HOT_ROWS, HOT_KEYS = 1000, 10_000


def prefix_length(trees: int = TREES, similarity: float = SIMILARITY, recall: float = RECALL, deepest: int = DEEPEST) -> int:
    """The longest prefix at which pairs of this similarity meet often enough."""
    for k in range(deepest, 1, -1):
        if 1 - (1 - similarity**k) ** trees >= recall:
            return k
    return 1


SHORTEST = prefix_length()


def least_agreeing(values: int = TREES * DEEPEST, similarity: float = SIMILARITY, deviations: float = DEVIATIONS) -> int:
    """Of so many byte values, how many agree at least where a pair may have the similarity."""
    return int(values * (similarity + (1 - similarity) / 256) - deviations * (values * similarity * (1 - similarity)) ** 0.5)


class Forest:
    """MinHash signatures of shingle sets: for each tree in turn its values, a byte each."""

    def __init__(self, trees: int = TREES, deepest: int = DEEPEST, seed: int = 11):
        rng = np.random.default_rng(seed)
        n = trees * deepest
        self.factor = rng.integers(1, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.offset = rng.integers(0, 1 << 32, n, dtype=np.uint32)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        low = (shingles >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.factor), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(low), 256):  # keeps the product in cache
            np.minimum(least, ((low[at : at + 256, None] ^ self.offset) * self.factor).min(0), out=least)
        return (least & np.uint32(0xFF)).astype(np.uint8)


def hanging_together(signatures: np.ndarray, tree: int, shortest: int = SHORTEST, deepest: int = DEEPEST, least: int | None = None) -> np.ndarray:
    """A label for each node of a subtrie of ``tree``: equal for those that hang together by similar signatures.

    The nodes are walked as a sorted trie, from long shared prefixes to
    shorter ones; pairs that hang together already aren't compared.
    """
    least = least_agreeing(signatures.shape[1]) if least is None else least
    own = signatures[:, tree * deepest : (tree + 1) * deepest]
    order = np.lexsort(own.T[::-1])
    sorted_, own = signatures[order], own[order]
    n = len(order)
    label, child = np.arange(n), np.arange(n)
    for depth in range(deepest, shortest - 1, -1):
        begins = np.r_[True, (own[1:, :depth] != own[:-1, :depth]).any(1)]
        starts = np.flatnonzero(begins)
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), n]):
            if child[lo] != child[hi - 1]:  # subtries meet here that were apart one value deeper
                _join_subtries(sorted_, child, label, lo, hi, least)
        if (label == label[0]).all():
            break
        child = np.cumsum(begins)
    out = np.empty(n, np.int64)
    out[order] = label
    return out


def _join_subtries(sorted_: np.ndarray, child: np.ndarray, label: np.ndarray, lo: int, hi: int, least: int) -> None:
    """Compare nodes ``lo`` to ``hi`` of different children and labels; ``label`` is changed."""
    for a in range(lo, hi - 1):
        if (label[lo:hi] == label[lo]).all():
            return
        later = np.flatnonzero((child[a + 1 : hi] != child[a]) & (label[a + 1 : hi] != label[a])) + a + 1
        if not len(later):
            continue
        close = later[(sorted_[later] == sorted_[a]).sum(1) >= least]
        if len(close):
            joined = np.unique(np.r_[label[a], label[close]])
            label[np.isin(label, joined)] = joined[0]


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    return np.unique(shingle_hashes(hashes.of(byte_words(text))))


def node_of(shingles: np.ndarray) -> int:
    """The 64-bit name of a set of shingles."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes()))))


_SKETCH = "doc_id bigint, node bigint, size bigint, signature binary"


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, node, size, signature) of every row; node is null for what links to nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, forest, known = WordHashes(), Forest(), {}
        for batch in batches:
            nodes, sizes, signatures = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shingles = shingle_set(text.as_py(), hashes) if doc_id is not None else ()
                if not len(shingles):
                    nodes.append(None), sizes.append(0), signatures.append(None)
                    continue
                node = node_of(shingles)
                if node not in known:
                    if len(known) > 20_000:
                        known.clear()
                    known[node] = forest.signature(shingles).tobytes()
                nodes.append(node), sizes.append(len(shingles)), signatures.append(known[node])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(signatures, pa.binary())], names=["doc_id", "node", "size", "signature"]
            )

    return materialise(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, _SKETCH), "near-sketches")


def matched(rows: DataFrame, on: str, table: DataFrame, key: str, weight: str, total: int, how: str) -> DataFrame:
    """``rows`` joined with the row of ``table`` (one per ``key``, for about ``weight`` rows each) that has its key, which is not null.

    Hot keys, of more than ``total`` / HOT_KEYS rows each, are fewer than
    about HOT_KEYS and go out by broadcast; only the others are shuffled.
    """
    bound = max(HOT_ROWS, total // HOT_KEYS)
    hot = table.where(F.col(weight) > bound)
    same = F.col(on) == F.col(key)
    frequent = rows.join(F.broadcast(hot), same)
    others = rows.join(F.broadcast(hot.select(key)), same, "left_anti").join(table.where(F.col(weight) <= bound), same, how)
    return frequent.unionByName(others).drop(key, weight)


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b); root is the smallest node of its component.

    Alternating large-star and small-star steps; each step's rows are at most
    the edges, and what is known of a node of very many neighbours is broadcast.
    What a step uses more than once is stored: put together in one plan, a step
    had 2,500 nodes, which the driver holds and reports anew with each change.
    """

    def oriented(e: DataFrame) -> DataFrame:
        return e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    def star(e: DataFrame, part: str) -> DataFrame:
        """(u, m, k): the smallest of a node ``a`` and its neighbours ``b``, and how many rows it has."""
        least = e.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"), F.count("*").alias("k"))
        return materialise(least.select("u", F.least("u", "m").alias("m"), "k"), f"{name}-{step}-{part}")

    def rows(*pairs: tuple[str, str]) -> Column:
        """A row (a, b) for each of the pairs of columns."""
        return F.inline(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in pairs]))

    now = materialise(oriented(edges), f"{name}-0")
    state = mark(now)
    step = 0
    while state[0]:
        step += 1
        least = star(now.select(rows(("a", "b"), ("b", "a"))), "least")
        later = now.select(F.col("b").alias("a"), F.col("a").alias("b"))  # a is the larger one in ``now``
        large = matched(later, "a", least, "u", "k", state[0], "inner").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large.distinct(), f"{name}-{step}-large")
        joined = matched(large, "a", star(large, "next"), "u", "k", state[0], "inner")
        now = materialise(oriented(joined.select(rows(("b", "m"), ("a", "m")))), f"{name}-{step}")
        before, state = state, mark(now)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())


_TIES = "a bigint, b bigint"


def _tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (prefix, i, j): the nodes of each unit that hang together, tied to their smallest."""
    unit, tree, nodes, signatures = None, 0, [], []
    a, b = [], []

    def done() -> None:
        if len(nodes) < 2:
            return
        matrix = np.frombuffer(b"".join(signatures), np.uint8).reshape(len(nodes), -1)
        label = hanging_together(matrix, tree)
        first: dict[int, int] = {}
        for node, k in zip(nodes, label.tolist(), strict=True):
            first[k] = min(node, first.get(k, node))
        for node, k in zip(nodes, label.tolist(), strict=True):
            if node != first[k]:
                a.append(node), b.append(first[k])

    for batch in batches:
        for prefix, i, j, t, node, signature in zip(*(batch.column(n).to_pylist() for n in ("prefix", "i", "j", "tree", "node", "signature")), strict=True):
            if (prefix, i, j) != unit:
                done()
                unit, tree, nodes, signatures = (prefix, i, j), t, [], []
            nodes.append(node), signatures.append(signature)
        if len(a) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            a, b = [], []
    done()
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _units(block: Column, parts: Column) -> Column:
    """The pairs (i, j) of blocks, i <= j, in which a block takes part."""
    return F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.struct(F.least(k, block).alias("i"), F.greatest(k, block).alias("j")))


def candidates(nodes: DataFrame, subtrie_nodes: int = SUBTRIE_NODES) -> DataFrame:
    """(node, root): nodes that are similar to another one by signature, and their cluster."""
    start = lambda t: t * DEEPEST + 1
    trees = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), F.xxhash64(t, F.substring(F.col("signature"), start(t), F.lit(SHORTEST))).alias("prefix")))
    met = nodes.select("node", F.inline(trees))
    shared = met.groupBy("prefix").agg(F.count("*").alias("n")).where("n > 1").select(F.col("prefix").alias("p"), F.ceil(F.col("n") / subtrie_nodes).cast("int").alias("parts"))
    members = met.join(shared, F.col("prefix") == F.col("p")).drop("p")
    block = F.pmod(F.xxhash64("node", F.lit("trie")), F.col("parts")).cast("int")
    rows = members.join(nodes.select(F.col("node").alias("n"), "signature"), F.col("node") == F.col("n"))
    rows = rows.select("prefix", "tree", "node", "signature", F.inline(_units(block, F.col("parts"))))
    rows = rows.repartition("prefix", "i", "j").sortWithinPartitions("prefix", "i", "j")
    return components(materialise(rows.mapInArrow(_tied, _TIES), "near-pairs"), "near-ties")


#: A shingle is counted by matrix products if more than one in DENSE sets has it; COLUMNS shingles at a time.
DENSE, COLUMNS = 8, 2048


class Union:
    """Disjoint sets over small integers; the smaller root wins."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = a = self.up[self.up[a]]
        return a

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


class Labels:
    """The smallest member of each set's group, where a set is joined with many others at once."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: int, others: np.ndarray) -> None:
        met = np.unique(np.append(self.of[others], self.of[a]))
        if len(met) > 1:
            self.of[np.isin(self.of, met)] = met[0]


def close(sets: list[np.ndarray], blocks: np.ndarray, within: bool) -> Iterator[tuple[int, np.ndarray]]:
    """For each set the later sets at Jaccard >= 0.8 (``within`` false: of the other block only)."""
    sizes = np.array([len(s) for s in sets], np.int64)
    n = len(sets)

    def near(a: int, others: np.ndarray, shared: np.ndarray) -> np.ndarray:
        keep = 9 * shared >= 4 * (sizes[a] + sizes[others])
        return others[keep if within else keep & (blocks[others] != blocks[a])]

    if n <= 8:
        for a in range(n):
            others = np.array([b for b in range(a + 1, n) if 5 * min(sizes[a], sizes[b]) >= 4 * max(sizes[a], sizes[b])], np.int64)
            yield a, near(a, others, np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for b in others], np.int64))
        return
    _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    by = np.argsort(shingle, kind="stable")
    often = np.bincount(shingle)
    owners, starts = owner[by], np.r_[0, np.cumsum(often)]
    first = np.r_[0, np.cumsum(sizes)]
    frequent = often > max(1, n / DENSE)
    common = shared_often(owner, shingle, frequent, n, None if within else blocks)
    rare = (often > 1) & ~frequent
    for a in range(n):
        own = shingle[first[a] : first[a + 1]]
        own = own[rare[own]]
        counts = np.bincount(np.concatenate([owners[starts[s] : starts[s + 1]] for s in own]), minlength=n) if len(own) else np.zeros(n, np.int64)
        counts = counts[a + 1 :] + common[a, a + 1 :].astype(np.int64)
        others = np.flatnonzero(counts)
        yield a, near(a, others + a + 1, counts[others])


def shared_often(owner: np.ndarray, shingle: np.ndarray, frequent: np.ndarray, n: int, blocks: np.ndarray | None) -> np.ndarray:
    """How many of the ``frequent`` shingles each two sets share (with ``blocks``: two sets of different blocks), by products of 0-1 matrices."""
    out = np.zeros((n, n), np.float32)  # exact: sets are far below 2^24
    column = np.cumsum(frequent) - 1
    keep = frequent[shingle]
    rows, columns = owner[keep], column[shingle[keep]]
    by = np.argsort(columns, kind="stable")
    rows, columns = rows[by], columns[by]
    halves = None if blocks is None else (np.flatnonzero(blocks == blocks[0]), np.flatnonzero(blocks != blocks[0]))
    for low in range(0, int(frequent.sum()), COLUMNS):
        lo, hi = np.searchsorted(columns, (low, low + COLUMNS))
        matrix = np.zeros((n, COLUMNS), np.float32)
        matrix[rows[lo:hi], columns[lo:hi] - low] = 1
        if halves is None:
            out += matrix @ matrix.T
        else:
            a, b = halves
            product = matrix[a] @ matrix[b].T
            out[np.ix_(a, b)] += product
            out[np.ix_(b, a)] += product.T
    return out


_LINKS = "node bigint, links bigint, root bigint, split boolean"


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over rows sorted by unit: the links and the local component of each node."""
    hashes = WordHashes()
    unit, members = None, {}

    def done():
        nodes = sorted(members)
        sets = [members[x][0] for x in nodes]
        copies = np.array([members[x][1] for x in nodes], np.int64)
        blocks = np.array([members[x][2] for x in nodes], np.int64)
        links, labels = np.zeros(len(nodes), np.int64), Labels(len(nodes))
        for a, others in close(sets, blocks, unit[1] == unit[2]):
            links[a] += copies[others].sum()
            links[others] += copies[a]
            labels.join(a, others)
        return pd.DataFrame({"node": nodes, "links": links, "root": [nodes[k] for k in labels.of], "split": unit[3] > 1})

    out = []
    for batch in batches:
        for cluster, i, j, parts, node, copies, block, text in batch[["cluster", "i", "j", "parts", "node", "copies", "block", "text"]].itertuples(index=False, name=None):
            if unit is not None and (cluster, i, j) != unit[:3]:
                out.append(done())
                members = {}
                if sum(map(len, out)) > 20_000:
                    yield pd.concat(out)
                    out = []
            unit = (cluster, i, j, parts)
            if node in members:
                continue
            shingles = shingle_set(text, hashes)
            if node_of(shingles) == node:  # else another row that repeats the doc_id
                members[node] = (shingles, copies, block)
    if unit is not None:
        out.append(done())
    if out:
        yield pd.concat(out)


def verified(docs: DataFrame, nodes: DataFrame, clusters: DataFrame, block_nodes: int, block_shingles: int) -> DataFrame:
    """(node, links, root, split) from the exact comparison inside clusters."""
    own = nodes.join(clusters.select(F.col("node").alias("c"), "root"), F.col("node") == F.col("c")).drop("c")
    sizes = own.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    parts = F.greatest(F.ceil(F.col("n") / block_nodes), F.ceil(F.col("s") / block_shingles)).cast("int")
    sizes = sizes.select(F.col("root").alias("cluster"), parts.alias("parts"))
    own = own.join(sizes, F.col("root") == F.col("cluster"))
    own = own.withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), F.col("parts")).cast("int"))
    units = _units(F.col("block"), F.col("parts"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text").where("id IS NOT NULL")
    rows = own.select("first_id", "node", "copies", "cluster", "parts", "block", units.alias("units")).join(texts, F.col("first_id") == F.col("id"))
    rows = rows.select("cluster", "parts", "node", "copies", "block", "text", F.explode("units").alias("unit")).select("cluster", "parts", "node", "copies", "block", "text", "unit.*")
    rows = rows.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    return materialise(rows.mapInPandas(_compare, _LINKS), "near-links")


def judged(docs: DataFrame, block_nodes: int, block_shingles: int) -> tuple[DataFrame, DataFrame, int]:
    """``sketches``; (n, root, class_id, copy_id, n_links, copies) of each node, nodes of one class having one root; and the rows with a node."""
    found = sketches(docs)
    nodes = found.where(F.col("node").isNotNull()).groupBy("node").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.max("size").alias("size"), F.first("signature").alias("signature"))
    nodes = materialise(nodes, "near-nodes")
    clusters = candidates(nodes.select("node", "signature"))
    nodes = nodes.drop("signature")
    compared = verified(docs, nodes, clusters, block_nodes, block_shingles)
    links = compared.groupBy("node").agg(F.sum("links").alias("links"))
    ties = compared.where("node <> root")
    split = components(ties.where("split").select(F.col("node").alias("a"), F.col("root").alias("b")), "near-classes")
    whole = ties.where("NOT split").select("node", "root")
    roots = whole.union(whole.select("root", "root").distinct()).union(split)
    named = materialise(roots.join(nodes.select(F.col("node").alias("n"), "first_id"), F.col("node") == F.col("n")).drop("n"), "near-named")
    classes = named.groupBy("root").agg(F.min("first_id").alias("class_id"), F.count("*").alias("members")).withColumnRenamed("root", "r")
    total = nodes.agg(F.sum("copies")).first()[0] or 0
    classed = matched(named, "root", classes, "r", "members", total, "inner").select(F.col("node").alias("n"), "root", "class_id")
    table = nodes.join(classed, F.col("node") == F.col("n"), "left").drop("n")
    table = table.join(links.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left")
    n_links = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    columns = F.col("node").alias("n"), F.coalesce("root", "node").alias("root"), F.coalesce("class_id", "first_id").alias("class_id"), F.col("first_id").alias("copy_id"), n_links.cast("bigint").alias("n_links"), "copies"
    return found, materialise(table.select(*columns), "near-judged"), total


def join(docs: DataFrame, block_nodes: int = BLOCK_NODES, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, copy_id, n_links.

    ``class_id``: the smallest doc_id of all documents that hang together by
    links; ``copy_id``: the smallest doc_id with the same set of shingles;
    ``n_links``: the other documents at Jaccard >= 0.8, copies included.
    """
    found, table, total = judged(docs, block_nodes, block_shingles)
    rows = found.select("doc_id", "node")
    alone = rows.where("node IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), F.lit(0).cast("bigint").alias("n_links"))
    linked = matched(rows.where("node IS NOT NULL"), "node", table.drop("root"), "n", "copies", total, "inner")
    return linked.select("doc_id", "class_id", "copy_id", "n_links").union(alone)


@F.arrow_udf(T.LongType())
def _node(texts: pa.Array) -> pa.Array:
    """``node_of`` each text; null where there are no shingles."""
    hashes = WordHashes()
    sets = (shingle_set(t.as_py(), hashes) for t in texts)
    return pa.array([node_of(s) if len(s) else None for s in sets], pa.int64())


def one_per_class(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class, one of its smallest doc_id.

    Rows are told apart by their shingle sets, so rows that share a doc_id are
    dropped only where another row of their class stays. Of several sets with
    the smallest doc_id the one of smallest node stays, of equal sets under it
    the row of smallest hash. Rows without shingles are copies of each other
    where they share a doc_id; rows without doc_id stay.
    """
    _, table, _ = judged(docs, BLOCK_NODES, BLOCK_SHINGLES)
    lead = table.where("copy_id = class_id").groupBy("root").agg(F.min(F.struct("n", "class_id")).alias("lead")).select(F.col("lead.n").alias("_lead"), F.col("lead.class_id").alias("_kept"))
    packed = docs.select(F.struct(*[docs["`" + c.replace("`", "``") + "`"] for c in docs.columns]).alias("_row"))
    rows = packed.select("_row", F.col("_row.doc_id").cast("bigint").alias("_id"))
    named = rows.where("_id IS NOT NULL").withColumn("_node", _node(F.col("_row.text")))
    stay = named.join(lead, (F.col("_id") == F.col("_kept")) & (F.col("_node") == F.col("_lead")), "left").where("_lead IS NOT NULL OR _node IS NULL")
    stay = stay.groupBy("_id", "_node").agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row")).select("_row")
    return stay.union(rows.where("_id IS NULL").select("_row")).select("_row.*")


#: The join in DuckDB's SQL: all pairs that share a shingle, compared exactly.
ORACLE_SQL = f"""
WITH RECURSIVE docs AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
places AS (SELECT row_id, doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE_WORDS - 1}, 1) + 1)) AS i FROM docs WHERE len(w) > 0 AND doc_id IS NOT NULL),
shingles AS (SELECT DISTINCT row_id, doc_id, md5(array_to_string(w[i:i + {SHINGLE_WORDS - 1}], ' ')) AS s FROM places),
sets AS MATERIALIZED (SELECT row_id, doc_id, md5(string_agg(s, '' ORDER BY s)) AS node, count(*) AS size FROM shingles GROUP BY row_id, doc_id),
nodes AS MATERIALIZED (SELECT node, count(*) AS copies, min(doc_id) AS first_id, any_value(size) AS size, min(row_id) AS row_id FROM sets GROUP BY node),
members AS MATERIALIZED (SELECT node, size, s FROM nodes JOIN shingles USING (row_id)),
pairs AS MATERIALIZED (SELECT a.node AS a, b.node AS b FROM members a JOIN members b ON a.s = b.s AND a.node < b.node GROUP BY a.node, b.node, a.size, b.size HAVING 9 * count(*) >= 4 * (a.size + b.size)),
edges AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reached(node, other) AS (SELECT node, node FROM nodes UNION SELECT reached.node, edges.b FROM reached JOIN edges ON reached.other = edges.a),
classes AS (SELECT reached.node, min(first_id) AS class_id FROM reached JOIN nodes ON nodes.node = other GROUP BY reached.node),
links AS (SELECT edges.a AS node, sum(copies) AS n FROM edges JOIN nodes ON nodes.node = edges.b GROUP BY edges.a)
SELECT docs.doc_id, coalesce(class_id, docs.doc_id) AS class_id, coalesce(first_id, docs.doc_id) AS copy_id, coalesce(links.n + copies - 1, copies - 1, 0)::BIGINT AS n_links
FROM docs LEFT JOIN sets USING (row_id) LEFT JOIN nodes ON nodes.node = sets.node LEFT JOIN classes ON classes.node = sets.node LEFT JOIN links ON links.node = sets.node
"""
