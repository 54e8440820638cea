"""The queries that read whole documents, on texts that the sample cut leaves out or shortens."""

from collections import Counter

import duckdb
import pytest

from test_queries import plain
from verdigris.plans import oracles, queries


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    long = "head\nhead\n" + " ".join(f"w{k % 90}" for k in range(400))
    folder = tmp_path_factory.mktemp("whole")
    texts = {1: long, 2: "one short  line", 3: "", 4: None, 5: "one"}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder), {i: (t or "").split() for i, t in texts.items()}


def test_all_words_are_read(spark, tables):
    folder, words = tables
    run = lambda name: queries.QUERIES[name](spark, folder).collect()
    assert {r.token: r.n for r in run("vocab_docs")} == Counter(w for ws in words.values() for w in ws)
    assert Counter(r.doc_id for r in run("token_ids_docs")) == {i: len(ws) for i, ws in words.items() if ws}
    pairs = {i: Counter(zip(ws, ws[1:])) for i, ws in words.items()}
    assert {(r.doc_id, r.prev, r.token): r.n for r in run("bigram_counts_docs")} == {(i, *p): n for i, c in pairs.items() for p, n in c.items()}
    assert {(r.prev, r.token) for r in run("greenlist_hash_docs")} == {(r.prev, r.token) for r in run("bias_logits_docs")} == {p for c in pairs.values() for p in c}
    assert {r.doc_id: r.num_tokens_scored for r in run("score_unique_bigrams_docs")} == {i: len(c) for i, c in pairs.items()}
    assert Counter(r.doc_id for r in run("green_bits_docs")) == {i: len(ws) - 1 for i, ws in words.items() if len(ws) > 1}
    assert {r.doc_id: len(r.watermark_bits.replace(",", "")) for r in run("bits_csv_docs")} == {i: max(len(ws) - 1, 0) for i, ws in words.items()}
    assert {r.doc_id for r in run("p_value_docs")} == set(words)


@pytest.mark.parametrize("name", ["unpivot_depths", "combine_labeled", "validate_counts", "sequential_id", "auc", "rolling_features", "pss_matrix", "auc_by_experiment"])
def test_both_halves_of_short_and_empty_texts(spark, tables, name):
    folder, words = tables
    df = queries.QUERIES[f"{name}_docs"](spark, folder)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = con.sql(oracles.ORACLES[f"{name}_docs"])
    at = [want.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_no_word_is_lost_between_the_halves(spark, tables):
    folder, words = tables
    found = {(r.doc_id, r.text_type): r.words for r in queries.whole_halves(spark, folder).collect()}
    assert len(found) == 2 * len(words)
    assert {i: found[i, "human"] + found[i, "ai"] for i in words} == words
    assert all(len(found[i, "ai"]) - len(found[i, "human"]) == len(ws) % 2 for i, ws in words.items())
