import hashlib
import random

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from verdigris.llm import chat, warc

TURNS = "conv_id bigint, turn bigint, role string, text string"


def expected(rows):
    """The digest columns by a plain loop."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in rows)
    loss = "".join(r[3] or "" for r in rows if r[2] == "assistant")
    return len(rows), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def read(spark, rows):
    got = chat.read_back(chat.format_segments(spark.createDataFrame(rows, TURNS))).collect()
    return {r.conv_id: r for r in got}


def test_digests_and_faults(spark):
    rows = [
        (1, 0, "user", "hi\nthere"), (1, 1, "assistant", "yes <s>[INST] é🙂\\"),
        (2, 0, "assistant", "first"), (2, 1, "user", None),
        (3, 0, "system", ""), (3, 1, "user", "q"), (3, 2, "user", "q again"), (3, 3, "assistant", "a"),
        (None, 0, None, "x"), (None, None, "to]ol\\", "[/TURN]"),
        (4, 0, "user", "same"), (4, 0, "user", "same"), (5, 0, "user", "x" * 300_000), (5, 1, "assistant", "</s>" * 50_000),
        (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"),
    ]
    got = read(spark, rows)
    for conv in {r[0] for r in rows}:
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == expected([x for x in rows if x[0] == conv])
    assert {c: got[c].fault for c in got} == {1: None, 2: 0, 3: 2, None: 0, 4: 1, 5: None, -7: None}
    assert got[-7].valid and not got[2].valid


BIG = 2**53


def test_large_ids_beside_nulls(spark):
    ids = [BIG, BIG + 1, -(2**63), 2**63 - 1, None, -BIG - 1]
    rows = [(i, k, r, f"{r} of {i}") for i in ids for k, r in enumerate(("user", "assistant"))] + [(BIG, None, "system", "first")]
    got = read(spark, rows)
    assert set(got) == set(ids)
    for i in ids:
        assert (got[i].n_turns, got[i].turns_sha256) == expected([x for x in rows if x[0] == i])[:2]
    formatted = chat.format_segments(spark.createDataFrame([(1, BIG + 1, "user", "x"), (1, None, "user", "y")], TURNS))
    assert {r.turn for r in formatted.collect()} == {BIG + 1, None}


def test_conversations_against_sql(spark):
    roles = ["system", "user", "assistant", "tool", "start", "a]b[\\'", None]
    rng = random.Random(4)
    texts = ["", None, "</s>[INST] ok [/INST]", "é🙂\\ <x>", "it's\n"]
    rows = [(rng.choice([None, *range(30)]), rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts)) for _ in range(300)]
    rows += [(100 + i, k, r, f"{k}") for i in range(4) for k, r in enumerate(["system", "user", "assistant", "user", "assistant"][i % 2 :])]
    got = chat.read_back(chat.format_segments(spark.createDataFrame(rows, TURNS)))
    con = duckdb.connect()
    con.execute("CREATE TABLE t(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", rows)
    want = con.sql(chat.oracle_sql("SELECT * FROM t"))
    assert want.columns == got.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


def test_formatted_text_alone_gives_the_turns_back():
    """All conversations of a table, formatted to one string each, in pieces cut anywhere."""
    rng = random.Random(9)
    for _ in range(200):
        turns = [(rng.choice(["system", "user", "assistant", "x]"]), "".join(rng.choice("<s>/[INST]\\ ]é\n") for _ in range(rng.randrange(20)))) for _ in range(rng.randint(1, 6))]
        whole = "".join(t for role, text in turns for t, _ in chat.segments(role, text, chat.INSTRUCT))
        cuts = sorted(rng.randrange(len(whole) + 1) for _ in range(3))
        reader = chat.Reader(chat.INSTRUCT)
        assert [x for i, j in zip([0, *cuts], [*cuts, len(whole)]) for x in reader.feed(whole[i:j])] == turns
        reader.end()


def test_empty_conversations(spark):
    assert read(spark, []) == {}


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(["system", "user", "assistant", "tool", "", "a]b[\\"]), st.text(alphabet=st.sampled_from("<s>/[INST]\\ ]é\n"), max_size=30))
def test_turns_round_trip(role, text):
    parts = chat.segments(role, text, chat.INSTRUCT)
    reader, whole = chat.Reader(chat.INSTRUCT), "".join(t for t, _ in parts) * 2
    for pieces in ([whole], list(whole)):
        assert [turn for piece in pieces for turn in reader.feed(piece)] == [(role, text)] * 2
        reader.end()
    assert not any(c in parts[1][0].replace("\\\\", "").replace("\\<", "").replace("\\[", "") for c in chat.INSTRUCT.controls)


PAGES = "page_id bigint, url string, html string, url2 string"


def test_archives(spark):
    long = "<p>é" + "x" * 200
    rows = [(5, "http://a/ b\r\n", long, ""), (3, "http://b", long, ""), (9, None, long, ""), (3, "http://b", long, ""),
            (1, "http://c", "short", ""), (2, "http://d", "short", ""), (4, "http://e", None, ""), (None, "http://f", long, ""), (6, "http://g", "y\r\n\r\n" * 200_000, "")]
    got = warc.round_trip(spark.createDataFrame(rows, PAGES)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    for page_id, _, html, _ in rows:
        payload = (html or "").encode()
        for r in by[page_id]:
            assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
            want = ("revisit", 3) if html == long and page_id != 3 else ("response", None)
            assert (r.record_type, r.refers_to) == want


def test_large_page_ids(spark):
    long = "z" * 200
    rows = [(BIG + 1, "u", long, ""), (BIG + 3, "u", long, ""), (None, "u", long, ""), (2**63 - 1, "u", "other" * 30, "")]
    got = {r.page_id: r.refers_to for r in warc.round_trip(spark.createDataFrame(rows, PAGES).coalesce(1)).collect()}
    assert got == {BIG + 1: None, BIG + 3: BIG + 1, None: BIG + 1, 2**63 - 1: None}


def test_reading_is_dealt_by_bytes(spark):
    pages = spark.createDataFrame([(i, "u", random.Random(i).randbytes(20_000).hex(), "") for i in range(300)], PAGES).repartition(4)
    folder = warc.shared_path(spark, "t")
    index = warc.write_archives(warc.classified(pages), folder)
    assert warc.ranges(index, 1 << 19).rdd.getNumPartitions() >= 6


def test_selected_records_and_payloads(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<html>{i}</html>" * 50, "") for i in range(50)], PAGES)
    folder = warc.shared_path(spark, "t")
    index = warc.write_archives(warc.classified(pages), folder)
    got = warc.read_records(index.where("page_id % 7 = 0"), folder).collect()
    assert {r.page_id: bytes(r.payload).decode() for r in got} == {i: f"<html>{i}</html>" * 50 for i in range(0, 50, 7)}
    ends = index.groupBy("file").agg({"length": "sum"}).collect()
    last = index.selectExpr("file", "offset + length AS e").groupBy("file").max("e").collect()
    assert {r[0]: r[1] for r in ends} == {r[0]: r[1] for r in last}


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_coalescing():
    runs = list(warc.coalesced([(0, 10), (10, 5), (100, 5), (104, 1)], gap=20))
    assert runs == [(0, [(0, 10), (10, 5)]), (100, [(100, 5), (104, 1)])]
