"""Quality rules, PII and mixing against plain loops."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from verdigris.llm import mixing, pii, quality_rules, weak

SCHEMA = "doc_id bigint, text string, source string, n_chars bigint, kept string, n_words string"
WORDS = "The river runs past old stone houses and nobody in town minds when water rises over low fields each spring".split()


def prose(rng, n):
    out = []
    while len(out) < n:
        out += [*rng.sample(WORDS, 9), rng.choice(WORDS) + str(rng.randrange(10**6)) + "."]
    return " ".join(out[:n])


def table(spark, texts):
    return spark.createDataFrame([(i, t, f"s{(i or 0) % 3}", 0, "mine", "mine") for i, t in texts], SCHEMA)


def base_figures(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(w, w[1:], w[2:]))
    inside = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(inside)


def junk(rng, kind):
    w = prose(rng, 120).split()
    return {"symbols": " ".join(x + "###" for x in w), "shouts": " ".join(x.upper() + "!!" for x in w), "copies": " ".join(x for x in w[:10] for _ in range(12)), "table": " | ".join(w)}[kind]


def test_quality_rules(spark):
    rng = random.Random(1)
    texts = [(i, prose(rng, rng.randint(60, 300))) for i in range(150)]
    bad = [(200 + i, junk(rng, k)) for i, k in enumerate(["symbols", "shouts", "copies", "table"] * 12)]
    odd = [(None, prose(rng, 80)), (400, None), (401, ""), (402, " \n\t\n"), (403, "a a a a"), (404, "x\x0b y\x0cz é🙂 | <>\n\nx\x0b y\n|\n|"), (405, "word " * 30_000), (0, texts[0][1])]
    df = table(spark, texts + bad + odd)
    rows, model = quality_rules.judged(df)
    got = rows.collect()
    assert len(got) == len(texts + bad + odd) and rows.columns[:4] == ["doc_id", "text", "source", "n_chars"]
    for r in got:
        want = base_figures(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)
        if r.doc_id is None or r.doc_id < 200:
            assert r.kept
        elif r.doc_id < 300:
            assert not r.kept
    stay = quality_rules.keep_good(df)
    assert stay.columns == df.columns and stay.count() == sum(r.kept for r in got)
    assert model.accuracy("symbols") > 0.8


def test_empty_tables(spark):
    df = table(spark, [])
    assert quality_rules.judged(df)[0].count() == 0 and pii.digests(df).count() == 0 and pii.redact(df).count() == 0 and mixing.mix(df).count() == 0


def test_estimation_recovers_accuracies(spark):
    rng = random.Random(7)
    right = {"a": 0.95, "b": 0.8, "c": 0.6, "d": 0.9}
    counts = Counter()
    for _ in range(20_000):
        truth = 1 if rng.random() < 0.7 else -1
        counts[tuple((truth if rng.random() < p else -truth) if rng.random() < 0.6 else 0 for p in right.values())] += 1
    patterns = spark.createDataFrame([(*k, n) for k, n in counts.items()], "a int, b int, c int, d int, n bigint")
    model = weak.estimate(patterns, tuple(right), steps=60, smoothing=0.0)
    con = duckdb.connect()
    con.register("patterns", patterns.toPandas())
    got = con.sql(f"WITH {weak.estimate_sql('patterns', tuple(right))} SELECT * FROM posteriors").fetchall()
    same = weak.estimate(patterns, tuple(right))
    want = {(r.a, r.b, r.c, r.d): r.p for r in patterns.select("*", same.posterior({k: F.col(k) for k in right}).alias("p")).collect()}
    assert {tuple(r[:4]): r[4] for r in got} == pytest.approx(want, abs=1e-9)
    assert abs(model.share - 0.7) < 0.05
    for rule, p in right.items():
        assert abs(model.accuracy(rule) - p) < 0.05


def base_spans(text):
    t, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([ -]?[0-9])+", t):
        d = [int(c) for c in re.sub("[^0-9]", "", m[0])]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][ ().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out)]


def test_pii_spans(spark):
    rng = random.Random(2)
    bits = ["1", "4", "9", "0", " ", "-", ".", "+", "@", "a", "é", "🙂", "(", ")", "_", "%", "\n", "255", "300", "com", "a@b.c", "1.2.3.4", "+49 30 1234567", "4111 1111 1111 1111", "a@b.c_d@e.f", "079-12-3456"]
    texts = [(i, "".join(rng.choice(bits) for _ in range(rng.choice([1, 4, 12, 60])))) for i in range(500)]
    texts += [(900, None), (901, ""), (None, "mail me: x.y@mail.example.com"), (902, "a" * 2000), (903, "a@b" + ".c" * 3000), (904, "1.1" * 2000), (905, "+1" + " " * 5000), (906, "1 " * 3000), (3, texts[3][1]), (907, "x@y.z " * 300)]
    df = table(spark, texts)
    got = pii.digests(df).collect()
    assert len(got) == len(texts)
    plain = {i: t for i, t in texts}
    for r in got:
        want = base_spans(plain[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in want) for k in pii.BASE]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(want) <= set(spans)
        ends = sorted(tuple(map(int, x.split(":")[1:])) for x in spans)
        assert all(0 <= s < e <= len(plain[r.doc_id] or "") for s, e in ends)


def test_spans_that_the_method_adds(spark):
    rng = random.Random(8)
    texts = [(i, f'{prose(rng, 30)} token = "{rng.getrandbits(160):040x}" {prose(rng, 5)} call me at +49 30 12345{rng.randrange(100, 999)}') for i in range(30)]
    texts += [(100 + i, f"{prose(rng, 40)} write to ann{i}@mail.example.com or 10.0.{i}.7 {prose(rng, 9)}") for i in range(40)]
    texts += [(200 + i, prose(rng, 80) + f" in {1900 + i} it rose by {i}.5 and 12-{i}") for i in range(100)]
    got = {r.doc_id: r.spans for r in pii.digests(table(spark, texts)).collect()}
    assert all(got[i].startswith("key:") and "phone:" in got[i] for i in range(30))
    assert not any(got[200 + i] for i in range(100))  # clean documents have none


def test_long_keys_go_whole(spark):
    rng = random.Random(8)
    keys = ["".join(rng.choice("abcdef") + rng.choice("0123456789") for _ in range(150)) for _ in range(30)]  # no run of digits that could be a card
    texts = [(i, f'{prose(rng, 30)} token = "{k}" {prose(rng, 5)}') for i, k in enumerate(keys)]
    texts += [(100 + i, f"{prose(rng, 40)} write to ann{i}@mail.example.com or 10.0.{i}.7 {prose(rng, 9)}") for i in range(40)]
    got = {r.doc_id: r.text for r in pii.redact(table(spark, texts)).collect()}
    assert all("[KEY]" in got[i] and k[-12:] not in got[i] for i, k in enumerate(keys))


def test_very_long_secrets_and_spelled_addresses_go_whole(spark):
    rng = random.Random(3)
    secret = "".join(rng.choice("abcdefGHIJ") + rng.choice("0123456789") for _ in range(5000))
    local, host = "n" * 90 + "ame", "h" * 80
    texts = [(i, f'{prose(rng, 30)} token={secret} {prose(rng, 5)}') for i in range(20)]
    texts += [(50 + i, f"{prose(rng, 30)} mail {local}{i} [at] {host} [dot] mail [dot] internationals {prose(rng, 5)}") for i in range(20)]
    texts += [(100 + i, f"{prose(rng, 40)} write to ann{i}@mail.example.com {prose(rng, 9)}") for i in range(40)]
    got = {r.doc_id: r.text for r in pii.redact(table(spark, texts)).collect()}
    assert all("[KEY]" in got[i] and secret[-6:] not in got[i] for i in range(20))
    assert all("[EMAIL]" in got[50 + i] and local not in got[50 + i] and "internationals" not in got[50 + i] for i in range(20))


def test_long_texts_take_no_quadratic_time(spark):
    df = table(spark, [(1, "a" * 200_000), (2, "a@b" + ".c" * 60_000), (3, "+1" + " " * 100_000), (4, "7 " * 60_000), (5, "a" * 200_000 + " [at"), (6, "a." * 60_000 + "[at]" + "b." * 60_000)])
    assert [r.n_email for r in pii.digests(df).orderBy("doc_id").collect()] == [0, 1, 0, 0, 0, 0]


def test_redaction(spark):
    df = table(spark, [(1, "write a@b.com or 1.2.3.4 now"), (2, "nothing here"), (3, None)])
    got = {r.doc_id: r for r in pii.redact(df).collect()}
    assert got[1].text == "write [EMAIL] or [IP] now" and got[1].n_chars == len(got[1].text)
    assert got[2].text == "nothing here" and got[2].n_chars == 0 and got[3].text is None
    assert pii.redact(df).columns == df.columns


def test_redaction_by_a_plain_loop(spark):
    rng = random.Random(12)
    marks = ["a.b@c.de", "1.2.3.4", "+41 44 123 45 67", "4111 1111 1111 1111", "token=abcd1234efgh5678", "ann [at] mail [dot] com", "(212) 555-0147", "123-45-6789", "𝔘é" * 9, "\n"]
    texts = [" ".join(rng.choice(marks) if rng.random() < 0.5 else "w" * rng.randint(1, 40) for _ in range(n)) for n in (1, 3, 40, 127, 400, 900)]
    texts += ["x" * 1024 + " a@b.cd", "a@b.cd" + " é" * 1024, "𝔘" * 2041 + " 1.2.3.4", "\u0000 a@b.cd " + "y" * 3000 + " 1.2.3.4"]
    df = table(spark, list(enumerate(texts)))
    got = {r.doc_id: r.text for r in pii.redact(df).collect()}
    for r in pii.digests(df).collect():
        out, at, text = "", 0, texts[r.doc_id]
        for kind, start, end in (s.split(":") for s in r.spans.split(",") if s):
            if int(start) >= at:
                out += text[at : int(start)] + f"[{kind.upper()}]"
            at = max(at, int(end))
        assert got[r.doc_id] == out + text[at:]


def test_overlaps_by_a_plain_loop(spark):
    rng = random.Random(2)
    rows = []
    for n in (0, 1, 2, 3, 7, 8, 33):
        cuts = sorted(rng.sample(range(200), 2 * n))
        base = [(cuts[2 * k], cuts[2 * k + 1]) for k in range(n)]
        rows += [(base, (s, s + rng.randint(1, 9))) for s in range(0, 205)]
    df = spark.createDataFrame(rows, "base array<struct<start:int,end:int>>, s struct<start:int,end:int>")
    for r in df.withColumn("hit", pii.overlaps(F.col("s"), F.col("base"))).collect():
        assert r.hit == any(r.s.start < b.end and b.start < r.s.end for b in r.base)


def test_thousands_of_spans_take_no_quadratic_time(spark):
    text = " ".join(f"mail ann{i}@mail.example.com now, or call (212) 555-{i % 10000:04d} today" for i in range(16_000))
    got = pii.redact(table(spark, [(1, text)])).first().text
    assert got.count("[EMAIL]") == 16_000 and "ann" not in got


def mixture(spark, n):
    rng = random.Random(n)
    return [(i, "x" * rng.randint(0, 40), "src0" if i % 3 == 0 else f"s{i % 7}") for i in range(n)] + [(-1, "z", "rare"), (-2, "", "rare")] + [(None, "yy", None), (None, None, "empty"), (5, "again", "s1")]


def test_mixing_against_sql(spark):
    rows = mixture(spark, 400)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("copy_no", F.lit("clash"))
    got = sorted(map(str, mixing.mix(df).select("doc_id", "text", "source", "copy_no", "mix_key").collect()))
    con = duckdb.connect()
    pdf = df.toPandas()
    pdf["doc_id"] = pdf["doc_id"].astype("Int64")
    con.register("documents", pdf)
    want = con.sql(mixing.oracle_sql(columns="d.doc_id, d.text, d.source")).select("doc_id, text, source, copy_no, mix_key").fetchall()
    from pyspark.sql import Row

    want = sorted(str(Row(doc_id=a, text=b, source=c, copy_no=d, mix_key=e)) for a, b, c, d, e in want)
    assert got == want


def test_mixing_reaches_its_targets(spark):
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("z" * 10).alias("text"), F.when(F.col("id") % 3 == 0, "src0").otherwise(F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))).alias("source"))
    out = mixing.mix(df, {"src0": 1.0, "s1": 2.0})
    share = {r.source: r["count"] / 30_000 for r in out.groupBy("source").count().collect()}
    for source, weight in {"src0": 1, "s1": 2, "s0": 1, "s2": 1}.items():
        assert share[source] == pytest.approx(weight / 7, abs=0.01)
    assert out.groupBy("doc_id").agg(F.countDistinct("copy_no").alias("n"), F.max("copy_no").alias("m")).where("n <> m").count() == 0
    assert [r.mix_key for r in mixing.mix(df).limit(50).collect()] == [r.mix_key for r in mixing.mix(df).limit(50).collect()]


def test_poisson_table(spark):
    import math

    for rate in (0.3, 4.0, 16.0):
        cdf = spark.range(1).select(mixing.poisson_table(F.lit(rate))).first()[0]
        total = 0.0
        logs = [-rate + k * math.log(rate) - math.lgamma(k + 1) for k in range(len(cdf))]
        for k, value in enumerate(cdf):
            total += math.exp(logs[k])
            assert value == pytest.approx(total, abs=1e-9)
        assert cdf[-1] == pytest.approx(1, abs=1e-9) and len(cdf) <= 77
    assert spark.range(1).select(mixing.poisson_table(F.lit(0.0))).first()[0] == [1.0]


def test_very_large_rates(spark):
    """A source of one character beside one of two million: its document is repeated a million times."""
    df = spark.createDataFrame([(1, "x", "tiny"), (2, "y" * 2_000_000, "large")], "doc_id bigint, text string, source string")
    out = mixing.mix(df, {}).groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("copy_no").alias("k"), F.max("copy_no").alias("m")).collect()
    tiny = next(r for r in out if r.source == "tiny")
    assert abs(tiny.n - 1_000_000.5) < 6_000 and tiny.n == tiny.k == tiny.m


def test_split_rates_are_poisson(spark):
    """Mean and variance of rates above ``MOST`` agree, as a Poisson number's do."""
    rate = 50.0
    rows = spark.range(4000).select(mixing.copies(5, F.col("id").cast("string"), mixing.parts_of(F.lit(rate)), mixing.poisson_table(F.lit(rate) / mixing.parts_of(F.lit(rate)))).alias("n"))
    mean, var = rows.agg(F.avg("n"), F.variance("n")).first()
    assert mean == pytest.approx(rate, abs=0.5) and var == pytest.approx(rate, rel=0.1)
