"""Personal data by weak supervision over spans (native).

Base spans are what fixed patterns and checks find; they always count.
Further candidates are what looser patterns find (national phone numbers,
spelled-out mail addresses, keys, social security numbers), where no base span
lies. What the base patterns matched but their checks refused is learned from
too, as that is where most wrong spans are. Four labelers vote on each span:
its shape, a gazetteer (domains, country codes, card issuers, address
ranges), the words before it, and the characters around it. Expectation
maximisation over the counts of vote patterns in the whole corpus estimates
their reliability; with the posteriors as soft labels a naive Bayes
classifier over features of spans is trained, and the candidates that it
gives a probability of at least ``THRESHOLD`` are added.

Positions come from splitting a text by a pattern and adding up the lengths
of pieces and matches, so whole texts are handled by built-in functions. The
patterns can't run in quadratic time: repetition is possessive, and a match
may begin only where the run of its characters begins or where the match
before ended, which changes no match. Spans are found once per text and
written to shared storage; only counts, at most a row per vote pattern and
one per feature value, go to the driver.

Defined results: a null text counts as empty and has no spans; repeated rows
and rows without doc_id are handled like any other; input columns named like
an output column are replaced. ``redact`` puts ``[KIND]`` for each run of
overlapping spans, named by the first, and keeps null texts null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm import weak
from verdigris.llm.common import materialise, packed, unpacked

#: Kinds in the order in which spans that start together are listed.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "key", "ssn")
THRESHOLD = 0.5

_MAIL = "A-Za-z0-9._%+-"
#: kind, pattern, and a cheap condition without which there is no match.
PATTERNS = {
    "email": (rf"(?:(?<![{_MAIL}])|\G)[{_MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9]"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
}
LOOSE = {
    "email": (r"(?:(?<![A-Za-z0-9._-])|\G)[A-Za-z0-9._-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z][A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)*+", r"[\[(]at[\])]"),
    "phone": (r"(?<![0-9.+-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])", r"[0-9]{3}[\x20.-][0-9]{4}"),
    "key": (r"(?i)(?<![A-Za-z])(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\x20?[=:]\x20?[\"']?[A-Za-z0-9/+_-]{12,}+[\"']?", r"[=:]"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-"),
}
#: Gazetteers; fixed values.
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "it", "nl", "ch", "at", "us", "ca", "au", "example", "test")
COUNTRIES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91")
ISSUERS = ("4", "51", "52", "53", "54", "55", "2", "34", "37", "35", "36", "38", "60", "64", "65", "62")
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|mailto)\b",
    "ip": r"(?i)\b(?:ip|host|address|server|from|client|login)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|payment|credit|debit|account)\b",
    "phone": r"(?i)\b(?:tel|phone|call|mobile|fax|cell|whatsapp|telefon|teléfono|téléphone)\b",
    "key": r"(?i)\b(?:token|key|secret|password|login|auth|credential)\b",
    "ssn": r"(?i)\b(?:ssn|social|security)\b",
}
#: Words before a number that is none of these.
AGAINST = r"(?i)\b(?:version|section|chapter|page|isbn|order|no|nr|release|figure|table)\b\W*$"
LABELERS = ("shape", "gazetteer", "context", "bounds")


#: Matches that are numbered together; keeps the cost of growing arrays near linear.
STRETCH = 128
_SPAN = "array<struct<start:int,end:int,match:string,before:string,after:string>>"


def found(text: Column, pattern: str, needs: str) -> Column:
    """Array of a pattern's matches, leftmost and not overlapping, in code points.

    Each has start, end, match, up to 32 characters before it (not beyond the
    match before) and the character after it (none if a match follows).
    """
    there = F.instr(text, needs) > 0 if needs == "@" else F.rlike(text, F.lit(needs))
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.arrays_zip(pieces.alias("piece"), matches.alias("match"), F.slice(pieces, F.lit(2), F.greatest(F.size(matches), F.lit(1))).alias("next"))
    return F.when(there, both)


def numbered(both: Column) -> Column:
    """Positions for what ``found`` returns, by running sums of lengths."""
    none = F.array().cast(_SPAN)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        end = start + F.coalesce(F.length(x["match"]), F.lit(0))
        span = F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match"), F.substring(x["piece"], -32, 32).alias("before"), F.substring(x["next"], 1, 1).alias("after"))
        return F.struct(end.alias("at"), F.when(x["match"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(span))).alias("out"))

    def stretch(acc: Column, k: Column) -> Column:
        part = F.slice(both, k * STRETCH + 1, F.lit(STRETCH))
        inner = F.aggregate(part, F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return F.struct(inner["at"].alias("at"), F.concat(acc["out"], F.array(inner["out"])).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))
    stretches = F.sequence(F.lit(0), F.floor((F.size(both) - 1) / STRETCH).cast("int"))
    return F.when(F.size(both) > 1, F.aggregate(stretches, first, stretch, lambda acc: F.flatten(acc["out"]))).otherwise(none)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often and in whatever lambda it is read."""
    return F.element_at(F.transform(F.array(value), body), 1)


def overlaps(span: Column, spans: Column) -> Column:
    """Whether a span meets one of ``spans``, which are in order and apart: by binary search for the first that ends behind its start."""
    n = F.size(spans)

    def halve(acc: Column, _: Column) -> Column:
        middle = F.shiftright(acc["lo"] + acc["hi"], 1)
        over, ends = acc["lo"] >= acc["hi"], F.get(spans, middle)["end"] > span["start"]
        return F.struct(F.when(over | ends, acc["lo"]).otherwise(middle + 1).alias("lo"), F.when(~over & ends, middle).otherwise(acc["hi"]).alias("hi"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(n + 1)).cast("int"))
    first = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), n.alias("hi")), halve, lambda acc: F.get(spans, acc["lo"]))
    return F.coalesce(first["start"] < span["end"], F.lit(False))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check: from the right, every second one counts doubled, by its cross sum."""
    def term(c: Column, i: Column) -> Column:
        d = F.ascii(c) - 48
        return F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), term)
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    """The base's check of a match."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        def small(part: Column) -> Column:
            bare = F.regexp_replace(part, "^0+", "")
            return (F.length(bare) <= 3) & (F.concat(F.lit("0"), F.substring(bare, 1, 3)).cast("int") <= 255)

        return F.forall(F.split(match, r"\."), small)
    n = F.length(_digits(match))
    return n.between(12, 19) & luhn(F.when(n <= 19, _digits(match)).otherwise("")) if kind == "card" else n.between(9, 15)


def plausible(kind: str, match: Column) -> Column:
    """Whether a refused match is still an example worth learning from; every valid match is plausible."""
    if kind in ("email", "ip"):
        return F.lit(True)
    return F.length(_digits(match)).between(12, 19) if kind == "card" else F.length(_digits(match)).between(7, 17)


def _gazetteer(kind: str, match: Column) -> Column:
    def listed(value: Column, values: tuple[str, ...]) -> Column:
        return F.when(value.isin(*values), 1).otherwise(-1)

    digits = _digits(match)
    if kind == "email":
        return listed(F.lower(F.regexp_extract(match, "([A-Za-z]+)$", 1)), DOMAINS)
    if kind == "ip":
        return F.when(F.rlike(match, F.lit(r"^(?:0|127|255)\.|\.0\.0\.0$")), -1).otherwise(0)
    if kind == "card":
        return F.when(F.substring(digits, 1, 1).isin(*ISSUERS) | F.substring(digits, 1, 2).isin(*ISSUERS), 1).otherwise(-1)
    if kind == "phone":
        code = F.substring(digits, 1, 1).isin(*COUNTRIES) | F.substring(digits, 1, 2).isin(*COUNTRIES)
        return F.when(F.rlike(match, F.lit(r"^\+")), F.when(code, 1).otherwise(-1)).otherwise(0)
    if kind == "key":
        return F.when(F.rlike(match, F.lit("[0-9]")) & F.rlike(match, F.lit("[A-Za-z]")), 1).otherwise(-1)
    return F.when(F.rlike(match, F.lit("^(?:000|666|9)|-00-|-0000$")), -1).otherwise(1)


def _labelled(kind: str, spans: Column, base: bool) -> Column:
    """The spans with kind, votes and features."""
    rank = KINDS.index(kind)

    def one(s: Column) -> Column:
        match, ok = s["match"], valid(kind, s["match"]) if base else F.lit(True)
        before, inner = s["before"], F.lit(r"[\p{L}\p{N}]")
        tight = F.rlike(F.substring(before, -1, 1), inner) | F.rlike(s["after"], inner)
        near = F.concat(before, match) if kind == "key" else before  # a key's name is part of its match
        about = F.when(F.rlike(near, F.lit(CONTEXT[kind])), 1).when(F.rlike(before, F.lit(AGAINST)), -1).otherwise(0)
        shape = F.when(ok, F.lit(1 if base else 0)).otherwise(-1)
        share = F.floor(4 * F.length(_digits(match)) / F.greatest(F.length(match), F.lit(1)))
        features = F.array(
            F.lit(f"kind:{kind}:{'base' if base else 'loose'}"),
            F.concat(F.lit(f"ok:{kind}:"), ok.cast("string")),
            F.concat(F.lit("size:"), F.least(F.floor(F.length(match) / 8), F.lit(8)).cast("string")),
            F.concat(F.lit("digits:"), share.cast("string")),
            F.concat(F.lit("tight:"), tight.cast("string")),
            F.concat(F.lit("about:"), about.cast("string")),
        )
        return F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.lit(rank).alias("rank"), (ok if base else F.lit(False)).alias("base"), F.lit(not base).alias("loose"),
            shape.alias("shape"), _gazetteer(kind, match).alias("gazetteer"), about.alias("context"), F.when(tight, -1).otherwise(1).alias("bounds"), features.alias("features"),
        )

    return F.transform(F.filter(spans, lambda s: plausible(kind, s["match"])) if base else spans, one)


def measured(docs: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """``_row`` and ``_spans``: base spans, refused matches, and candidates that overlap no base span."""
    rows = packed(docs, F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    names = []
    for base, patterns in ((True, PATTERNS), (False, LOOSE)):
        for kind, (pattern, needs) in patterns.items():
            names.append((kind, base, f"_{'base' if base else 'loose'}_{kind}"))
            rows = rows.withColumn(names[-1][2], found(F.col("_text"), pattern, needs))
    # a column each, so that lambdas read the matches instead of finding them again
    rows = rows.select("_row", *[numbered(F.col(name)).alias(name) for _, _, name in names])
    spans = F.concat(*[_labelled(kind, F.col(name), base) for kind, base, name in names])
    some = F.lit(False)
    for _, _, name in names:
        some = some | (F.size(name) > 0)
    kept = [n for n in docs.columns if n not in drop]
    rows = rows.select(F.struct(*[F.col("_row").getField(n).alias(n) for n in kept]).alias("_row"), F.when(some, spans).alias("_all"))
    # base spans of one kind are in order and apart
    sure = F.array(*[F.filter("_all", lambda s, k=rank: s["base"] & (s["rank"] == k)) for rank in range(len(BASE))])
    clear = _let(sure, lambda by_kind: F.filter("_all", lambda s: ~s["loose"] | ~F.exists(by_kind, lambda spans: overlaps(s, spans))))
    return rows.select("_row", F.sort_array(clear).alias("_spans"))


def trained(rows: DataFrame) -> Column | None:
    """Array of the spans of ``_spans`` that count, or None where the corpus has no span."""
    spans = rows.where("_spans IS NOT NULL").select(F.explode("_spans").alias("s"))
    patterns = materialise(spans.groupBy(*[F.col(f"s.{x}").alias(x) for x in LABELERS], F.col("s.features").alias("features")).agg(F.count("*").alias("n")), "pii-patterns")
    votes = patterns.groupBy(*LABELERS).agg(F.sum("n").alias("n"))
    model = weak.estimate(votes, LABELERS, weak.first_guess(LABELERS, telling=False))
    p = model.posterior({x: F.col(x) for x in LABELERS})
    values = patterns.select("n", p.alias("p"), F.explode("features").alias("f")).groupBy("f").agg(F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no")).collect()
    if not values:
        return None
    yes, no = sum(r.yes for r in values if r.f.startswith("kind:")), sum(r.no for r in values if r.f.startswith("kind:"))
    weights = F.create_map(*[F.lit(x) for r in values for x in (r.f, math.log((r.yes + 1) / (yes + 2)) - math.log((r.no + 1) / (no + 2)))])
    prior, least = math.log((yes + 1) / (no + 1)), math.log(THRESHOLD / (1 - THRESHOLD))
    score = lambda s: F.aggregate(s["features"], F.lit(prior), lambda a, f: a + F.coalesce(F.element_at(weights, f), F.lit(0.0)))
    return F.filter("_spans", lambda s: s["base"] | (s["loose"] & (score(s) >= least)))


def detected(docs: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """``_row`` and ``_found``, the array of spans that count, by start, then kind."""
    rows = materialise(measured(docs, drop), "pii-spans")
    chosen = trained(rows)
    none = F.array().cast(rows.schema["_spans"].dataType)
    return rows.select("_row", F.coalesce(none if chosen is None else chosen, none).alias("_found"))


def _listed(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` but its text, with base counts, the base's digest, all spans and their number."""
    rows = detected(docs, drop=("text",))
    base = F.filter("_found", lambda s: s["base"])

    def count(rank: int) -> Column:
        return F.size(F.filter("_found", lambda s: s["base"] & (s["rank"] == rank))).cast("bigint")

    counts = [count(rank).alias(f"n_{k}") for rank, k in enumerate(BASE)]
    more = [*counts, F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("_found")).alias("spans"), F.size("_found").cast("bigint").alias("n_spans")]
    return unpacked(rows, *more, replacing=(*[f"n_{k}" for k in BASE], "base_sha256", "spans", "n_spans"))


#: Characters of a block of a text, so that a piece is found without counting from the text's start.
BLOCK = 1024


def _cut(blocks: Column, start: Column, end: Column) -> Column:
    """The characters from ``start`` up to ``end`` of a text in blocks."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
    head = F.substring(F.get(blocks, first), start % BLOCK + 1, F.when(first == last, end - start).otherwise(BLOCK))
    tail = F.substring(F.coalesce(F.get(blocks, last), F.lit("")), F.lit(1), end % BLOCK)
    return F.when(end <= start, "").when(first == last, head).otherwise(F.concat(head, F.array_join(F.slice(blocks, first + 2, last - first - 1), ""), tail))


def _replaced(spans: Column, blocks: Column, length: Column, kinds: Column) -> Column:
    """The text with the name of its kind for each run of overlapping spans, in stretches of spans whose pieces are joined once."""
    none = F.array().cast("array<string>")

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(_cut(blocks, acc["at"], s["start"]), F.get(kinds, s["rank"]))
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(piece))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    def stretch(acc: Column, k: Column) -> Column:
        part = F.slice(spans, k * STRETCH + 1, F.lit(STRETCH))
        inner = F.aggregate(part, F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return _let(inner, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(F.array_join(x["out"], ""))).alias("out")))

    stretches = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / STRETCH).cast("int"))
    first = F.struct(F.lit(0).alias("at"), none.alias("out"))
    return F.aggregate(stretches, first, stretch, lambda acc: F.concat(F.array_join(acc["out"], ""), _cut(blocks, acc["at"], length)))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span in ``text`` replaced, and ``n_chars``, where there is one, recounted."""
    rows = detected(docs)
    text = F.col("_row").getField("text")
    kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ordered = F.sort_array(F.transform("_found", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"))))
    rows = rows.withColumn("_text", text).withColumn("_order", ordered)
    blocks = F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{BLOCK}}}+"), F.lit(0))
    done = _let(F.col("_order"), lambda spans: _let(blocks, lambda parts: _replaced(spans, parts, F.length("_text"), kinds)))
    rows = rows.withColumn("_new", F.when(F.size("_order") > 0, done).otherwise(F.col("_text")))
    out = []
    for f in rows.schema["_row"].dataType.fields:
        column = F.col("_row").getField(f.name)
        if f.name == "text":
            column = F.col("_new")
        elif f.name == "n_chars":
            column = F.when(F.size("_order") > 0, F.length("_new")).otherwise(column).cast(f.dataType)
        out.append(column.alias(f.name))
    return rows.select(*out)
