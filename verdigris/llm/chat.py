"""Chat formatting by a finite-state machine over roles and a declarative template.

A template says, for each role, what stands before and after a turn's text and
whether the text counts for the loss; its transition table says which role may
follow which. Formatting emits segments (text, loss flag): markers never carry
loss, a turn's text carries its role's flag. Control strings inside a text are
escaped so that no text can forge a turn; ``Reader`` finds the turns again in
the formatted text alone, by its control strings, and undoes the escapes.

Rows are dealt by conversation and sorted by turn inside partitions, then
streamed: a worker holds one row, the machine's state and running digests,
never a conversation, so a conversation with a third of all rows costs time
in one task but no memory. That one task can't be split where a digest over
the whole conversation is asked for; ``format_segments`` alone needs no more
than the state, too.

Defined results: a null text is an empty one; a null role is the empty role,
an unknown role is formatted with the template's fallback markers, and both
make the conversation invalid, as does a forbidden order; invalid
conversations are formatted all the same and carry the position of their
first fault. Rows without conv_id form one conversation of their own. Rows
with equal turn are ordered by role, then text; a null turn comes first.
Columns besides conv_id, turn, role and text are not carried along.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Markers and loss by role, and the machine that checks their order."""

    turns: dict[str, tuple[str, str, bool]]  # role: before, after, loss
    first: frozenset[str]  # roles that may begin
    follows: dict[str, frozenset[str]]  # state (last role): roles that may come
    final: frozenset[str]  # states in which a conversation may end
    fallback: tuple[str, str] = ("[TURN:{role}] ", " [/TURN]")
    escape: str = "\\"
    controls: tuple[str, ...] = field(default=())

    @property
    def escaped(self) -> tuple[str, ...]:
        """First characters of control strings, and the escape itself."""
        return tuple(sorted({c[0] for c in self.controls} | {self.escape}))


#: A template in the widespread instruction style; every control string starts with < or [.
INSTRUCT = Template(
    turns={
        "system": ("[SYS] ", " [/SYS]", False),
        "user": ("<s>[INST] ", " [/INST]", False),
        "assistant": (" ", "</s>", True),
    },
    first=frozenset({"system", "user"}),
    follows={
        "system": frozenset({"user"}),
        "user": frozenset({"assistant"}),
        "assistant": frozenset({"user"}),
    },
    final=frozenset({"assistant"}),
    controls=("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[TURN:", "[/TURN]"),
)


class Machine:
    """Validates roles one by one; remembers the first fault."""

    def __init__(self, template: Template):
        self.template, self.state, self.position, self.fault = template, None, 0, None

    def feed(self, role: str) -> None:
        may = self.template.first if self.state is None else self.template.follows.get(self.state, ())
        if self.fault is None and role not in may:
            self.fault = self.position
        self.state, self.position = role, self.position + 1

    def end(self) -> int | None:
        """Position of the first fault, or of the missing turn, or None."""
        if self.fault is None and self.state not in self.template.final:
            return self.position
        return self.fault


def escape(text: str, template: Template) -> str:
    """Put the escape before each character that could begin a control string."""
    return re.sub("[" + re.escape("".join(template.escaped)) + "]", lambda m: template.escape + m[0], text)


def unescape(text: str, template: Template) -> str:
    return re.sub(re.escape(template.escape) + "(.)", r"\1", text, flags=re.S)


def segments(role: str, text: str, template: Template) -> list[tuple[str, bool]]:
    """What a turn becomes."""
    if role in template.turns:
        before, after, loss = template.turns[role]
    else:
        before, after, loss = template.fallback[0].format(role=escape(role, template).replace("]", template.escape + "]")), template.fallback[1], False
    return [(before, False), (escape(text, template), loss), (after, False)]


class Reader:
    """Finds turns in formatted text that comes in pieces, whatever the pieces are.

    Inside a turn's text each character that could begin a control string is
    escaped, so the first bare one is where the turn ends.
    """

    def __init__(self, template: Template):
        self.template, self.buffer = template, ""
        bare = re.escape("".join(template.escaped))
        e = re.escape(template.escape)
        self.body = re.compile(f"(?:[^{bare}]++|{e}.)*+", re.S)
        self.role = re.compile(f"(?:[^{bare}\\]]++|{e}.)*+", re.S)
        self.head, self.tail = template.fallback[0].split("{role}")

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        """Role and text of each turn that the piece completes."""
        self.buffer += piece
        while (turn := self._turn()) is not None:
            role, text, self.buffer = turn
            yield role, text

    def _turn(self) -> tuple[str, str, str] | None:
        b = self.buffer
        if b.startswith(self.head):
            named = self.role.match(b, len(self.head)).end()
            if not b.startswith(self.tail, named):
                return None
            return self._ended(unescape(b[len(self.head) : named], self.template), named + len(self.tail), self.template.fallback[1])
        for role, (before, after, _) in self.template.turns.items():
            if b.startswith(before):
                return self._ended(role, len(before), after)
        if not any(m.startswith(b) for m in (self.head, *(t[0] for t in self.template.turns.values()))):
            raise ValueError(f"no turn of the template: {b[:80]!r}")
        return None

    def _ended(self, role: str, start: int, after: str) -> tuple[str, str, str] | None:
        """The turn that began at ``start``, if its end mark is there."""
        b = self.buffer
        mark = next(k for k, c in enumerate(after) if c in self.template.escaped)  # plain characters before the control string
        stop = self.body.match(b, start).end() - mark
        if len(b) < stop + len(after):
            return None
        if not b.startswith(after, stop):
            raise ValueError(f"{role} turn does not end with {after!r}")
        return role, unescape(b[start:stop], self.template), b[stop + len(after) :]

    def end(self) -> None:
        if self.buffer:
            raise ValueError(f"text after the last turn: {self.buffer[:80]!r}")


_SEGMENTS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("position", pa.int64()), ("segment", pa.int32()), ("text", pa.string()), ("loss", pa.bool_()), ("ended", pa.bool_()), ("fault", pa.int64())])
_SEGMENTS_DDL = "conv_id bigint, turn bigint, position bigint, segment int, text string, loss boolean, ended boolean, fault bigint"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Rows as Arrow columns: ids stay integers beside nulls."""
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def format_segments(turns: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Rows (conv_id, turn, position, segment, text, loss), in order inside each partition.

    After a conversation's last turn comes a row with ``ended`` true, no text,
    and the machine's ``fault`` (null: valid).
    """
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        last, machine = "none yet", Machine(template)
        for batch in batches:
            for conv, turn, role, text in _rows(batch, "conv_id", "turn", "role", "text"):
                if conv != last:
                    if last != "none yet":
                        out.append((last, None, machine.position, 0, None, False, True, machine.end()))
                    last, machine = conv, Machine(template)
                at = machine.position
                machine.feed(role)
                out += [(conv, turn, at, k, t, loss, False, None) for k, (t, loss) in enumerate(segments(role, text, template))]
                if len(out) >= 5000:
                    yield _batch(out, _SEGMENTS)
                    out = []
        if last != "none yet":
            out.append((last, None, machine.position, 0, None, False, True, machine.end()))
        yield _batch(out, _SEGMENTS)

    return rows.mapInArrow(run, _SEGMENTS_DDL)


_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_()), ("fault", pa.int64())])
_DIGESTS_DDL = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, valid boolean, fault bigint"


def read_back(formatted: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """One row per conversation, read from the text and loss flags of ``format_segments``' output in its order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fresh():
            return Reader(template), hashlib.sha256(), hashlib.sha256(), 0, 0, 0

        reader, turns, loss, n, loss_chars, chars = fresh()
        for batch in batches:
            out = []
            for conv, text, flag, ended, fault in _rows(batch, "conv_id", "text", "loss", "ended", "fault"):
                if ended:
                    reader.end()
                    out.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, fault is None, fault))
                    reader, turns, loss, n, loss_chars, chars = fresh()
                    continue
                chars += len(text)
                if flag:
                    plain = unescape(text, template)
                    loss_chars += len(plain)
                    loss.update(plain.encode("utf-8", "surrogatepass"))
                for role, said in reader.feed(text):
                    turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    n += 1
            yield _batch(out, _DIGESTS)

    return formatted.mapInArrow(run, _DIGESTS_DDL)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle_sql(turns: str, template: Template = INSTRUCT) -> str:
    """The digests in DuckDB's SQL, for the rows (conv_id, turn, role, text) of ``turns``."""
    control = "".join(c for c in template.escaped)
    head, tail = template.fallback[0].split("{role}")

    def escaped(x: str, characters: str) -> str:
        return f"(2 * length({x}) - length(translate({x}, {_quoted(characters)}, '')))"

    def listed(roles: frozenset[str]) -> str:
        return ", ".join(map(_quoted, sorted(roles)))

    marks = " ".join(f"WHEN role = {_quoted(r)} THEN {len(a) + len(b)}" for r, (a, b, _) in template.turns.items())
    loss = f"role IN ({listed(frozenset(r for r, t in template.turns.items() if t[2]))})"
    follows = " ".join(f"WHEN prev = {_quoted(s)} THEN role IN ({listed(r)})" for s, r in template.follows.items())
    return f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM ({turns})),
placed AS (
  SELECT *, row_number() OVER w - 1 AS position, lag(role) OVER w AS prev, count(*) OVER (PARTITION BY conv_id) AS n
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
judged AS (
  SELECT *, CASE WHEN position = 0 THEN role IN ({listed(template.first)}) {follows} ELSE false END AS fits,
    {escaped('text', control)} + CASE {marks} ELSE {len(head) + len(tail) + len(template.fallback[1])} + {escaped('role', control + ']')} END AS chars
  FROM placed),
found AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY position)) AS turns_sha256,
    sum(CASE WHEN {loss} THEN length(text) ELSE 0 END)::BIGINT AS loss_chars, sha256(string_agg(CASE WHEN {loss} THEN text ELSE '' END, '' ORDER BY position)) AS loss_sha256,
    sum(chars)::BIGINT AS formatted_chars,
    coalesce(min(CASE WHEN NOT fits THEN position END), min(CASE WHEN position = n - 1 AND role NOT IN ({listed(template.final)}) THEN n END)) AS fault
  FROM judged GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, fault IS NULL AS valid, fault FROM found
"""
