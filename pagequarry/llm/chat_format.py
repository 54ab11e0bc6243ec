r"""Chat formatting: a finite-state machine over roles and a declarative template.

Conversations are dealt to tasks by id and sorted by turn; a task then walks
its rows once, a turn at a time, so neither a conversation nor a task's share is ever
held in memory.  Every turn becomes three segments, its header, its text and its
end mark, each with a loss flag: only the texts of the template's loss roles
carry loss.  Control strings inside texts are escaped with a backslash, and so are
backslashes, so a formatted conversation can be read back exactly.

Defined results: a null text is empty, a null role is the empty role; unknown roles
are written with a header that names them; a conversation whose turns break the
order keeps all its turns, with ``valid`` false and the first broken turn in
``broken_at``; rows of one turn number (ties, repeats) are ordered by role and
text; rows with a null conversation id form one conversation; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (state, role) -> state; a pair that is missing breaks the order.
TRANSITIONS = {
    ("start", "system"): "system",
    ("start", "user"): "user",
    ("system", "user"): "user",
    ("user", "assistant"): "assistant",
    ("assistant", "user"): "user",
}
#: States in which a conversation may end.
FINAL = frozenset({"user", "assistant"})


@dataclass(frozen=True)
class Template:
    """Headers by role, the mark of a turn's end, and the strings that only the template may write."""

    headers: dict[str, str] = field(default_factory=lambda: {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "})
    other_header: tuple[str, str] = ("### Role ", ": ")
    end: str = " </turn>\n"
    controls: tuple[str, ...] = ("###", "</turn>")
    loss_roles: frozenset[str] = frozenset({"assistant"})

    def escape(self, text: str, also: str = "") -> str:
        """A backslash before every backslash and every place where a control string starts."""
        starts = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in (*self.controls, *also))
        return re.sub(rf"\\|{starts}", lambda m: "\\" + m[0], text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)

    def header(self, role: str) -> str:
        return self.headers.get(role) or self.other_header[0] + self.escape(role, ":") + self.other_header[1]

    def turn_pattern(self) -> re.Pattern:
        """One formatted turn: a known header or a named role, the escaped text, the end mark."""
        bare = "".join(re.escape(c[0]) for c in self.controls)
        lone = "|".join(f"{re.escape(c[0])}(?!{re.escape(c[1:])})" for c in self.controls)
        body = rf"(?:\\.|[^\\{bare}]+|{lone})*?"
        known = "|".join(re.escape(h) for h in self.headers.values())
        named = rf"{re.escape(self.other_header[0])}(?P<role>(?:\\.|[^\\:])*){re.escape(self.other_header[1])}"
        return re.compile(rf"(?:(?P<header>{known})|{named})(?P<text>{body}){re.escape(self.end)}", re.DOTALL)


SEGMENTS = "conv_id long, turn_index long, part int, segment string, loss boolean, valid boolean, broken_at long"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, broken_at long"


def ordered(rows: DataFrame) -> DataFrame:
    """Conversations whole within partitions, their turns in order."""
    return (
        rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in schema.split(", "))])


#: Stands for "no conversation yet"; None is a conversation's id.
NONE = object()


def _format(template: Template):
    schema = _arrow(SEGMENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, index, broken = NONE, "start", 0, None
        for batch in batches:
            out = []
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if conv is NONE or conv_id != conv:
                    conv, state, index, broken = conv_id, "start", 0, None
                following = TRANSITIONS.get((state, role))
                if following is None:
                    broken = index if broken is None else broken
                    following = role if role in template.headers else state
                state = following
                ok = broken is None and state in FINAL
                for part, (segment, loss) in enumerate(((template.header(role), False), (template.escape(text), role in template.loss_roles), (template.end, False))):
                    out.append((conv_id, index, part, segment, loss, ok, broken))
                index += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)] if out else [pa.array([], t) for t in schema.types], schema=schema)

    return run


def format_segments(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """The text segments of every conversation in order, with their loss flags.

    ``valid`` and ``broken_at`` hold as of the segment's turn: those of the last
    segment are the conversation's.
    """
    return ordered(rows).mapInArrow(_format(template), SEGMENTS)


class _Reader:
    """Reads one conversation back from its formatted text, turn by turn."""

    def __init__(self, template: Template):
        self.template, self.pattern = template, template.turn_pattern()
        self.roles = {h: r for r, h in template.headers.items()}
        self.buffer, self.loss_parts, self.n_turns, self.n_chars, self.loss_chars = "", [], 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, segment: str, under_loss: bool, ends_turn: bool) -> None:
        self.buffer += segment
        self.n_chars += len(segment)
        if under_loss:
            text = self.template.unescape(segment)
            self.loss_chars += len(text)
            self.loss.update(text.encode())
        if ends_turn:
            found = self.pattern.fullmatch(self.buffer)
            if not found:
                raise ValueError(f"a formatted turn can't be read back: {self.buffer[:80]!r}")
            role = self.roles[found["header"]] if found["header"] else self.template.unescape(found["role"])
            self.turns.update(f"{role}\n{self.template.unescape(found['text'])}\n".encode())
            self.n_turns += 1
            self.buffer = ""


def _read(template: Template):
    schema = _arrow(DIGEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, reader, last = NONE, None, None

        def done():
            return (conv, reader.n_turns, reader.turns.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.n_chars, *last)

        for batch in batches:
            out = []
            for conv_id, part, segment, loss, valid, broken in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "segment", "loss", "valid", "broken_at")), strict=True):
                if conv is NONE or conv_id != conv:
                    if conv is not NONE:
                        out.append(done())
                    conv, reader = conv_id, _Reader(template)
                reader.feed(segment, loss, part == 2)
                last = (valid, broken)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)] if out else [pa.array([], t) for t in schema.types], schema=schema)
        if conv is not NONE:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(done(), schema.types)], schema=schema)

    return run


def read_back(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """Per conversation, what its formatted text says: turns, loss text and sizes.

    ``segments`` must come straight from ``format_segments``: it keeps its order.
    """
    return segments.mapInArrow(_read(template), DIGEST)


def formatted_text(segments: DataFrame) -> DataFrame:
    """conv_id and its formatted text, for conversations that fit in a row."""
    parts = F.array_sort(F.collect_list(F.struct("turn_index", "part", "segment")))
    return segments.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["segment"]), "").alias("formatted"))
