"""Chat formatting: a finite-state machine over roles, and a declarative template.

A template says what stands before and after the text of each role, which texts count for the loss, and from which role
which other may follow. Texts are escaped, so that no control string of the template can come from inside a text, and
reading the output back gives the turns again. The output is one row for each segment, so a conversation of any length
streams through a task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from llm.cluster import partitions, ship


@dataclass(frozen=True)
class Role:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """start: before the first turn. other: of roles not named, whose name stands for {role}. moves: state -> roles that may follow."""

    start: str = "<s>"
    roles: dict[str, Role] = field(default_factory=lambda: {"system": Role("<<SYS>>\n", "\n<</SYS>>\n\n"), "user": Role("[INST] ", " [/INST]"), "assistant": Role(" ", " </s>", loss=True)})
    other: Role = field(default_factory=lambda: Role("[ROLE {role}] ", " [/ROLE]"))
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE", "[/ROLE]")
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: tuple[str, ...] = ("user", "assistant")

    def escape(self, text: str) -> str:
        """A backslash doubled; one put after the first character of each control string."""
        return self._control.sub(lambda m: m[0] * 2 if m[0] == "\\" else m[0] + "\\", text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)

    @property
    def _control(self) -> re.Pattern:
        # the rest of a control string is only looked at, so one that begins inside another is found too
        return re.compile(r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in sorted(self.controls, key=len, reverse=True)))

    def of(self, role: str) -> Role:
        r = self.roles.get(role)
        return r or Role(self.other.before.replace("{role}", self.escape(role).replace("]", "\\]")), self.other.after, self.other.loss)


LLAMA = Template()

SEGMENT = "conv_id long, seg long, kind string, role string, text string, loss boolean, valid boolean"
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_()]


def segments(turns: Iterable[tuple[str | None, str | None]], template: Template) -> Iterator[tuple[str, str, str, bool, bool]]:
    """kind (start, before, text, after), role, text, loss, and whether the turns up to here are in a valid order."""
    state, valid = "", True
    yield "start", "", template.start, False, True
    for role, text in turns:
        role = role or ""
        valid = valid and role in template.moves.get(state, ())
        state, r = role, template.of(role)
        yield "before", role, r.before, False, valid
        yield "text", role, template.escape(text or ""), r.loss, valid
        yield "after", role, r.after, False, valid
    yield "stop", state, "", False, valid and state in template.ends


def format_chats(turns: DataFrame, template: Template = LLAMA, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each segment of each conversation, in order of seg: text, loss, kind, role; valid says whether the
    turns so far follow the template's moves, and in the last segment (kind stop, without text) whether all do and the
    conversation may end there.

    Turns are in the order of turn, nulls first, then role and text, nulls first. Null roles and texts are empty; a null
    conv_id is a conversation; repeated rows are turns of their own. Other columns are left aside. An empty table gives
    an empty result.
    """
    rows = turns.select(F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text"))
    rows = rows.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def scan(batches):
        def stream():
            for b in batches:
                yield from zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)

        out = []
        for conv, own in groupby(stream(), key=lambda r: r[0]):
            for k, s in enumerate(segments(((r[1], r[2]) for r in own), template)):
                out.append((conv, k, *s))
                if len(out) >= 10_000:
                    yield _batch(out)
                    out = []
        if out:
            yield _batch(out)

    ship(turns.sparkSession)
    return rows.mapInArrow(scan, SEGMENT)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], [x.split()[0] for x in SEGMENT.split(", ")])


class Parser:
    """Reads formatted text back, fed in pieces: gives (role, text) of each turn, texts unescaped, as soon as it is whole."""

    def __init__(self, template: Template):
        self.template = template
        marks = {template.start: ("start", "")} | {r.before: ("before", k) for k, r in template.roles.items() if r.before.strip()}
        self._opening, self._marks = sorted(marks, key=len, reverse=True), marks

    def turns(self, text: str) -> Iterator[tuple[str, str]]:
        t, at = self.template, 0
        if not text.startswith(t.start):
            raise ValueError("no start mark")
        at = len(t.start)
        plain = next((k for k, r in t.roles.items() if not r.before.strip()), None)
        head, tail = t.other.before.split("{role}")
        while at < len(text):
            mark = next((m for m in self._opening if m != t.start and text.startswith(m, at)), None)
            if mark:
                role = self._marks[mark][1]
                after, at = t.roles[role].after, at + len(mark)
            elif text.startswith(head, at):
                stop = at + len(head)
                while text[stop] != tail[0] or text[stop - 1] == "\\" and (len(text[:stop]) - len(text[:stop].rstrip("\\"))) % 2:
                    stop += 1
                role, after, at = t.unescape(text[at + len(head) : stop]), t.other.after, stop + len(tail)
            elif plain and text.startswith(t.roles[plain].before, at):
                role, after, at = plain, t.roles[plain].after, at + len(t.roles[plain].before)
            else:
                raise ValueError(f"no turn begins at {at}")
            stop = text.index(after, at)
            yield role, t.unescape(text[at:stop])
            at = stop + len(after)


def read_back(formatted: DataFrame, template: Template = LLAMA) -> DataFrame:
    """From the segments of format_chats(), one row for each conversation: n_turns, digests and lengths of what is read
    from the text alone (turns) and from the text under the loss mask (loss), formatted_chars, valid.

    The segments of a conversation come in order from one task, so there is no shuffle; hashes are taken as they come.
    """

    def scan(batches):
        def stream():
            for b in batches:
                yield from zip(*(b.column(i).to_pylist() for i in (0, 2, 4, 5, 6)), strict=True)

        parser, out = Parser(template), []
        for conv, own in groupby(stream(), key=lambda r: r[0]):
            turns, loss, n, chars, lost, ok, piece = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, False, ""
            for _, kind, text, masked, valid in own:
                chars += len(text)
                if masked:
                    plain = template.unescape(text)
                    loss.update(plain.encode())
                    lost += len(plain)
                piece += "" if kind == "start" else text
                if kind == "start" and text != template.start:
                    raise ValueError("no start mark")
                if kind == "after":  # a turn is whole
                    for role, plain in parser.turns(template.start + piece):
                        turns.update(f"{role}\n{plain}\n".encode())
                        n += 1
                    piece = ""
                ok = valid
            out.append((conv, n, turns.hexdigest(), lost, loss.hexdigest(), chars, ok))
            if len(out) >= 5000:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in schema.split(", ")])

    ship(formatted.sparkSession)
    return formatted.mapInArrow(scan, schema)


def joined(formatted: DataFrame) -> DataFrame:
    """conv_id, text: each conversation as one string, for those short enough to be one."""
    got = formatted.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seg", "text"))).alias("s"))
    return got.select("conv_id", F.array_join(F.transform("s", lambda x: x["text"]), "").alias("text"))
