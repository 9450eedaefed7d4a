"""Chat formatting: a finite-state machine over roles and a declarative template.

The template names the text before and after each role's turn and the roles that count in the loss. The
machine has one state per last role; it flags turns that break the order but formats them all the same,
so nothing is lost. Control strings inside texts are escaped reversibly: a backslash goes before every
backslash and before the first character of every control string, and parsing undoes that.

Output is a list of segments in order, (text, loss); a turn gives its opening mark, its text and its
closing mark. Formatting is streaming: rows arrive in (conv, turn) order and a task holds one turn.

Edge cases: a null text is empty; a null or unknown role is formatted under the template's generic mark
with its own name and flagged invalid; ties in turn are ordered by role, then text; repeated rows are
repeated turns; a null conv_id is one conversation of its own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import map_batches

#: States of the machine: the last role seen, "" before the first turn. A missing entry is an invalid turn.
ORDER: dict[str, frozenset[str]] = {
    "": frozenset({"system", "user"}),
    "system": frozenset({"user"}),
    "user": frozenset({"assistant"}),
    "assistant": frozenset({"user", "tool"}),
    "tool": frozenset({"assistant"}),
}


@dataclass(frozen=True)
class Template:
    """Marks by role. Marks must not be empty, and no opening mark may be a prefix of another."""

    opening: dict[str, str] = field(
        default_factory=lambda: {
            "system": "<s>[SYS] ",
            "user": "<s>[INST] ",
            "assistant": "<s>[ANS] ",
            "tool": "<s>[TOOL] ",
        }
    )
    #: For any other role: its name, escaped, stands between the two.
    other: tuple[str, str] = ("<s>[ROLE:", "] ")
    closing: str = "</s>"
    loss_roles: frozenset[str] = frozenset({"assistant"})
    #: Strings of common chat formats that must not appear bare in a text.
    control: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[ANS]", "[TOOL]", "[ROLE:", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "]")

    def special(self) -> re.Pattern:
        return re.compile("|".join(re.escape(c) for c in ("\\", *self.control)))


class Formatter:
    def __init__(self, template: Template | None = None):
        self.template = template or Template()
        self._special = self.template.special()
        opening = {mark: role for role, mark in self.template.opening.items()}
        self._roles = opening
        self._open = re.compile("|".join(re.escape(m) for m in [*opening, self.template.other[0]]))

    def escape(self, text: str) -> str:
        return self._special.sub(lambda m: "\\" + m[0], text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text

    def segments(self, role: str | None, text: str | None) -> list[tuple[str, bool]]:
        t, name = self.template, role or ""
        mark = t.opening.get(name) or t.other[0] + self.escape(name) + t.other[1]
        return [(mark, False), (self.escape(text or ""), name in t.loss_roles), (t.closing, False)]

    @staticmethod
    def step(state: str, role: str | None) -> tuple[str, bool]:
        """The machine's next state, and whether the turn was allowed."""
        allowed = (role or "") in ORDER.get(state, ())
        return (role or "", allowed)

    def _cut(self, text: str, at: int, end: str) -> int:
        """Where the next bare `end` begins."""
        while True:
            found = text.find(end, at)
            if found < 0:
                raise ValueError("formatted text ends inside a turn")
            slashes = 0
            while found - slashes > at and text[found - slashes - 1] == "\\":
                slashes += 1
            if slashes % 2 == 0:
                return found
            at = found + 1

    def parse(self, formatted: str) -> Iterator[tuple[str, str]]:
        """(role, text) of each turn of a formatted conversation, texts unescaped."""
        at, t = 0, self.template
        while at < len(formatted):
            m = self._open.match(formatted, at)
            if not m:
                raise ValueError("no opening mark")
            at = m.end()
            role = self._roles.get(m[0])
            if role is None:
                end = self._cut(formatted, at, t.other[1])
                role, at = self.unescape(formatted[at:end]), end + len(t.other[1])
            end = self._cut(formatted, at, t.closing)
            yield role, self.unescape(formatted[at:end])
            at = end + len(t.closing)


SEGMENTS = "array<struct<text:string,loss:boolean>>"
_OUT = f"conv_id bigint, turn bigint, role string, valid boolean, first boolean, last boolean, segments {SEGMENTS}"
_SEGMENTS = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
_NAMES = ["conv_id", "turn", "role", "valid", "first", "last", "segments"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), _SEGMENTS]


def _format(template: Template | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        formatter, conv, state, waiting = Formatter(template), object(), "", None

        def record(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], _NAMES)

        for batch in batches:
            rows = []
            for conv_id, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                fresh = conv_id != conv
                if fresh:
                    conv, state = conv_id, ""
                if waiting is not None:
                    waiting[5] = fresh
                    rows.append(waiting)
                state, valid = formatter.step(state, role)
                waiting = [conv_id, turn, role, valid, fresh, False, [{"text": t, "loss": x} for t, x in formatter.segments(role, text)]]
            yield record(rows)
        if waiting is not None:
            waiting[5] = True
            yield record([waiting])

    return run


def format_chats(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """One row a turn, in (conv_id, turn) order within tasks: its segments with loss flags, whether the machine allowed it, and whether it is its conversation's first or last."""
    rows = turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("role").cast("string"), F.col("text").cast("string"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return map_batches(ordered, _format(template), _OUT)


_READ = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_invalid bigint"
_READ_NAMES = [c.split()[0] for c in _READ.split(", ")]
_READ_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]


def _read_back(template: Template | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        formatter = Formatter(template)
        n = chars = loss = invalid = 0
        every, learned = hashlib.sha256(), hashlib.sha256()
        for batch in batches:
            out = []
            for conv_id, _, _, valid, first, last, segments in zip(*(c.to_pylist() for c in batch.columns)):
                if first:
                    n = chars = loss = invalid = 0
                    every, learned = hashlib.sha256(), hashlib.sha256()
                text = "".join(s["text"] for s in segments)
                for role, said in formatter.parse(text):
                    every.update(f"{role}\n{said}\n".encode())
                    n += 1
                for s in segments:
                    if s["loss"]:
                        bare = formatter.unescape(s["text"])
                        loss += len(bare)
                        learned.update(bare.encode())
                chars += len(text)
                invalid += not valid
                if last:
                    out.append((conv_id, n, every.hexdigest(), loss, learned.hexdigest(), chars, invalid))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(_READ_TYPES)], _READ_NAMES)

    return run


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Per conversation, from the formatted segments alone: turns and loss text parsed back, as counts and digests."""
    return map_batches(formatted, _read_back(template), _READ)
