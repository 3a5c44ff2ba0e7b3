"""Chat formatting: a finite-state machine over roles, driven by a declarative template.

The template gives each role the text before and after its turns and whether its text bears loss.  The
machine checks the order of turns; a turn it does not expect is still formatted, and its conversation is
marked invalid from there on (nothing is dropped).  Output rows are text segments with a loss flag; control
strings inside texts are escaped with a private character, reversibly, so a control string in the output is
always the template's own.

Turns stream through sorted partitions, one conversation after another: no conversation, however long, is
held in memory.  Defined results: null texts are empty; null roles are the empty role, formatted as an
unknown role; null conv_ids form one conversation; turns order by (turn, role, text), nulls first; repeated
rows are turns of their own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import map_arrow


@dataclass(frozen=True)
class Template:
    """Marks by role: (before the role's name, text before the turn's text, text after it, loss)."""

    turns: dict[str, tuple[str, str, bool]] = field(
        default_factory=lambda: {
            "system": ("<<SYS>>", "<</SYS>>", False),
            "user": ("<s>[INST] ", " [/INST]", False),
            "assistant": (" ", "</s>", True),
        }
    )
    #: Any other role: its escaped name stands between the first two marks.
    other: tuple[str, str, str] = ("<|role|>", "<|text|>", "<|end|>")
    #: State -> roles that may follow; "" is the start.
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    #: Ends that a valid conversation may have.
    ends: tuple[str, ...] = ("user", "assistant")
    escape: str = "\\"

    def controls(self) -> list[str]:
        found = {m.strip() for before, after, _ in self.turns.values() for m in (before, after)} | {m.strip() for m in self.other}
        return sorted(found - {""}, key=lambda m: (-len(m), m))

    def hide(self, text: str) -> str:
        """Each character that begins a control string, and each escape character, gets an escape before it."""
        heads = "".join(sorted({c[0] for c in self.controls()} | {self.escape}))
        return re.sub(f"([{re.escape(heads)}])", lambda m: self.escape + m[1], text)

    def reveal(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + "(.)", lambda m: m[1], text, flags=re.S)


SEGMENTS = "conv_id long, seq long, turn_no long, role string, kind string, loss boolean, valid boolean, text string"


def format_conversations(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """Segments (kind: mark, name or text) in order of (conv_id, seq); ``text`` is escaped output."""
    t = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, seq, number, valid, begun = None, "", 0, 0, True, False
        for batch in batches:
            out: list[tuple] = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if not begun or conv != current:
                    current, state, seq, number, valid, begun = conv, "", 0, 0, True, True
                role, text = role or "", text or ""
                valid = valid and role in t.follows.get(state, ())
                state = role
                if role in t.turns:
                    before, after, loss = t.turns[role]
                    parts = [("mark", False, before), ("text", loss, t.hide(text)), ("mark", False, after)]
                else:
                    parts = [("mark", False, t.other[0]), ("name", False, t.hide(role)), ("mark", False, t.other[1]), ("text", False, t.hide(text)), ("mark", False, t.other[2])]
                for kind, loss, shown in parts:
                    out.append((conv, seq, number, role, kind, loss, valid, shown))
                    seq += 1
                number += 1
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.string())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), types)], [c.split()[0] for c in SEGMENTS.split(", ")])

    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    dealt = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").repartition("conv_id").sortWithinPartitions(*order)
    return map_arrow(dealt, run, SEGMENTS)


class Reader:
    """Reads formatted text back, piece by piece: the template's own marks are those without an escape."""

    def __init__(self, template: Template):
        self.t = template
        esc = re.escape(template.escape)
        self.token = re.compile(f"{esc}.|" + "|".join(map(re.escape, template.controls())) + f"|[^{esc}]", re.S)

    def turns(self, formatted: str) -> list[tuple[str, str]]:
        """(role, text) of each turn of a whole formatted conversation."""
        t, out, rest = self.t, [], formatted
        openers = sorted(((b, r) for r, (b, _, _) in t.turns.items()), key=lambda x: -len(x[0]))
        while rest:
            if rest.startswith(t.other[0]):
                name, rest = self._until(rest[len(t.other[0]) :], t.other[1])
                text, rest = self._until(rest, t.other[2])
                out.append((t.reveal(name), t.reveal(text)))
                continue
            before, role = next(x for x in openers if rest.startswith(x[0]))
            text, rest = self._until(rest[len(before) :], t.turns[role][1])
            out.append((role, t.reveal(text)))
        return out

    def _until(self, text: str, mark: str) -> tuple[str, str]:
        at = 0
        while not text.startswith(mark, at):
            at += 2 if text.startswith(self.t.escape, at) else 1
            if at >= len(text):
                raise ValueError("unclosed turn")
        return text[:at], text[at + len(mark) :]


class Stream:
    """Turns of a conversation's formatted text, which comes in pieces; what is not yet a whole turn waits for more."""

    def __init__(self, template: Template):
        self.t, self.rest = template, ""
        self.openers = sorted([(b, r) for r, (b, _, _) in template.turns.items()] + [(template.other[0], None)], key=lambda x: -len(x[0]))
        marks = {after for _, after, _ in template.turns.values()} | set(template.other[1:])
        self.ends = {m: re.compile(f"{re.escape(template.escape)}.|({re.escape(m)})", re.S) for m in marks}

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        """(role, text) of each turn that ends in ``piece``."""
        self.rest += piece
        while self.rest:
            before, role = next((x for x in self.openers if self.rest.startswith(x[0])), (None, None))
            if before is None:
                if any(b.startswith(self.rest) for b, _ in self.openers):
                    return
                raise ValueError(f"no mark opens a turn: {self.rest[:40]!r}")
            if any(len(b) > len(self.rest) and b.startswith(self.rest) for b, _ in self.openers):
                return  # it may become a longer mark
            at = len(before)
            if role is None:
                name, at = self._until(at, self.t.other[1])
            text, at = self._until(at, self.t.other[2] if role is None else self.t.turns[role][1])
            if at < 0:
                return
            self.rest = self.rest[at:]
            yield self.t.reveal(name) if role is None else role, self.t.reveal(text)

    def _until(self, at: int, mark: str) -> tuple[str, int]:
        """What stands from ``at`` to a mark without an escape, and the place after it; -1 if it is not there yet."""
        found = next((m for m in self.ends[mark].finditer(self.rest, at) if m[1]), None) if at >= 0 else None
        return (self.rest[at : found.start()], found.end()) if found else ("", -1)

    def close(self) -> None:
        if self.rest:
            raise ValueError("unclosed turn")


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """Digests of each conversation from its written segments: turns and roles by the marks in their text, only the
    loss from their flag."""
    t = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict | None = None

        def close() -> tuple:
            state["stream"].close()
            return (state["conv"], state["turns"], state["all"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["shown"], state["valid"] and state["role"] in t.ends)

        for batch in batches:
            out = []
            for conv, loss, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "loss", "text"))):
                if state is None or state["conv"] != conv:
                    if state is not None:
                        out.append(close())
                    state = {"conv": conv, "stream": Stream(t), "turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "shown": 0, "valid": True, "role": "", "bears": False}
                state["shown"] += len(text)
                state["bears"] |= loss
                for role, plain in state["stream"].feed(text):
                    state["turns"] += 1
                    state["valid"], state["role"] = state["valid"] and role in t.follows.get(state["role"], ()), role
                    state["all"].update(f"{role}\n{plain}\n".encode())
                    if state["bears"]:
                        state["chars"] += len(plain)
                        state["loss"].update(plain.encode())
                    state["bears"] = False
            if out:
                yield table(out)
        if state is not None:
            yield table([close()])

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())

    def table(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), types)], names)

    dealt = segments.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return map_arrow(dealt, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
