r"""Chat formatting with a grammar that reads back exactly what was written.

Template: each turn is `### role: text </turn>` and a newline. Control strings (`###`, `</turn>`) inside a text are
escaped: n backslashes before one become 2n+1, so every control string of a text has an odd number before it and the
template's own have none.

Method: grammar round trip. Each conversation is written as one text, turn behind turn, and that text goes through a
deterministic parser (`Parser`), which is fed as the text grows and refuses one with an unescaped control string. The
turns that it recovers are compared with the source; where they differ, the parser goes back to where the turn began
and is fed the turn with its conflicting content escaped. At the end nothing may be left unread. What is returned is
read back from the parser alone.

Defined results: a null text is empty; a null role is written `?`; rows come in the order of turn
(null first), then role, then text, repeated rows included; a conversation of any length is streamed turn by turn, so
memory holds one turn, however long; rows without an id are conversations of their own, one each; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import over_batches

OPEN, CLOSE = "### ", " </turn>\n"
_CONTROL = re.compile(r"(\\*)(###|</turn>)")
_ROLE_OUT = {"\\": "\\\\", "\n": "\\n", ":": "\\c", "#": "\\h", "<": "\\l", "?": "\\q"}
_ROLE_IN = {v: k for k, v in _ROLE_OUT.items()}
_ROLE = re.compile(r"\?|(?:[^\\\n:#<?]|\\[\\nchlq])*")
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" * (2 * len(m[1]) + 1) + m[2], text)


def unescape(text: str) -> str | None:
    """The text behind an escaped one; None where a control string isn't escaped."""
    if any(len(m[1]) % 2 == 0 for m in _CONTROL.finditer(text)):
        return None
    return _CONTROL.sub(lambda m: "\\" * (len(m[1]) // 2) + m[2], text)


def _role_out(role: str | None) -> str:
    return "?" if role is None else re.sub(r"[\\\n:#<?]", lambda m: _ROLE_OUT[m[0]], role)


def _role_in(mark: str) -> str | None:
    return None if mark == "?" else re.sub(r"\\.", lambda m: _ROLE_IN[m[0]], mark)


class Parser:
    """Reads the turns of a conversation's text as it is fed."""

    def __init__(self):
        self.rest = ""

    def feed(self, text: str) -> list[tuple[str | None, str]] | None:
        """The turns that end in text, or None where it can't belong to a conversation."""
        text, at, out = self.rest + text if self.rest else text, 0, []
        while at < len(text):
            colon = text.find(": ", at)
            end = text.find(CLOSE, colon + 2) if colon >= 0 else -1
            if not text.startswith(OPEN, at):
                if len(text) - at >= len(OPEN) or not OPEN.startswith(text[at:]):
                    return None
                break
            if end < 0:
                break
            role, turn = text[at + len(OPEN) : colon], unescape(text[colon + 2 : end])
            if turn is None or not _ROLE.fullmatch(role):
                return None
            out.append((_role_in(role), turn))
            at = end + len(CLOSE)
        self.rest = text[at:]
        return out


def parse(rendered: str) -> list[tuple[str | None, str]] | None:
    """The turns of a rendered conversation, or None where it isn't one."""
    parser = Parser()
    turns = parser.feed(rendered)
    return None if parser.rest else turns


class Writer:
    """Writes a conversation turn by turn, each as the parser of the whole text reads it back."""

    def __init__(self):
        self.parser = Parser()

    def add(self, role: str | None, text: str) -> tuple[str, int, list[tuple[str | None, str]]]:
        """The turn's part of the text, where the turn's own text begins in it, and what the parser has read. Escaped only where it would else read something else."""
        head, before = f"{OPEN}{_role_out(role)}: ", self.parser.rest
        for body in (text, escape(text)):
            out = f"{head}{body}{CLOSE}"
            read = self.parser.feed(out)
            if read == [(role, text)] and not self.parser.rest:
                return out, len(head), read
            self.parser.rest = before
        raise ValueError("a turn can't be written so that it is read back")


def render_turn(role: str | None, text: str) -> tuple[str, int]:
    """A turn's rendered form and where its text begins in it."""
    return Writer().add(role, text)[:2]


class _Reading:
    """What is read back from the text of one conversation."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.n_turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.writer = Writer()

    def add(self, role: str | None, text: str | None) -> str:
        rendered, _, read = self.writer.add(role, text or "")
        for r, t in read:
            self.n_turns += 1
            self.turns.update(f"{'' if r is None else r}\n{t}\n".encode())
            if r == LOSS_ROLE:
                self.loss_chars += len(t)
                self.loss.update(t.encode())
        self.chars += len(rendered)
        return rendered

    def row(self) -> tuple:
        return self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
_TEXTS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("rendered", pa.string()), ("loss_from", pa.int64()), ("loss_to", pa.int64())])


def _ordered(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    # rows without an id don't meet in one place
    return rows.repartition(F.coalesce("conv_id", F.xxhash64("turn", "role", "text"))).sortWithinPartitions("conv_id", "turn", "role", "text")


def format_digests(conversations: DataFrame) -> DataFrame:
    """Per conversation what the formatted text reads back as: turns, the text under the loss mask, and lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if now is None or conv is None or now.conv_id != conv:
                    if now is not None:
                        rows.append(now.row())
                    now = _Reading(conv)
                now.add(role, text)
            if len(rows) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _DIGEST.types, strict=True)], schema=_DIGEST)
                rows = []
        if now is not None:
            rows.append(now.row())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _DIGEST.types, strict=True)], schema=_DIGEST)

    return over_batches(_ordered(conversations), run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_turns(conversations: DataFrame) -> DataFrame:
    """Per turn its rendered form, and the code points from and to which it is under the loss mask (null: not)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [[], [], []]
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                out, begin = render_turn(role, text or "")
                loss = role == LOSS_ROLE
                for c, x in zip(cols, (out, begin if loss else None, len(out) - len(CLOSE) if loss else None), strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), *(pa.array(c, t) for c, t in zip(cols, _TEXTS.types[2:], strict=True))], schema=_TEXTS)

    return over_batches(_ordered(conversations), run, "conv_id long, turn long, rendered string, loss_from long, loss_to long")
