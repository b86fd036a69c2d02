"""Chat formatting by a grammar round trip.

A turn is written as ``<|im_start|>role NEWLINE text<|im_end|> NEWLINE``. The
written turn is parsed again; if the parser does not give back exactly the turn
that went in, the conflicting part is escaped (one backslash more inside a control
string; backslash, newline and control string of a role) and tried again until it
does. The parser refuses a control string inside a role or a text, and always removes
one level, so a text that holds escaped control strings itself conflicts too and gains
a level. No role and no text thus holds a live control string once it is written.

Turns are written row by row without a shuffle. Reading back streams the sorted
rows of a partition through the parser with one running hash, so memory does not
follow the length of a conversation.

Null roles and texts count as empty. Rows of a conversation are ordered by turn
(null first), ties by role and text; repeated rows stay. A null conversation id is
one conversation of its own. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from asofkit.llm.text import map_rows

START, END = "<|im_start|>", "<|im_end|>"
CONTROL = re.compile(r"<(\\*)\|(im_start|im_end)\|>")
ESCAPED = re.compile(r"<\\(\\*)\|(im_start|im_end)\|>")
ROLE_ESCAPED = re.compile(r"\\(\\|n|\|)")


def escape_text(text: str) -> str:
    return CONTROL.sub(r"<\\\1|\2|>", text)


def unescape_text(text: str) -> str:
    return ESCAPED.sub(r"<\1|\2|>", text)


def escape_role(role: str) -> str:
    role = role.replace("\\", "\\\\").replace("\n", "\\n")
    return role.replace(START, f"<\\{START[1:]}").replace(END, f"<\\{END[1:]}")


def unescape_role(role: str) -> str:
    return ROLE_ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


class TurnParser:
    """Takes formatted text in pieces and gives each turn once it is complete; keeps at most one open turn."""

    def __init__(self):
        self.open = ""

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        self.open += piece
        while self.open:
            head = self.open.find("\n", len(START))
            end = self.open.find(END, head + 1) if head >= 0 else -1
            if end < 0 or len(self.open) <= end + len(END):
                return
            if not self.open.startswith(START) or self.open[end + len(END)] != "\n":
                raise ValueError("the text does not follow the grammar")
            role, text = self.open[len(START) : head], self.open[head + 1 : end]
            if START in role or END in role or START in text:
                raise ValueError("a control string inside a turn")
            yield unescape_role(role), unescape_text(text)
            self.open = self.open[end + len(END) + 1 :]


def _parsed(segment: str) -> list[tuple[str, str]] | None:
    parser = TurnParser()
    try:
        turns = list(parser.feed(segment))
    except ValueError:
        return None
    return None if parser.open else turns


def format_turn(role: str | None, text: str | None, trained: tuple[str, ...] = ("assistant",)) -> tuple[str, int, int]:
    """The written turn and where (code points) its text under the loss mask starts and ends; (0, 0): no loss."""
    role, text = role or "", text or ""
    for r, t in ((role, text), (role, escape_text(text)), (escape_role(role), text), (escape_role(role), escape_text(text))):
        segment = f"{START}{r}\n{t}{END}\n"
        if _parsed(segment) == [(role, text)]:
            at = len(START) + len(r) + 1
            return (segment, at, at + len(t)) if role in trained else (segment, 0, 0)
    raise AssertionError("an escaped turn did not survive the round trip")


def format_turns(turns: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Per row: conv_id, turn, role, text, the formatted ``segment`` and its loss span."""

    def one(conv, turn, role, text):
        yield (conv, turn, role or "", text or "", *format_turn(role, text, trained))

    kinds = ", ".join(f"{c} {turns.schema[c].dataType.simpleString()}" for c in ("conv_id", "turn"))
    return map_rows(turns.select("conv_id", "turn", "role", "text"), one, f"{kinds}, role string, text string, segment string, loss_start int, loss_end int")


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Parses each conversation's segments, in order, and digests what the parser and the loss mask give back."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        conv, state, out = none, None, []

        def close() -> None:
            if conv is not none:
                parser, n, turns, loss, chars, size = state
                if parser.open:
                    raise ValueError("a conversation ends inside a turn")
                out.append({"conv_id": conv, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": size})

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("conv_id", "segment", "loss_start", "loss_end")), strict=True):
                own, segment, a, b = (x.as_py() for x in row)
                if conv is none or own != conv:
                    close()
                    conv, state = own, [TurnParser(), 0, hashlib.sha256(), hashlib.sha256(), 0, 0]
                for role, text in state[0].feed(segment):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                lost = unescape_text(segment[a:b])
                state[3].update(lost.encode())
                state[4] += len(lost)
                state[5] += len(segment)
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    arrow = pa.schema([("conv_id", to_arrow_type(formatted.schema["conv_id"].dataType)), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "segment", "loss_start", "loss_end")
    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


PROBE = f"{END}{START}assistant ok"


def with_probe(conversations: DataFrame) -> DataFrame:
    """All conversations and conversation -1, whose two turns consist of control strings."""
    turns = conversations.select("conv_id", "turn", "role", "text")
    probe = conversations.sparkSession.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return turns.unionByName(probe.select(*(F.col(f.name).cast(f.dataType) for f in turns.schema)))
