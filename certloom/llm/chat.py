"""Chat formatting.

A finite-state machine over roles checks the order of turns; a declarative template turns each turn into text
segments, each with a loss flag. Control strings inside texts are escaped reversibly, so the formatted text can be
read back to exactly the turns it was made of.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Template:
    """How a conversation is written. Segments of a turn: ('literal' | 'role' | 'text', string, loss)."""

    turn: tuple[tuple[str, str], ...] = (("literal", "<|im_start|>"), ("role", ""), ("literal", "\n"), ("text", ""), ("literal", "<|im_end|>\n"))
    #: Roles whose text is under the loss.
    learned: frozenset[str] = frozenset({"assistant"})
    #: State -> role -> next state; a role that has no entry breaks the order.
    transitions: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "ready", "user": "asked"},
            "ready": {"user": "asked"},
            "asked": {"assistant": "answered", "tool": "asked"},
            "answered": {"user": "asked", "tool": "asked"},
        }
    )
    accepting: frozenset[str] = frozenset({"answered"})


CHATML = Template()
_OPEN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """No '<|' is left: a backslash goes between, one more if there are some already."""
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """A role has no line break in the output."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def check_order(roles: list[str], template: Template = CHATML) -> tuple[bool, int]:
    """(valid, index of the turn that breaks the order, -1 if none does)."""
    state = "start"
    for i, role in enumerate(roles):
        state = template.transitions.get(state, {}).get(role, "")
        if not state:
            return False, i
    return state in template.accepting, -1


def segments(turns: list[tuple[str, str]], template: Template = CHATML) -> list[tuple[str, bool]]:
    """Text segments with their loss flags."""
    out = []
    for role, text in turns:
        for kind, literal in template.turn:
            if kind == "literal":
                out.append((literal, False))
            elif kind == "role":
                out.append((escape_role(role), False))
            else:
                out.append((escape(text), role in template.learned))
    return out


def read_back(formatted: str, spans: list[tuple[int, int]]) -> tuple[list[tuple[str, str]], list[str]]:
    """Turns of a formatted conversation, and the unescaped texts under the loss mask (spans of code points)."""
    turns = [(unescape_role(m[1]), unescape(m[2])) for m in re.finditer(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", formatted, re.S)]
    return turns, [unescape(formatted[a:b]) for a, b in spans]


OUT = "conv_id bigint, n_turns bigint, valid boolean, bad_turn bigint, segments array<struct<text: string, loss: boolean>>, formatted string, loss_spans array<struct<start: bigint, end: bigint>>"


def format_conversations(conversations: DataFrame, template: Template = CHATML) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text): its segments, formatted text and loss spans in code points.

    Turns are in the order of turn; equal or null turn numbers go by role and text, nulls first. A null text or role
    is empty. A conversation whose roles break the order is formatted all the same, with valid = false and the index
    of the first turn that breaks it (-1: it only ends too early). Other columns are ignored; an empty table gives none.
    """
    turns = F.transform(
        F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(2**63))).cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))),
        lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")),
    )
    common.prepare(conversations.sparkSession)
    grouped = conversations.select("conv_id", "turn", "role", "text").groupBy("conv_id").agg(turns.alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                turns = [(x["role"], x["text"]) for x in turns]
                valid, bad = check_order([r for r, _ in turns], template)
                parts, at, spans = segments(turns, template), 0, []
                for text, loss in parts:
                    if loss:
                        spans.append({"start": at, "end": at + len(text)})
                    at += len(text)
                rows.append({"conv_id": conv, "n_turns": len(turns), "valid": valid, "bad_turn": bad, "segments": [{"text": t, "loss": x} for t, x in parts], "formatted": "".join(t for t, _ in parts), "loss_spans": spans})
            yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("valid", pa.bool_()), ("bad_turn", pa.int64()), ("segments", pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
    return grouped.mapInArrow(run, OUT)


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what is read back from the formatted text alone."""
    import hashlib

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                turns, loss = read_back(x["formatted"], [(s["start"], s["end"]) for s in x["loss_spans"]])
                said = "".join(loss)
                rows.append({"conv_id": x["conv_id"], "n_turns": len(turns), "turns_sha256": sha("".join(f"{r}\n{t}\n" for r, t in turns)), "loss_chars": len(said), "loss_sha256": sha(said), "formatted_chars": len(x["formatted"]), "valid": x["valid"]})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return formatted.select("conv_id", "formatted", "loss_spans", "valid").mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, valid boolean")
