r"""Conversations as text for training, checked by reading them back.

Grammar of a formatted conversation, turn after turn with nothing between:

    user       [INST] TEXT [/INST]
    assistant  <s>TEXT</s>
    system     <<SYS>>\nTEXT\n<</SYS>>
    any other  <|role:ROLE|>TEXT<|/role|>

A turn's text ends at the first closing mark. Inside a text or role a control string may be
escaped by a backslash after its first character; one more backslash stands for each that
was there before, so reading takes exactly one away. A rendered conversation is parsed and
compared with its source; turns that came back different are escaped and it is rendered
anew, until the two are identical.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKS = {
    "user": ("[INST] ", " [/INST]"),
    "assistant": ("<s>", "</s>"),
    "system": ("<<SYS>>\n", "\n<</SYS>>"),
}
OTHER = ("<|role:", "|>", "<|/role|>")
CONTROL = r"(?:/?INST\]|</?SYS>>|/?s>|\|role:|\|/role\|>)"
_PLAIN = re.compile(rf"([\[<|])(\\*)({CONTROL}|>)")
_ESCAPED = re.compile(rf"([\[<|])\\(\\*)({CONTROL}|>)")

Turn = tuple[str, str]


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def render(turns: list[Turn], escaped: set[int]) -> tuple[str, list[tuple[int, int]]]:
    """(text, spans of the assistant's texts). Turns in ``escaped`` have their marks escaped."""
    parts, spans, at = [], [], 0
    for i, (role, text) in enumerate(turns):
        body = escape(text) if i in escaped else text
        if role in MARKS:
            opening, closing = MARKS[role]
        else:
            opening, closing = OTHER[0] + (escape(role) if i in escaped else role) + OTHER[1], OTHER[2]
        parts += [opening, body, closing]
        if role == "assistant":
            spans.append((at + len(opening), at + len(opening) + len(body)))
        at += len(opening) + len(body) + len(closing)
    return "".join(parts), spans


def parse(text: str) -> list[Turn] | None:
    """The turns of a formatted conversation; None if it does not follow the grammar."""
    turns, at = [], 0
    while at < len(text):
        for role, (opening, closing) in MARKS.items():
            if text.startswith(opening, at):
                break
        else:
            if not text.startswith(OTHER[0], at):
                return None
            end = text.find(OTHER[1], at)
            if end < 0:
                return None
            role = unescape(text[at + len(OTHER[0]) : end])
            opening, closing = text[at : end + len(OTHER[1])], OTHER[2]
        begin = at + len(opening)
        end = text.find(closing, begin)
        if end < 0:
            return None
        turns.append((role, unescape(text[begin:end])))
        at = end + len(closing)
    return turns


def format_turns(turns: list[Turn]) -> tuple[str, list[tuple[int, int]]]:
    """A conversation's text and loss spans, rendered until it reads back as ``turns``."""
    escaped: set[int] = set()
    while True:
        text, spans = render(turns, escaped)
        back = parse(text)
        if back == turns:
            return text, spans
        back = back or []
        wrong = {i for i, t in enumerate(turns) if i >= len(back) or back[i] != t} - escaped
        if not wrong:
            wrong = set(range(len(turns))) - escaped
        if not wrong:
            raise ValueError("a conversation does not survive formatting")
        # a text that ends too early garbles the turns after it, so the first goes first; if
        # many differ, they go together, which keeps the number of rounds small
        escaped |= {min(wrong)} if len(wrong) < 16 else wrong


def _format(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        made = [
            format_turns([(t["role"], t["text"]) for t in turns]) for turns in batch.column(1).to_pylist()
        ]
        spans = [[{"start": a, "end": b} for a, b in s] for _, s in made]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_pydict(
            {
                "conv_id": batch.column(0),
                "formatted": pa.array([t for t, _ in made], pa.string()),
                "loss_spans": pa.array(spans, kind),
            }
        )


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted and loss_spans (code points, ends exclusive) of every conversation.

    ``turns`` has conv_id, turn, role and text; rows go by turn (null first), those of one
    turn by role and text. Null roles and texts are empty; an empty role is a role of its own.
    Rows without conv_id are one conversation without id. Repeated rows are turns each;
    other columns are ignored. An empty table gives an empty result. A conversation becomes
    one text, so it has to fit into a row.
    """
    said = turns.select(
        "conv_id",
        F.struct(
            "turn",
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("said"),
    )
    whole = said.groupBy("conv_id").agg(F.array_sort(F.collect_list("said")).alias("turns"))
    schema = "conv_id long, formatted string, loss_spans array<struct<start:bigint,end:bigint>>"
    return whole.mapInArrow(_format, schema)


def loss_text(formatted: str, spans: list[dict]) -> str:
    """The text under the loss mask, unescaped."""
    return "".join(unescape(formatted[s["start"] : s["end"]]) for s in spans)
