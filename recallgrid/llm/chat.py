r"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns (role, text) to a string; nothing is known of how it works. locate()
renders the prefixes of a conversation, one turn more each time. Where an output begins with the one before, the rest
is the new turn's span. Where it does not, the template has rewritten history (as those do that strip earlier
reasoning or merge turns), and the place of the change is reported. Inside a span, two more renderings with probe
characters in place of the text show where the text itself lies, so that a loss mask covers texts and no markup.

Prefixes make the work grow with the square of a conversation's turns: that is the price of a black box. The
conversation itself is one output row, so its rows are brought together in one group.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

_TEXT = re.compile(r"\\|###|</turn>")
_ROLE = re.compile(r"\\|###|</turn>|:|\n")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:|\n)")
_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)
#: Characters of the private use area that stand in for a text.
PROBES = ("\ue000", "\ue001")


def escape(text: str) -> str:
    """Puts a backslash before each control string and each backslash."""
    return _TEXT.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def turn_template(turns: list[Turn]) -> str:
    r"""The template of op5: ### role: text</turn>\n for each turn, control strings escaped."""
    return "".join(f"### {_ROLE.sub(lambda m: chr(92) + m[0], role)}: {escape(text)}</turn>\n" for role, text in turns)


def read_turns(formatted: str) -> list[Turn]:
    """The turns of turn_template()'s output."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}: {formatted[at : at + 60]!r}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


@dataclass
class Located:
    text: str  # the whole conversation, rendered
    spans: list[tuple[int, int] | None]  # of each turn; None where the template rewrote it later
    contents: list[tuple[int, int] | None]  # of the wanted turns' texts, within the spans
    rewritten: list[tuple[int, int]]  # (turn that changed history, place of the first change)


def locate(template: Template, turns: list[Turn], wanted: Callable[[str], bool] = lambda role: True) -> Located:
    """Renders successive prefixes and compares consecutive outputs."""
    before = template([])
    spans: list[tuple[int, int] | None] = []
    contents: list[tuple[int, int] | None] = []
    rewritten = []
    for k, (role, text) in enumerate(turns):
        now = template(turns[: k + 1])
        if now.startswith(before):
            spans.append((len(before), len(now)))
            contents.append(None)
            if wanted(role):
                contents[-1] = _content(template, turns[:k], role, now, len(before))
        else:
            place = len(os.path.commonprefix([before, now]))
            rewritten.append((k, place))
            # What lies behind the change has moved; earlier spans that end before it still hold.
            spans = [s if s and s[1] <= place else None for s in spans] + [None]
            contents = [c if s else None for c, s in zip(contents, spans, strict=False)] + [None]
        before = now
    return Located(before, spans, contents, rewritten)


def _content(template: Template, earlier: list[Turn], role: str, now: str, start: int) -> tuple[int, int] | None:
    """Where the last turn's text lies: behind what two probes have in common before them, before what they have behind."""
    one, two = (template([*earlier, (role, probe)]) for probe in PROBES)
    head = len(os.path.commonprefix([one, two]))
    if head == len(one) or one[head] != PROBES[0]:
        return None
    tail = len(one) - head - 1
    if head < start or not now.startswith(one[:head]) or not now.endswith(one[head + 1 :]) or head + tail > len(now):
        return None
    return head, len(now) - tail


def format_conversations(df: DataFrame, template: Template = turn_template, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row for each conversation: conv_col, n_turns, formatted, loss (start, end of each text that counts) and history_rewritten.

    Rows are ordered by turn, nulls first; rows of the same turn by role and text. Repeated rows are turns of their
    own. Null roles and texts count as empty; rows without a conversation are one conversation with a null id.
    loss has the texts of loss_role that stand in the output as the template left them; turns that the template
    rewrote later have none. Other columns of df aren't carried over. An empty table gives none.
    """
    kind = df.schema[conv_col].dataType.simpleString()
    rows = df.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    loss_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        found = zip(*(table.column(c).to_pylist() for c in ("turn", "role", "text")), strict=True)
        turns = [(role, text) for _, role, text in sorted(found, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))]
        at = locate(template, turns, lambda role: role == loss_role)
        loss = [{"start": c[0], "end": c[1]} for c in at.contents if c]
        return pa.table({conv_col: pa.array([key[0].as_py()], table.schema.field("conv").type), "n_turns": pa.array([len(turns)], pa.int64()), "formatted": pa.array([at.text], pa.string()), "loss": pa.array([loss], loss_type), "history_rewritten": pa.array([bool(at.rewritten)])})

    return rows.groupBy("conv").applyInArrow(run, f"`{conv_col}` {kind}, n_turns long, formatted string, loss array<struct<start: long, end: long>>, history_rewritten boolean")


def conversation_digests(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Read back from turn_template()'s output: turns, the text under the loss mask, and their digests."""
    kind = formatted.schema[conv_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, loss in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = read_turns(text)
                masked = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
                rows.append((len(turns), _sha256("".join(f"{role}\n{said}\n" for role, said in turns)), len(masked), _sha256(masked), len(text)))
            n, turns_sha, chars, loss_sha, size = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(turns_sha, pa.string()), pa.array(chars, pa.int64()), pa.array(loss_sha, pa.string()), pa.array(size, pa.int64()), batch.column(3)], [conv_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "history_rewritten"])

    return formatted.select(f"`{conv_col}`", "formatted", "loss", "history_rewritten").mapInArrow(run, f"`{conv_col}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, history_rewritten boolean")


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()
