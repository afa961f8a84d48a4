"""Chat formatting through a black-box template.

A template is any function from turns to text. Its output is learnt incrementally: it renders each prefix of the
turns, and what the longer output adds to the shorter one is the new turn's span. If the longer output doesn't
start with the shorter one, the template rewrites history. Where a turn's text lies in its span is found the
same way: by rendering the turn with two probe texts, whose outputs agree before and after it.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

Turns = list[tuple[str, str]]
Template = Callable[[Turns], str]
START, END = "<|im_start|>", "<|im_end|>"
#: For templates declared context-free, prefixes are rendered in full up to twice so many turns; longer conversations go on in windows of this many.
WINDOW = 64
_ESCAPES = {"\\": "\\\\", "|": "\\|", "\n": "\\n"}
_PLAIN = {"\\": "\\", "|": "|", "n": "\n"}


class RewritesHistory(ValueError):
    """The template's output for a prefix isn't a prefix of its output for more turns."""


def escape(text: str, line: bool = False) -> str:
    """Text in which no control string occurs: a backslash is doubled and ``<|`` becomes ``<\\|``; in a line, breaks are escaped too."""
    text = text.replace("\\", "\\\\").replace("<|", "<\\|")
    return text.replace("\n", "\\n") if line else text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _PLAIN[m[1]], text)


def marked_turns(turns: Turns) -> str:
    """The production template: each turn between start and end marks, its role on the first line."""
    return "".join(f"{START}{escape(r, True)}\n{escape(t)}{END}\n" for r, t in turns)


def parse(formatted: str) -> Turns:
    """The turns of ``marked_turns``' output."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn starts at {at}")
        line = formatted.index("\n", at)
        end = formatted.index(END, line + 1)
        turns.append((unescape(formatted[at + len(START) : line]), unescape(formatted[line + 1 : end])))
        at = end + len(END) + 1
    return turns


@dataclass(frozen=True)
class Span:
    """A turn in the output: [start, end), and its text in [text_start, text_end)."""

    start: int
    end: int
    text_start: int
    text_end: int


class Incremental:
    """Feeds turns to a template one by one, keeping at most two windows of turns and their rendering, or without a window all.

    With a window, the prefix is replaced by its last turns beyond twice as many, which is only right for a context-free
    template, whose output for a turn depends on no turn before those; only each replacement is checked to give
    the same addition for the next turn in both contexts. Without one, every prefix is rendered whole: that is right for
    any template, and takes time that grows with the square of a conversation's length.
    """

    def __init__(self, template: Template, window: int | None = WINDOW):
        self.template, self.window = template, window
        self.context: Turns = []
        self.out, self.length = template([]), 0
        self.preamble = self.out
        self.length = len(self.out)

    def _added(self, context: Turns, before: str, turn: tuple[str, str]) -> str:
        after = self.template([*context, turn])
        if not after.startswith(before):
            raise RewritesHistory(f"turn {len(context)} changes what was rendered before it")
        return after[len(before) :]

    def feed(self, turn: tuple[str, str]) -> tuple[str, Span]:
        """The text that the turn adds, and its span in the whole output."""
        added = self._added(self.context, self.out, turn)
        if self.window and len(self.context) >= 2 * self.window:
            context = self.context[-self.window :]
            out = self.template(context)
            if self._added(context, out, turn) != added:
                raise RewritesHistory("a turn's rendering depends on turns far before it")
            self.context, self.out = context, out
        a, b = (self._added(self.context, self.out, (turn[0], probe)) for probe in ("a", "b"))
        head = len(os.path.commonprefix((a, b)))
        tail = len(os.path.commonprefix((a[head:][::-1], b[head:][::-1])))
        start = self.length
        self.context.append(turn)
        self.out += added
        self.length += len(added)
        return added, Span(start, self.length, start + head, self.length - tail)


def format_turns(turns: Iterable[tuple[str, str]], template: Template = marked_turns, context_free: bool = True) -> tuple[str, list[Span]]:
    """The output for one conversation and the span of each turn. The template is taken as context-free unless said otherwise."""
    state, parts, spans = Incremental(template, WINDOW if context_free else None), [], []
    for t in turns:
        added, span = state.feed(t)
        parts.append(added)
        spans.append(span)
    return state.preamble + "".join(parts), spans


FORMATTED = "conv_id long, turn_index long, role string, formatted string, start long, text_start long, text_end long, end long, loss boolean"


def format_conversations(rows: DataFrame, template: Template = marked_turns, loss_role: str = "assistant", context_free: bool | None = None) -> DataFrame:
    """One row per turn, in order within each conversation: what it adds to the output, its span, and whether it bears loss.

    Input: conv_id, turn, role, text. Null roles and texts are empty. Rows go by turn (nulls first), ties by role and
    text, so rows that repeat are turns of their own; rows of null conv_id are one conversation. Conversations
    are streamed turn by turn, however long they are; a partition holds whole conversations, in order. Only templates
    declared ``context_free``, as ``marked_turns`` is, are rendered in windows; others get every prefix whole.
    """
    window = WINDOW if (template is marked_turns if context_free is None else context_free) else None
    schema = common.arrow_type(FORMATTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv: object = ()
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                out: dict[str, list] = {x: [] for x in schema.names}
                for c, role, text in zip(*(x.to_pylist() for x in b.slice(lo, 512).columns)):
                    if c != conv:
                        conv, state, i = c, Incremental(template, window), 0
                    added, s = state.feed((role, text))
                    shown = (state.preamble if i == 0 else "") + added
                    for x, v in zip(schema.names, (c, i, role, shown, s.start, s.text_start, s.text_end, s.end, role == loss_role)):
                        out[x].append(v)
                    i += 1
                yield common.to_batch(out, schema)

    common.ship(rows.sparkSession)
    plain = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = plain.repartition(common.shuffle_partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, FORMATTED)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame) -> DataFrame:
    """Reads the turns and the loss mask back from the output of ``format_conversations``, as it comes from there."""
    schema = common.arrow_type(DIGEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv: object = ()
        open_ = False

        def row() -> pa.RecordBatch:
            return common.to_batch({"conv_id": [conv], "n_turns": [n], "turns_sha256": [turns.hexdigest()], "loss_chars": [chars], "loss_sha256": [loss.hexdigest()], "formatted_chars": [length]}, schema)

        for b in batches:
            for lo in range(0, b.num_rows, 512):
                for c, shown, start, text_start, text_end, masked in zip(*(x.to_pylist() for x in b.slice(lo, 512).columns)):
                    if not open_ or c != conv:
                        if open_:
                            yield row()
                        conv, open_, n, chars, length, turns, loss = c, True, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                    for role, text in parse(shown):
                        turns.update(f"{role}\n{text}\n".encode())
                        n += 1
                    if masked:
                        text = unescape(shown[text_start - start : text_end - start])
                        chars += len(text)
                        loss.update(text.encode())
                    length += len(shown)
        if open_:
            yield row()

    return formatted.select("conv_id", "formatted", "start", "text_start", "text_end", "loss").mapInArrow(run, DIGEST)


HARD = f"{END}{START}assistant ok"


def op2_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """All conversations, and one that says the control strings, formatted and read back."""
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD).alias("text"))
    return digests(format_conversations(rows.union(hard)))


OP2_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{HARD}' UNION ALL SELECT -1, 1, 'assistant', '{HARD}'
), e AS (
  SELECT *, replace(replace(text, '\\', '\\\\'), '<|', '<\\|') AS shown,
         replace(replace(replace(role, '\\', '\\\\'), '<|', '<\\|'), chr(10), '\\n') AS line
  FROM c
), a AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    CAST(sum(length(shown) + length(line) + length('{START}') + length('{END}') + 2) AS BIGINT) AS formatted_chars
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM a
"""
