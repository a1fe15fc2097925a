"""Chat formatting by rendering a black box over successive prefixes of a conversation.

A template is any ``render(turns) -> str`` over a list of (role, text). Where a turn stands in the output is found by
comparing what consecutive prefixes render to; where its text stands within that, by rendering the turn once more with
a mark in place of the text: what stands before the mark is the turn's header. A template whose output for a longer
prefix doesn't begin with its output for a shorter one rewrites history; such a conversation gets the index of the
first turn that does so and no spans, because a mask over its final text would teach turns that no model saw.

Rendering every prefix whole takes time in the square of a conversation's length. Past the first 2 * WINDOW turns a
prefix is therefore cut to the WINDOW to 2 * WINDOW turns before its end, and at the end of each WINDOW turns the whole
prefix is rendered: it must equal the pieces found so far. If it ever doesn't, all prefixes are rendered whole.

``Marked`` is the template of the query. A conversation is one training example and so one row: its turns are sorted
by Spark (spilling) and streamed to the task that renders them, which holds one conversation at a time.

Defined results: turns come by turn (nulls first), then role, then text, nulls as ''; repeated rows are turns of their
own; a null conv_id is a conversation; an empty table gives an empty result; other columns, whatever their names,
aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.llm.common import shuffle_partitions, table

Turn = tuple[str, str]
Render = Callable[[list[Turn]], str]
WINDOW = 32
#: Stands for a text while its place is sought; a template that changes or drops it can't be used. A private character on either side.
MARK = "\ue000mark\ue000"
#: Bytes of output that a task gathers before it hands a batch on.
BATCH_BYTES = 4 << 20

SCHEMA = "conv_id bigint, formatted string, n_turns bigint, rewrites_at bigint, spans array<struct<role: string, start: bigint, stop: bigint, text_start: bigint, text_stop: bigint>>"


class Marked:
    """``### Role: text </turn>`` and a new line for each turn.

    A backslash stands before each backslash, ``###`` and ``</turn>`` of a role or text and each colon of a role, so
    that what marks a turn never comes from inside one and taking the backslashes away restores it.
    """

    TURN = re.compile(r"### ((?:[^\\:]+|\\.)*): ((?:[^\\<]+|\\.|<(?!/turn>))*) </turn>\n", re.S)

    def render(self, turns: list[Turn]) -> str:
        return "".join(f"### {self.escaped(role).replace(':', '\\:')}: {self.escaped(text)} </turn>\n" for role, text in turns)

    @staticmethod
    def escaped(text: str) -> str:
        return text.replace("\\", "\\\\").replace("###", "\\###").replace("</turn>", "\\</turn>")

    @staticmethod
    def restored(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S)

    def parse(self, formatted: str) -> list[Turn]:
        """The turns of a rendered conversation; ValueError where it isn't one."""
        turns, at = [], 0
        while at < len(formatted):
            m = self.TURN.match(formatted, at)
            if not m:
                raise ValueError(f"no turn at {at}")
            turns.append((self.restored(m[1]), self.restored(m[2])))
            at = m.end()
        return turns


class Rewritten(Exception):
    """args: the turn whose prefix renders to something that doesn't begin with what was rendered before."""


def _found(render: Render, turns: list[Turn], first: int, last: int, start: int, at: int) -> list[tuple]:
    """(start, stop, text_start, text_stop) of the turns first..last, by prefixes that begin with turn ``start``; ``at`` is where turn first begins."""
    before, found = render(turns[start:first]), []
    for k in range(first, last):
        out, marked = render(turns[start : k + 1]), render([*turns[start:k], (turns[k][0], MARK)])
        if not out.startswith(before):
            raise Rewritten(k)
        header, mark, footer = marked[len(before) :].partition(MARK)
        size = len(out) - len(before)
        known = mark and marked.startswith(before) and MARK not in footer and len(header) + len(footer) <= size
        if not known or not out.startswith(header, len(before)) or not out.endswith(footer):
            raise ValueError(f"the text of turn {k} can't be told from what surrounds it")
        found.append((at, at + size, at + len(header), at + size - len(footer)))
        at, before = at + size, out
    return found


def spans(render: Render, turns: list[Turn], window: int = WINDOW) -> tuple[str, int | None, list[tuple]]:
    """(formatted, first turn that rewrites history or None, (role, start, stop, text_start, text_stop) of each turn).

    start of the first turn is the length of what no turns render to. ValueError if a turn's text can't be told
    from what surrounds it.
    """
    whole, head = render(turns), len(render([]))
    try:
        found = _windows(render, turns, window, whole, head)
        if found is None:
            found = _found(render, turns, 0, len(turns), 0, head)
    except Rewritten as e:
        return whole, e.args[0], []
    return whole, None, [(role, *place) for (role, _), place in zip(turns, found)]


def _windows(render: Render, turns: list[Turn], window: int, whole: str, at: int) -> list[tuple] | None:
    """The turns' places by cut prefixes, or None if a whole prefix shows that they don't hold."""
    found: list[tuple] = []
    for first in range(0, len(turns), window):
        last, start = min(first + window, len(turns)), max(0, first - window)
        try:
            found += _found(render, turns, first, last, start, found[-1][1] if found else at)
        except (Rewritten, ValueError):
            if start == 0:
                raise
            return None
        if start and render(turns[:last]) != whole[: found[-1][1]]:
            return None
    return found


def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[Turn]]]:
    """Conversations of sorted rows (conv_id, role, text), one at a time."""
    held, turns, any_row = None, [], False
    for batch in batches:
        for conv, role, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if any_row and conv != held:
                yield held, turns
                turns = []
            held, any_row = conv, True
            turns.append((role, text))
    if any_row:
        yield held, turns


def formatted(rows: DataFrame, render: Render, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row per conversation: conv_id, formatted, n_turns, rewrites_at and the spans of turns and texts, in code points from 0."""
    spark = rows.sparkSession
    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("n_turns", pa.int64()), ("rewrites_at", pa.int64()), ("spans", pa.list_(pa.struct([("role", pa.string()), *((k, pa.int64()) for k in ("start", "stop", "text_start", "text_stop"))])))])
    names = ("role", "start", "stop", "text_start", "text_stop")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for conv_id, turns in conversations(batches):
            whole, rewrites_at, found = spans(render, turns)
            out.append({"conv_id": conv_id, "formatted": whole, "n_turns": len(turns), "rewrites_at": rewrites_at, "spans": [dict(zip(names, s)) for s in found]})
            size += len(whole) + 64 * len(turns)
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    held = rows.select(F.col(conv).cast("bigint").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    held = held.repartition(shuffle_partitions(spark), "conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return held.select("conv_id", "role", "text").mapInArrow(task, SCHEMA)


def masked(done: DataFrame, template: Marked, roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """What the output itself says: conv_id, n_turns, turns_sha256 of the turns that it parses to, and the digest of all text under the loss mask."""
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                turns = template.parse(r["formatted"])
                loss = "".join(template.restored(r["formatted"][s["text_start"] : s["text_stop"]]) for s in r["spans"] if s["role"] in roles)
                out.append((r["conv_id"], len(turns), digest("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), digest(loss), len(r["formatted"])))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, kinds)], names)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return done.select("conv_id", "formatted", "spans").mapInArrow(task, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: all conversations, and one whose texts hold the template's own marks."""
    odd = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more)
    template = Marked()
    return masked(formatted(rows, template.render), template)
