"""Conversation structure repair by Hirschberg's divide and conquer over a four-state automaton.

A conversation is sound if its roles read ``(s?(ua)+)?`` by their initials. Edits of its rows, in order: Keep costs 0,
Rerole (to user or assistant) 3, Delete 4, Insert (an empty user or assistant row) 3; a truncated row that stays adds
3; blank and duplicate rows must go. The cheapest edits are wanted, and of equally cheap ones the string of initials
that is ASCII-least.

States are what stands before: nothing, s, u, a. An edit leads from a state to one other, so that a state and an audit
tell where it ends, and strings that end at row edits in different states never begin one another. A forward pass over
half of the rows therefore carries, for each state, its least cost and the rank of its least string among the four;
with the costs of a backward pass over the other half, the crossing is the cheapest state of least rank, and each half
is solved in the same way between its known ends. Costs and ranks are four numbers each, whatever the length.

The same passes run over chunks of rows: a chunk of at most CHUNK rows is known by the costs and ranks from each state
to each other. Rows are sorted by range, so that a conversation of any length is cut into chunks of many tasks; a
conversation's crossings between chunks are found from the chunks' tables alone, and the chunks are then solved on
their own. What is sorted and solved has no texts, only hashes of 128 bits that lead back to them.

Defined results: null roles and texts are read as one space, null turns come first and count for no gap; rows of one
turn come by role, then by a hash of their texts; repeated rows are duplicates of the first; a role of another initial
can be reroled or deleted alone; a null conv_id is a conversation; an empty table gives an empty result; other
columns, whatever their names, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.llm.common import shuffle_partitions, table, written

SPACES = " \t\n\x0b\x0c\r"
RULES = {"keep": 0, "rerole": 3, "delete": 4, "insert": 3, "truncated": 3}
#: Rows that are solved together.
CHUNK = 4096
NONE = 1 << 60
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Where an inserted or reroled row leads, by the state before it.
TURN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: What it costs to end in a state: how many rows must be inserted.
MISSING = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
#: Initials by their code; any other is OTHER.
INITIALS, OTHER = "sua", 3
LEGAL = {(0, 1), (1, 2), (2, 1)}
TRUNCATED, DEAD = 4, 8

#: A step of the passes: for each state the (state after, cost, order among the steps from the same state).
Step = list[list[tuple]]


def _row_step(code: int) -> Step:
    """The edits of one row, each after at most two inserted ones (a third would lead nowhere new)."""
    initial, step = code & 3, []
    for p in range(4):
        best: dict[int, tuple] = {}
        state = p
        for inserts in range(3):
            ways = [(state, RULES["delete"], "D")]
            if not code & DEAD:
                more = RULES["truncated"] if code & TRUNCATED else 0
                ways.append((TURN[state], RULES["rerole"] + more, "R"))
                if initial == 0 and state == START:
                    ways.append((SYSTEM, RULES["keep"] + more, "K"))
                elif initial != OTHER and initial and TURN[state] == initial + 1:
                    ways.append((initial + 1, RULES["keep"] + more, "K"))
            for q, cost, letter in ways:
                way = (cost + inserts * RULES["insert"], "I" * inserts + letter)
                best[q] = min(best.get(q, way), way)
            state = TURN[state]
        step.append([(q, *way) for q, way in best.items()])
    return step


STEPS = [_row_step(code) for code in range(16)]


def forward(steps: list[Step], lo: int, hi: int, start: int) -> tuple[list[int], list[int]]:
    """Least costs from start before step lo to each state after step hi - 1, and the ranks of their least strings."""
    cost, rank = [NONE] * 4, [0] * 4
    cost[start] = 0
    for i in range(lo, hi):
        new: list = [None] * 4
        for p in range(4):
            if (c := cost[p]) < NONE:
                for q, more, order in steps[i][p]:
                    way = (c + more, rank[p], order)
                    if new[q] is None or way < new[q]:
                        new[q] = way
        cost = [NONE if way is None else way[0] for way in new]
        for place, q in enumerate(sorted((q for q in range(4) if new[q] is not None), key=lambda q: new[q][1:])):
            rank[q] = place
    return cost, rank


def backward(steps: list[Step], lo: int, hi: int, end: int) -> list[int]:
    """Least costs from each state before step lo to end after step hi - 1."""
    cost = [NONE] * 4
    cost[end] = 0
    for i in range(hi - 1, lo - 1, -1):
        cost = [min((more + cost[q] for q, more, _ in steps[i][p]), default=NONE) for p in range(4)]
    return cost


def crossings(steps: list[Step], start: int, end: int) -> list[int]:
    """The states before, between and after the steps on the cheapest way of least string from start to end."""
    states = [start] * len(steps) + [end]
    halves = [(0, len(steps))]
    while halves:
        lo, hi = halves.pop()
        if hi - lo < 2:
            continue
        mid = (lo + hi) // 2
        to, rank = forward(steps, lo, mid, states[lo])
        left = backward(steps, mid, hi, states[hi])
        states[mid] = min((q for q in range(4) if to[q] < NONE and left[q] < NONE), key=lambda q: (to[q] + left[q], rank[q]))
        halves += [(lo, mid), (mid, hi)]
    return states


def ending(steps: list[Step]) -> tuple[int, int]:
    """(cost, state after the last step) of the cheapest way to a sound conversation."""
    cost, rank = forward(steps, 0, len(steps), START)
    total = lambda q: cost[q] + MISSING[q] * RULES["insert"]
    q = min((q for q in range(4) if cost[q] < NONE), key=lambda q: (total(q), rank[q]))
    return total(q), q


def solved(codes: bytes, start: int, end: int, tail: int = 0) -> str:
    """The audit of a chunk between two states, with tail inserts after it."""
    steps = [STEPS[c] for c in codes]
    states = crossings(steps, start, end)
    return "".join(next(order for q, _, order in step[p] if q == after) for step, p, after in zip(steps, states, states[1:])) + "I" * tail


#: conv_id, chunk: the order of a conversation's chunks, unique in the table; ways: cost and rank from state to state; sites: the rows that may stay.
CHUNKS = "conv_id bigint, chunk bigint, codes binary, ways array<bigint>, first_turn bigint, last_turn bigint, turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, sites array<struct<at: int, h1: bigint, h2: bigint>>"
FOUND = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, ends array<struct<chunk: bigint, start: int, end: int, tail: int>>"


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += 1 + len(row.get("codes", ())) // 64
        if size >= most:
            yield pa.RecordBatch.from_pylist(out, schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _chunk(conv: int | None, number: int, codes: bytearray, turns: list, counts: list[int], sites: list) -> dict:
    steps, known = [STEPS[c] for c in codes], [t for t in turns if t is not None]
    ways: list[int] = []
    for p in range(4):
        cost, rank = forward(steps, 0, len(steps), p)
        ways += cost + rank
    illegal = sum((a & 3, b & 3) not in LEGAL for a, b in zip(codes, codes[1:]))
    return {
        "conv_id": conv, "chunk": number, "codes": bytes(codes), "ways": ways, "first_turn": known[0] if known else None, "last_turn": known[-1] if known else None,
        "turns": len(known), "blank": counts[0], "duplicate": counts[1], "truncated": counts[2], "illegal": illegal, "sites": sites,
    }


def _cut(size: int, schema: pa.Schema):
    """Sorted rows into chunks of at most size rows of one conversation."""

    def chunks(batches: Iterator[pa.RecordBatch], task: int) -> Iterator[dict]:
        number, conv, codes, turns, counts, sites = task << 32, None, bytearray(), [], [0, 0, 0], []
        for batch in batches:
            for c, turn, initial, kind, first, n, h1, h2 in zip(*(batch.column(k).to_pylist() for k in range(8))):
                for nth in range(n):
                    if codes and (c != conv or len(codes) >= size):
                        yield _chunk(conv, number, codes, turns, counts, sites)
                        number, codes, turns, counts, sites = number + 1, bytearray(), [], [0, 0, 0], []
                    conv = c
                    fault = 0 if kind == 1 else 1 if not first or nth else 2 if kind == 2 else None
                    if fault is not None:
                        counts[fault] += 1
                    if fault is None or fault == 2:
                        sites.append({"at": len(codes), "h1": h1, "h2": h2})
                    codes.append(initial | (TRUNCATED if fault == 2 else 0) | (DEAD if fault in (0, 1) else 0))
                    if not turns or turns[-1] != turn:
                        turns.append(turn)
        if codes:
            yield _chunk(conv, number, codes, turns, counts, sites)

    return lambda batches: _batches(chunks(batches, TaskContext.get().partitionId()), schema, 1 << 10)


def _join_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations of chunks (conv_id, chunks in order): the counts over them and the states between them."""

    def found(conv: int | None, chunks: list[dict]) -> dict:
        steps = [[[(q, w[8 * p + q], w[8 * p + 4 + q]) for q in range(4) if w[8 * p + q] < NONE] for p in range(4)] for w in (c["ways"] for c in chunks)]
        cost, end = ending(steps)
        states = crossings(steps, START, end)
        tails = [0] * (len(chunks) - 1) + [MISSING[end]]
        timed = [c for c in chunks if c["turns"]]
        distinct = sum(c["turns"] for c in timed) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(timed, timed[1:]))
        row = {k: sum(c[k] for c in chunks) for k in ("blank", "duplicate", "truncated", "illegal")}
        row["illegal"] += sum((a["last"] & 3, b["first"] & 3) not in LEGAL for a, b in zip(chunks, chunks[1:]))
        row["gaps"] = timed[-1]["last_turn"] - timed[0]["first_turn"] + 1 - distinct if timed else 0
        return row | {"conv_id": conv, "cost": cost, "ends": [{"chunk": c["chunk"], "start": p, "end": q, "tail": t} for c, p, q, t in zip(chunks, states, states[1:], tails)]}

    ints = [(k, pa.int64()) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    schema = pa.schema([("conv_id", pa.int64()), *ints, ("ends", pa.list_(pa.struct([("chunk", pa.int64()), *((k, pa.int32()) for k in ("start", "end", "tail"))])))])
    for batch in batches:
        yield pa.RecordBatch.from_pylist([found(r["conv_id"], r["chunks"]) for r in batch.to_pylist()], schema)


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's audit and the rows that it leaves: place, edit, the role it gives (null: its own), and the hashes of its text (null: inserted)."""

    def edits(r: dict) -> dict:
        audit, state, at, out = solved(r["codes"], r["start"], r["end"], r["tail"]), r["start"], 0, []
        texts = {s["at"]: s for s in r["sites"]}
        for place, letter in enumerate(audit):
            if letter in "IR":
                state = TURN[state]
            elif letter == "K":
                state = (r["codes"][at] & 3) + 1
            if letter != "D":
                text = texts[at] if letter != "I" else {"h1": None, "h2": None}
                out.append({"place": place, "edit": letter, "role": None if letter == "K" else NAMES[state], "h1": text["h1"], "h2": text["h2"]})
            at += letter != "I"
        return {"conv_id": r["conv_id"], "chunk": r["chunk"], "audit": audit, "edits": out}

    struct = pa.struct([("place", pa.int32()), ("edit", pa.string()), ("role", pa.string()), ("h1", pa.int64()), ("h2", pa.int64())])
    schema = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("audit", pa.string()), ("edits", pa.list_(struct))])
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield pa.RecordBatch.from_pylist([edits(r) for r in batch.slice(at, 256).to_pylist()], schema)


def repair(rows: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """For rows (conv_id, turn, role, text): conversations with their counts, cost and audit; and their repaired rows.

    The repaired rows are conv_id, chunk and place (their order in the conversation), edit, role and text.
    """
    spark = rows.sparkSession
    role, text = (F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text"))
    held = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role, text)
    known = lambda seed, *cols: F.xxhash64(F.lit(seed), *[x for c in cols for x in (F.isnull(c), F.col(c))])
    held = held.withColumns({"h1": known(1, "conv_id", "turn", "role", "text"), "h2": known(2, "text", "role", "turn", "conv_id")})
    shown = F.rtrim("text", F.lit(SPACES))
    kind = F.when(shown == "", 1).when(F.substring(shown, -1, 1).isin(".", "!", "?"), 0).otherwise(2)
    initial = F.lit(OTHER)
    for code, letter in enumerate(INITIALS):
        initial = F.when(F.substring("role", 1, 1) == letter, code).otherwise(initial)
    narrow = held.select("conv_id", "turn", "role", "h1", "h2", known(3, "role", "text").alias("d1"), known(4, "text", "role").alias("d2"), kind.alias("kind"), initial.alias("initial"))
    narrow = narrow.groupBy(*narrow.columns).count()
    same = narrow.groupBy("conv_id", "d1", "d2").agg(F.min(F.struct("turn")).alias("earliest"), F.count("*").alias("times")).where("times > 1")
    same = same.select(F.col("conv_id").alias("c"), F.col("d1").alias("e1"), F.col("d2").alias("e2"), "earliest")
    narrow = narrow.join(same, narrow["conv_id"].eqNullSafe(same["c"]) & (narrow["d1"] == same["e1"]) & (narrow["d2"] == same["e2"]), "left")
    first = F.coalesce(F.col("turn").eqNullSafe(F.col("earliest.turn")) | F.col("earliest").isNull(), F.lit(True))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "d1", "d2"]
    ranged = narrow.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).select("conv_id", "turn", "initial", "kind", first.alias("first"), "count", "h1", "h2")
    sites = pa.list_(pa.struct([("at", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())]))
    ints = [(k, pa.int64()) for k in ("first_turn", "last_turn", "turns", "blank", "duplicate", "truncated", "illegal")]
    schema = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("codes", pa.binary()), ("ways", pa.list_(pa.int64())), *ints, ("sites", sites)])
    chunks = written(ranged.mapInArrow(_cut(chunk, schema), CHUNKS), "chunks")

    byte = lambda at: F.conv(F.hex(F.substring("codes", at, 1)), 16, 10).cast("bigint")
    part = F.struct("chunk", "ways", "first_turn", "last_turn", "turns", "blank", "duplicate", "truncated", "illegal", byte(1).alias("first"), byte(-1).alias("last"))
    # A conversation's chunks: one row for each CHUNK of its rows.
    found = chunks.groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("chunks")).mapInArrow(_join_chunks, FOUND)
    found = written(found, "conversations")
    ends = found.select(F.explode("ends").alias("e")).select("e.*")
    pieces = chunks.select("conv_id", "chunk", "codes", "sites").join(ends, "chunk")
    pieces = written(pieces.mapInArrow(_solve, "conv_id bigint, chunk bigint, audit string, edits array<struct<place: int, edit: string, role: string, h1: bigint, h2: bigint>>"), "edits")
    audits = pieces.groupBy(F.col("conv_id").alias("c")).agg(_joined(F.struct("chunk", F.col("audit").alias("line")), "").alias("audit"))
    done = found.join(audits, found["conv_id"].eqNullSafe(audits["c"])).drop("c", "ends")

    edits = pieces.select("conv_id", "chunk", F.explode("edits").alias("e")).select("conv_id", "chunk", "e.*")
    texts = held.groupBy("h1", "h2").agg(F.first("role").alias("own"), F.first("text").alias("text"))
    kept = edits.where("h1 is not null").join(texts, ["h1", "h2"]).select("conv_id", "chunk", "place", "edit", F.coalesce("role", "own").alias("role"), "text")
    inserted = edits.where("h1 is null").select("conv_id", "chunk", "place", "edit", "role", F.lit("").alias("text"))
    return done, kept.unionByName(inserted)


def _joined(item: Column, by: str) -> Column:
    """The lines of a group in the order of what stands before them in item."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["line"]), by)


def damaged(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with every twentieth of five kinds of damage, by a checksum of conv_id and turn."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    role, text, hit = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" ")), F.col("hit")
    held = rows.withColumn("hit", F.crc32(key.cast("binary")) % 20).where(hit != 0)
    shown = F.when(hit == 1, "").when(hit == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    return held.withColumn("copy", F.explode(F.when(hit == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", F.when(hit == 4, "user").otherwise(role).alias("role"), shown.alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: damages all conversations and repairs them."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    done, repaired = repair(damaged(rows))
    line = F.concat("role", F.lit(":"), "text").alias("line")
    texts = repaired.groupBy(F.col("conv_id").alias("r")).agg(F.sha2(_joined(F.struct("chunk", "place", line), "\n"), 256).alias("repaired_sha256"))
    every = rows.select(F.col("conv_id").alias("k")).distinct()
    out = every.join(done, every["k"].eqNullSafe(done["conv_id"]), "left").drop("conv_id").join(texts, F.col("k").eqNullSafe(F.col("r")), "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("k").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
