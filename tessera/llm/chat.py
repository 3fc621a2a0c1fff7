"""Minimum-cost role repair of conversations.

A legal conversation is an optional system turn, then user and assistant turns in
alternation, from user to assistant. Each source turn is kept, relabelled or
merged into the turn before it, and empty turns may be inserted; dynamic
programming over the automaton of last roles finds the cheapest repair.

The program composes: a run of turns is a 4 x 4 matrix of least costs. Turns are
handled in chunks of a conversation, so a conversation of any length never meets
in one task. Where a conversation has several chunks, they give their matrices,
matrices give each chunk's entry and exit role, and chunks are repaired between
those; others are repaired at once. Tasks read sorted rows as a stream and hold
one chunk at a time.

Defined results: turns go by turn number, null last, ties by role and text; role
names are trimmed and lower-cased, and any other or null role is relabelled at
less cost; null text is empty; what looks like a delimiter in a text gets a
backslash behind its angle bracket (``unescape`` takes it away); null conv_id is one
conversation, other ids are integers; repeated rows are turns of their own; a very
long text is one turn; an empty table gives an empty table; other columns are
ignored, whatever their names. Of repairs that cost the same the choice follows from
the turns and from where chunks end (every CHUNK turn numbers), not from partitions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.scratch import Scratch

ROLES = ("system", "user", "assistant")
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
OTHER = 4
#: From the last role to the next turn's.
LEGAL = {(BEGIN, SYSTEM), (BEGIN, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
#: Costs, least first among equals: keep, merge with the same role, relabel an unknown role, insert, relabel, merge another role.
MERGE, NAME, INSERT, RELABEL, BLEND = 10, 11, 20, 21, 32
FAR = 1 << 40
#: Turn numbers in a chunk.
CHUNK = 4096
NAMES = ("", *ROLES)
Step = tuple[int, str, tuple[int, ...], int]
_DELIMITER = re.compile(r"<(\\*)\|")


def escape(text: str) -> str:
    """Text in which no delimiter can begin."""
    return _DELIMITER.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


@cache
def insertions() -> dict[tuple[int, int], tuple[int, ...]]:
    """Fewest empty turns that lead from one last role to another."""
    out: dict[tuple[int, int], tuple[int, ...]] = {(s, s): () for s in range(4)}
    for _ in range(4):
        for (s, t), path in list(out.items()):
            for a, b in LEGAL:
                if a == t and b != SYSTEM and ((s, b) not in out or len(path) + 1 < len(out[s, b])):
                    out[s, b] = (*path, b)
    return out


@cache
def steps(code: int) -> dict[tuple[int, int], Step]:
    """Cheapest way for a turn of a role to lead from one last role to another: cost, action, turns inserted before, new role."""
    out: dict[tuple[int, int], Step] = {}

    def offer(s: int, t: int, step: Step) -> None:
        if (s, t) not in out or step[:2] < out[s, t][:2]:
            out[s, t] = step

    for s in range(4):
        for (a, mid), path in insertions().items():
            if a != s:
                continue
            toll = INSERT * len(path)
            for t in (SYSTEM, USER, ASSISTANT):
                if (mid, t) in LEGAL:
                    offer(s, t, (toll + (0 if code == t else NAME if code == OTHER else RELABEL), "keep" if code == t else "relabel", path, t))
        if s != BEGIN:
            offer(s, s, (MERGE if code in (s, OTHER) else BLEND, "merge", (), s))
    return out


def matrix(codes: list[int]) -> np.ndarray:
    """Least cost of a run of turns between any two last roles."""
    one = {c: np.full((4, 4), FAR, np.int64) for c in range(1, 5)}
    for c, m in one.items():
        for (s, t), step in steps(c).items():
            m[s, t] = step[0]
    out = np.where(np.eye(4, dtype=bool), 0, FAR).astype(np.int64)
    for c in codes:
        out = np.minimum((out[:, :, None] + one[c][None]).min(axis=1), FAR)
    return out


def closing(state: int) -> tuple[int, tuple[int, ...]]:
    """Cost and empty turns that end a conversation after an assistant turn."""
    path = insertions()[state, ASSISTANT]
    return INSERT * len(path), path


def ends(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """Entry and exit role of each chunk on a cheapest repair."""
    cost, back = np.array([0, FAR, FAR, FAR], np.int64), []
    for m in matrices:
        both = np.minimum(cost[:, None] + m, FAR)
        back.append(both.argmin(axis=0))
        cost = both.min(axis=0)
    state = int(np.argmin([int(cost[s]) + closing(s)[0] for s in range(4)]))
    out = []
    for b in back[::-1]:
        out.append((int(b[state]), state))
        state = int(b[state])
    return out[::-1]


@cache
def moves(code: int) -> tuple[tuple[int, int, int], ...]:
    """(from, to, cost) of a turn's steps, in a fixed order."""
    return tuple((s, t, step[0]) for (s, t), step in sorted(steps(code).items()))


def repair(codes: list[int], entry: int, leave: int | None) -> tuple[list[Step], int]:
    """A cheapest step for each turn from the entry role to the exit role (None: the best to close from), and the exit role."""
    cost, back = {entry: 0}, []
    for c in codes:
        best: dict[int, tuple[int, int]] = {}
        for s, t, toll in moves(c):
            if s in cost and (t not in best or cost[s] + toll < best[t][0]):
                best[t] = (cost[s] + toll, s)
        back.append(best)
        cost = {t: v for t, (v, _) in best.items()}
    state = leave if leave is not None else min(cost, key=lambda t: (cost[t] + closing(t)[0], t))
    out, last = [], state
    for c, best in zip(codes[::-1], back[::-1], strict=True):
        before = best[state][1]
        out.append(steps(c)[before, state])
        state = before
    return out[::-1], last


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of equal first ``keys`` columns, from batches sorted by them."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_MATRIX = pa.schema([("conv", pa.string()), ("chunk", pa.int64()), ("m", pa.list_(pa.int64()))])
_PLAN = pa.schema([("conv", pa.string()), ("chunk", pa.int64()), ("entry", pa.int32()), ("leave", pa.int32()), ("last", pa.bool_())])
_TURN = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("pos", pa.int64()), ("turn", pa.int64()), ("role_in", pa.string()), ("action", pa.string()), ("role", pa.string()), ("cost", pa.int64()), ("segment", pa.string())])


def _chunk_ends(rows: DataFrame, scratch: Scratch) -> DataFrame | None:
    """Entry and exit roles of the chunks of conversations that have several; None if no conversation has."""
    several = scratch.table(rows.groupBy("conv").agg((F.min("chunk") < F.max("chunk")).alias("several")).where("several").select("conv"), "several")
    if several.isEmpty():
        return None

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(((run[0][0], run[0][1], matrix([r[2] for r in run]).reshape(-1).tolist()) for run in _runs(batches, 2)), _MATRIX)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for run in _runs(batches, 1):
                found = ends([np.array(r[2]).reshape(4, 4) for r in run])
                for k, (r, (e, x)) in enumerate(zip(run, found, strict=True)):
                    yield r[0], r[1], e, x, k == len(run) - 1

        yield from _batches(each(), _PLAN)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turns = rows.select("conv", "chunk", "code", "turn").join(several, "conv", "left_semi").repartition(parts, "conv", "chunk")
    sums = turns.sortWithinPartitions("conv", "chunk", F.col("turn").asc_nulls_last(), "code").select("conv", "chunk", "code").mapInArrow(summary, "conv string, chunk long, m array<long>")
    dealt = sums.repartition(parts, "conv").sortWithinPartitions("conv", "chunk")
    return scratch.table(dealt.mapInArrow(link, "conv string, chunk long, entry int, leave int, last boolean"), "plan")


def repair_roles(turns: DataFrame) -> DataFrame:
    """One row a turn of the repaired conversation, in order of (conv_id, chunk, pos).

    turn and role_in are null for inserted turns; action is keep, relabel, merge
    or insert; cost is the row's; segment is what the row adds to the rendered
    conversation, so segments laid end to end are the whole.
    """
    scratch = Scratch(turns.sparkSession, "chat")
    role = F.lower(F.trim(F.col("role").cast("string")))
    code = F.when(role == "system", SYSTEM).when(role == "user", USER).when(role == "assistant", ASSISTANT).otherwise(OTHER)
    rows = turns.select(
        F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit("")).alias("conv"),
        F.coalesce(F.floor(F.col("turn").cast("long") / CHUNK).cast("long"), F.lit(2**62)).alias("chunk"),
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role_in"),
        code.cast("int").alias("code"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    plan = _chunk_ends(rows, scratch)
    if plan is None:
        rows = rows.select("*", F.lit(BEGIN).alias("entry"), F.lit(None).cast("int").alias("leave"), F.lit(True).alias("last"))
    else:
        met = rows.join(plan, ["conv", "chunk"], "left")
        rows = met.select(*rows.columns, F.coalesce("entry", F.lit(BEGIN)).alias("entry"), "leave", F.coalesce("last", F.lit(True)).alias("last"))

    def repaired(run: list[tuple]) -> Iterator[tuple]:
        _, chunk, conv_id, *_, entry, leave, last = run[0]
        found, leave = repair([r[5] for r in run], entry, leave)
        out: list[tuple] = []
        state = entry

        def add(turn: int | None, role_in: str | None, action: str, to: int, cost: int, text: str) -> None:
            nonlocal state
            lead = "\n" if action == "merge" else ("<|end|>\n" if state != BEGIN else "") + f"<|{NAMES[to]}|>\n"
            out.append((conv_id, chunk, len(out), turn, role_in, action, NAMES[to], cost, lead + escape(text)))
            state = to

        for r, (cost, action, path, to) in zip(run, found, strict=True):
            for p in path:
                add(None, None, "insert", p, INSERT, "")
            add(r[3], r[4], action, to, cost - INSERT * len(path), r[6])
        if last:
            for p in closing(leave)[1]:
                add(None, None, "insert", p, INSERT, "")
            out[-1] = (*out[-1][:8], out[-1][8] + "<|end|>\n")
        yield from out

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches((row for run in _runs(batches, 2) for row in repaired(run)), _TURN)

    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "conv", "chunk").sortWithinPartitions("conv", "chunk", F.col("turn").asc_nulls_last(), "code", "text")
    return dealt.mapInArrow(write, "conv_id long, chunk long, pos long, turn long, role_in string, action string, role string, cost long, segment string")


def render(repaired: DataFrame) -> DataFrame:
    """conv_id, rendered conversation and its cost; for conversations that fit a row."""
    ordered = F.sort_array(F.collect_list(F.struct("chunk", "pos", "segment")))
    return repaired.groupBy("conv_id").agg(F.concat_ws("", F.transform(ordered, lambda x: x["segment"])).alias("rendered"), F.sum("cost").alias("cost"))


