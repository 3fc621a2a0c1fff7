"""Mix sources to target weights by exact subset-sum fitting.

Each source's share of all words follows its weight, no source above three times
its size. A source takes its documents whole: some full passes, then for the
rest an equal fraction of every length, then a bounded-knapsack dynamic program
over the counts of lengths closes the gap, by giving documents back too. Documents
of a length are picked in the order of a seeded hash.

Defined results: sources are ranked by code point, null last; null or empty text
has size 0 and is never repeated for weight; a source without words has target 0;
repeated rows are rows of their own, and which of several equal ones is taken
makes no difference; rows of one id and text go by their other columns; a very
long text is one length like any other, and where it is most of its source the
nearest sum below the target is taken; ids may be of any type; an empty table
gives an empty table; other columns pass through, and one named like an added
column is replaced by it. Sources are ranked in one task, a row each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import sharding
from tessera.sources.scratch import Scratch

WORDS = r"[^\x20\x09-\x0D]+"
ADDED = ("size", "source_size", "target", "taken", "times")
#: Most sums the dynamic program looks at (4 bytes each).
STATES = 1 << 25
#: Hash slices of a (source, length) cell; only the slice at the cut is ranked row by row.
SLICES = 1024


def _close(pieces: list[tuple[int, int, int]], low: int, high: int) -> dict[int, int]:
    """Copies of each piece's length to add (or, if negative, to give back) for the largest sum up to ``high`` that the pieces reach without passing below ``low``.

    ``via`` names the piece that first reached a sum; the sum before it was reached earlier, so no piece is used twice.
    """
    via = np.full(high - low + 1, -1, np.int32)
    via[-low] = 0
    for k, (_, _, w) in enumerate(pieces, 1):
        if abs(w) < len(via):
            old, new = (via[: len(via) - w], via[w:]) if w > 0 else (via[-w:], via[: len(via) + w])
            hit = np.flatnonzero((old >= 0) & (new < 0))
            new[hit] = k
            if via[-1] >= 0:
                break
    at, moves = int(np.flatnonzero(via >= 0)[-1]), Counter()
    while via[at]:
        i, copies, w = pieces[via[at] - 1]
        moves[i] += copies
        at -= w
    return moves


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, states: int = STATES) -> np.ndarray:
    """How many documents of each length to take, at most ``counts``, for the largest sum that is no more than ``budget``.

    An equal share of all lengths and then the longest documents that still fit
    leave a small gap. The dynamic program closes it over sums around that choice,
    giving documents back as well as adding more; its window widens until the gap
    is closed or everything taken could be given back, when its answer is the best
    there is. A window never passes ``states`` sums: beyond, the sums that can be
    reached at all are listed, as few long documents have few; only where these are
    more than ``states`` too does the best found count.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    some = lengths > 0
    unit = int(np.gcd.reduce(lengths[some & (counts > 0)])) if total else 1
    budget = max(budget, 0) // unit * unit  # every sum is a multiple
    # Every so-manieth document in order of length, so that no length is preferred.
    upto = [c * budget // total for c in accumulate((counts * some).tolist(), initial=0)]
    take = np.diff(np.array(upto, np.int64))
    left = budget - int((take * lengths).sum())
    while left < 0:  # that may be a little too much: the shortest document that mends it goes, else the longest
        taken = np.flatnonzero(some & (take > 0))
        enough = taken[lengths[taken] >= -left]
        i = int(enough[np.argmin(lengths[enough])] if len(enough) else taken[np.argmax(lengths[taken])])
        take[i] -= 1
        left += int(lengths[i])
    for i in np.argsort(-lengths, kind="stable").tolist():
        if some[i] and lengths[i] <= left:
            more = min(int(counts[i] - take[i]), left // int(lengths[i]))
            take[i] += more
            left -= more * int(lengths[i])

    def pieces(free: np.ndarray, sign: int, most: int) -> list[tuple[int, int, int]]:
        """Counts in binary pieces: (length's place, copies, sum)."""
        out = []
        for i in np.flatnonzero(some & (free > 0) & (lengths <= most)).tolist():
            rest, size = min(int(free[i]), most // int(lengths[i])), 1
            while rest > 0:
                k = min(size, rest)
                out.append((i, sign * k, sign * k * int(lengths[i])))
                rest, size = rest - k, size * 2
        return out

    taken, window, limited = budget - left, 8 * int(lengths.max(initial=1)), left >= states
    while left:
        window = min(window, taken, max(states - left, 0))
        moves = _close([*pieces(take, -1, window), *pieces(counts - take, 1, window + left)], -window, left)
        gain = sum(k * int(lengths[i]) for i, k in moves.items())
        if gain == left or window in (taken, states - left) or left >= states:
            limited = gain < left and (window < taken or left >= states)
            for i, k in moves.items():
                take[i] += k
            break
        window *= 8
    listed = _listed(pieces(counts, 1, budget), budget, states) if limited else None
    if listed is not None:
        take = np.zeros_like(take)
        for i, k in listed.items():
            take[i] = k
    return take


def _listed(pieces: list[tuple[int, int, int]], budget: int, states: int) -> dict[int, int] | None:
    """Copies by place of the largest sum within the budget, from a list of all sums that pieces reach; None if there are more than ``states``."""
    sums, added = np.zeros(1, np.int64), []
    for _, _, size in pieces:
        new = np.setdiff1d(sums[: int(np.searchsorted(sums, budget - size, side="right"))] + size, sums, assume_unique=True)
        added.append(new)
        sums = np.union1d(sums, new)
        if len(sums) > states:
            return None
    # A sum came with the first piece that reached it; what is left of it was there before.
    out: dict[int, int] = {}
    at = int(sums[-1])
    for (i, k, size), new in zip(reversed(pieces), reversed(added), strict=True):
        j = int(np.searchsorted(new, at))
        if j < len(new) and new[j] == at:
            out[i], at = out.get(i, 0) + k, at - size
    return out


def targets(sources: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """Add ``target`` to (source, source_size): shares by cycled weight, capped sources' excess reshared until none is above its cap."""
    ranked = sources.select("source", "source_size", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).alias("rank"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights)).cast("int") + 1)
    rows = ranked.select("source", "source_size", w.alias("w"), (F.col("source_size") * most).cast("double").alias("cap"))
    # Water filling: a source is capped while cap / w is below the level that the rest would share.
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    rows = rows.withColumn("level", level)
    rows = rows.withColumn("level", F.max(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level"))).over(Window.partitionBy()))
    return rows.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3, seed: int = 17, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all by default) with size, source_size, target, times (0 to ``most``) and taken (times * size)."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ADDED]
    scratch = Scratch(docs.sparkSession, "mix")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    mark = F.xxhash64(F.lit(seed), F.col("doc_id"), F.crc32(text.cast("binary")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("size"), mark.alias("mark"))
    rows = rows.withColumn("slice", F.pmod("mark", F.lit(SLICES)).cast("int"))
    slices = scratch.table(rows.groupBy("source", "size", "slice").agg(F.count("*").alias("n")), "slices")
    cells = slices.groupBy("source", "size").agg(F.sum("n").alias("n"))
    totals = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    aims = targets(totals, weights, most)

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ignore_index=True)
        size, n = pdf["size"].to_numpy(), pdf["n"].to_numpy()
        total, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        whole = min(most, int(target // total)) if total else 1
        extra = fit(size, n, int(round(target)) - whole * total) if whole < most and total else np.zeros(len(pdf), np.int64)
        return pd.DataFrame({"source": pdf["source"], "size": size, "source_size": total, "target": target, "whole": whole, "extra": extra})

    cell = [F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull()]
    named = lambda df, *more: df.select(cell[0].alias("k"), cell[1].alias("k0"), *more)
    joined = named(cells, "source", "size", "n").join(named(aims, "source_size", "target"), ["k", "k0"]).select("source", "size", "n", "source_size", "target")
    chosen = joined.groupBy("source").applyInPandas(plan, "source string, size long, source_size long, target double, whole int, extra long")
    chosen = scratch.table(chosen, "chosen")

    running = Window.partitionBy("k", "k0", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    cut = named(slices, "size", "slice", "n").join(named(chosen, "size", "source_size", "target", "whole", "extra"), ["k", "k0", "size"])
    cut = cut.withColumn("pick", F.least(F.col("n"), F.greatest(F.lit(0), F.col("extra") - F.coalesce(F.sum("n").over(running), F.lit(0)))))
    cut = scratch.table(cut.select("k", "k0", "size", "slice", "source_size", "target", "whole", "pick", "n"), "cut")

    met = named(rows, "size", "slice", "mark", "row").join(cut, ["k", "k0", "size", "slice"])
    # Rows of equal mark differ in columns besides id and text only and go by a hash of all; maps go as JSON.
    ties = [F.col("row").getField(c) if sharding.has_order(docs.schema[c].dataType) else F.to_json(F.struct(F.col("row").getField(c))) for c in keep]
    place = F.row_number().over(Window.partitionBy("k", "k0", "size", "slice").orderBy("mark", F.xxhash64(*ties)))
    times = F.col("whole") + F.when(F.col("pick") == F.col("n"), 1).when(F.col("pick") == 0, 0).otherwise(F.when(place <= F.col("pick"), 1).otherwise(0))
    return met.withColumn("times", times.cast("int")).select(*[F.col("row").getField(c).alias(c) for c in keep], "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken"))


def repeat_rows(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each row ``times`` times."""
    kept = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    return mixed.where("times > 0").select(kept, F.explode(F.sequence(F.lit(1), F.col("times")))).select(*[F.col("row").getField(c).alias(c) for c in columns])


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns, whatever these are called."""
    clash = [c for c in docs.columns if c.lower() in ADDED]
    if not clash:
        return repeat_rows(mix_sources(docs), docs.columns)
    plain = [c for c in docs.columns if c not in clash]
    own = next(f"own{i}" for i in range(len(docs.columns) + 1) if f"own{i}" not in plain)
    packed = docs.select(*[F.col(f"`{c}`") for c in plain], F.struct(*[F.col(f"`{c}`") for c in clash]).alias(own))
    mixed = repeat_rows(mix_sources(packed), packed.columns)
    return mixed.select(*[F.col(f"`{c}`") if c in plain else F.col(own).getField(c).alias(c) for c in docs.columns])
