"""Benchmark decontamination by the q-gram lemma.

Texts and items are normalised (A-Z lower-cased, white space runs as one space).
An occurrence of an item of m bytes with at most e edits shares at least
m - q + 1 - q e of its q-grams, on diagonals no more than e apart. Shared grams
are counted in bands of 2 (e + 1) diagonals, e + 1 apart, so some band holds them
all; bands under the bound are dropped, and the others are verified by an
alignment in the band, many at once. Items whose bound is below one gram are cut
into e + 1 pieces instead, one of which an occurrence holds unedited. An item over
PART bytes is cut into parts that are looked for on their own, so cost grows with
an item's length and not with its square; an occurrence of the whole within its
budget has a part within its own, and adjoining finds are one region.

Tasks index the items in blocks of bounded size and write them to the shared
folder. One pass over the texts maps the blocks and goes through them; nothing is
broadcast but their place. Off a mounted folder a worker keeps few blocks read.

Defined results: null and empty texts match nothing; null and blank items are
passed over; items under SHORT bytes match only exactly, with no word character
before or behind; every occurrence counts, overlapping ones of an item once; equal
items each match; repeated rows match alike; very long texts and items are handled
like others; ids are integers (null ids stay null); empty tables give no matches;
other columns are ignored.
"""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.hashstore import Recent, save
from tessera.llm.textkit import LOWER, SPACE, blocks, utf8
from tessera.sources.scratch import Scratch

#: Gram length, edits as a share of an item's bytes, shortest item matched with edits, longest matched in one, bytes of items in a block.
Q, EDITS, SHORT, PART, ITEM_BYTES = 8, 0.1, 16, 1024, 1 << 20
_COST = 32
#: Cells an alignment holds at once.
CELLS = 1 << 22
_ODD = np.uint64(0x9E3779B97F4A7C15)


def normalise(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes, their row offsets, and each one's place in ``data``."""
    blank = SPACE[data]
    drop = np.zeros(len(data), bool)
    drop[1:] = blank[1:] & blank[:-1]
    inner = off[1:-1]
    drop[inner[inner < len(data)]] = False
    at = np.flatnonzero(~drop)
    out = LOWER[data[at]]
    out[blank[at]] = 32
    return out, np.searchsorted(at, off), at


def grams(data: np.ndarray) -> np.ndarray:
    """The Q (8) bytes from each place, packed; zeros follow the last byte."""
    one = np.concatenate([data, np.zeros(Q - 1, np.uint8)]).astype(np.uint64)
    two = one[:-1] | one[1:] << np.uint64(8)
    four = two[:-2] | two[2:] << np.uint64(16)
    n = len(data)
    return four[:n] | four[4 : n + 4] << np.uint64(32)


def slots(codes: np.ndarray, bits: int) -> np.ndarray:
    return (codes * _ODD >> np.uint64(64 - bits)).astype(np.int64)


def _first(code: np.ndarray, size: int) -> np.ndarray:
    """The first ``size`` bytes of packed grams."""
    return code if size >= Q else code & np.uint64((1 << 8 * size) - 1)


@dataclass(frozen=True)
class Index:
    """A block of patterns (items, and parts of long ones): their bytes, budgets, and sorted grams with pattern and place.

    ``owner`` is the pattern of the whole item (an item's own, if it isn't cut), ``shift`` a part's place in it. Patterns without grams have pieces instead: a piece's length, first bytes, pattern and place, sorted by length and bytes.
    """

    ids: np.ndarray
    owner: np.ndarray
    shift: np.ndarray
    body: np.ndarray
    at: np.ndarray
    budget: np.ndarray
    need: np.ndarray
    code: np.ndarray
    item: np.ndarray
    place: np.ndarray
    seen: np.ndarray
    piece_size: np.ndarray
    piece_code: np.ndarray
    piece_item: np.ndarray
    piece_place: np.ndarray

    @staticmethod
    def of(rows: list[tuple[int | None, str | None]]) -> Index:
        ids, owner, shift, items, budget, need, parts, pieces = [], [], [], [], [], [], [], []

        def add(item_id: int | None, body: bytes, of: int, at: int) -> tuple[int, int, int]:
            i, m = len(ids), len(body)
            e = int(EDITS * m) if m >= SHORT else 0
            for have, x in zip((ids, owner, shift, items, budget, need), (item_id, of, at, body, e, m - Q + 1 - Q * e), strict=True):
                have.append(x)
            return i, m, e

        for item_id, text in rows:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            whole = normalise(raw, np.array([0, len(raw)]))[0].tobytes().strip()
            cut, of = -(-len(whole) // PART), len(ids)
            if cut > 1:
                add(item_id, whole, of, 0)
            for j in range(cut):
                at = j * len(whole) // cut
                body = whole[at : (j + 1) * len(whole) // cut]
                i, m, e = add(item_id, body, of, at)
                code = grams(np.frombuffer(body, np.uint8))
                if need[-1] > 0 and m >= SHORT:
                    parts.append((code[: m - Q + 1], np.full(m - Q + 1, i, np.int32), np.arange(m - Q + 1, dtype=np.int32)))
                else:
                    ends = [j * m // (e + 1) for j in range(e + 2)]
                    pieces += [(hi - lo, int(_first(code[lo : lo + 1], hi - lo)[0]), i, lo) for lo, hi in zip(ends[:-1], ends[1:], strict=True)]
        code, item, place = map(np.concatenate, zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32))
        order = np.argsort(code, kind="stable")
        bits = max(8, min(22, (8 * len(code)).bit_length()))
        seen = np.zeros(1 << bits, bool)
        seen[slots(code, bits)] = True
        pieces.sort()
        size, head, of, where = (np.array(x, t) for x, t in zip(zip(*pieces, strict=True) if pieces else [[]] * 4, (np.int64, np.uint64, np.int64, np.int64), strict=True))
        at = np.concatenate([[0], np.cumsum([len(x) for x in items])]).astype(np.int64)
        known = np.array([i if i is not None else 0 for i in ids], np.int64)
        named = np.array([i is not None for i in ids], bool)
        body = np.frombuffer(b"".join(items), np.uint8)
        return Index(np.stack([known, named.astype(np.int64)]), np.array(owner, np.int64), np.array(shift, np.int64), body, at, np.array(budget, np.int64), np.array(need, np.int64), code[order], item[order], place[order], seen, size, head, of, where)

    def pattern(self, i: int) -> np.ndarray:
        return self.body[self.at[i] : self.at[i + 1]]


@dataclass(frozen=True)
class Block:
    """Normalised texts: bytes, row offsets, places in the original, packed grams."""

    data: np.ndarray
    off: np.ndarray
    origin: np.ndarray
    code: np.ndarray
    raw_off: np.ndarray

    @staticmethod
    def of(column: pa.Array) -> Block:
        raw, raw_off = utf8(column)
        data, off, origin = normalise(raw, raw_off)
        return Block(data, off, origin, grams(data), raw_off)

    def row(self, pos: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.off, pos, side="right") - 1


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges [lo, hi): which range each member is of, and the members."""
    many = hi - lo
    which = np.repeat(np.arange(len(lo)), many)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + lo[which]


def candidates(index: Index, text: Block) -> np.ndarray:
    """(row, pattern, first diagonal of the band) of every band that meets its pattern's bound."""
    if not len(index.code) or len(text.data) < Q:
        return np.zeros((0, 3), np.int64)
    pos = np.flatnonzero(index.seen[slots(text.code, len(index.seen).bit_length() - 1)])
    lo, hi = (np.searchsorted(index.code, text.code[pos], side=s) for s in ("left", "right"))
    row = text.row(pos)
    ok = (hi > lo) & (pos + Q <= text.off[row + 1])
    pos, lo, hi, row = pos[ok], lo[ok], hi[ok], row[ok]
    which, entry = _ranges(lo, hi)
    item, row = index.item[entry].astype(np.int64), row[which]
    step = index.budget[item] + 1
    band = (pos[which] - index.place[entry] + len(text.data)) // step  # never below zero
    most = 2 * len(text.data) + 2
    patterns = len(index.owner)
    key = (row * patterns + item) * most
    found, count = np.unique(np.concatenate([key + band, key + np.maximum(band - 1, 0)]), return_counts=True)
    owner, band = found // most, found % most
    row, item = owner // patterns, owner % patterns
    keep = count >= index.need[item]
    row, item, band = row[keep], item[keep], band[keep]
    return np.stack([row, item, band * (index.budget[item] + 1) - len(text.data)], axis=1)


def piece_places(index: Index, text: Block) -> tuple[np.ndarray, np.ndarray]:
    """(entry of the piece lists, place in the block) of every unedited piece inside a row."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for size in np.unique(index.piece_size).tolist():
        first, last = (int(np.searchsorted(index.piece_size, size, side=s)) for s in ("left", "right"))
        known, code = index.piece_code[first:last], _first(text.code, size)
        seen = np.zeros(1 << 16, bool)
        seen[slots(known, 16)] = True
        pos = np.flatnonzero(seen[slots(code, 16)])
        lo, hi = (np.searchsorted(known, code[pos], side=s) for s in ("left", "right"))
        which, entry = _ranges(lo, hi)
        pos, entry = pos[which], entry + first
        ok = pos + size <= text.off[text.row(pos) + 1]
        for k in range(Q, size):  # the bytes behind those packed
            ok[ok] = text.data[pos[ok] + k] == index.body[index.at[index.piece_item[entry[ok]]] + index.piece_place[entry[ok]] + k]
        out.append((entry[ok], pos[ok]))
    return tuple(map(np.concatenate, zip(*out, strict=True)))  # type: ignore[return-value]


def _word_byte(body: bytes, k: int, step: int) -> bool:
    """Whether the character that ends (step -1) or begins (step 1) at byte k is of a word."""
    if not 0 <= k < len(body):
        return False
    lo, hi = k, k + 1
    while step < 0 and lo > 0 and body[lo] & 0xC0 == 0x80:
        lo -= 1
    while step > 0 and hi < len(body) and body[hi] & 0xC0 == 0x80:
        hi += 1
    c = body[lo:hi].decode(errors="replace")[0]
    return c.isalnum() or c == "_" or unicodedata.category(c)[0] == "M"


def pieced(index: Index, text: Block) -> tuple[np.ndarray, np.ndarray]:
    """Bands as of ``candidates`` of the patterns in pieces that allow edits, and finds as of ``align`` of the others."""
    entry, pos = piece_places(index, text)
    item = index.piece_item[entry]
    step, row, size = index.budget[item] + 1, text.row(pos), index.piece_size[entry]
    exact = step == 1
    band = (pos - index.piece_place[entry] + len(text.data)) // step
    bands = [np.stack([row, item, b * step - len(text.data)], axis=1)[~exact] for b in (band, np.maximum(band - 1, 0))]
    out = []
    for r, i, k, n in zip(row[exact].tolist(), item[exact].tolist(), pos[exact].tolist(), size[exact].tolist(), strict=True):
        lo, hi = int(text.off[r]), int(text.off[r + 1])
        before, behind = (text.data[max(lo, k - 4) : k].tobytes(), text.data[k + n : min(hi, k + n + 4)].tobytes())
        if not _word_byte(before, len(before) - 1, -1) and not _word_byte(behind, 0, 1):
            out.append((r, i, k, k + n, 0))
    return np.unique(np.concatenate(bands), axis=0), np.array(out, np.int64).reshape(-1, 5)


def _align(index: Index, text: Block, found: np.ndarray) -> np.ndarray:
    row, item, first = found.T
    e = index.budget[item]
    m = index.at[item + 1] - index.at[item]
    width = int((4 * e + 4).max())
    pattern = np.zeros((len(found), int(m.max())), np.uint8)
    for c, i in enumerate(item.tolist()):
        pattern[c, : m[c]] = index.pattern(i)
    data, off = text.data, text.off
    start = (first - e)[:, None] + np.arange(width)
    left, right = off[row][:, None], off[row + 1][:, None]
    far = np.int64(1) << 62
    cell = np.where((start >= left) & (start <= right), start, far)
    ramp = np.arange(width, dtype=np.int64) << _COST
    best = np.full((len(found), width), far)
    one = np.int64(1) << _COST
    for i in range(pattern.shape[1]):
        if i % 64 == 63 and ((cell.min(axis=1) >> _COST) > e).all() and not (m <= i).any():
            return np.zeros((0, 5), np.int64)
        at = start + i
        same = (data[np.clip(at, 0, len(data) - 1)] == pattern[:, i : i + 1]) & (at >= left) & (at < right)
        down = np.full_like(cell, far)
        down[:, :-1] = cell[:, 1:] + one
        cell = np.minimum(np.where(same, cell, cell + one), down)
        cell = np.minimum(np.minimum.accumulate(cell - ramp, axis=1) + ramp, far)
        done = m == i + 1
        if done.any():
            best[done] = cell[done]
    pick = best.argmin(axis=1)
    value = best[np.arange(len(best)), pick]
    edits, begin = value >> _COST, value & (one - 1)
    end = np.minimum(start[np.arange(len(best)), pick] + m, off[row + 1])
    return np.stack([row, item, begin, end, edits], axis=1)[edits <= e]


def align(index: Index, text: Block, found: np.ndarray) -> np.ndarray:
    """(row, pattern, start, end, edits) of the best alignment of each band that is within its pattern's budget.

    Bands of like width share an array of at most CELLS cells; a cell is edits << 32 plus where the alignment began, so one minimum tracks both.
    """
    found = found[np.argsort(index.budget[found[:, 1]], kind="stable")]
    out, lo = [np.zeros((0, 5), np.int64)], 0
    widths = 4 * index.budget[found[:, 1]] + 4
    while lo < len(found):
        hi = min(int(np.searchsorted(widths, 2 * widths[lo], side="right")), lo + max(1, CELLS // (2 * int(widths[lo]))))
        out.append(_align(index, text, found[lo:hi]))
        lo = hi
    return np.concatenate(out)


def _joined(hits: np.ndarray) -> np.ndarray:
    """Finds of an item, overlapping ones once (the one of fewest edits)."""
    hits = hits[np.lexsort((hits[:, 2], hits[:, 4], hits[:, 1], hits[:, 0]))]
    kept: list[list[int]] = []
    last, spans = None, []
    for h in hits.tolist():
        if last != (h[0], h[1]):
            last, spans = (h[0], h[1]), []
        k = bisect(spans, (h[2], h[3]))
        if (k == 0 or spans[k - 1][1] <= h[2]) and (k == len(spans) or h[3] <= spans[k][0]):
            spans.insert(k, (h[2], h[3]))
            kept.append(h)
    return np.array(kept, np.int64).reshape(-1, 5)


def whole_items(index: Index, text: Block, hits: np.ndarray) -> np.ndarray:
    """Finds with those of parts replaced by their whole items, aligned around them, where these are within their budgets."""
    part = index.owner[hits[:, 1]] != hits[:, 1]
    row, of, first = hits[part, 0], index.owner[hits[part, 1]], hits[part, 2] - index.shift[hits[part, 1]]
    order = np.lexsort((first, of, row))
    bands: list[tuple[int, int, int]] = []
    last = None
    for r, i, d in zip(row[order].tolist(), of[order].tolist(), first[order].tolist(), strict=True):
        e = int(index.budget[i])
        # A band has 2 e diagonals on either side, of which the find needs e and a part's own budget.
        if last is None or last[:2] != (r, i) or d - last[2] > e // 2 - 1:
            last = (r, i, d)
            bands.append((r, i, d - e - 1))
    return np.concatenate([hits[~part], align(index, text, np.array(bands, np.int64).reshape(-1, 3))])


def matches(index: Index, text: Block | pa.Array) -> np.ndarray:
    """(row, pattern, start, end, edits), places as bytes of the original text from the row's start."""
    text = text if isinstance(text, Block) else Block.of(text)
    bands, hits = pieced(index, text)
    hits = whole_items(index, text, np.concatenate([align(index, text, candidates(index, text)), align(index, text, bands), hits]))
    if len(hits):
        hits = _joined(hits)
        lead = text.raw_off[hits[:, 0]]
        hits[:, 2], hits[:, 3] = text.origin[np.minimum(hits[:, 2], len(text.origin) - 1)] - lead, text.origin[hits[:, 3] - 1] + 1 - lead
    return hits


_KEPT = Recent()


@dataclass(frozen=True)
class Items:
    """Blocks of indexed items in the shared folder."""

    uri: str
    blocks: tuple[int, ...]

    def __iter__(self) -> Iterator[Index]:
        for b in self.blocks:
            yield Index(**_KEPT.get(f"{self.uri}/{b:06d}").by_name)


def index_items(benchmark: DataFrame) -> Items:
    """Write the items' blocks, some ITEM_BYTES of text each."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text.alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long") + 16), F.lit(0))).first()[0]
    many = max(1, math.ceil(total / ITEM_BYTES))
    uri = Scratch(benchmark.sparkSession, "items").path("blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                index = Index.of([h[1:] for h in held])
                save(f"{uri}/{held[0][0]:06d}", **{f.name: getattr(index, f.name) for f in fields(Index)})
                yield pa.RecordBatch.from_pydict({"block": pa.array([held[0][0]], pa.int32())})
                held.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    yield from flush()
                held.append(row)
        yield from flush()

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(many)).cast("int")).repartition(min(many, 4096), "block")
    written = dealt.sortWithinPartitions("block", "item_id", "text").select("block", "item_id", "text").mapInArrow(run, "block int")
    return Items(uri, tuple(sorted(r[0] for r in written.collect())))


def contaminated_regions(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, end (characters of the original text), edits of every occurrence of an item in a text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = index_items(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            text, runes = Block.of(b.column("text")), None
            for index in items:
                hit = matches(index, text)
                if len(hit):
                    raw, off = utf8(b.column("text"))
                    runes = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)]) if runes is None else runes
                    r = hit[:, 0]
                    char = lambda at: runes[off[r] + at] - runes[off[r]]  # noqa: B023, E731
                    ids, named = index.ids[:, hit[:, 1]]
                    yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").take(pa.array(r)), "item_id": pa.array(ids, mask=named == 0), "start": char(hit[:, 2]), "end": char(hit[:, 3]), "edits": hit[:, 4].astype(np.int32)})

    return rows.mapInArrow(run, "doc_id long, item_id long, start long, end long, edits int")


def is_clean(benchmark: DataFrame, text: Column) -> Column:
    """True where a text holds no item; one pass however many item blocks there are."""
    items = index_items(benchmark)

    @F.arrow_udf("boolean")
    def clean(column: pa.Array) -> pa.Array:
        out = []
        for b in blocks(iter([pa.RecordBatch.from_arrays([column], ["text"])]), "text"):
            ok, block = np.ones(b.num_rows, bool), Block.of(b.column("text"))
            for index in items:
                ok[matches(index, block)[:, 0]] = False
            out.append(ok)
        return pa.array(np.concatenate(out) if out else np.zeros(0, bool))

    return clean(text.cast("string"))
