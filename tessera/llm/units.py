"""Substring deduplication by line, sentence and stretch hashing.

A unit is a line, and within it each sentence (a piece ended by ``.``, ``!`` or
``?`` before white space) and each stretch (words up to the next one whose mark,
a small number of its and the next word's bytes, is least within REACH words), so
that a passage inside a line is found too. Units are normalised (A-Z lower-cased,
white space runs as one space, ends trimmed), hashed to 128 bits and grouped
globally; the first occurrence by (doc_id, offset) stays.

A word is repeated if a later occurrence of a unit covers it. Repeated words are
removed where at least ``min_run`` of them follow each other, lines notwithstanding:
a boilerplate line of a few words in clean documents stays, a passage goes. Words
of a first occurrence that others point to are never removed, so what is kept is
kept whole. Each removed piece keeps its offsets in the original text.

The groups' first occurrences are stored as sorted hash arrays; a second scan
looks every unit up, so no text moves and a unit that a third of all documents
share is one row of the store.

Defined results: null and empty texts have no units; ids are integers, a null id
ranks last; of repeated rows (same id and text) the units are one occurrence, kept
in each; units under ``min_words`` words aren't looked at; a very long text is
handled whole; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.hashstore import build
from tessera.llm.textkit import LOWER, blocks, mix, row_bounds, utf8, word_hashes, words
from tessera.sources.scratch import Scratch

#: Words of the shortest unit, and of the shortest run of repeated words that is removed.
MIN_WORDS, MIN_RUN = 5, 20
LINE, SENTENCE, STRETCH = 0, 1, 2
KINDS = np.array(["line", "sentence", "stretch"])
#: Words on either side among which a stretch opens at the least mark.
REACH = 4
_NONE = 2**63 - 1


def _digest(hashes: np.ndarray, first: np.ndarray, last: np.ndarray, salt: int) -> np.ndarray:
    """Order-aware digest of each word span [first, last): differences of a running polynomial."""
    base, inverse = 0xD1342543DE82EF95 + 2 * salt, pow(0xD1342543DE82EF95 + 2 * salt, -1, 2**64)
    n = len(hashes)
    power, back = np.full(n + 1, base, np.uint64), np.full(n + 1, inverse, np.uint64)
    power[0] = back[0] = 1
    power, back = np.multiply.accumulate(power), np.multiply.accumulate(back)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(hashes + np.uint64(salt)) * power[:n], out=sums[1:])
    return mix((sums[last] - sums[first]) * back[first] + (last - first).astype(np.uint64))


def _opens_stretch(data: np.ndarray, start: np.ndarray, end: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Words whose mark is less than those of the REACH words before and no more than those of the REACH after, in their line."""
    own = (end - start) * 31 + LOWER[data[start]].astype(np.int64) * 7 + LOWER[data[end - 1]].astype(np.int64) * 13
    after = np.append(own[1:], 0)
    after[:-1][line[1:] != line[:-1]] = 0
    mark = (own * 17 + after * 29) % 1009
    least = np.ones(len(mark), bool)
    for k in range(1, REACH + 1):
        same = line[k:] == line[:-k]
        least[k:] &= ~same | (mark[k:] < mark[:-k])
        least[:-k] &= ~same | (mark[:-k] <= mark[k:])
    return least


def units(data: np.ndarray, off: np.ndarray, min_words: int) -> dict[str, np.ndarray]:
    """Every unit of a block: row, kind, first word and the one behind its last (in the block), start (bytes from the row's start), digests d1 and d2."""
    start, end, row = words(data, off)
    n = len(start)
    if not n:
        z = np.zeros(0, np.int64)
        return {"row": z, "kind": z, "first": z, "last": z, "start": z, "d1": z.astype(np.uint64), "d2": z.astype(np.uint64)}
    hashes = word_hashes(data, start, end)
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    line_of = lines[start]
    new_line = np.ones(n, bool)
    new_line[1:] = (line_of[1:] != line_of[:-1]) | (row[1:] != row[:-1])
    stop = np.isin(data[end - 1], list(b".!?"))
    new_sentence = new_line.copy()
    new_sentence[1:] |= stop[:-1]
    found = []
    sentences = np.zeros(0, np.int64)
    for kind, opens in ((LINE, new_line), (SENTENCE, new_sentence), (STRETCH, new_line | _opens_stretch(data, start, end, np.cumsum(new_line)))):
        first = np.flatnonzero(opens)
        last = np.append(first[1:], n)
        if kind != LINE:  # the same words are a unit once
            whole = new_line[first] & np.append(new_line, True)[last]
            first, last = first[~whole], last[~whole]
        if kind == SENTENCE:
            sentences = first * (n + 1) + last
        elif kind == STRETCH:
            other = ~np.isin(first * (n + 1) + last, sentences)
            first, last = first[other], last[other]
        keep = last - first >= min_words
        first, last = first[keep], last[keep]
        found.append((row[first], np.full(len(first), kind), first, last, start[first] - off[row[first]], _digest(hashes, first, last, 1), _digest(hashes, first, last, 2)))
    return dict(zip(("row", "kind", "first", "last", "start", "d1", "d2"), map(np.concatenate, zip(*found, strict=True)), strict=True))


def _covered(n: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which of n words lie in any span [first, last)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, last, -1)
    return np.cumsum(step[:n]) > 0


def _runs(of: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans [first, last) of consecutive true words in a row."""
    at = np.flatnonzero(of)
    if not len(at):
        return at, at
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])
    first = at[new]
    return first, at[np.append(np.flatnonzero(new)[1:], len(at)) - 1] + 1


def repeated_pieces(row: np.ndarray, u: dict[str, np.ndarray], again: np.ndarray, own: np.ndarray, min_run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, the one behind the last, and the widest unit over the first word, of every piece to remove.

    ``row`` is each word's; ``again`` marks units that occurred before, ``own`` those that are the first of several.
    """
    n = len(row)
    repeated = _covered(n, u["first"][again], u["last"][again])
    first, last = _runs(repeated, row)
    long = last - first >= min_run
    gone = _covered(n, first[long], last[long]) & ~_covered(n, u["first"][own], u["last"][own])
    first, last = _runs(gone, row)
    over = np.full(n, -1, np.int64)
    for kind in (STRETCH, SENTENCE, LINE):  # the widest kind is written last
        k = np.flatnonzero(again & (u["kind"] == kind))
        size = u["last"][k] - u["first"][k]
        over[np.repeat(u["first"][k], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = np.repeat(k, size)
    return first, last, over[first]


def repeated_units(docs: DataFrame, min_words: int = MIN_WORDS, with_text: bool = False, min_run: int = MIN_RUN) -> DataFrame:
    """One row a removed piece: doc_id, start and end (characters in the original text, end excluded), words, and of the widest repeated unit over its first word the kind and where its first occurrence is.

    ``with_text`` returns instead one row a document: doc_id, text without the
    removed pieces, and ``removed``, their list.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "units")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def ids_of(b: pa.RecordBatch) -> np.ndarray:
        return b.column("doc_id").fill_null(_NONE).to_numpy()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            u = units(*utf8(b.column("text")), min_words)
            ids = ids_of(b)[u["row"]]
            order = np.lexsort((u["start"], ids, u["d2"], u["d1"]))
            d1, d2 = u["d1"][order], u["d2"][order]
            new = np.ones(len(order), bool)
            new[1:] = (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])
            at = np.flatnonzero(new)
            yield pa.RecordBatch.from_pydict({"d1": d1[at].view(np.int64), "d2": d2[at].view(np.int64), "doc": ids[order][at], "start": u["start"][order][at], "n": np.diff(np.append(at, len(order))).astype(np.int64)})

    seen = texts.mapInArrow(scan, "d1 long, d2 long, doc long, start long, n long")
    groups = seen.groupBy("d1", "d2").agg(F.min(F.struct("doc", "start")).alias("first"), F.sum("n").alias("n")).where("n > 1")
    # The store's key is d1; two groups that share it (none expected below 2^32 units) keep the earlier's entry and d2 tells them apart.
    firsts = scratch.table(groups.groupBy("d1").agg(F.min(F.struct("first", "d2")).alias("m")).select("d1", "m.d2", "m.first.doc", "m.first.start"), "firsts")
    uri = scratch.path("store")
    store = build(firsts, "d1", uri)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            data, off = utf8(b.column("text"))
            begin, end, of = words(data, off)
            u = units(data, off, min_words)
            ids = ids_of(b)
            hit, got = store.open().lookup(u["d1"])
            hit &= got["d2"] == u["d2"].view(np.int64)
            own = hit & (got["doc"] == ids[u["row"]]) & (got["start"] == u["start"])
            first, last, unit = repeated_pieces(of, u, hit & ~own, own, min_run)
            row = of[first]
            runes = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            kept = got["doc"][unit]
            spans = {
                "doc_id": pa.array(ids[row], mask=ids[row] == _NONE),
                "start": runes[begin[first]] - runes[off[row]],
                "end": runes[end[last - 1]] - runes[off[row]],
                "words": last - first,
                "kind": pa.array(KINDS[u["kind"][unit]], pa.string()),
                "kept_doc_id": pa.array(kept, mask=kept == _NONE),
                "kept_start_byte": got["start"][unit].astype(np.int64),
            }
            if not with_text:
                yield pa.RecordBatch.from_pydict(spans)
                continue
            at = row_bounds(row, b.num_rows)
            raw, out = data.tobytes(), []
            for r in range(b.num_rows):
                left, stay = int(off[r]), []
                for k in range(at[r], at[r + 1]):
                    stay.append(raw[left : begin[first[k]]])
                    left = int(end[last[k] - 1])
                out.append(b"".join([*stay, raw[left : off[r + 1]]]).decode())
            names = [k for k in spans if k != "doc_id"]
            cells = pa.StructArray.from_arrays([pa.array(spans[k]) for k in names], names)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), cells)], ["doc_id", "text", "removed"])

    span = "start long, end long, words long, kind string, kept_doc_id long, kept_start_byte long"
    if with_text:
        return texts.mapInArrow(remove, "doc_id long, text string, removed array<struct<" + span.replace(" ", ":").replace(",:", ",") + ">>")
    return texts.mapInArrow(remove, "doc_id long, " + span)
