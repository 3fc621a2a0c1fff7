"""Byte-level BPE encoding and decoding with a public vocabulary file.

Texts are cut into words by character class with numpy. A block's distinct words
are merged once, and a worker remembers what it merged. A short word is a row of
two contiguous arrays, its parts and the ranks of adjacent parts: the least rank
is searched again and again, its boundary deleted, and the ranks beside it taken
anew, for all rows of one length class at once. A long word would make that
quadratic; there, all places of the least rank are merged in one round, and the
rounds follow the ranks upwards (a merge only makes pairs of higher rank, which is
checked when the file is read).

Decoding joins the bytes of the ids; bytes that aren't UTF-8 become U+FFFD.

Defined results: a null or empty text has no ids, no ids (or null) are the empty
text; strings of the vocabulary's special tokens in a text are their ids; ids that
the vocabulary lacks, and null ids, are passed over in decoding; repeated rows
each give a row; very long texts and words are encoded whole; an empty table gives
no rows. Columns named in ``keep`` come along, others are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.textkit import blocks, release, utf8, word_hashes

#: Bytes of a word that is merged as a row of ranks, rows merged at once, and words that a worker remembers.
SHORT, ROWS, REMEMBERED = 64, 4096, 1 << 16
#: Merges a vocabulary may hold: it is sent to every executor.
MOST_MERGES = 1 << 21
NONE = np.iinfo(np.int32).max
OTHER, LETTER, NUMBER, SPACE = range(4)

# Letters and numbers that came after Unicode 16.0, to which the tokenizers library keeps; there they are other characters.
YOUNGER = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4),
    (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6),
    (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4),
    (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]
# Endings that are words of their own behind an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@cache
def classes() -> np.ndarray:
    """Class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            # The string lacks the surrogates.
            lo, hi = (x if x < 0xD800 else x + 0x800 for x in m.span())
            out[lo:hi] = kind
    for lo, hi in YOUNGER:
        out[lo : hi + 1] = OTHER
    return out


def code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points of the characters that begin at ``at``."""
    cp = data[at].astype(np.int32)
    many = np.flatnonzero(cp >= 0x80)
    if len(many):
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        head, where = cp[many], at[many]
        after = [padded[where + k].astype(np.int32) & 0x3F for k in (1, 2, 3)]
        two = (head & 0x1F) << 6 | after[0]
        three = (head & 0x0F) << 12 | after[0] << 6 | after[1]
        four = (head & 0x07) << 18 | after[0] << 12 | after[1] << 6 | after[2]
        cp[many] = np.minimum(np.where(head < 0xE0, two, np.where(head < 0xF0, three, four)), 0x10FFFF)
    return cp


def word_starts(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where words begin: runs of one class, a single space in front joined to them, white space before it apart, endings behind an apostrophe apart. No word crosses ``edges`` (sorted offsets, both ends included)."""
    if not len(data):
        return np.zeros(0, np.int64)
    lead = (data & 0xC0) != 0x80
    inner = edges[edges < len(data)]
    lead[inner] = True
    at = np.flatnonzero(lead)
    n = len(at)
    cp = code_points(data, at)
    kind = classes()[cp]
    first = np.zeros(n + 3, bool)
    first[np.searchsorted(at, inner)] = True
    first[n:] = True
    run = first[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()
    after = np.flatnonzero(run[1:] & ~first[1:n] & (kind[:-1] == SPACE)) + 1
    start[after - 1] = True
    start[after[cp[after - 1] == 32]] = False
    quote = np.flatnonzero(run & start & (cp == 39))
    cp = np.concatenate([cp, np.zeros(2, cp.dtype)])
    for ending in ENDINGS:
        hit = quote
        for k, letter in enumerate(ending, 1):
            hit = hit[~first[hit + k] & (cp[hit + k] == ord(letter))]
        start[hit + 1] = False
        behind = hit + len(ending) + 1
        start[behind[behind < n]] = True
    return at[start]


def byte_letters() -> dict[str, int]:
    """The letters by which vocabulary files write bytes: printable ones as themselves, the others from U+0100 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclass(frozen=True)
class Vocabulary:
    """Merges and bytes of a byte-level vocabulary: ``pairs`` sorted, with each pair's rank; the id a rank makes; every id's bytes."""

    pairs: np.ndarray
    pair_ranks: np.ndarray
    made: np.ndarray
    of_byte: np.ndarray
    ends: np.ndarray
    blob: np.ndarray
    known: np.ndarray
    special: dict[bytes, int]
    _memory: dict[bytes, tuple[int, ...]] = field(default_factory=dict, compare=False, repr=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_memory": {}}

    @property
    def size(self) -> int:
        return len(self.ends) - 1

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NONE where the file has no such merge."""
        key = a.astype(np.int64) * self.size + b
        if not len(self.pairs):
            return np.full(key.shape, NONE, np.int32)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_ranks[at], NONE)

    def merge_rows(self, words: Sequence[bytes]) -> list[tuple[int, ...]]:
        """Ids of short words: rows of parts and of the ranks of adjacent parts."""
        width = max(map(len, words))
        parts = np.zeros((len(words), width + 1), np.int32)
        left = np.array([len(w) for w in words])
        inside = np.arange(width + 1) < left[:, None]
        parts[inside] = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        ranks = np.full((len(words), width + 1), NONE, np.int32)
        ranks[:, :-1] = np.where(inside[:, 1:], self.ranks(parts[:, :-1], parts[:, 1:]), NONE)
        row, column, out = np.arange(len(words)), np.arange(width + 1), [()] * len(words)
        while len(row):
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(row)), at]
            done = least == NONE
            for i, ids, n in zip(row[done].tolist(), parts[done].tolist(), left[done].tolist(), strict=True):
                out[i] = tuple(ids[:n])
            row, parts, ranks, left, at, least = (x[~done] for x in (row, parts, ranks, left, at, least))
            if not len(row):
                break
            every = np.arange(len(row))
            # The boundary behind the least rank goes: what is right of it moves up by one.
            shift = np.minimum(column + (column > at[:, None]), width)
            parts, ranks = np.take_along_axis(parts, shift, 1), np.take_along_axis(ranks, shift, 1)
            left = left - 1
            parts[every, at] = self.made[least]
            ranks[every, at] = np.where(at + 1 < left, self.ranks(parts[every, at], parts[every, np.minimum(at + 1, width)]), NONE)
            inner = np.flatnonzero(at > 0)
            ranks[inner, at[inner] - 1] = self.ranks(parts[inner, at[inner] - 1], parts[inner, at[inner]])
        return out

    def merge_long(self, word: bytes) -> np.ndarray:
        """Ids of a long word: rank after rank, all places of one rank at once, from the left where they overlap."""
        n = len(word)
        ids = np.append(self.of_byte[np.frombuffer(word, np.uint8)], 0).astype(np.int32)
        after, before, alive = np.arange(1, n + 2), np.arange(-1, n), np.ones(n, bool)
        rank = np.full(n + 1, NONE, np.int32)
        rank[: n - 1] = self.ranks(ids[: n - 1], ids[1:n])
        places: dict[int, list[np.ndarray]] = defaultdict(list)
        queue: list[int] = []

        def note(at: np.ndarray) -> None:
            at = at[rank[at] != NONE]
            at = at[np.argsort(rank[at], kind="stable")]
            cut = np.flatnonzero(np.diff(rank[at])) + 1
            for some in np.split(at, cut) if len(at) else []:
                r = int(rank[some[0]])
                if r not in places:
                    heapq.heappush(queue, r)
                places[r].append(some)

        note(np.arange(n - 1))
        while queue:
            r = heapq.heappop(queue)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            chained = np.concatenate([[False], after[at[:-1]] == at[1:]])
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(chained, 0, place))) % 2 == 0]
            gone = after[at]
            ids[at], rank[gone], alive[gone] = self.made[r], NONE, False
            after[at] = after[gone]
            before[after[at]] = at
            beside = before[at]
            anew = np.unique(np.concatenate([at, beside[beside >= 0]]))
            follows = after[anew]
            rank[anew] = np.where(follows < n, self.ranks(ids[anew], ids[np.minimum(follows, n)]), NONE)
            note(anew)
        return ids[:n][alive]

    def encode_words(self, words: list[bytes]) -> list[tuple[int, ...] | np.ndarray]:
        """Ids of distinct words; short ones are remembered."""
        memory = self._memory
        if len(memory) > REMEMBERED:
            memory.clear()
        out = list(map(memory.get, words))
        new: dict[int, list[int]] = defaultdict(list)
        for i, found in enumerate(out):
            if found is None:
                if len(words[i]) > SHORT:
                    out[i] = self.merge_long(words[i])
                else:
                    new[max(4, 1 << (len(words[i]) - 1).bit_length())].append(i)
        for places in new.values():
            for lo in range(0, len(places), ROWS):
                some = places[lo : lo + ROWS]
                for i, ids in zip(some, self.merge_rows([words[i] for i in some]), strict=True):
                    out[i] = memory[words[i]] = ids
        return out

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one behind the other, and each row's bounds in them."""
        edges, special = off, {}
        raw = data.tobytes()
        if self.special:
            # At one place the longest counts.
            pattern = re.compile(b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))
            if pattern.search(raw):
                special = {a + m.start(): (self.special[m.group()], a + m.end()) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True) for m in pattern.finditer(raw[a:b])}
                edges = np.unique(np.concatenate([off, np.array([x for a, (_, b) in special.items() for x in (a, b)], np.int64)]))
        start = word_starts(data, edges)
        if special:  # nothing but its own beginning starts within a special token
            at = np.array(sorted(special), np.int64)
            stop = np.array([special[a][1] for a in at.tolist()], np.int64)
            inside = np.searchsorted(at, start, side="left") - 1
            start = start[(inside < 0) | (start >= stop[np.maximum(inside, 0)])]
        end = np.append(start[1:], len(data)) if len(start) else start
        which, first = same_words(data, start, end)
        words = [raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        ids = self.encode_words(words)
        count = np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(count.sum()))
        if special:  # a row of its own behind the others for each special id
            at = np.searchsorted(start, np.array(list(special), np.int64))
            count = np.append(count, np.ones(len(special), np.int64))
            flat = np.append(flat, np.array([i for i, _ in special.values()], np.int32))
            which[at] = len(words) + np.arange(len(special))
        begin = np.cumsum(count) - count
        of_word = count[which]
        bounds = np.append(0, np.cumsum(of_word))
        place = np.arange(bounds[-1]) + np.repeat(begin[which] - bounds[:-1], of_word)
        return flat[place], bounds[np.searchsorted(start, off)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of ids, and each id's bounds in them; unknown ids have none."""
        real = (ids >= 0) & (ids < self.size)
        real[real] = self.known[ids[real]]
        at = np.where(real, ids, 0)
        length = np.where(real, self.ends[at + 1] - self.ends[at], 0)
        bounds = np.append(0, np.cumsum(length))
        return self.blob[np.arange(bounds[-1]) + np.repeat(self.ends[at] - bounds[:-1], length)], bounds


def same_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each word among the distinct ones, and where each of those is first. Words are sorted by hash and then compared byte by byte."""
    _, first, which = np.unique(word_hashes(data, start, end, fold=False), return_index=True, return_inverse=True)
    length = end - start
    of = first[which]
    if (length == length[of]).all():
        cut = np.cumsum(length) - length
        if (data[np.repeat(start[of] - cut, length) + np.arange(int(length.sum()))] == data[np.repeat(start - cut, length) + np.arange(int(length.sum()))]).all():
            return which, first
    raw, seen = data.tobytes(), {}  # two words of one hash
    which = np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(start.tolist(), end.tolist(), strict=True)])
    return which, np.unique(which, return_index=True)[1]


def read_vocabulary(path: str) -> Vocabulary:
    """A byte-level BPE file of the tokenizers library; other kinds are refused."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, before = file["model"], file.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and (file.get("decoder") or {}).get("type") == "ByteLevel"
    added = file.get("added_tokens") or []
    if not (plain and level) or file.get("normalizer") or any(a[k] for a in added for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"{path} isn't a plain byte-level BPE vocabulary")
    vocabulary, letters = model["vocab"], byte_letters()
    if len(model["merges"]) > MOST_MERGES:
        raise ValueError(f"{path} has more than {MOST_MERGES} merges")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    size = max([*vocabulary.values(), *(a["id"] for a in added)]) + 1
    made = np.array([vocabulary[a + b] for a, b in merges], np.int32)
    pairs = np.array([vocabulary[a] * size + vocabulary[b] for a, b in merges], np.int64)
    by = {int(t): r for r, t in reversed(list(enumerate(made)))}
    if any(by.get(vocabulary[x], -1) >= r for r, m in enumerate(merges) for x in m):
        raise ValueError(f"{path} merges a part before it is made")
    of_id = {i: bytes(letters[c] for c in t) for t, i in vocabulary.items()}
    of_id |= {a["id"]: bytes(letters[c] for c in a["content"]) if all(c in letters for c in a["content"]) else a["content"].encode() for a in added}
    ends = np.append(0, np.cumsum([len(of_id.get(i, b"")) for i in range(size)]))
    order = np.argsort(pairs, kind="stable")
    return Vocabulary(
        pairs[order], order.astype(np.int32), made, np.array([vocabulary[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int32), ends,
        np.frombuffer(b"".join(of_id.get(i, b"") for i in range(size)), np.uint8), np.array([i in of_id for i in range(size)]), {a["content"].encode(): a["id"] for a in added},
    )


def shared(spark: SparkSession, path: str) -> Broadcast[Vocabulary]:
    """A file's vocabulary, read by the driver and sent to each executor once; MOST_MERGES bounds its size."""
    return spark.sparkContext.broadcast(read_vocabulary(path))


def encode_texts(texts: DataFrame, vocabulary: Broadcast[Vocabulary], text: str = "text", keep: Sequence[str] = ("doc_id",), packed: bool = False) -> DataFrame:
    """``keep`` and ``ids`` of every row: an array of int, or if ``packed`` the ids as little-endian 32-bit numbers in one binary value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "_text"):
            ids, bounds = vocabulary.value.encode(*utf8(b.column("_text")))
            if packed:
                column = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer((bounds * 4).astype("<i4")), pa.py_buffer(ids.astype("<u4"))])
            else:
                column = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], column], names=out.names)

    rows = texts.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"), *keep)
    out = texts.select(*keep, F.lit(None).cast("binary" if packed else "array<int>").alias("ids")).schema
    return rows.mapInArrow(run, out)


def decode_ids(encoded: DataFrame, vocabulary: Broadcast[Vocabulary], ids: str = "ids", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``text`` of every row's ids, which are an array or packed."""
    packed = encoded.schema[ids].dataType.simpleString() == "binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks([batch], "_ids") if packed else [batch]:
                lists = b.column(0)
                if packed:
                    raw, at = utf8(lists)
                    numbers, at = np.frombuffer(raw.tobytes(), "<i4"), at // 4
                else:
                    numbers = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
                    at = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
                data, bounds = vocabulary.value.decode(numbers)
                raw, cut = data.tobytes(), bounds[at].tolist()
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([raw[x:y].decode("utf-8", "replace") for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.string())], names=out.names)
        release()

    none = F.lit(b"") if packed else F.array().cast("array<int>")
    rows = encoded.select(F.coalesce(F.col(ids) if packed else F.col(ids).cast("array<int>"), none).alias("_ids"), *keep)
    out = encoded.select(*keep, F.lit(None).cast("string").alias("text")).schema
    return rows.mapInArrow(run, out)
