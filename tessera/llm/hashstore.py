"""Sorted hash arrays in the shared folder, memory-mapped by workers.

A store is cut by key range into parts. Each part is one file of a sorted ``uint64``
key array and one value array a column. Parts are written by Spark tasks under a
temporary name and renamed, so a repeated task leaves the same file. On a local
or mounted folder workers map the files; elsewhere they read a file when it is
needed and keep what was used last, up to a fixed number of bytes.
"""

from __future__ import annotations

import json
import math
import mmap
import os
import struct
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OPEN: dict[str, HashStore] = {}
#: Keys of a part, which one task sorts and writes.
PART_ROWS = 4_000_000
#: Arrays of a file begin at multiples of this; seconds after which an unused file is closed.
ALIGN, IDLE = 64, 30.0


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Part of each key by its top 24 bits; parts follow key order."""
    return ((keys >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def save(uri: str, **arrays: np.ndarray) -> None:
    """Write arrays one behind the other as one file, then give it its name: their number, then of each its name, type and length, then their bytes."""
    system, path = _place(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    head = json.dumps([(k, v.dtype.str, v.shape) for k, v in arrays.items()]).encode()
    head = struct.pack("<q", len(head)) + head
    temporary = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(temporary) as out:
        out.write(head.ljust(-(-len(head) // ALIGN) * ALIGN, b"\0"))
        for v in arrays.values():
            out.write(np.ascontiguousarray(v).data.cast("B") if v.size else b"")
            out.write(b"\0" * (-v.nbytes % ALIGN))
    try:
        system.move(temporary, path)
    except OSError:  # a copy of this task was first, with the same bytes
        if system.get_file_info(path).type == fs.FileType.NotFound:
            raise
        system.delete_file(temporary)


def load(uri: str) -> Arrays | None:
    """A written file's arrays, mapped where the folder is mounted; None if there is none."""
    system, path = _place(uri)
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return None
    if mapped := isinstance(system, fs.LocalFileSystem):
        with open(path, "rb") as f:
            raw = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    else:
        with system.open_input_file(path) as f:
            raw = f.read()
    (size,) = struct.unpack_from("<q", raw)
    at, out = -(-(8 + size) // ALIGN) * ALIGN, {}
    for name, kind, shape in json.loads(raw[8 : 8 + size]):
        count = math.prod(shape)
        out[name] = np.frombuffer(raw, kind, count, at).reshape(shape)
        at += -(-out[name].nbytes // ALIGN) * ALIGN
    return Arrays(out, 0 if mapped else len(raw))


@dataclass(frozen=True)
class Arrays:
    """A file's arrays by name, and the bytes they hold in memory of their own."""

    by_name: dict[str, np.ndarray]
    held: int

    def __getitem__(self, name: str) -> np.ndarray:
        return self.by_name[name]


class Recent:
    """Files a worker has opened. Those not used for IDLE seconds go when another is opened, and the least recently used go beyond ``files``, or ``most`` bytes of what isn't mapped."""

    def __init__(self, most: int = 256 << 20, files: int = 2048) -> None:
        self.most, self.files, self.held = most, files, 0
        self._have: OrderedDict[str, Arrays | None] = OrderedDict()
        self._used: dict[str, float] = {}

    def get(self, uri: str) -> Arrays | None:
        now = time.monotonic()
        if uri in self._have:
            self._have.move_to_end(uri)
            self._used[uri] = now
            return self._have[uri]
        found = self._have[uri] = load(uri)
        self._used[uri] = now
        self.held += found.held if found else 0
        while len(self._have) > 1 and (self.held > self.most or len(self._have) > self.files or now - self._used[next(iter(self._have))] > IDLE):
            name, gone = self._have.popitem(last=False)
            del self._used[name]
            self.held -= gone.held if gone else 0
        return found


_ARRAYS = Recent()


class HashStore:
    """Reader of a store; opening costs nothing until a part is asked for."""

    def __init__(self, uri: str, parts: int, columns: tuple[str, ...] = ()) -> None:
        self.uri, self.parts, self.columns = uri, parts, columns

    @staticmethod
    def opened(uri: str, parts: int, columns: tuple[str, ...] = ()) -> HashStore:
        """The worker's one reader of this store."""
        if uri not in _OPEN:
            _OPEN[uri] = HashStore(uri, parts, columns)
        return _OPEN[uri]

    def lookup(self, keys: np.ndarray, route: np.ndarray | None = None) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Whether each key is there, and its values (zero if not). Queries go part by part in key order, each distinct key once.

        ``route`` is what a key's part goes by, where that isn't the key itself.
        """
        distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
        part = part_of(distinct if route is None else route[first], self.parts)
        if route is not None:
            order = np.argsort(part.astype(np.int16 if self.parts < 1 << 15 else np.int64), kind="stable")
            distinct, part = distinct[order], part[order]
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            back = place[back]
        found = np.zeros(len(distinct), bool)
        values = {c: np.zeros(len(distinct), np.int64) for c in self.columns}
        cut = np.searchsorted(part, np.arange(self.parts + 1))
        for p in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
            part_arrays = _ARRAYS.get(f"{self.uri}/{p:06d}")
            if part_arrays is None or not len(part_arrays["key"]):
                continue
            have = part_arrays["key"]
            ask = distinct[cut[p] : cut[p + 1]]
            at = np.minimum(np.searchsorted(have, ask), len(have) - 1)
            hit = np.asarray(have[at]) == ask
            found[cut[p] : cut[p + 1]] = hit
            for c in self.columns:
                values[c][cut[p] : cut[p + 1]][hit] = part_arrays[c][at[hit]]
        return found[back], {c: v[back] for c, v in values.items()}


def write_part(uri: str, p: int, keys: np.ndarray, values: dict[str, np.ndarray]) -> None:
    """Write a part's arrays in key order; keys must be distinct."""
    order = np.argsort(keys)
    save(f"{uri}/{p:06d}", key=keys[order], **{c: v[order] for c, v in values.items()})


@dataclass(frozen=True)
class Stored:
    """Where a store is; small, so it travels with a task."""

    uri: str
    parts: int
    columns: tuple[str, ...]
    rows: int

    def open(self) -> HashStore:
        return HashStore.opened(self.uri, self.parts, self.columns)


def build(df: DataFrame, key: str, uri: str) -> Stored:
    """Store ``df`` (a written table of distinct long keys and numeric columns) under ``uri``, in parts of some PART_ROWS keys."""
    columns = tuple(c for c in df.columns if c != key)
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(df.count() / PART_ROWS))
    part = F.shiftright(F.shiftrightunsigned(F.col(key), 40) * F.lit(parts), 24).cast("int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now, rows = -1, 0

        def flush() -> None:
            if held:
                t = pa.Table.from_batches(held)
                write_part(uri, now, t[key].to_numpy().view(np.uint64), {c: t[c].to_numpy() for c in columns})
                held.clear()

        for batch in batches:
            ids = batch.column("_part").to_numpy()
            edges = np.flatnonzero(np.diff(ids)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(ids)], strict=True):
                if hi > lo:
                    if ids[lo] != now:
                        flush()
                        now = int(ids[lo])
                    held.append(batch.slice(lo, hi - lo))
            rows += len(ids)
        flush()
        yield pa.RecordBatch.from_pydict({"n": pa.array([rows], pa.int64())})

    dealt = df.withColumn("_part", part).repartition(parts, "_part").sortWithinPartitions("_part")
    return Stored(uri, parts, columns, dealt.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
