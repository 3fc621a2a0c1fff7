"""Source trees as a Python data source.

The driver lists folders from the root down, without entering skipped ones, until
the tree ends or MOST_LISTED entries are seen; what was found is cut into
partitions by bytes. Tasks list the rest: folders not yet entered in groups, and a
folder with more entries than the driver may see in shares by name. Nothing below a
skipped folder is listed, and no file that the filters exclude is opened. Filters on
``path`` and ``length`` are pushed and count before a file is opened; a prefix of
``path`` also prunes folders. ``read_tree`` only lists with it: the files found are
dealt by path before they are read, so that no task reads a whole folder.

Options: ``path`` (the root), ``scan`` (``source``: source suffixes; ``repository``:
manifests, environment examples, infrastructure and workflows too; ``all``),
``content`` (``false``: only path and length, nothing is opened).
"""

from __future__ import annotations

import os
import re
import stat
import uuid
import zlib
from collections import deque
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith

from tessera.functions.paths import CI, INFRA, MANIFEST, SKIP_DIRS, SOURCE_SUFFIXES

#: Entries the driver lists, and the bytes and files of a partition.
MOST_LISTED, PART_BYTES, PART_FILES = 200_000, 64 << 20, 5000
#: Folders that a task lists, and the tasks among which few folders or one large folder are shared.
PART_FOLDERS, SHARES = 1000, 64
#: Bytes of text in a batch of rows.
BATCH_BYTES = 4 << 20


@dataclass
class Slice(InputPartition):
    """Files to read (path, length), and folders whose files the task finds itself; of what these folders hold, share k of n by name."""

    files: tuple[tuple[str, int], ...] = ()
    folders: tuple[str, ...] = ()
    share: tuple[int, int] = (0, 1)

    def __post_init__(self) -> None:
        super().__init__(None)


def kept_folder(path: str, scan: str) -> bool:
    """Whether files below a folder can be rows."""
    if scan == "all":
        return True
    parts = path.replace("\\", "/").split("/")
    return not any(p in SKIP_DIRS for p in parts) and (scan == "source" or parts[:2] != ["data", "clones"])


def kept_file(path: str, scan: str) -> bool:
    """Whether a file outside skipped folders is a row."""
    if scan == "all" or path.endswith(SOURCE_SUFFIXES):
        return True
    plain = path.replace("\\", "/")
    low = plain.lower()
    return scan == "repository" and bool(re.search(MANIFEST, plain.rsplit("/", 1)[-1]) or re.search(INFRA, re.sub(r"^[./]+", "", low)) or re.search(CI, low))


class Folder:
    """Listing and reading below a root, on a local or mounted folder or a store that Arrow opens. Links to folders aren't followed."""

    def __init__(self, root: str) -> None:
        self.local = "://" not in root and not root.startswith("file:")
        if self.local:
            self.system, self.root = fs.LocalFileSystem(), root.rstrip("/") or "/"
        else:
            self.system, self.root = fs.FileSystem.from_uri(root if "://" in root else "file://" + root.removeprefix("file:"))
            self.root = self.root.rstrip("/") or "/"
            self.local = isinstance(self.system, fs.LocalFileSystem)

    def place(self, path: str) -> str:
        return f"{self.root}/{path}" if path else self.root

    def entries(self, path: str, share: tuple[int, int] = (0, 1)) -> Iterator[tuple[str, bool, int]]:
        """(path, is a folder, length) of a share by name of what a folder holds, in no order."""
        lead = path + "/" if path else ""
        k, n = share
        if self.local:
            with os.scandir(self.place(path)) as found:
                for e in found:
                    if zlib.crc32(os.fsencode(e.name)) % n != k:
                        continue
                    if e.is_dir(follow_symlinks=False):
                        yield lead + e.name, True, 0
                    else:
                        try:
                            info = e.stat()
                        except OSError:  # a link to nothing
                            continue
                        if stat.S_ISREG(info.st_mode):
                            yield lead + e.name, False, info.st_size
            return
        for e in self.system.get_file_info(fs.FileSelector(self.place(path))):
            if e.type in (fs.FileType.Directory, fs.FileType.File) and zlib.crc32(os.fsencode(e.base_name)) % n == k:
                yield lead + e.base_name, e.type == fs.FileType.Directory, e.size or 0

    def read(self, path: str) -> bytes:
        with self.system.open_input_stream(self.place(path)) as f:
            return f.read()


def opens(root: str) -> bool:
    """Whether Arrow can open the root's file system."""
    try:
        Folder(root)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.scan, self.content = options["path"], options.get("scan", "source"), options.get("content", "true").lower() != "false"
        if self.scan not in ("source", "repository", "all"):
            raise ValueError(f"scan {self.scan!r} isn't source, repository or all")
        self.pushed: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            named = getattr(f, "attribute", ())
            if (named == ("path",) and isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith, StringContains))) or (named == ("length",) and isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual))):
                self.pushed.append(f)
            else:
                yield f

    def _passes(self, path: str, length: int) -> bool:
        for f in self.pushed:
            x = path if f.attribute == ("path",) else length
            ok = (
                x == f.value if isinstance(f, EqualTo)
                else x in f.value if isinstance(f, In)
                else x.startswith(f.value) if isinstance(f, StringStartsWith)
                else x.endswith(f.value) if isinstance(f, StringEndsWith)
                else f.value in x if isinstance(f, StringContains)
                else x > f.value if isinstance(f, GreaterThan)
                else x >= f.value if isinstance(f, GreaterThanOrEqual)
                else x < f.value if isinstance(f, LessThan)
                else x <= f.value
            )
            if not ok:
                return False
        return True

    def _enters(self, folder: str) -> bool:
        """A folder whose files may pass."""
        lead = folder + "/"
        for f in self.pushed:
            if f.attribute != ("path",):
                continue
            wanted = f.value if isinstance(f, In) else [f.value] if isinstance(f, (EqualTo, StringStartsWith)) else None
            if wanted is not None and not any(w.startswith(lead) or (isinstance(f, StringStartsWith) and lead.startswith(w)) for w in wanted):
                return False
        return kept_folder(folder, self.scan)

    def _kept(self, found: Iterable[tuple[str, bool, int]], folders: deque[str]) -> Iterator[tuple[str, int]]:
        """The files among entries that are rows; folders to enter go to ``folders``."""
        for path, is_folder, length in found:
            if is_folder:
                if self._enters(path):
                    folders.append(path)
            elif kept_file(path, self.scan) and self._passes(path, length):
                yield path, length

    def _below(self, tree: Folder, part: Slice) -> Iterator[tuple[str, int]]:
        """All files of a partition's folders."""
        inner: deque[str] = deque()
        for folder in part.folders:
            yield from self._kept(tree.entries(folder, part.share), inner)
            while inner:
                yield from self._kept(tree.entries(inner.pop()), inner)

    def partitions(self) -> Sequence[InputPartition]:
        tree, queue, out, held, size, left = Folder(self.root), deque([""]), [], [], 0, MOST_LISTED
        while queue and left > 0:
            folder = queue.popleft()
            found = list(islice(tree.entries(folder), left + 1))
            if len(found) > left:
                out += [Slice(folders=(folder,), share=(k, SHARES)) for k in range(SHARES)]
                break
            left -= len(found)
            for path, length in self._kept(found, queue):
                held.append((path, length))
                size += length if self.content else 0
                if size >= PART_BYTES or len(held) >= PART_FILES:
                    out.append(Slice(files=tuple(held)))
                    held, size = [], 0
        if held:
            out.append(Slice(files=tuple(held)))
        rest = tuple(queue)
        groups = max(min(len(rest), SHARES), -(-len(rest) // PART_FOLDERS))
        return [*out, *(Slice(folders=rest[k::groups]) for k in range(groups))] or [Slice()]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        tree = Folder(self.root)
        rows: list[tuple[str, int, str]] = []
        size = 0

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            types = [pa.string(), pa.int64(), pa.string()][: 3 if self.content else 2]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names=["path", "length", "text"][: len(types)])

        for path, length in partition.files or self._below(tree, partition):
            text = tree.read(path).decode("utf-8", "replace") if self.content else ""
            rows.append((path, length, text))
            size += length if self.content else 64
            if size >= BATCH_BYTES:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, length long" + ("" if self.options.get("content", "true").lower() == "false" else ", text string")

    def reader(self, schema) -> TreeReader:  # noqa: ANN001
        return TreeReader(dict(self.options))


def read_tree(spark: SparkSession, root: str, scan: str = "source", content: bool = True) -> DataFrame:
    """(path, length, text) of a tree's files; without ``content`` (path, length) only. The session's pushdown to Python sources, which this source needs, is turned on.

    Files are dealt by path over the session's shuffle partitions before they are read.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)
    listed = spark.read.format("source_tree").option("scan", scan).option("content", "false").load(root)
    if not content:
        return listed

    @F.arrow_udf("array<string>")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tree = Folder(root)
        for b in batches:
            rows, size = [], 0
            for path in b.to_pylist():
                body = tree.read(path)
                rows.append([body.decode("utf-8", "replace")])
                size += len(body)
                if size >= BATCH_BYTES:
                    yield pa.array(rows, pa.list_(pa.string()))
                    rows, size = [], 0
            if rows:
                yield pa.array(rows, pa.list_(pa.string()))

    dealt = listed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    # Exploded, since a filter on the text of a plain call would read each file twice; filters on path and length still pass below.
    return dealt.select("path", "length", F.explode(texts("path")).alias("text"))


def write_tree(files: DataFrame, root: str) -> int:
    """Write rows (path, text) as files below ``root``, each under another name first; the number of files. Rows of one path: the last writer's text stays, whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, n = Folder(root), 0
        for b in batches:
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                place = tree.place(path)
                tree.system.create_dir(os.path.dirname(place), recursive=True)
                draft = f"{place}.{uuid.uuid4().hex}"
                with tree.system.open_output_stream(draft) as f:
                    f.write((text or "").encode())
                tree.system.move(draft, place)
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return files.select("path", "text").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
