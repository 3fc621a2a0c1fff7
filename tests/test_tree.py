import os
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringEndsWith, StringStartsWith

from tessera.functions import paths
from tessera.sources import tables, tree

NAMES = ["a/x.py", "a/__init__.py", "a/_private.ts", "a/node_modules/y.js", "a/node_modules/z/w.py", "a/b/dist/q.py", "package.json", "a/package-lock.json", "notes.txt", ".github/workflows/ci.yml", ".env.example",
         "deploy/app.yaml", "docker-compose.yml", "Dockerfile.dev", "data/clones/r/x.py", "data/other/x.py", "src/pyproject.toml", ".hidden/k.py", "build/out.js", "a/build.py", "go.mod", "x.PY", "vendor", "a/Ünï.py"]


@pytest.fixture
def root(tmp_path):
    for name in NAMES:
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_text(f"# {name}\n" * 3)
    (tmp_path / "t/a/bad.py").write_bytes(b"\xff\xfe\x00x")
    (tmp_path / "t/a/empty.py").write_text("")
    os.symlink(tmp_path / "t", tmp_path / "t/a/loop")
    os.symlink(tmp_path / "nowhere", tmp_path / "t/a/broken.py")
    return str(tmp_path / "t")


def plain(root, scan):
    """Every file, then the rules."""
    out = []
    for folder, _, names in os.walk(root):
        for n in names:
            rel = os.path.relpath(f"{folder}/{n}", root)
            parts = rel.split("/")
            if not os.path.isfile(f"{folder}/{n}") or any(p in paths.SKIP_DIRS for p in parts[:-1]) or (scan == "repository" and parts[:2] == ["data", "clones"]):
                continue
            more = re.search(paths.MANIFEST, n) or re.search(paths.INFRA, re.sub("^[./]+", "", rel.lower())) or re.search(paths.CI, rel.lower())
            if rel.endswith(paths.SOURCE_SUFFIXES) or (scan == "repository" and more):
                out.append((rel, os.path.getsize(f"{folder}/{n}"), Path(f"{folder}/{n}").read_bytes().decode("utf-8", "replace")))
    return sorted(out)


@pytest.mark.parametrize(("scan", "manifests"), [("source", False), ("repository", True)])
def test_rows_are_those_of_a_whole_walk(spark, root, scan, manifests):
    got = sorted(map(tuple, tables.source_files(spark, root, manifests).collect()))
    assert got == plain(root, scan) and ("a/__init__.py" in {r[0] for r in got})
    rule = paths.is_scanned if manifests else paths.is_source
    frame = spark.createDataFrame([(n,) for n in NAMES], "path string")
    assert {r[0] for r in frame.where(rule(F.col("path"))).collect()} == {r[0] for r in got} & set(NAMES)
    assert sorted(map(tuple, tables.source_files(spark, "file://" + root, manifests).collect())) == got


def test_column_rules_are_the_readers(spark):
    for scan, rule in (("source", paths.is_source), ("repository", paths.is_scanned)):
        frame = spark.createDataFrame([(n,) for n in NAMES], "path string").select("path", rule(F.col("path")).alias("kept"))
        for path, kept in frame.collect():
            folder = path.rpartition("/")[0]
            assert kept == ((not folder or tree.kept_folder(folder, scan)) and tree.kept_file(path, scan)), path


def test_skipped_folders_are_neither_listed_nor_opened(tmp_path, monkeypatch):
    """100,000 files under a skipped folder: none is opened, none is listed."""
    deep = tmp_path / "web/node_modules/pkg"
    deep.mkdir(parents=True)
    for i in range(100_000):
        os.close(os.open(deep / f"f{i}.js", os.O_CREAT))
    for i in range(20):
        (tmp_path / f"web/{i}.ts").write_text("x")
    opened, listed = [], []
    read, entries = tree.Folder.read, tree.Folder.entries
    monkeypatch.setattr(tree.Folder, "read", lambda self, path: opened.append(path) or read(self, path))
    monkeypatch.setattr(tree.Folder, "entries", lambda self, path: listed.append(path) or entries(self, path))
    reader = tree.TreeReader({"path": str(tmp_path)})
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert len(rows) == 20 and sorted(opened) == sorted(f"web/{i}.ts" for i in range(20)) and listed == ["", "web"]
    opened.clear()
    reader = tree.TreeReader({"path": str(tmp_path), "content": "false"})
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 20 and not opened


@pytest.mark.parametrize(("filters", "want"), [
    ([StringEndsWith(("path",), ".ts")], lambda p, n: p.endswith(".ts")),
    ([StringStartsWith(("path",), "a/_")], lambda p, n: p.startswith("a/_")),
    ([EqualTo(("path",), "a/x.py")], lambda p, n: p == "a/x.py"),
    ([In(("path",), ("a/x.py", "data/other/x.py", "none"))], lambda p, n: p in ("a/x.py", "data/other/x.py")),
    ([GreaterThan(("length",), 36), StringStartsWith(("path",), "data")], lambda p, n: n > 36 and p.startswith("data")),
])
def test_pushed_filters_count_before_a_file_is_opened(root, monkeypatch, filters, want):
    opened = []
    read = tree.Folder.read
    monkeypatch.setattr(tree.Folder, "read", lambda self, path: opened.append(path) or read(self, path))
    reader = tree.TreeReader({"path": root})
    assert list(reader.pushFilters(filters)) == []
    got = [r["path"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(got) == sorted(opened) == sorted(p for p, n, _ in plain(root, "source") if want(p, n))


def test_pushdown_through_spark(spark, root):
    pushed = tree.read_tree(spark, root).where("path like '%.ts' and length > 2 and upper(path) <> 'x'")
    assert [r["path"] for r in pushed.collect()] == ["a/_private.ts"]
    kept = re.findall(r"Filter .*", pushed._jdf.queryExecution().executedPlan().toString())
    assert all("upper" in x and "EndsWith" not in x for x in kept)


def test_deep_trees_are_listed_by_tasks(spark, root, monkeypatch):
    """The driver stops listing early: folders it didn't enter are partitions."""
    monkeypatch.setattr(tree, "MOST_LISTED", 3)
    reader = tree.TreeReader({"path": root, "scan": "repository"})
    parts = reader.partitions()
    assert any(p.folders for p in parts)
    monkeypatch.setattr(tree, "BATCH_BYTES", 10)
    got = [(r["path"], r["length"], r["text"]) for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(got) == plain(root, "repository")
    monkeypatch.setattr(tree, "MOST_LISTED", 200_000)
    monkeypatch.setattr(tree, "PART_FILES", 2)
    assert max(len(p.files) for p in reader.partitions()) == 2


def test_written_tree_reads_back(spark, tmp_path):
    rows = [(f"d{i % 7}/f{i}.py", f"x = {i}\n" * (i % 5)) for i in range(60)] + [("d/node_modules/a.js", "x"), ("n.py", None)]
    assert tree.write_tree(spark.createDataFrame(rows, "path string, text string").repartition(4), str(tmp_path / "o")) == 62
    got = tables.source_files(spark, str(tmp_path / "o")).collect()
    assert sorted((r["path"], r["text"]) for r in got) == sorted((p, t or "") for p, t in rows if "node_modules" not in p)
    assert tables.source_files(spark, str(tmp_path / "o/d/node_modules")).count() == 1


def test_empty_and_unknown(spark, tmp_path):
    (tmp_path / "e").mkdir()
    assert tree.read_tree(spark, str(tmp_path / "e")).count() == 0
    with pytest.raises(Exception, match="isn't source"):
        tree.read_tree(spark, str(tmp_path / "e"), "half").count()


def wide(root):
    """A tree as tree_scan's: many folders of one file beside a folder of many files."""
    for i in range(300):
        (root / f"pkg{i}").mkdir(parents=True)
        (root / f"pkg{i}/package.json").write_text("{" + " " * (i % 9) + "}")
    (root / ".github/workflows").mkdir(parents=True)
    for i in range(200):
        (root / f".github/workflows/w{i}.yml").write_text(f"on: {i}")
    return plain(str(root), "repository")


@pytest.mark.parametrize("most", [1, 40, 301, 350, 10_000])
def test_many_folders_are_few_partitions(tmp_path, monkeypatch, most):
    """Folders that the driver doesn't enter are listed in groups, a large one in shares; before, each was a partition."""
    want = wide(tmp_path / "t")
    monkeypatch.setattr(tree, "MOST_LISTED", most)
    monkeypatch.setattr(tree, "PART_FOLDERS", 100, raising=False)
    monkeypatch.setattr(tree, "SHARES", 8, raising=False)
    listed = []
    entries = tree.Folder.entries
    monkeypatch.setattr(tree.Folder, "entries", lambda self, path, *share: (listed.append(e[0]) or e for e in entries(self, path, *share)))
    reader = tree.TreeReader({"path": str(tmp_path / "t"), "scan": "repository"})
    parts = reader.partitions()
    assert len(parts) <= 9 and len(listed) <= most + 1
    assert sorted((r["path"], r["length"], r["text"]) for p in parts for b in reader.read(p) for r in b.to_pylist()) == want


def test_files_of_one_folder_are_read_by_many_tasks(spark, tmp_path):
    want = wide(tmp_path / "t")
    files = tree.read_tree(spark, str(tmp_path / "t"), "repository")
    assert sorted(tuple(r) for r in files.collect()) == want
    flows = files.where("path like '.github/%'").groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(flows) == 4 and max(r["count"] for r in flows) < 100


def test_texts_are_read_once(spark, root):
    found = tree.read_tree(spark, root).where("text like '# a/x.py%'")
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [r["path"] for r in found.collect()] == ["a/x.py"]
