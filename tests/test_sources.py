import pytest
from pyspark.sql import functions as F

from tessera.operators.incremental import merge
from tessera.plans import registry
from tessera.sources import tables
from tessera.streaming import maintenance


def test_tree_scan_and_tools(spark, tmp_path):
    (tmp_path / "a/node_modules").mkdir(parents=True)
    for name, body in {"a/x.py": "print(1)\nprint(2)", "a/node_modules/y.js": "x", "package.json": "{}", "notes.txt": "n"}.items():
        (tmp_path / name).write_text(body)
    files = tables.source_files(spark, str(tmp_path), manifests=True).cache()
    assert sorted(r["path"] for r in files.collect()) == ["a/x.py", "package.json"]
    assert [tuple(r) for r in tables.list_dir(files, ".").collect()] == [("a", True), ("package.json", False)]
    assert [r["line"] for r in tables.read_file(files, "a/x.py", 2).collect()] == [2]
    assert [r["path"] for r in tables.glob_files(files, "**/*.py").collect()] == ["a/x.py"]
    assert registry.run_tool("grep", files, r"print\(2")["result"].first()["line"] == 2
    assert registry.run_tool("nope")["ok"] is False


def test_tenant_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("o1", 1, 1), ("o2", 2, 1)], "org_id string, k int, v int")
    view = tables.TenantView("o1")
    assert view.read(df).count() == 1
    with pytest.raises(Exception, match="another tenant"):
        view.check(df).collect()
    at = tables.upsert(spark, df, str(tmp_path / "t"), ["k"], df["v"].desc(), "1")
    newer = spark.createDataFrame([("o1", 1, 5)], "org_id string, k int, v int")
    assert sorted(r["v"] for r in merge(spark.read.parquet(at), newer, ["k"], [F.desc("v")]).collect()) == [1, 5]
    bad = spark.createDataFrame([("p", False)], "slug string, ok boolean")
    assert tables.publish(df, bad, str(tmp_path / "s"), str(tmp_path / "live")) is False
    assert tables.publish(df, bad.where("ok"), str(tmp_path / "s"), str(tmp_path / "live")) is True


def test_push_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = '{"delivery_id": "1", "ref": "refs/heads/main", "repository_id": 7, "commits": [{"added": ["b", "a"], "modified": ["a"], "removed": []}], "received_at": "2024-01-01T00:00:00"}\n'
    (tmp_path / "in/x.json").write_text(line * 2)
    got = []
    q = maintenance.push_stream(spark, str(tmp_path / "in"), lambda changed, full, n: got.extend(sorted(tuple(r) for r in changed.collect())), str(tmp_path / "cp"))
    q.awaitTermination()
    assert got == [(7, "a"), (7, "b")]


def test_registered_sql_functions(spark):
    from tessera.functions import paths

    registry.register(spark)
    rows = ["tests/test_a.py", "./apps\\api/routes/x.py", "apps/worker/tasks/y.py", "jobs/nightly_cron.py", "app/api/a/route.ts", "app/page.tsx", "packages/a/models/b.py", "src/models/b.py", "components/B.tsx", "alembic/1.py", "frontend/x.js", None]
    df = spark.createDataFrame([(x,) for x in rows], "p string")
    got = df.selectExpr("categorize_path(p, null)", "assign_layer(p)", "normalize_path(p)").collect()
    want = df.select(paths.categorize_path(F.col("p")), paths.assign_layer(F.col("p")), paths.normalize_path(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    files = spark.createDataFrame([("a.py", "def f():\n    return g('x')\n"), ("b.py", "def ("), ("c.py", None)], "path string, text string")
    files.createOrReplaceTempView("registry_files")
    assert [tuple(r) for r in spark.sql("select path, s.name, s.kind from registry_files, lateral extract_symbols(path, text) s").collect()] == [("a.py", "f", "function")]
    assert [tuple(r) for r in spark.sql("select r.name, r.str_arg from registry_files, lateral extract_references(path, text) r").collect()] == [("g", "x")]
    assert spark.sql("select c.* from registry_files, lateral chunk_file(text) c").count() == 2
    assert len(spark.sql("select hash_embed('a b') as v").first()["v"]) == 64


def test_publish_keeps_the_old_version(spark, tmp_path):
    pages = spark.createDataFrame([("a", 1)], "slug string, n int")
    good, bad = spark.createDataFrame([(True,)], "ok boolean"), spark.createDataFrame([(True,), (False,)], "ok boolean")
    live, staging = str(tmp_path / "live"), str(tmp_path / "staging")
    assert tables.published(spark, live) is None
    assert tables.publish(pages, good, staging, live) and tables.published(spark, live).count() == 1
    assert not tables.publish(pages.unionByName(pages), bad, staging, live) and tables.published(spark, live).count() == 1
    assert tables.publish(pages.unionByName(pages), good, staging, live) and tables.published(spark, live).count() == 2


def test_cache_ledger_and_trace(spark, tmp_path):
    cache = tables.ResultCache(spark, str(tmp_path / "cache"))
    rows = spark.createDataFrame([(1, "x")], "n int, t string")
    assert cache.get("abc", "why?") is None and cache.put("abc", "why?", rows)
    assert [tuple(r) for r in cache.get("abc", "why?").collect()] == [(1, "x")] and cache.get("abd", "why?") is None
    assert tables.ResultCache(spark, str(tmp_path / "cache"), ttl_days=-1).get("abc", "why?") is None
    assert tables.ResultCache.key("r", "q") == "r-" + "8e35c2cd3bf6641b"
    ledger = tables.RunLedger(spark, str(tmp_path / "runs"))
    done = []
    assert ledger.run("history", [("a", lambda: done.append(1) or 3)])["ok"]
    failed = ledger.run("graph", [("a", lambda: done.append(2)), ("b", lambda: 1 / 0)])
    assert not failed["ok"] and "division" in failed["error"] and done == [1, 2]
    assert sorted((r["trigger"], r["status"]) for r in ledger.states().collect()) == [("graph", "error"), ("history", "success")]
    assert tables.append_trace(rows, str(tmp_path / "trace")) and not tables.append_trace(rows, "nowhere://x/y")
    tables.write_report(rows, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 1


def test_history_in_two_steps(spark, tmp_path):
    commits = spark.createDataFrame([("c1", 1, "Ann", "2024-01-01"), ("c2", 2, "Bo", "2024-01-02")], "sha string, author_id int, author_name string, committed_at string")
    changes = spark.createDataFrame([("c1", "a.py", 3, 1), ("c2", "a.py", 1, 0), ("c2", "b.py", 5, 5)], "sha string, path string, additions int, deletions int")
    for number, seen in enumerate((commits.where("sha = 'c1'"), commits, commits)):
        got = tables.ingest_history(spark, str(tmp_path / "h"), seen, changes, number)
        assert {k: df.count() for k, df in got.items()} == ({"authors": 2, "files": 2, "commits": 2, "commit_files": 3} if number else {"authors": 1, "files": 1, "commits": 1, "commit_files": 1})


def test_windows_and_listings(spark):
    files = spark.createDataFrame([("big.txt", "x\n" * (300 << 10)), ("a.txt", "1\n2\n3")], "path string, text string")
    assert tables.read_file(files, "big.txt").count() == 0 and tables.read_file(files, "big.txt", 5, 7).count() == 3 and tables.read_file(files, "a.txt").count() == 3
    pages = spark.createDataFrame([("b", "B", "x"), ("a", "A", "y"), ("c", "C", "x")], "slug string, title string, type string")
    assert [r["slug"] for r in tables.list_pages(pages).collect()] == ["b", "c", "a"] and [r["slug"] for r in tables.list_pages(pages, 2, 2).collect()] == ["a"]


def test_scanned_paths(spark):
    from tessera.functions import paths

    yes = ["a.py", "package.json", ".env.example", "x/Dockerfile.dev", "k8s/a.yml", ".github/workflows/ci.yml", "conf/x.toml", "docker-compose.yaml", "Pipfile"]
    no = ["a.txt", "node_modules/a.py", "data/clones/r/a.py", "k8s/a.txt", "env.example", "x.yml", ".github/a.yml"]
    df = spark.createDataFrame([(x,) for x in yes + no], "p string").select("p", paths.is_scanned(F.col("p")).alias("y"))
    assert {r["p"] for r in df.collect() if r["y"]} == set(yes)
    e = spark.createDataFrame([("a.py",), ("a.min.js",), ("yarn.lock",), ("b.tsx",), ("c.md",)], "p string").where(paths.is_embeddable(F.col("p")))
    assert {r["p"] for r in e.collect()} == {"a.py", "b.tsx"}


def test_deliveries(spark, tmp_path):
    import hashlib
    import hmac

    from tessera.streaming import maintenance

    body = '{"é": 1}'
    sign = lambda s, b: "sha256=" + hmac.new(s.encode(), b.encode(), hashlib.sha256).hexdigest()
    for secret in ("key", "k" * 100):
        rows = [("1", "push", sign(secret, body), body), ("1", "push", sign(secret, body), body), ("2", "push", sign("no", body), body), ("3", "star", sign(secret, body), body), ("4", "pull_request", None, body)]
        df = spark.createDataFrame(rows, "delivery_id string, event string, signature string, body string")
        seen = []
        assert maintenance.route_deliveries(df, {"push": lambda d, seen=seen: seen.append(d.count())}, secret) == {"push": 1} and seen == [1]
    assert maintenance.route_deliveries(df, {}) == {"push": 2, "pull_request": 1}
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.json").write_text('{"delivery_id": "a", "event": "push", "body": "{}", "received_at": "2024-01-01T00:00:00Z"}\n')
    got = []
    maintenance.delivery_stream(spark, str(folder), {"push": lambda d: got.append(d.count())}, str(tmp_path / "cp")).awaitTermination()
    assert got == [1]


def test_review_sink_and_dismissals(spark, tmp_path):
    from tessera.streaming import maintenance

    schema = "repo_id int, pr_id int, head_sha string, created_at string, body string"
    folder = tmp_path / "in"
    spark.createDataFrame([(1, 1, "a", "1", "x"), (1, 1, "a", "2", "y"), (1, 1, "b", "3", "z")], schema).coalesce(1).write.json(str(folder))
    out = str(tmp_path / "out")
    for n in range(2):
        if n:
            spark.createDataFrame([(1, 1, "b", "4", "w"), (2, 1, "a", "1", "v")], schema).coalesce(1).write.mode("append").json(str(folder))
        stream = spark.readStream.schema(schema).json(str(folder))
        maintenance.review_sink(spark, stream, out, str(tmp_path / "cp")).awaitTermination()
    rows = maintenance.current_reviews(spark, out)
    assert sorted((r["repo_id"], r["head_sha"], r["body"]) for r in rows.collect()) == [(1, "a", "y"), (1, "b", "w"), (2, "a", "v")]
    gone = maintenance.dismiss_latest(rows.withColumn("dismissed", F.lit(None).cast("boolean")), spark.createDataFrame([(1, 1)], "repo_id int, pr_id int"))
    assert sorted((r["repo_id"], r["head_sha"]) for r in gone.where("dismissed").collect()) == [(1, "b")]


def test_sync_parses_only_what_changed(spark):
    from tessera.operators import extract
    from tessera.streaming import maintenance

    schema = "path string, text string"
    old = spark.createDataFrame([("a.py", "from lib import f\n\ndef a():\n    f()\n"), ("lib.py", "def f():\n    pass\n"), ("c.py", "def c():\n    pass\n")], schema)
    symbols, edges = extract.repository_graph(old)
    chunks = extract.chunk_files(old, symbols)
    new = spark.createDataFrame([("a.py", "from lib import f\n\ndef a():\n    f()\n"), ("lib.py", "X = 1\n\n\ndef f():\n    pass\n\n\ndef g():\n    pass\n")], schema)
    got = maintenance.sync_files(new, spark.createDataFrame([("lib.py",), ("c.py",)], "path string"), symbols, edges, chunks)
    full_symbols, full_edges = extract.repository_graph(new)
    flat = lambda df: sorted(tuple(str(x) for x in r) for r in df.collect())
    assert flat(got["symbols"].select("symbol_id", "name")) == flat(full_symbols.select("symbol_id", "name"))
    assert flat(got["edges"].select("src_id", "dst_id", "kind", "confidence", "path")) == flat(full_edges.select("src_id", "dst_id", "kind", "confidence", "path"))
    assert flat(got["chunks"]) == flat(extract.chunk_files(new, full_symbols))
