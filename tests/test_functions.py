from pyspark.sql import functions as F

from tessera.functions import paths, text
from tessera.functions.vectors import cosine_distance, hash_embed


def value(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_path_rules(spark):
    rows = [
        ("tests/test_a.py", "tests", "test", "Tests"),
        ("apps/api/src/api/routes/x.py", "routes", "api", "API routes"),
        ("apps/worker/src/worker/tasks/y.py", "workers", "worker", "Worker"),
        ("apps/worker/src/worker/ingest/y.py", "workers", "worker", "Ingest"),
        ("jobs/nightly_cron.py", "cron", "lib", "Jobs"),
        ("src/util.py", "other", "lib", "Util.py"),
        ("./components/B.tsx", "other", "web", "Web"),
        ("app/api/users/route.ts", "routes", "api", "API"),
        ("packages/core_lib/x.py", "other", "lib", "Core lib"),
        ("alembic/versions/1.py", "other", "data", "Migrations"),
        (None, "other", "lib", "Root"),
    ]
    df = spark.createDataFrame([r[:1] for r in rows], "p string")
    p = F.col("p")
    got = df.select(paths.categorize_path(p), paths.assign_layer(p), paths.assign_domain(p)).collect()
    assert [tuple(r) for r in got] == [r[1:] for r in rows]


def test_prefixes(spark):
    assert value(spark, paths.normalize_path(F.lit("./.github\\x"))) == "github/x"
    assert value(spark, paths.parent_prefix(F.lit("a/b/c.ts"))) == "a/b"
    assert value(spark, paths.parent_prefix(F.lit("README.md"))) == "."
    assert value(spark, paths.ancestors(F.lit("a/b"))) == ["a/b", "a", "."]
    assert value(spark, paths.module_of(F.lit("a/b/c.py"), 2)) == "a/b"
    assert value(spark, paths.module_of(F.lit(""), 2)) == "(root)"
    assert value(spark, paths.package_key(F.lit("packages/x/y.py"))) == "packages/x"
    assert value(spark, paths.is_source(F.lit("a/node_modules/x.js"))) is False
    assert value(spark, paths.is_source(F.lit("a/build.py"))) is True
    for total, reached, risk in ((0, False, "none"), (3, False, "low"), (5, False, "medium"), (15, False, "high"), (1, True, "high")):
        assert value(spark, paths.risk_level(F.lit(total), F.lit(reached))) == risk


def test_text_rules(spark):
    assert value(spark, text.github_login(F.lit("12345+bob@users.noreply.github.com"))) == "bob"
    assert value(spark, text.github_login(F.lit("bob@example.com"))) is None
    assert value(spark, text.pr_numbers(F.lit("Merge GH-9 and #9, #10"))) == [9, 10]
    assert value(spark, text.query_identifiers(F.lit("where is compute_blast_radius handled in GraphNode or parse?"))) == ["compute_blast_radius", "GraphNode", "handled", "parse"]
    assert value(spark, text.abstains(F.lit("That could not be found; there is no such file."))) is True
    assert value(spark, text.abstains(F.lit("It is in a.py"))) is False
    assert value(spark, text.route_group(F.lit("/{id}/users/1"))) == "USERS"
    assert value(spark, text.scrub(F.lit("a\0b"))) == "ab"
    t = lambda s: text.trigrams(F.lit(s))
    assert value(spark, text.similarity(t("word"), t("words"))) == 4 / 7


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert value(spark, cosine_distance(v(1, 0), v(1, 0))) == 0
    assert value(spark, cosine_distance(v(0, 0), v(1, 0))) == 1
    rows = spark.createDataFrame([("a b",), ("a b",), (None,)], "t string").select(hash_embed(8)("t").alias("v")).collect()
    assert rows[0] == rows[1]
    assert abs(sum(x * x for x in rows[0]["v"]) - 1) < 1e-6
    assert set(rows[2]["v"]) == {0.0}
