"""Maximum spanning forests, and where large clusters are cut.

A round of Boruvka's method takes each component's heaviest edge to another one
and joins what those edges connect. Edges are ordered strictly (by weight, then by
their ends), so the forest is the one that a single pass over the sorted edges
would give, and its edges alone say when parts come apart.

Edges are lost from the lightest on. Until two parts of three or more members
appear, each lost forest edge takes one or two members off the one large part, and
members of large parts only grow fewer; so the first cut that leaves two such parts
is the only one that can still hold the share. It is the lightest forest edge with
three or more members on either side over heavier edges, which an edge's ends and
their strongest neighbours tell. No step holds a component of more than PART edges in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import Scratch


#: Edges that a task joins at once.
PART = 1 << 18


def root_of(parent: dict, x):  # noqa: ANN001, ANN201
    """The root of ``x``, with paths halved."""
    while (up := parent.get(x, x)) != x:
        parent[x] = x = parent.get(up, up)
    return x


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of a task's edges as (vertex, least vertex that they connect it with)."""
    parent: dict = {}
    schema = None
    for batch in batches:
        schema = batch.schema
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = root_of(parent, a), root_of(parent, b)  # noqa: PLW2901
            if a != b:
                parent[max(a, b)] = min(a, b)
    if parent:
        every = list(parent)
        yield pa.RecordBatch.from_pydict({"a": every, "b": [root_of(parent, v) for v in every]}, schema=schema)


def _acyclic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges that close no cycle with those before them in their part (group, part)."""
    now, parent = None, {}
    for batch in batches:
        keep = []
        for group, part, x, y in zip(*(batch.column(c).to_pylist() for c in ("group", "part", "x", "y")), strict=True):
            if now != (group, part):
                now, parent = (group, part), {}
            x, y = root_of(parent, x), root_of(parent, y)  # noqa: PLW2901
            keep.append(x != y)
            parent[x] = y
        yield batch.filter(pa.array(keep, pa.bool_()))


def _thinned(ends: DataFrame, scratch: Scratch) -> DataFrame:
    """``ends`` (group, e, x, y) without edges that are the lightest of a cycle in a part of some PART edges of their group; ``parts`` says in how many a group was dealt, so where it is 1 the forest is there.

    Groups are dealt anew as long as a fifth of the edges goes.
    """
    parts = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    ends, turn, before = scratch.table(ends, "thin-0"), 0, None
    while True:
        turn += 1
        sizes = ends.groupBy("group").agg(F.ceil(F.count("*") / PART).alias("parts"))
        dealt = ends.select("group", "e", "x", "y").join(sizes, "group").withColumn("part", F.pmod(F.xxhash64("e"), "parts"))
        dealt = dealt.repartition(parts, "group", "part").sortWithinPartitions("group", "part", F.desc("e"))
        now = scratch.table(dealt.mapInArrow(_acyclic, dealt.schema), f"thin-{turn}")
        scratch.drop(f"thin-{turn - 1}")
        left, most = now.agg(F.count("*"), F.max("parts")).first()
        if (most or 1) == 1 or (before is not None and left > 0.8 * before):
            return now
        ends, before = now, left


def spanning_forest(pairs: DataFrame, scratch: Scratch, components) -> DataFrame:  # noqa: ANN001
    """The edges (a, b, w, a < b) of the maximum spanning forest of ``pairs``; of equal weights the edge with greater ends counts as heavier. ``components``: (nodes, pairs) to (id, component).

    Edges that are the lightest of a cycle go first, in parts of bounded size; with a
    column ``cluster`` parts are dealt by it, and no edge may connect two clusters.
    Groups that are one part by then are done, others go on in rounds.
    """
    group = F.col("cluster").cast("string") if "cluster" in pairs.columns else F.lit("")
    thin = _thinned(pairs.where("a <> b").select(group.alias("group"), F.struct("w", "a", "b").alias("e"), F.col("a").alias("x"), F.col("b").alias("y")), scratch)
    done = thin.where("parts = 1").select("e.a", "e.b", "e.w").distinct()
    if thin.where("parts > 1").isEmpty():
        return done
    return done.unionByName(_rounds(thin.where("parts > 1").select("e", "x", "y"), scratch, components))


def _rounds(ends: DataFrame, scratch: Scratch, components) -> DataFrame:  # noqa: ANN001
    """The spanning forest (a, b, w) of edges (e, x, y) by rounds of heaviest edges."""
    chosen, turn = None, 0
    ends = scratch.table(ends, "ends-0")
    while not ends.isEmpty():
        turn += 1
        both = ends.select("x", "e").unionByName(ends.select(F.col("y").alias("x"), "e"))
        best = scratch.table(both.groupBy("x").agg(F.max("e").alias("e")).select("e").distinct(), f"best-{turn}")
        chosen = best if chosen is None else chosen.unionByName(best)
        joined = ends.join(best, "e").select(F.col("x").alias("a"), F.col("y").alias("b"))
        name = scratch.table(components(joined.select(F.col("a").alias("id")).unionByName(joined.select(F.col("b").alias("id"))).distinct(), joined), f"name-{turn}")
        of = lambda c: name.select(F.col("id").alias(c), F.col("component").alias(f"{c}_"))  # noqa: E731, B023
        moved = ends.join(of("x"), "x", "left").join(of("y"), "y", "left").select("e", F.coalesce("x_", "x").alias("x"), F.coalesce("y_", "y").alias("y")).where("x <> y")
        # Of several edges between two components only the heaviest can be chosen.
        low, high = F.least("x", "y"), F.greatest("x", "y")
        ends = scratch.table(moved.groupBy(low.alias("x"), high.alias("y")).agg(F.max("e").alias("e")), f"ends-{turn}")
        scratch.drop(f"ends-{turn - 1}", f"name-{turn}")
    if chosen is None:
        return ends.select("e.a", "e.b", "e.w")
    return chosen.distinct().select("e.a", "e.b", "e.w")


def _thirds(forest: DataFrame) -> DataFrame:
    """(v, third): the lightest edge that v's component needs to have three members, if edges come from the heaviest on; null where it never has."""
    ends = forest.select(F.col("a").alias("v"), F.col("b").alias("other"), "e").unionByName(forest.select(F.col("b").alias("v"), F.col("a").alias("other"), "e"))
    # A vertex's two heaviest edges: the second completes three members, as does the first with one more at its other end.
    first = ends.groupBy("v").agg(F.max(F.struct("e", "other")).alias("top"))
    rest = ends.join(first, "v").where(F.col("e") != F.col("top.e")).groupBy("v").agg(F.max("e").alias("second"))
    two = first.join(rest, "v", "left").select("v", F.col("top.e").alias("first"), F.col("top.other").alias("other"), "second")
    beyond = two.select(F.col("v").alias("other"), F.col("second").alias("of_other"))
    met = two.join(beyond, "other")
    # greatest() and least() pass over nulls, and a neighbour without a second edge gives none.
    through = F.when(F.col("of_other").isNotNull(), F.when(F.col("first") < F.col("of_other"), F.col("first")).otherwise(F.col("of_other")))
    third = F.when(F.col("second").isNull(), through).when(through.isNull(), F.col("second")).otherwise(F.when(F.col("second") > through, F.col("second")).otherwise(through))
    return met.select("v", third.alias("third"))


def weakest_cuts(member: DataFrame, inside: DataFrame, forest: DataFrame, scratch: Scratch, components, share: float = 0.6) -> DataFrame:  # noqa: ANN001
    """(cluster, e): the heaviest edge that a cluster loses so that its parts of three or more members are two and together hold the share; clusters for which a fifth of the edges doesn't do have none.

    ``inside``: all edges (cluster, a, b, w) of the clusters, of which ``forest`` (a, b, w) has the spanning ones.
    """
    inside = inside.withColumn("e", F.struct("w", "a", "b"))
    tree = scratch.table(forest.withColumn("e", F.struct("w", "a", "b")).join(inside.select("cluster", "a", "b"), ["a", "b"]).select("cluster", "a", "b", "e"), "tree")
    third = scratch.table(_thirds(tree), "third")
    of = lambda c: third.select(F.col("v").alias(c), F.col("third").alias(f"{c}_third"))
    parted = tree.join(of("a"), "a").join(of("b"), "b").where((F.col("a_third") > F.col("e")) & (F.col("b_third") > F.col("e")))
    cut = scratch.table(parted.groupBy("cluster").agg(F.min("e").alias("e")), "cut")
    lost = inside.join(cut.withColumnRenamed("e", "at"), "cluster").groupBy("cluster").agg(F.count("*").alias("edges"), F.sum((F.col("e") <= F.col("at")).cast("long")).alias("lost"))
    # What is still in one part with the cut edge itself: its two large parts.
    kept = tree.join(cut.withColumnRenamed("e", "at"), "cluster").where(F.col("e") >= F.col("at")).select("a", "b")
    ends = kept.select(F.col("a").alias("id")).unionByName(kept.select(F.col("b").alias("id"))).distinct()
    part = scratch.table(components(ends, kept), "part")
    sizes = part.groupBy("component").agg(F.count("*").alias("held"))
    held = cut.select("cluster", F.col("e.a").alias("id")).join(part, "id").join(sizes, "component").select("cluster", "held")
    size = member.groupBy("cluster").agg(F.count("*").alias("size"))
    ok = lost.join(held, "cluster").join(size, "cluster").where((F.col("lost") <= F.greatest(F.lit(1), F.floor(F.col("edges") / 5))) & (F.col("edges") >= 2) & (F.col("held") >= F.floor(F.col("size") * F.lit(share))))
    return cut.join(ok.select("cluster"), "cluster")


def evidence_edges(pairs: DataFrame, member: DataFrame, inner: bool = True, most: int = 12) -> DataFrame:
    """(cluster, src, dst, weight, rank): a cluster's heaviest edges (a, b, w), within it or to others; ties by their ends."""
    of = lambda c: member.select(F.col("id").alias(c), F.col("cluster").alias(f"c{c}"))
    met = pairs.join(of("a"), "a").join(of("b"), "b").where("ca = cb" if inner else "ca <> cb")
    rows = met.select("ca", "a", "b", "w")
    if not inner:
        rows = rows.unionByName(met.select(F.col("cb").alias("ca"), "a", "b", "w"))
    rows = rows.select(F.col("ca").alias("cluster"), F.col("a").alias("src"), F.col("b").alias("dst"), F.round("w", 3).alias("weight"))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("weight"), "src", "dst"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most)


def accepted_labels(labels: DataFrame, member: DataFrame) -> DataFrame:
    """(cluster, name) of proposed names (cluster, name, paths) that cite members alone, one at least; the first in order of names counts."""
    clean = F.trim(F.regexp_replace("name", r"\s+", " "))
    rows = labels.select("cluster", clean.alias("name"), "paths").where(r"name <> '' and length(name) <= 80 and not name rlike '[\\[\\]{}]' and size(paths) > 0")
    rows = rows.withColumn("at", F.xxhash64("cluster", "name", "paths"))
    cited = rows.select("cluster", "name", "at", F.explode("paths").alias("id")).join(member.withColumn("known", F.lit(1)), ["cluster", "id"], "left")
    good = cited.groupBy("cluster", "name", "at").agg(F.count("*").alias("n"), F.count("known").alias("k")).where("n = k")
    return good.groupBy("cluster").agg(F.min("name").alias("name"))
