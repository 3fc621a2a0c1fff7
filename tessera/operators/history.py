"""Commit graphs: what a head reaches, and which deletions and additions are renames.

Reach goes along first parents by doubling: a table of each commit's ancestor
2^k steps up, and from a set of commits all their first-parent ancestors in as many
joins as there are tables, a few joins a plan. What merges bring in starts the next
round, so rounds follow the nesting of merged branches, not the length of the history.

Renames are pairs of a deleted and an added file of one commit, chosen best first.
Files of equal content are paired by path. Of the others, each pair that shares at
least half of the larger one's bytes, line by line, is found by an inverted index
over the lines that are rare in the commit: with its lines in order of rarity, a
file's tail that weighs less than half can be left out, since two files that share
enough meet before it. Only pairs that meet are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import Scratch

#: Per cent of the larger file's bytes that a rename keeps.
SIMILAR = 50
#: Joins of one plan: all of a long history in one plan held its tables and stages in the driver at once.
JOINS = 4


def reachable(commits: DataFrame, heads: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(sha) of the commits (sha, parents) that ``heads`` (sha) reach, themselves included; parents and heads that aren't among the commits are passed over."""
    scratch = scratch or Scratch(commits.sparkSession, "reach")
    known = scratch.table(commits.select("sha").where("sha is not null").distinct(), "known")
    links = commits.select("sha", F.posexplode("parents").alias("at", "up")).where("sha is not null and up is not null")
    links = scratch.table(links.join(known.select(F.col("sha").alias("up")), "up").groupBy("sha", "up").agg(F.min("at").alias("at")), "links")
    jumps = [scratch.table(links.groupBy("sha").agg(F.min_by("up", "at").alias("up")), "up-0")]
    while True:  # a history of n commits has no more than log2(n) such tables
        last = jumps[-1]
        twice = scratch.table(last.select("sha", F.col("up").alias("mid")).join(last.select(F.col("sha").alias("mid"), "up"), "mid").select("sha", "up"), f"up-{len(jumps)}")
        if twice.isEmpty():
            break
        jumps.append(twice)
    reached = scratch.table(known.where("false"), "reached-0")
    new = scratch.table(heads.select("sha").distinct().join(known, "sha", "left_semi"), "new-0")
    turn = 0
    while not new.isEmpty():
        turn += 1
        line, written = new, []
        for i, jump in enumerate(reversed(jumps), 1):  # each commit stays, and its ancestor of that table comes
            line = line.join(jump.hint("merge"), "sha", "left").select(F.explode(F.array_compact(F.array("sha", "up"))).alias("sha")).distinct()
            if i % JOINS == 0 or i == len(jumps):
                written.append(f"line-{turn}-{i}")
                line = scratch.table(line, written[-1])
        merged = links.join(line, "sha", "left_semi").select(F.col("up").alias("sha")).distinct()
        reached = scratch.table(reached.unionByName(line).distinct(), f"reached-{turn}")
        new = scratch.table(merged.join(reached, "sha", "left_anti"), f"new-{turn}")
        scratch.drop(f"reached-{turn - 1}", f"new-{turn - 1}", *written)
    return reached


def _sides(files: DataFrame) -> DataFrame:
    """Deleted and added files with content: those without can't be told from each other."""
    return files.select("sha", "path", "added", "text").where("sha is not null and path is not null and text <> ''")


def same_content(files: DataFrame) -> DataFrame:
    """(sha, old_path, new_path) of files of equal content, in order of their paths."""
    place = F.row_number().over(Window.partitionBy("sha", "added", "digest").orderBy("path"))
    rows = _sides(files).select("sha", "path", "added", F.sha2("text", 256).alias("digest")).distinct().withColumn("place", place)
    old = rows.where("not added").select("sha", "digest", "place", F.col("path").alias("old_path"))
    return old.join(rows.where("added").select("sha", "digest", "place", F.col("path").alias("new_path")), ["sha", "digest", "place"]).select("sha", "old_path", "new_path")


def similar_pairs(files: DataFrame, scratch: Scratch, similar: int = SIMILAR) -> DataFrame:
    """(sha, old_path, new_path, similarity) of each deleted and added file of a commit that share at least ``similar`` per cent of the larger one's bytes.

    Shared bytes are those of equal lines, each as often as both files have it.
    """
    line = F.explode(F.split("text", "\n", -1))
    cut = _sides(files).select("sha", "path", "added", line.alias("line")).groupBy("sha", "path", "added", F.sha2("line", 256).alias("line")).agg(F.count("*").alias("n"), F.max(F.octet_length("line") + 1).cast("long").alias("bytes"))
    cut = scratch.table(cut, "lines")
    spread = cut.groupBy("sha", "line").agg(F.count("*").alias("files"))
    whole = Window.partitionBy("sha", "path", "added")
    # What a line and the more common ones weigh: below the share that a partner needs, no first common line can be there.
    tail = F.sum(F.col("n") * F.col("bytes")).over(whole.orderBy(F.desc("files"), F.desc("line")))
    weighed = cut.join(spread, ["sha", "line"]).withColumn("size", F.sum(F.col("n") * F.col("bytes")).over(whole)).withColumn("tail", tail)
    rare = weighed.where(F.col("tail") * 100 >= F.col("size") * similar).select("sha", "path", "added", "line", "size")
    rare = scratch.table(rare, "rare")
    old = rare.where("not added").select("sha", "line", F.col("path").alias("old_path"), F.col("size").alias("old_size"))
    new = rare.where("added").select("sha", "line", F.col("path").alias("new_path"), F.col("size").alias("new_size"))
    larger, smaller = F.greatest("old_size", "new_size"), F.least("old_size", "new_size")
    met = old.join(new, ["sha", "line"]).where(smaller * 100 >= larger * similar).select("sha", "old_path", "new_path", larger.alias("larger")).distinct()
    one = met.join(cut.where("not added").select("sha", F.col("path").alias("old_path"), "line", F.col("n").alias("m"), "bytes"), ["sha", "old_path"])
    both = one.join(cut.where("added").select("sha", F.col("path").alias("new_path"), "line", "n"), ["sha", "new_path", "line"])
    shared = both.groupBy("sha", "old_path", "new_path", "larger").agg(F.sum(F.least("m", "n") * F.col("bytes")).alias("shared"))
    return shared.select("sha", "old_path", "new_path", F.expr("shared * 100 div larger").alias("similarity")).where(F.col("similarity") >= similar)


def _order() -> Column:
    """Best pair first: most similar, same file name, then by a hash, so that ties of many files are settled in few rounds."""
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    return F.struct((-F.col("similarity")).alias("s"), (name("old_path") != name("new_path")).alias("d"), F.md5(F.concat_ws("\n", F.col("sha").cast("string"), "old_path", "new_path")).alias("h"), "old_path", "new_path")


def best_matches(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """Each file in one pair at most, best pairs first. In a round all pairs that are the best of both their files are taken, which is what taking them one by one gives."""
    left = scratch.table(pairs.withColumn("order", _order()), "left-0")
    chosen: list[DataFrame] = []
    while not left.isEmpty():
        turn = len(chosen)
        old = left.groupBy("sha", "old_path").agg(F.min("order").alias("of_old"))
        new = left.groupBy("sha", "new_path").agg(F.min("order").alias("of_new"))
        best = left.join(old, ["sha", "old_path"]).join(new, ["sha", "new_path"]).where("order = of_old and order = of_new")
        best = scratch.table(best.select("sha", "old_path", "new_path", "similarity"), f"best-{turn}")
        chosen.append(best)
        left = left.join(best.select("sha", "old_path"), ["sha", "old_path"], "left_anti").join(best.select("sha", "new_path"), ["sha", "new_path"], "left_anti")
        left = scratch.table(left, f"left-{turn + 1}")
    if not chosen:
        return left.drop("order")
    out = chosen[0]
    for more in chosen[1:]:
        out = out.unionByName(more)
    return out


def renames(files: DataFrame, similar: int = SIMILAR, scratch: Scratch | None = None) -> DataFrame:
    """(sha, old_path, new_path, similarity) of deleted and added files (sha, path, added, text): equal content first, then the most similar."""
    scratch = scratch or Scratch(files.sparkSession, "renames")
    equal = scratch.table(same_content(files), "equal")
    used = equal.select("sha", F.col("old_path").alias("path"), F.lit(False).alias("added")).unionByName(equal.select("sha", F.col("new_path").alias("path"), F.lit(True).alias("added")))
    rest = files.join(used, ["sha", "path", "added"], "left_anti")
    matched = best_matches(similar_pairs(rest, scratch, similar), scratch)
    return equal.withColumn("similarity", F.lit(100).cast("long")).unionByName(matched.withColumn("similarity", F.col("similarity").cast("long")))


def with_renames(changes: DataFrame, found: DataFrame) -> DataFrame:
    """Changes (sha, path, change, ...) with a rename as one change of its new path (``old_path``); its deletion goes."""
    gone = found.select("sha", F.col("old_path").alias("path"), F.lit("deleted").alias("change"))
    came = found.select("sha", F.col("new_path").alias("path"), F.lit("added").alias("change"), "old_path")
    rows = changes.join(gone, ["sha", "path", "change"], "left_anti").join(came, ["sha", "path", "change"], "left")
    return rows.withColumn("change", F.when(F.col("old_path").isNotNull(), "renamed").otherwise(F.col("change")))
