"""Deterministic summaries, bottom up: symbols, leaf modules, parents from their children, features and the overview."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import Scratch

# The sentences, and how sure a symbol's sentence is by what it rests on.
DOCUMENTED, SIGNED, NAMED = ("%s (%s) in %s: %s", 0.62), ("%s is a %s in %s, signature %s.", 0.5), ("%s is a %s in %s.", 0.4)
LEAF, MEASURES, MEMBERS, NO_FILES = "%s covers %s.", " Cohesion %.2f, coupling %.2f.", " Members: %s.", "no indexed files"
PARENT, CHILDLESS = "%s brings together %s.", "%s has no child modules."
FEATURE = "%s starts%s. Confirmed steps (%s): %s. Inferred steps: %s. Touches %s."
OVERVIEW, EMPTY, CROSSING = "This %s is explained from its modules — %s.", "This %s does not have responsibility modules yet.", " Cross-cutting features: %s."
SURE, PASSES = 0.7, 4


def first_line(text: Column) -> Column:
    return F.regexp_replace(F.trim(F.element_at(F.split(F.trim(F.coalesce(text, F.lit(""))), "\n"), 1)), "^[\"']+|[\"']+$", "")


def first_sentence(text: Column) -> Column:
    return F.trim(F.element_at(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\."), 1))


def symbol_summaries(symbols: DataFrame) -> DataFrame:
    """(symbol_id, path, summary, confidence) from a docstring's first line, else the signature, else the name."""
    doc, sign = first_line(F.col("docstring")), F.substring(F.trim(F.coalesce("signature", F.lit(""))), 1, 180)
    said = F.when(doc != "", F.format_string(DOCUMENTED[0], "name", "kind", "path", doc)).when(sign != "", F.format_string(SIGNED[0], "name", "kind", "path", sign)).otherwise(F.format_string(NAMED[0], "name", "kind", "path"))
    sure = F.when(doc != "", DOCUMENTED[1]).when(sign != "", SIGNED[1]).otherwise(NAMED[1])
    return symbols.select("symbol_id", "path", "start_line", F.substring(said, 1, 500).alias("summary"), sure.alias("confidence"))


def leaf_summaries(leaves: DataFrame, atoms: DataFrame) -> DataFrame:
    """(id, summary) of leaf modules (id, name, files, cohesion, coupling, deep); deep ones name their measures and first three members in file order."""
    at = leaves.select("id", F.explode("files").alias("path")).join(atoms.select("path", "start_line", F.regexp_replace(F.trim("summary"), r"\.+$", "").alias("line")), "path")
    ranked = at.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("path", "start_line", "line"))).where("n <= 3")
    members = ranked.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "; ").alias("members"))
    shown = F.array_join(F.slice("files", 1, 4), ", ")
    covers = F.format_string(LEAF, "name", F.when(shown == "", NO_FILES).otherwise(shown))
    more = F.concat(F.format_string(MEASURES, "cohesion", "coupling"), F.when(F.col("members").isNotNull(), F.format_string(MEMBERS, "members")).otherwise(""))
    return leaves.join(members, "id", "left").select("id", F.when(F.col("deep"), F.concat(covers, more)).otherwise(covers).alias("summary"))


def parent_summaries(modules: DataFrame, leaves: DataFrame, passes: int = PASSES) -> DataFrame:
    """(id, summary) of modules (id, parent_id, name): leaves as given, parents from their children's first sentences, a level a pass."""
    scratch = Scratch(modules.sparkSession, "summaries")
    known = scratch.table(leaves.select("id", "summary"), "leaves")
    waiting = modules.select("parent_id", "id").where("parent_id is not null").groupBy("parent_id").agg(F.count("*").alias("children"))
    for i in range(passes):
        said = first_sentence(F.col("summary"))
        kids = modules.join(known, "id").select("parent_id", "id", F.concat("name", F.when(said != "", F.concat(F.lit(" ("), said, F.lit(")"))).otherwise("")).alias("bit"))
        ready = kids.groupBy("parent_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "bit"))), lambda x: x["bit"]), "; ").alias("bits")).join(waiting, "parent_id").where("n = children")
        new = ready.join(modules.select(F.col("id").alias("parent_id"), "name"), "parent_id").join(known.select(F.col("id").alias("parent_id")), "parent_id", "left_anti")
        new = scratch.table(new.select(F.col("parent_id").alias("id"), F.format_string(PARENT, "name", "bits").alias("summary")), f"level-{i}")
        if new.isEmpty():
            break
        known = known.unionByName(new)
    return known


def feature_summaries(features: DataFrame, hops: DataFrame) -> DataFrame:
    """(id, summary) of features (id, name, entry_file, modules, resolution) and their steps (id, step, src, dst, confidence)."""
    sure = F.col("confidence") >= SURE
    text = lambda keep: F.coalesce(F.nullif(F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("step", F.concat_ws(" → ", "src", "dst").alias("t"))))), lambda x: x["t"]), 1, 6), ", "), F.lit("")), F.lit("none"))
    steps = hops.groupBy("id").agg(text(sure).alias("confirmed"), text(~sure).alias("inferred"))
    where = F.when(F.coalesce("entry_file", F.lit("")) != "", F.concat(F.lit(" in "), "entry_file")).otherwise("")
    touched = F.coalesce(F.nullif(F.array_join("modules", ", "), F.lit("")), F.lit("no other module"))
    none = F.lit("none")
    return features.join(steps, "id", "left").select("id", F.format_string(FEATURE, "name", where, "resolution", F.coalesce("confirmed", none), F.coalesce("inferred", none), touched).alias("summary"))


def overview_summary(children: DataFrame, features: DataFrame, style: str) -> DataFrame:
    """One row: the overview of child modules (pos, name, summary) and features (pos, name)."""
    said = first_sentence(F.col("summary"))
    bit = F.concat("name", F.when(said != "", F.concat(F.lit(": "), said)).otherwise(""))
    listed = lambda df, c, sep: df.orderBy("pos").limit(4).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", c.alias("t")))), lambda x: x["t"]), sep).alias("t"))
    main = listed(children, bit, "; ").select(F.when(F.col("t") == "", EMPTY % style).otherwise(F.format_string(OVERVIEW, F.lit(style), "t")).alias("main"))
    more = listed(features, F.col("name"), ", ").select(F.when(F.col("t") == "", "").otherwise(F.format_string(CROSSING, "t")).alias("more"))
    return main.crossJoin(more).select(F.substring(F.concat("main", "more"), 1, 700).alias("summary"))


def unchanged(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Targets (target, content_sha) that have a summary made from the same content."""
    met = stored.where(F.trim(F.coalesce("summary", F.lit(""))) != "").select("target", "content_sha")
    return found.join(met, ["target", "content_sha"], "left_semi")
