"""Dotted names and paths: the longest known prefix, and the order of a file tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .sequence import running_totals


def prefixes(name: Column) -> Column:
    """All dotted prefixes of a name, itself included."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))


def longest_prefix(names: DataFrame, known: DataFrame) -> DataFrame:
    """(name, module): each distinct name of ``names`` with its longest dotted prefix among ``known`` (module), else null.

    Every name asks for its prefixes by equality; a prefix that is only part of a dotted word is none.
    """
    distinct = names.select("name").filter("name is not null").distinct()
    asked = distinct.select("name", F.explode(prefixes(F.col("name"))).alias("module"))
    met = asked.join(known.select("module").distinct(), "module")
    best = met.groupBy("name").agg(F.max_by("module", F.length("module")).alias("module"))
    return distinct.join(best, "name", "left")


def tree_rows(files: DataFrame) -> DataFrame:
    """(path, kind, depth, key) of every file and every directory above it, once.

    ``key`` sorts the tree: at each level directories come first, then names without regard to case, then with it. Empty
    parts of a path don't count; a path without parts is no file.
    """
    slashed = F.replace(F.col("path"), F.lit("\\"), F.lit("/"))
    parts = files.select(F.filter(F.split(slashed, "/"), lambda p: p != "").alias("parts")).filter("size(parts) > 0")
    level = lambda last: lambda p, i: F.struct((last & (i == F.size("parts") - 1)).cast("int").alias("file"), F.lower(p).alias("low"), p.alias("name"))
    whole = parts.select("parts", F.lit("file").alias("kind"), F.transform("parts", level(F.lit(True))).alias("key"))
    up = parts.select(F.explode(F.when(F.size("parts") > 1, F.transform(
        F.sequence(F.lit(1), F.size("parts") - 1), lambda n: F.slice("parts", 1, n)))).alias("parts")).distinct()
    above = up.select("parts", F.lit("dir").alias("kind"), F.transform("parts", level(F.lit(False))).alias("key"))
    return whole.distinct().unionByName(above).select(
        F.array_join("parts", "/").alias("path"), "kind", F.size("parts").alias("depth"), "key")


def tree_order(files: DataFrame) -> DataFrame:
    """(position, path, kind, depth): the tree of ``files`` (path) written out from the top, positions from 1.

    One sort by ranges gives the order that sorting each directory by itself would.
    """
    rows = tree_rows(files).withColumn("one", F.lit(1).cast("long"))
    return running_totals(rows, ["key"], "one", "file-tree").select((F.col("before") + 1).alias("position"), "path", "kind", "depth")
