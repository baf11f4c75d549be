"""Names resolved through nested scopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .sequence import as_of

UNSEEN = "class"        # a scope of this kind is looked into only where the search begins


def chains(tree: DataFrame) -> DataFrame:
    """(scope, seen, distance): the scopes that a search from ``scope`` looks into, itself at distance 0.

    ``tree``: scope, parent, kind. One join a level, as many as the deepest nesting; a scope that
    is its own ancestor would nest without end, so the search stops at one already met.
    """
    up = tree.select(F.col("scope").alias("at"), "parent", "kind").filter("parent is not null")
    level = materialize(tree.select("scope", F.col("scope").alias("at"), F.lit(0).alias("distance"), F.array("scope").alias("met")), "scope-chain")
    out = level
    while not level.isEmpty():
        level = materialize(level.join(up.select("at", "parent"), "at").filter(~F.array_contains("met", F.col("parent"))).select(
            "scope", F.col("parent").alias("at"), (F.col("distance") + 1).alias("distance"), F.array_append("met", F.col("parent")).alias("met")), "scope-chain")
        out = out.unionByName(level)
    kinds = tree.select(F.col("scope").alias("at"), "kind").distinct()
    seen = out.join(kinds, "at", "left").filter((F.col("distance") == 0) | F.col("kind").isNull() | (F.col("kind") != UNSEEN))
    return seen.select("scope", F.col("at").alias("seen"), "distance")


def resolve(uses: DataFrame, bindings: DataFrame, tree: DataFrame, width: int) -> DataFrame:
    """``uses`` (event_id, scope, name, line) with the binding each sees and its distance, null where none is.

    ``bindings``: scope, name, line, binding. In each scope of the chain the last binding strictly before the
    line counts; the innermost scope that has one wins. Work is dealt by scope, name and
    ``width`` of lines, so a name bound everywhere doesn't meet in one task.
    """
    asked = uses.join(chains(tree), "scope").select("event_id", F.col("seen").alias("scope"), "name", "line", "distance")
    met = as_of(asked, bindings, ["scope", "name"], "line", "binding", width)
    best = met.filter("binding is not null").groupBy("event_id").agg(F.min(F.struct("distance", "binding")).alias("b"))
    return uses.join(best, "event_id", "left").select(*uses.columns, "b.binding", "b.distance")
