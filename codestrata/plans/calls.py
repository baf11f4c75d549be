"""Calls resolved to definitions by name.

A call of a bare name means the function of that name in its own module, a call on the own instance
the method of its own class; otherwise every definition of the name may be meant. These stay one row for the call
with the number of definitions, as a name that is defined and called everywhere would give all pairs; which they
are can be looked up by the name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def resolve(calls: DataFrame, defs: DataFrame) -> DataFrame:
    """(call_id, how, target, n_targets) of every call.

    ``calls``: call_id, module, class, name, kind (name, self or attr). ``defs``: def_id, module, class (null at the
    top of a module), name. how: module, class, name (any of n_targets definitions of the name; target where there is
    one) or none. Of two definitions in one place the later id counts. A null name or module is defined nowhere.
    """
    kind = F.col("kind")
    top = defs.filter("class is null").groupBy("module", "name").agg(F.max("def_id").alias("in_module"))
    method = defs.filter("class is not null").groupBy("module", "class", "name").agg(F.max("def_id").alias("in_class"))
    named = defs.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.max("def_id").alias("any"))
    met = calls.join(top, ["module", "name"], "left").join(method, ["module", "class", "name"], "left").join(named, "name", "left")
    module, own = F.when(kind == "name", F.col("in_module")), F.when(kind == "self", F.col("in_class"))
    n = F.coalesce("n", F.lit(0))
    how = F.when(module.isNotNull(), "module").when(own.isNotNull(), "class").when(n > 0, "name").otherwise("none")
    exact = F.coalesce(module, own)
    return met.select("call_id", how.alias("how"), F.coalesce(exact, F.when(n == 1, F.col("any"))).alias("target"),
                      F.when(exact.isNotNull(), 1).otherwise(n).cast("long").alias("n_targets"))


def resolve_unique(calls: DataFrame, defs: DataFrame) -> DataFrame:
    """(call_id, target): as resolve, but across modules only a name that one top-level function of all has; null else."""
    top = defs.filter("class is null")
    here = top.groupBy("module", "name").agg(F.max("def_id").alias("in_module"))
    method = defs.filter("class is not null").groupBy("module", "class", "name").agg(F.max("def_id").alias("in_class"))
    places = here.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.max("in_module").alias("any"))
    met = calls.join(here, ["module", "name"], "left").join(method, ["module", "class", "name"], "left").join(places.filter("n = 1"), "name", "left")
    kind = F.col("kind")
    return met.select("call_id", F.when(kind == "name", F.coalesce("in_module", "any")).when(kind == "self", F.col("in_class")).alias("target"))


def unreferenced(defs: DataFrame, calls: DataFrame, entry: Column) -> DataFrame:
    """``defs`` that no call may mean and that are no entry points: no exact target, and no call left to its name."""
    met = resolve(calls.select("call_id", "module", "class", "name", "kind"), defs).join(calls.select("call_id", "name"), "call_id")
    exact = met.filter("how in ('module', 'class')").select(F.col("target").alias("def_id"))
    names = met.filter("how = 'name'").select("name").distinct()
    return defs.filter(~F.coalesce(entry, F.lit(False))).join(exact, "def_id", "left_anti").join(names, "name", "left_anti")
