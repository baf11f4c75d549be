"""Classes that are too large, frameworks that files import, layers that imports break."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .batches import by_key, codes, parted
from .graphs import connected
from .paths import prefixes

# Methods of a large class and its unrelated groups, and methods of one too large in any case.
METHODS, GROUPS, METHODS_HARD = 12, 3, 25
LEAST_METHODS = 3
SMALL = 4096        # rows of a class up to which it is grouped together with others
# What a path segment of each layer is called, from the lowest layer up.
LAYERS = {
    "model": ("model", "models", "entity", "entities", "schema", "schemas", "domain", "dto"),
    "repository": ("repository", "repositories", "dao", "store", "dataaccess"),
    "service": ("service", "services", "usecase", "usecases", "business", "logic", "engine"),
    "api": ("api", "routes", "route", "controller", "controllers", "view", "views", "handler", "handlers", "endpoint", "endpoints"),
}


def grouped(table: pa.Table) -> pa.Table:
    """(class, n_methods, groups) of small classes; ``table``: class, method, attribute."""
    class_, names = codes(table["class"])
    method, _ = codes(table["method"])
    attribute, _ = codes(table["attribute"])
    methods, of_row = np.unique(class_ * (method.max() + 1) + method, return_inverse=True)
    class_of = methods // (method.max() + 1)
    some = attribute >= 0
    u = of_row[some]
    _, v = np.unique(class_[some] * (attribute.max() + 1) + attribute[some], return_inverse=True)
    label = np.arange(len(methods))
    while True:
        # the least method of each attribute, of each method's attributes, and that method's own label
        least = np.full(len(u), len(methods))
        np.minimum.at(least, v, label[u])
        new = label.copy()
        np.minimum.at(new, u, least[v])
        new = new[new]
        if (new == label).all():
            break
        label = new
    groups = np.bincount(class_of[label == np.arange(len(methods))], minlength=len(names))
    return pa.table({"class": names, "n_methods": np.bincount(class_of, minlength=len(names)), "groups": groups})


def method_groups(touched: DataFrame) -> DataFrame:
    """(class, n_methods, groups) of ``touched`` (class, method, attribute): groups of methods that share attributes.

    Methods that touch the same attribute of their class are in one group, directly or by way of others; one that touches
    none (a null attribute) is a group of its own. Rows with a null class or method are left out.
    """
    rows = touched.select("class", "method", "attribute").filter("class is not null and method is not null")
    small, large = parted(rows, "class", F.lit(1), SMALL)
    out = by_key(small, "class", grouped, f"class {rows.schema['class'].dataType.simpleString()}, n_methods bigint, groups bigint")
    return out if large is None else out.unionByName(_connected_groups(large))


def _connected_groups(touched: DataFrame) -> DataFrame:
    """method_groups for classes of any size, as parts of one graph."""
    rows = touched.distinct()
    mark = lambda kind, c: F.struct(F.col("class").alias("c"), F.lit(kind).alias("k"), F.col(c).cast("string").alias("n"))
    edges = rows.filter("attribute is not null").select(mark("method", "method").alias("u"), mark("attribute", "attribute").alias("v"))
    parts = connected(edges).filter("node.k = 'method'").select(F.col("node.c").alias("class"), F.col("node.n").alias("name"), "component")
    methods = rows.select("class", F.col("method").cast("string").alias("name")).distinct()
    met = methods.join(parts, ["class", "name"], "left")
    # counted once for each component, and once for each method without one
    return met.groupBy("class").agg(F.count(F.lit(1)).alias("n_methods"), (
        F.countDistinct("component") + F.count_if(F.col("component").isNull())).alias("groups"))


def god_objects(classes: DataFrame) -> DataFrame:
    """(class, n_methods, groups, reason) of the classes that are very large, or large and of several groups."""
    n, groups = F.col("n_methods"), F.col("groups")
    reason = F.when(n >= METHODS_HARD, "very large").when((n >= METHODS) & (groups >= GROUPS), "unrelated groups")
    return classes.withColumn("reason", reason).filter((n >= LEAST_METHODS) & F.col("reason").isNotNull())


def detected(imports: DataFrame, signatures: dict[str, dict[str, tuple[str, ...]]]) -> DataFrame:
    """(category, framework, n_files, confidence): files of ``imports`` (file, name) that import each framework.

    A framework's prefixes match the name itself and whatever is dotted below it. Names ask by all their prefixes, so
    the match is an equality with the short list of signatures.
    """
    spark: SparkSession = imports.sparkSession
    rows = [(c, f, p) for c, frameworks in signatures.items() for f, ps in frameworks.items() for p in ps]
    known = spark.createDataFrame(rows, "category string, framework string, prefix string")
    asked = imports.filter("name is not null").select("file", F.explode(prefixes(F.col("name"))).alias("prefix"))
    hits = asked.join(F.broadcast(known), "prefix").select("category", "framework", "file").distinct()      # as long as the code's own list
    return hits.groupBy("category", "framework").agg(F.count(F.lit(1)).alias("n_files")).withColumn(
        "confidence", F.least(F.round(0.5 + 0.1 * F.col("n_files"), 2), F.lit(0.99)))


def primary(found: DataFrame) -> DataFrame:
    """(category, framework): of each category the one that most files import, of equal ones the first by name."""
    best = F.min(F.struct((-F.col("n_files")).alias("n"), "framework"))
    return found.groupBy("category").agg(best.alias("b")).select("category", "b.framework")


def layer(module: Column) -> Column:
    """Number of the lowest layer that a dotted module has a segment of, null without one."""
    parts = F.split(F.replace(module, F.lit("::"), F.lit(".")), r"\.")
    return F.coalesce(*[F.when(F.arrays_overlap(parts, F.array(*map(F.lit, words))), k) for k, words in enumerate(LAYERS.values())])


def layer_violations(imports: DataFrame) -> DataFrame:
    """(importer, importee, line, importer_layer, importee_layer): imports of a strictly higher layer."""
    names = F.array(*map(F.lit, LAYERS))
    rows = imports.withColumns({"_a": layer(F.col("importer")), "_b": layer(F.col("importee"))}).filter("_a < _b and importer <> importee")
    return rows.select("importer", "importee", "line", F.get(names, F.col("_a")).alias("importer_layer"), F.get(names, F.col("_b")).alias("importee_layer"))
