"""How much the functions of a module hang together: the share of pairs that touch an identifier in common.

Pairs are counted and not listed where an identifier is common: the HEAVY most frequent identifiers of a
module become bits, functions are counted by their bits, and the pairs that share none of them follow from
sums over subsets of the bits. Only pairs through rarer identifiers are listed, once each, and counted where
they share no common one. So a module in which all functions touch the same thing costs a row for
each function. That is for modules that touch more than SMALL identifiers; the pairs of the others are listed, in
tables of many modules.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize
from .batches import by_key, codes, parted

HEAVY = 12          # identifiers of a module that are bits
SMALL = 256         # identifiers, with repeats, that a module's functions touch, up to which its pairs are listed


def disjoint_pairs(bits: np.ndarray, counts: np.ndarray) -> int:
    """Number of unordered pairs whose bits have nothing in common, ``counts`` functions having each of ``bits``."""
    subsets = np.zeros(1 << HEAVY, np.int64)
    np.add.at(subsets, bits, counts)
    for k in range(HEAVY):          # sums over all subsets, one bit after another
        view = subsets.reshape(-1, 2, 1 << k)
        view[:, 1] += view[:, 0]
    whole = sum(int(n) * int(subsets[~b & ((1 << HEAVY) - 1)]) for b, n in zip(bits.tolist(), counts.tolist()))
    none = int(counts[bits == 0].sum())        # a function without bits meets itself, too
    return (whole - none) // 2


def listed(table: pa.Table) -> pa.Table:
    """(module, n_functions, pairs, connected) of small modules; ``table``: module, function, identifiers."""
    module, names = codes(table["module"])
    function, _ = codes(table["function"])
    functions, of_row = np.unique(module * (function.max() + 1) + function, return_inverse=True)
    module_of = functions // (function.max() + 1)
    lists = table["identifiers"].combine_chunks()
    identifier, _ = codes(lists.flatten())
    holder = of_row[pc.list_parent_indices(lists).to_numpy()]
    holder, identifier = holder[identifier >= 0], identifier[identifier >= 0]
    n = np.bincount(module_of, minlength=len(names))
    connected = np.zeros(len(names), np.int64)
    if len(identifier):
        # once for each function, in groups of one module and identifier
        width = int(identifier.max()) + 1
        held = np.unique((module_of[holder] * width + identifier) * len(functions) + holder)
        group, holder = np.divmod(held, len(functions))
        end = np.searchsorted(group, group, "right")
        after = end - np.arange(len(group)) - 1
        left = np.repeat(np.arange(len(group)), after)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(after) - after, after)
        pairs = np.unique(holder[left] * len(functions) + holder[right])
        connected = np.bincount(module_of[pairs // len(functions)], minlength=len(names))
    return pa.table({"module": names, "n_functions": n, "pairs": n * (n - 1) // 2, "connected": connected})


def modules(touched: DataFrame) -> DataFrame:
    """(module, n_functions, pairs, connected, cohesion) of ``touched`` (module, function, identifier or the array identifiers).

    Modules with one function have a cohesion of 1. A null identifier is none; rows with a null module or function are
    left out; repeated rows count once.
    """
    what = "identifiers" if "identifiers" in touched.columns else F.array("identifier").alias("identifiers")
    rows = touched.select("module", "function", what).filter("module is not null and function is not null")
    small, large = parted(rows, "module", F.greatest(F.size("identifiers"), F.lit(1)), SMALL)
    kind = rows.schema["module"].dataType.simpleString()
    out = by_key(small, "module", listed, f"module {kind}, n_functions bigint, pairs bigint, connected bigint")
    if large is not None:
        out = out.unionByName(_counted(large.select("module", "function", F.explode_outer("identifiers").alias("identifier"))))
    return out.withColumn("cohesion", F.when(F.col("pairs") == 0, 1.0).otherwise(F.col("connected") / F.col("pairs")))


def _counted(touched: DataFrame) -> DataFrame:
    """(module, n_functions, pairs, connected) of modules of any size."""
    rows = materialize(touched.distinct(), "touched")
    sizes = rows.filter("identifier is not null").groupBy("module", "identifier").agg(F.count(F.lit(1)).alias("holders")).filter("holders > 1")
    by = Window.partitionBy("module").orderBy(F.desc("holders"), "identifier")
    # Spark keeps the most frequent ones of each task before they are shuffled
    heavy = sizes.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= HEAVY).select("module", "identifier", (F.col("place") - 1).alias("bit"))
    heavy = materialize(heavy, "heavy-identifiers")
    bit = F.when(F.col("bit").isNotNull(), F.expr("shiftleft(1, bit)")).otherwise(0)
    marked = materialize(rows.join(heavy, ["module", "identifier"], "left").groupBy("module", "function").agg(F.bit_or(bit).alias("bits")), "function-bits")

    def count(table: pa.Table) -> pa.Table:
        bits, counts = table["bits"].to_numpy(), table["n"].to_numpy()      # as many rows as there are sets of bits, at most
        n = int(counts.sum())
        return pa.table({"module": table["module"].slice(0, 1), "n_functions": [n], "pairs": [n * (n - 1) // 2],
                         "apart": [disjoint_pairs(bits, counts)]})

    kind = rows.schema["module"].dataType.simpleString()
    whole = marked.groupBy("module", "bits").agg(F.count(F.lit(1)).alias("n")).groupBy("module").applyInArrow(
        count, f"module {kind}, n_functions bigint, pairs bigint, apart bigint")
    rare = rows.join(sizes.select("module", "identifier"), ["module", "identifier"]).join(heavy, ["module", "identifier"], "left_anti")
    held = materialize(rare.join(marked, ["module", "function"]), "rare-identifiers")
    other = held.select("module", "identifier", F.col("function").alias("other"), F.col("bits").alias("other_bits"))
    light = held.join(other, ["module", "identifier"]).filter("function < other and (bits & other_bits) = 0").select(
        "module", "function", "other").distinct().groupBy("module").agg(F.count(F.lit(1)).alias("light"))
    out = whole.join(light, "module", "left").withColumn("connected", F.col("pairs") - F.col("apart") + F.coalesce("light", F.lit(0)))
    return out.select("module", "n_functions", "pairs", "connected")
