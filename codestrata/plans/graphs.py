"""Directed graphs as tables of edges (u, v): cycles, reach and connected parts.

Every loop is a sequence of joins with a frontier, the rows that changed in the round
before; what a round makes is a table in the shared folder, and a loop ends when a round
changes nothing. No node's edges are ever one row, and a component is only within one task where
what contraction leaves of it has at most WITHIN edges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize

WITHIN = 200_000        # edges up to which one task finds the cycles among them
PACK = 50_000           # edges that a task gets of such parts, about


def _clean(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").filter("u is not null and v is not null").distinct()


def spread(start: DataFrame, edges: DataFrame, best: dict[str, str], step: dict[str, str] | None = None) -> DataFrame:
    """Carry values along ``edges`` until none improves: (node, a column for each key of ``best``).

    ``start``: node and those columns. ``best`` says whether the "min" or "max" of a column counts, each by
    itself; ``step`` gives the SQL of a value one edge further, as itself where missing; null goes no further. Only nodes
    that improved in a round send their values on in the next one.
    """
    names, step = list(best), step or {}
    pick = lambda kind, c: (F.min if kind == "min" else F.max)(c)
    merged = lambda rows: rows.groupBy("node").agg(*[pick(best[c], c).alias(c) for c in names])
    known = materialize(merged(start.select("node", *names)), "spread")
    new = known
    while not new.isEmpty():
        sent = new.join(edges, new["node"] == edges["u"]).select(F.col("v").alias("node"), *[F.expr(step.get(c, c)).alias(c) for c in names])
        sent = merged(sent.filter(F.coalesce(*names).isNotNull())).select("node", *[F.col(c).alias(f"_{c}") for c in names])
        both = known.join(sent, "node", "full")
        values, better = [], F.lit(False)
        for c in names:
            keep = (F.least if best[c] == "min" else F.greatest)(c, f"_{c}")       # these pass over nulls
            values.append(keep.alias(c))
            better = better | ~keep.eqNullSafe(F.col(c))
        known = materialize(both.select("node", *values, better.alias("_new")), "spread")
        new, known = known.filter("_new").select("node", *names), known.select("node", *names)
    return known


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges less those at nodes that nothing leads to or that lead nowhere; these are on no cycle."""
    n = edges.count()
    while n:
        live = edges.select("u").intersect(edges.select("v")).select(F.col("u").alias("node"))
        left = edges.join(live, edges["u"] == live["node"], "left_semi").join(live, edges["v"] == live["node"], "left_semi")
        edges = materialize(left, "trimmed")
        n, before = edges.count(), n
        if n == before:
            break
    return edges


def strong(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, components) of the strongly connected components of more than one node, by Tarjan's search."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    n, a, b = len(nodes), ends[:len(u)], ends[len(u):]
    to = b[np.argsort(a, kind="stable")].tolist()
    at = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n))]).tolist()
    ends, seen, low, open_, of = at[1:], [0] * n, [0] * n, [], [-1] * n
    count = 0
    for start in range(n):
        if seen[start]:
            continue
        count += 1
        seen[start] = low[start] = count
        path = [start]
        open_.append(start)
        while path:
            x = path[-1]
            if at[x] < ends[x]:
                y = to[at[x]]
                at[x] += 1
                if not seen[y]:
                    count += 1
                    seen[y] = low[y] = count
                    path.append(y)
                    open_.append(y)
                elif of[y] < 0:
                    low[x] = min(low[x], seen[y])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[x])
            if low[x] == seen[x]:
                k = len(open_) - 1
                while open_[k] != x:
                    k -= 1
                most = max(open_[k:])
                for y in open_[k:]:
                    of[y] = most
                del open_[k:]
    of = np.array(of, np.int64)
    many = np.bincount(of, minlength=n)[of] > 1 if n else np.zeros(0, bool)
    return nodes[many], nodes[of[many]]


def _cycles_within(edges: DataFrame, packs: int) -> DataFrame:
    """(node, component) of ``edges`` (u, v, part) whose parts are small, many of them in a task."""
    def run(table: pa.Table) -> pa.Table:
        nodes, component = strong(table["u"].to_numpy(), table["v"].to_numpy())
        return pa.table({"node": pa.array(nodes, pa.int64()), "component": pa.array(component, pa.int64())})

    packed = edges.select("u", "v", F.pmod(F.xxhash64("part"), F.lit(packs)).alias("pack"))
    return packed.groupBy("pack").applyInArrow(run, "node long, component long")


def cycles(edges: DataFrame) -> DataFrame:
    """(node, component): nodes on a cycle, named by the greatest node that is mutually reachable.

    Strongly connected components of more than one node, and nodes with an edge to themselves. More than
    WITHIN edges are contracted first; the components of what is left are searched. Null ends are no edges.
    """
    every = materialize(_clean(edges.select(F.col("u").cast("long"), F.col("v").cast("long"))), "graph")
    loops = every.filter("u = v").select(F.col("u").alias("node"), F.col("u").alias("component"))
    core, merges = _contracted(every.filter("u <> v"))
    found = materialize(_expanded(_components(core), merges), "cycles")
    return found.unionByName(loops.join(found.select("node"), "node", "left_anti"))


def _contracted(edges: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(``edges`` between fewer nodes, a table for each round): nodes with one way on, or one way to them, become one with the node there.

    Whatever passes such a node passes the other, so reach between the nodes left stays as it is. A round merges
    nodes no two of which are neighbours and leaves out those that nothing leads to or that lead nowhere; chains shorten
    by a part in each. Its table says which node went where, and with what other neighbours: (x, y, w). Ends
    where few edges go.
    """
    n, merges = edges.count(), []
    while n > WITHIN:
        ends = edges.select(F.col("u").alias("node"), F.col("v").alias("to"), F.lit(None).cast("long").alias("by")).unionByName(
            edges.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("to"), F.col("u").alias("by")))
        marks = ends.groupBy("node").agg(F.count("to").alias("n_on"), F.count("by").alias("n_by")).filter("n_on > 0 and n_by > 0")
        marks = materialize(marks.select("node", F.expr("CASE WHEN n_on = 1 THEN 'on' WHEN n_by = 1 THEN 'by' ELSE 'no' END").alias("way")), "marks")
        side = lambda end: marks.select(F.col("node").alias(end), F.col("way").alias(f"way_{end}")).hint("merge")
        live = materialize(edges.join(side("u"), "u").join(side("v"), "v"), "live")
        rank = lambda end: F.struct(F.xxhash64(end, F.lit(len(merges))), end)
        later = live.filter("way_u <> 'no' and way_v <> 'no'").select(F.when(rank("u") < rank("v"), F.col("v")).otherwise(F.col("u")).alias("x")).distinct()
        moves = live.filter("way_u = 'on'").select(F.col("u").alias("x"), F.col("v").alias("y"), F.lit(True).alias("on")).unionByName(
            live.filter("way_v = 'by'").select(F.col("v").alias("x"), F.col("u").alias("y"), F.lit(False).alias("on")))
        moves = materialize(moves.join(later.hint("merge"), "x", "left_anti"), "moves")
        on, by = moves.filter("on").drop("on").hint("merge"), moves.filter("not on").drop("on").hint("merge")
        others = live.select(F.col("v").alias("x"), F.col("u").alias("w")).join(on, "x").unionByName(live.select(F.col("u").alias("x"), F.col("v").alias("w")).join(by, "x"))
        merges.append(materialize(others.select("x", "y", "w"), "merged"))
        goes = lambda end: moves.select(F.col("x").alias(end), F.col("y").alias(f"new_{end}")).hint("merge")
        moved = live.select("u", "v").join(goes("u"), "u", "left").join(goes("v"), "v", "left")
        edges = materialize(_clean(moved.select(F.coalesce("new_u", "u").alias("u"), F.coalesce("new_v", "v").alias("v")).filter("u <> v")), "contracted")
        n, before = edges.count(), n
        if n > 0.95 * before:
            break
    return edges, merges


def _expanded(found: DataFrame, merges: list[DataFrame]) -> DataFrame:
    """Components (node, component) of more than one node, named by their greatest node, after ``merges`` are taken back, the last one first.

    A merged node is in the component of the node it went to if another neighbour of it is.
    """
    if not merges:
        return found
    for merge in reversed(merges):
        of = lambda end: found.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")).hint("merge")
        held = merge.join(of("y"), "y", "left").join(of("w"), "w", "left").withColumn("component", F.coalesce("of_y", "y"))
        held = held.filter(F.col("component") == F.coalesce("of_w", "w"))
        back = held.select(F.explode(F.when(F.col("of_y").isNull(), F.array("x", "y")).otherwise(F.array("x"))).alias("node"), "component").distinct()
        found = materialize(found.unionByName(back), "expanded")
    names = found.groupBy("component").agg(F.max("node").alias("name"))
    return found.join(names.hint("merge"), "component").select("node", F.col("name").alias("component"))


def _components(edges: DataFrame) -> DataFrame:
    """Strongly connected components (node, component) of more than one node.

    No cycle leaves a connected part, and parts of at most WITHIN edges are searched within a task. From larger ones
    the component of their busiest node is taken, which mostly leaves small parts; what is still large goes by colours.
    """
    take, found = _by_pivots, None
    while True:
        small, large = _split(edges)
        got = _cycles_within(small, small.count() // PACK + 1)
        found = got if found is None else found.unionByName(got)
        if large.isEmpty():
            return materialize(found, "components")
        taken, edges = take(large)
        found, take = found.unionByName(taken), _by_colours


def _split(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``edges`` (u, v, part) of connected parts of at most WITHIN edges, and those of larger ones. So few edges are taken as one part."""
    if edges.count() <= WITHIN:
        owned = edges.select("u", "v", F.lit(0).cast("long").alias("part"))
        return owned, owned.limit(0)
    parts = connected(edges)
    owned = edges.join(parts.select(F.col("node").alias("u"), F.col("component").alias("part")).hint("merge"), "u")
    sizes = owned.groupBy("part").agg((F.count(F.lit(1)) <= WITHIN).alias("small"))
    owned = materialize(owned.join(sizes.hint("merge"), "part"), "part-edges")
    return owned.filter("small").drop("small"), owned.filter("not small").drop("small")


def _by_pivots(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The strongly connected component (node, component) of one node of each part, and the edges (u, v) left.

    What the node reaches and what reaches it is found in the same rounds; both together are its component. An
    edge between nodes that differ in either is on no cycle. The node with most ways through it is mostly in the largest
    component, without which a part falls apart.
    """
    ends = edges.select("part", F.col("u").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        edges.select("part", F.col("v").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    busy = ends.groupBy("part", "node").agg((F.sum("o") * F.sum("i")).alias("ways"))
    pivots = busy.groupBy("part").agg(F.max(F.struct("ways", "node"))["node"].alias("node"))
    ways = materialize(edges.select("u", "v", F.lit(True).alias("on")).unionByName(
        edges.select(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(False).alias("on"))), "ways")
    met = spread(pivots.select("node", F.lit(1).alias("after"), F.lit(1).alias("before")), ways, {"after": "max", "before": "max"},
                 {"after": "if(on, after, null)", "before": "if(on, null, before)"})
    core = edges.select("part", F.col("u").alias("node")).distinct().join(met.filter("after = 1 and before = 1").select("node"), "node", "left_semi")
    names = core.groupBy("part").agg(F.max("node").alias("component"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    side = lambda end: met.select(F.col("node").alias(end), F.struct("after", "before").alias(f"at_{end}")).hint("merge")
    sides = edges.join(side("u"), "u", "left").join(side("v"), "v", "left").filter(
        "at_u.after <=> at_v.after and at_u.before <=> at_v.before and not (at_u.after <=> 1 and at_u.before <=> 1)")
    return core.join(names, "part").select("node", "component"), materialize(sides.select("u", "v"), "parted")


def _by_colours(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Strongly connected components (node, component) of more than one node, one at least of every colour, and the edges (u, v) left.

    The edges are trimmed, the greatest node that reaches each node becomes its colour, and what
    reaches the node of its own colour inside the colour is that node's component. Edges
    between colours can be on no cycle and go, as do finished components.
    """
    left = _trimmed(edges.select("u", "v"))
    nodes = left.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    colour = spread(nodes.withColumn("colour", F.col("node")), left, {"colour": "max"})
    a, b = colour.select(F.col("node").alias("u"), F.col("colour").alias("cu")), colour.select(F.col("node").alias("v"), F.col("colour").alias("cv"))
    inside = materialize(left.join(a, "u").join(b, "v").filter("cu = cv").select("u", "v", F.col("cu").alias("colour")), "coloured")
    roots = inside.select(F.col("colour").alias("node")).distinct().withColumn("component", F.col("node"))
    back = spread(roots, inside.select(F.col("v").alias("u"), F.col("u").alias("v")), {"component": "max"})
    done = back.select("node")
    rest = inside.join(done, inside["u"] == done["node"], "left_anti").join(done, inside["v"] == done["node"], "left_anti")
    # a colour without an edge back to its root has the root alone
    sizes = back.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return back.join(sizes.select("component"), "component", "left_semi").select("node", "component"), materialize(rest.select("u", "v"), "uncoloured")


def connected(edges: DataFrame) -> DataFrame:
    """(node, component): parts connected in either direction, named by their least node.

    Each round a node takes the least label among itself and its neighbours, and labels are followed
    to their own labels, which halves long paths.
    """
    every = materialize(_clean(edges), "graph")
    both = materialize(every.unionByName(every.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "both-ways")
    label = materialize(both.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct(), "labels")
    while True:
        # merge joins: labels are small as files, and sent to the driver once in each round they'd be much in the end
        near = both.join(label.select(F.col("node").alias("v"), "component").hint("merge"), "v").select(F.col("u").alias("node"), "component", F.lit(None).alias("old"))
        least = near.unionByName(label.withColumn("old", F.col("component"))).groupBy("node").agg(F.min("component").alias("component"), F.max("old").alias("old"))
        of = label.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = least.join(of.hint("merge"), "component").select("node", F.col("further").alias("component"), (F.col("further") != F.col("old")).alias("_new"))
        new = materialize(new, "labels")
        label = new.select("node", "component")
        if new.filter("_new").isEmpty():
            return label


def reached(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, hops, tier): the fewest edges from any seed, and the worst tier among all that reach the node.

    ``seeds``: node, tier, the greater the worse. Semi-naive: a round only follows nodes that got nearer
    or worse in the one before.
    """
    # a table, as every round reads it
    return spread(seeds.select("node", F.lit(0).alias("hops"), "tier"), materialize(_clean(edges), "graph"), {"hops": "min", "tier": "max"}, {"hops": "hops + 1"})


def unused(nodes: DataFrame, edges: DataFrame, entry: DataFrame) -> DataFrame:
    """``nodes`` that no edge, from whatever node, leads to and that are no entry points (both: column node)."""
    called = edges.select(F.col("v").alias("node"))
    return nodes.join(called, "node", "left_anti").join(entry.select("node"), "node", "left_anti")
