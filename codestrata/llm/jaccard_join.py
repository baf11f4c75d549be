"""N-gram Jaccard join by a token-group matrix.

A document is the set of its word shingles, as 64-bit hashes. Equal sets are one from
the start. A set that reaches the threshold with another one misses few of its own
tokens there; so in any fixed sample of its tokens most must be found in some other set
as well, and sets for which that fails leave early. For the others:

* Sets whose tokens are held by more than CROWD sets are members of a large family. They are
  grouped under OTHER_KEYS further hashes and linked within these groups, so that a family
  has one name, but for few of its sets, before it meets the matrix.
* Similar sets are put into groups of some BLOCK, a family's by its name, others by their
  least token, and all links within a group are found.
* The matrix has a row for each token, group whose union holds it, and class of set sizes
  that hold it there. A set asks it for its rarest tokens, as many as it may miss and one
  more, in its own size class and the two beside it, and so gets every group that can hold a
  partner in another component.
* The set is sent to these groups. Where its overlap with the group's union, which
  bounds that with every member, is large enough, the group is opened and its members
  are compared.

So a family of near copies costs one row for each set outside its main component and
group, not one for each pair: its tokens are no other component's, and ask for nothing.
Components are joined over the links found.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .common import arrow_map, bit_filter, hash_texts, holds, raw, shingle_hashes
from .graphs import components

BLOCK = 400             # sets in a block, about
CROWD = 16              # sets that hold a token, from which on it is a family's
OTHER_KEYS = 3          # groups that a family's set is in before it meets the matrix
SAMPLE = 5              # a set's sample is as many tokens as it may miss, one, and so many percent of all


def need(n, percent: int):
    """Least overlap that a set of n tokens has with a linked one."""
    return -(-n * percent // 100)


def size_class(n: np.ndarray, percent: int) -> np.ndarray:
    """Class of a set's size; linked sets are at most one class apart."""
    # a little wider than the ratio of linked sizes, so that rounding doesn't part them
    return np.floor(np.log(np.maximum(n, 1)) / (max(np.log(100 / percent), 1e-3) * 1.0001)).astype(np.int64)


def token_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of texts; of fewer words than ``width`` all make one shingle."""
    return [np.unique(shingle_hashes(h, min(width, len(h)))) if len(h) else h
            for h in hash_texts([raw(t).lower() for t in texts])]


def _digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def profiles(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, digest) for every row."""
    def run(c):
        sets = token_sets(c["text"], width)
        return {"doc_id": c["doc_id"], "n": [len(s) for s in sets], "digest": [_digest(s) for s in sets]}

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, n long, digest binary")


def samples(docs: DataFrame, width: int, percent: int, maybe=None) -> DataFrame:
    """(doc_id, d, key, least, token): a fixed sample of every set; ``least`` of them must occur elsewhere.

    key is the set's least token. ``maybe``: a broadcast filter; tokens that it rules out are left out, and so are sets
    with fewer than ``least`` others.
    """
    def run(c):
        out = {k: [] for k in ("doc_id", "digest", "key", "least", "tokens")}
        for key, s in zip(c["doc_id"], token_sets(c["text"], width)):
            missing = len(s) - need(len(s), percent)
            took = s[:min(len(s), missing + 1 + len(s) * SAMPLE // 100)]
            least = len(took) - missing
            if maybe is not None:
                took = took[holds(maybe.value, took)]
                if len(took) < least:
                    continue
            for k, v in zip(out, (key, _digest(s), int(s[0]) if len(s) else None, least, took)):
                out[k].append(v)
        return out

    rows = arrow_map(docs.select("doc_id", "text").filter("doc_id is not null"), run,
                     "doc_id long, digest binary, key long, least int, tokens array<long>")
    return rows.select("doc_id", F.xxhash64("digest").alias("d"), "key", "least", F.explode("tokens").alias("token"))


def candidates(docs: DataFrame, leaders: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, d, key, crowded, others) of the sets that may have a partner of another content.

    crowded: as many of the set's sample tokens as a partner must have are a family's. others: its least tokens under further hashes.
    """
    shared = materialize(
        samples(docs, width, percent).groupBy("token").agg(
            F.min("d").alias("lo"), F.max("d").alias("hi"), (F.count(F.lit(1)) > CROWD).alias("crowd"))
        .filter("lo <> hi").select("token", "crowd"), "shared-tokens")
    maybe = docs.sparkSession.sparkContext.broadcast(bit_filter(shared, "token"))
    others = [F.min(F.xxhash64("token", F.lit(k))) for k in range(OTHER_KEYS)]
    found = samples(docs, width, percent, maybe).join(shared, "token").groupBy("doc_id", "d").agg(
        F.count(F.lit(1)).alias("hits"), F.first("least").alias("least"), F.first("key").alias("key"),
        F.count_if("crowd").alias("crowds"), F.array(*others).alias("others"))
    return found.filter("hits >= least").select("doc_id", "d", "key", (F.col("crowds") >= F.col("least")).alias("crowded"), "others").join(
        leaders, ["doc_id", "d"], "left_semi")


def link_block(docs: list[int], sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Component of every set of a block, named by the least doc_id in it."""
    k = len(sets)
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(k), size)
    _, col, count = np.unique(flat, return_inverse=True, return_counts=True)
    many = count > 1
    place = np.cumsum(many) - 1
    keep = many[col]
    owner, col = owner[keep], place[col[keep]]
    both = np.zeros((k, k), np.float32)
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    for at in range(0, int(many.sum()), 8192):
        a, b = np.searchsorted(col, [at, at + 8192])
        x = np.zeros((k, 8192), np.float32)
        x[owner[a:b], col[a:b] - at] = 1
        both += x @ x.T
    both = both.astype(np.int64)
    near = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    label = np.full(k, -1)
    for i in range(k):
        if label[i] >= 0:
            continue
        todo = [i]
        label[i] = i
        while todo:
            new = np.flatnonzero(near[todo.pop()] & (label < 0))
            label[new] = i
            todo += new.tolist()
    ids = np.array(docs, np.int64)
    least = np.full(k, np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids)
    return least[label]


def _sets(column) -> list[np.ndarray]:
    """Arrays of a list column without a Python object for each token."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, at = column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()
    return [flat[a:b] for a, b in zip(at[:-1], at[1:])]


def places(chosen: DataFrame) -> DataFrame:
    """``chosen`` with key, part and lead: sets of one least token, some BLOCK to a group.

    The key's first set is in all its groups (lead = true in all but its own), so that
    components which hold it get one name throughout.
    """
    sizes = chosen.groupBy("key").agg(F.min("doc_id").alias("first"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    home = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    every = F.when(F.col("doc_id") == F.col("first"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(home))
    dealt = chosen.join(sizes, "key").select("doc_id", "d", "key", home.alias("home"), F.explode(every).alias("part"))
    return dealt.select("doc_id", "d", "key", "part", (F.col("part") != F.col("home")).alias("lead"))


def placed_sets(docs: DataFrame, placed: DataFrame, width: int) -> DataFrame:
    """``placed`` with the tokens of every set. Only texts whose doc_id may be placed are shuffled."""
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(placed.select(F.xxhash64("doc_id").alias("id")), "id"))

    @F.pandas_udf("boolean")
    def may(ids: pd.Series) -> pd.Series:
        return pd.Series(holds(bits.value, ids.to_numpy()))

    texts = docs.select("doc_id", "text").filter("doc_id is not null").filter(may(F.xxhash64("doc_id")))
    texts = texts.join(placed.hint("merge"), "doc_id")     # the same at every size
    rest = [f for f in placed.schema if f.name != "doc_id"]

    def whole(c):
        sets = token_sets(c["text"], width)
        return {"doc_id": c["doc_id"], "digest": [_digest(s) for s in sets], "tokens": sets} | {f.name: c[f.name] for f in rest}

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString().replace('bigint', 'long')}" for f in rest)
    sets = arrow_map(texts, whole, f"doc_id long, {kinds}, digest binary, tokens array<long>")
    # a doc_id may have rows with other texts
    return sets.filter(F.xxhash64("digest") == F.col("d")).drop("digest", "d")


def family_links(sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): every set of a group with the least doc_id of its component there."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        docs = table["doc_id"].to_pylist()
        cid = link_block(docs, _sets(table["tokens"]), percent) if len(docs) > 1 else docs
        return pa.table({"u": pa.array(docs, pa.int64()), "v": pa.array(cid, pa.int64())})

    return sets.select("doc_id", "key", "part", "tokens").groupBy("key", "part").applyInArrow(run, "u long, v long").filter("u <> v")


def common_names(cid: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Least name of what is connected by equal ``cid`` or equal ``name``."""
    _, by_cid = np.unique(cid, return_inverse=True)
    _, by_name = np.unique(name, return_inverse=True)
    while True:
        least = name.copy()
        for by in (by_cid, by_name):
            of = np.full(by.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(of, by, least)
            least = of[by]
        if (least == name).all():
            return name
        name = least


def group_sets(sets: DataFrame, percent: int) -> DataFrame:
    """(doc_id, cid, key, part, tokens, matrix, sizes, lo, hi): every set with its component as its group knows it.

    ``sets`` have a name, equal for sets already known to be connected. One row of each group also has the group's row of the matrix: the union of its
    tokens by size class, each with the least and the greatest component that has it.
    """
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        docs, lead = table["doc_id"].to_pylist(), np.array(table["lead"].to_pylist())
        name = table["name"].to_numpy()
        cid = common_names(link_block(docs, _sets(table["tokens"]), percent), name) if len(docs) > 1 else name
        out = table.append_column("cid", pa.array(cid, pa.int64())).filter(pa.array(~lead)).select(
            ["doc_id", "cid", "key", "part", "tokens"])
        columns: dict[str, np.ndarray] = {n: np.zeros(0, np.int64) for n in ("matrix", "sizes", "lo", "hi")}
        if out.num_rows:
            own = _sets(out["tokens"])
            n = np.array([len(s) for s in own])
            flat, names, sizes = np.concatenate(own), np.repeat(out["cid"].to_numpy(), n), np.repeat(size_class(n, percent), n)
            order = np.lexsort((names, sizes, flat))
            flat, sizes, names = flat[order], sizes[order], names[order]
            first = np.flatnonzero(np.append(True, (flat[1:] != flat[:-1]) | (sizes[1:] != sizes[:-1])))
            last = np.append(first[1:], len(flat)) - 1
            columns = {"matrix": flat[first], "sizes": sizes[first], "lo": names[first], "hi": names[last]}
        for name, v in columns.items():
            out = out.append_column(name, pa.array(([v] + [None] * (out.num_rows - 1))[:out.num_rows], pa.list_(pa.int64())))
        return out

    return sets.groupBy("key", "part").applyInArrow(
        run, "doc_id long, cid long, key long, part int, tokens array<long>, matrix array<long>, sizes array<long>, lo array<long>, hi array<long>")


def narrowed(rows: DataFrame, maybe, column: str = "id") -> DataFrame:
    """Rows whose hash ``column`` a broadcast filter doesn't rule out; spares a shuffle, decides nothing."""
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(holds(maybe.value, batch[column].to_numpy())))

    return rows.mapInArrow(run, rows.schema)


def cross_links(grouped: DataFrame, percent: int) -> DataFrame:
    """(u, v): components of different groups that links join; enough of them, not all."""
    share = grouped.sparkSession.sparkContext.broadcast
    matrix = grouped.filter("matrix is not null").select("key", "part", F.explode(F.arrays_zip("matrix", "sizes", "lo", "hi")).alias("m")).select(
        F.col("m.matrix").alias("token"), F.col("m.sizes").alias("size"), "key", "part", "m.lo", "m.hi")
    group = F.xxhash64("key", "part")
    rare = matrix.groupBy("token").agg(
        F.min("lo").alias("least"), F.max("hi").alias("most"), F.count(F.lit(1)).alias("groups"), F.min(group).alias("one"), F.max(group).alias("other")
    ).filter("least <> most and one <> other").select("token", "groups")
    rare = materialize(rare, "shared-tokens")
    common = share(bit_filter(rare, "token"))
    shared = materialize(narrowed(matrix, common, "token").join(rare, "token"), "token-groups")
    by_group = shared.groupBy("key", "part").agg(
        F.collect_list("token").alias("asked"), F.collect_list("groups").alias("groups"))   # no longer than a group's union

    def may_ask(batches):
        for batch in batches:
            ok = [int(holds(common.value, t).sum()) >= need(len(t), percent) for t in _sets(batch["tokens"])]
            yield batch.filter(pa.array(ok, pa.bool_()))

    sets = grouped.select("doc_id", "cid", "key", "part", "tokens")
    held = sets.mapInArrow(may_ask, sets.schema).join(by_group, ["key", "part"]).select(
        "doc_id", "cid", "key", "part", "tokens", "asked", "groups")

    def probe(batches):
        """A set's tokens that other groups have too, rarest first; the rest it misses anywhere."""
        for batch in batches:
            rows = zip(*(batch[n].to_pylist() for n in ("doc_id", "cid", "key", "part")),
                       *(_sets(batch[n]) for n in ("tokens", "asked", "groups")))
            out = {k: [] for k in ("doc_id", "cid", "key", "part", "size", "token")}
            for doc, cid, key, part, tokens, asked, groups in rows:
                order = np.argsort(asked)
                asked, groups = asked[order], groups[order]
                at = np.searchsorted(asked, tokens)
                at[at == len(asked)] = 0
                ok = asked[at] == tokens
                known, n = tokens[ok], groups[at[ok]]
                least = need(len(tokens), percent)
                if len(known) < least:
                    continue
                took = known[np.lexsort((known, n))[:len(known) - least + 1]]
                for k, v in zip(out, (doc, cid, key, part, int(size_class(np.array(len(tokens)), percent)))):
                    out[k] += [v] * len(took)
                out["token"] += took.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out.values()], names=list(out))

    probes = materialize(held.mapInArrow(probe, "doc_id long, cid long, key long, part long, size long, token long"), "set-probes")
    targets = shared.select("token", "size", F.col("key").alias("to_key"), F.col("part").alias("to_part"), "lo")
    # Sets of one group ask together. A linked pair finds itself from either side, so the
    # side of the larger name asks.
    pairs = (
        probes.groupBy("key", "part", "size", "token").agg(F.max("cid").alias("cid"))
        .withColumn("size", F.explode(F.sequence(F.col("size") - 1, F.col("size") + 1))).join(targets, ["token", "size"])
        .filter("lo < cid and (key <> to_key or part <> to_part)")
        .groupBy("key", "part", "to_key", "to_part").agg(F.min("lo").alias("lo")))
    asks = materialize(
        probes.select("doc_id", "cid", "key", "part").distinct().join(pairs, ["key", "part"]).filter("lo < cid")
        .select("doc_id", "cid", "to_key", "to_part"), "asked-groups")
    askers = share(bit_filter(asks.select(F.xxhash64("doc_id").alias("id")), "id"))
    opened = share(bit_filter(asks.select(F.xxhash64("to_key", F.col("to_part").cast("int")).alias("id")), "id"))
    queries = asks.join(narrowed(grouped.select("doc_id", "tokens", F.xxhash64("doc_id").alias("id")), askers), "doc_id").select(
        F.col("to_key").alias("key"), F.col("to_part").cast("int").alias("part"), "cid", "tokens")

    def open_groups(left: pa.Table, right: pa.Table) -> pa.Table:
        u, v = [], []
        if left.num_rows and right.num_rows:
            members, names = _sets(left["tokens"]), left["cid"].to_numpy()
            sizes = np.array([len(s) for s in members])
            flat = np.concatenate(members)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], np.repeat(np.arange(len(members)), sizes)[order]
            union = np.unique(flat)
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while root.get(x, x) != x:
                    x = root[x]
                return x

            for cid, q in zip(right["cid"].to_pylist(), _sets(right["tokens"])):
                at = np.searchsorted(union, q)
                at[at == len(union)] = 0
                if (union[at] == q).sum() < need(len(q), percent):
                    continue
                lo, hi = np.searchsorted(flat, q, "left"), np.searchsorted(flat, q, "right")
                n = hi - lo
                take = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                both = np.bincount(owner[take], minlength=len(members))
                near = (100 * both >= percent * (sizes + len(q) - both)) & (names < cid)
                for other in np.unique(names[near]).tolist():
                    a, b = find(cid), find(other)
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        u.append(cid)
                        v.append(other)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    members = narrowed(grouped.select("key", "part", "cid", "tokens", F.xxhash64("key", "part").alias("id")), opened).drop("id")
    return members.groupBy("key", "part").cogroup(queries.groupBy("key", "part")).applyInArrow(open_groups, "u long, v long")


def join_documents(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    Two documents link when percent of their union is in their intersection. component_id
    is the least doc_id reachable over links, a document's own included. No words, empty
    or null text: no shingles and no link. A null doc_id: n_shingles as usual, component
    null, no link. Rows that repeat a doc_id are one node with several sets. Empty table:
    no rows. Further columns are ignored.
    """
    rows = materialize(profiles(docs, width), "set-profiles")
    full = rows.filter("doc_id is not null and n > 0").select("doc_id", "digest", F.xxhash64("digest").alias("d"))
    leads = full.groupBy("digest", "d").agg(F.min("doc_id").alias("lead"))
    leaders = leads.select(F.col("lead").alias("doc_id"), "d")

    chosen = materialize(candidates(docs, leaders, width, percent), "set-candidates")
    crowd = chosen.filter("crowded").select("doc_id", "d", F.explode("others").alias("key"))
    crowd = crowd.join(crowd.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "key", "left_semi").select("doc_id", "d", "key")
    links = family_links(placed_sets(docs, materialize(places(crowd), "family-places"), width), percent)
    families = components(links)
    named = chosen.select("doc_id", "d", "key").join(families.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    named = materialize(named.select("doc_id", "d", F.when(F.col("component").isNull(), F.col("key")).otherwise(F.xxhash64("component")).alias("key"), F.coalesce("component", "doc_id").alias("name")), "set-names")
    placed = materialize(places(named.drop("name")).join(named.select("doc_id", "name").distinct(), "doc_id"), "set-places")
    grouped = materialize(group_sets(placed_sets(docs, placed, width), percent), "set-groups")
    inner = grouped.select(F.col("doc_id").alias("u"), F.col("cid").alias("v"))
    # rows of one doc_id, and its copies of other sets, meet in their doc_id
    known = families.select(F.col("node").alias("u"), F.col("component").alias("v"))
    found = components(inner.unionByName(known).unionByName(cross_links(grouped, percent)).unionByName(
        full.join(leads, ["digest", "d"]).select(F.col("doc_id").alias("u"), F.col("lead").alias("v"))))
    return rows.join(found, rows["doc_id"] == found["node"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
