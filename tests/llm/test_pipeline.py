"""The whole pipeline on a hand-made table against brute force of its stages; hashes of long words."""

from __future__ import annotations

import hashlib
import random
import struct

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from codestrata.llm import catalog, common, decontaminate, jaccard_join, quality_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(11)
    voc = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(600)]
    say = lambda n: " ".join(rng.choice(voc) for _ in range(n))
    items = [(1, say(30)), (2, say(25)), (3, None), (4, "")]
    base, shared = say(80), say(30)
    words = base.split()
    near = [" ".join(words[:k] + ["zz"] + words[k + 1:]) for k in (0, 79)]
    rows = [(i, say(60 + i)) for i in range(20, 60)]
    rows += [(1, base), (2, base), (3, near[0]), (4, near[1]), (5, "too short"), (6, None), (7, ""), (8, "# " * 300 + say(30)),
             (9, say(40) + " " + shared), (10, shared + " " + say(40)), (11, say(30) + " " + items[0][1] + " " + say(30)),
             (12, say(20) + " " + items[1][1][1:-1] + "q " + say(20)), (70, say(50)), (70, say(50)), (70, "junk"), (71, say(45)), (71, "junk"),
             (None, say(50)), (None, "one"), (None, base), (None, say(30) + " " + items[0][1]), (72, shared)]
    return [(i, t, rng.choice(["en", "en", None]), rng.choice(["web", None]), None if t is None else len(t)) for i, t in rows], items


def expected(rows, verdicts, items):
    docs = [r for r, kept in zip(rows, verdicts) if kept]
    # near duplicates: rows of one doc_id are one document
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[j:j + 5]) for j in range(len(w) - 4)} or {tuple(w)}

    known = [(r[0], shingles(r[1])) for r in docs if r[0] is not None]
    low = {i: i for i, _ in known}
    for _ in known:
        for i, a in known:
            for j, b in known:
                if 100 * len(a & b) >= 80 * len(a | b):
                    low[i] = low[j] = min(low[i], low[j])
    docs = [r for r in docs if r[0] is None or low[r[0]] == r[0]]
    return docs


def cut(docs):
    wins = {}
    for i, t in docs:
        w = t.split()
        for j in range(len(w) - 12):
            if i is not None:
                wins[tuple(w[j:j + 13])] = min(i, wins.get(tuple(w[j:j + 13]), i))
    out = []
    for i, t in docs:
        w = t.split()
        gone = {j + k for j in range(len(w) - 12) if i is not None and wins[tuple(w[j:j + 13])] < i for k in range(13)}
        if not gone:
            out.append((i, t))
        elif len(gone) < len(w):
            out.append((i, " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def test_run(spark, tmp_path):
    rows, items = corpus()
    theirs = Tokenizer.from_file(catalog.vocabulary())
    sha = lambda t: hashlib.sha256(struct.pack(f"<{len(x := theirs.encode(t, add_special_tokens=False).ids)}I", *x)).hexdigest()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "1" / "benchmark.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "7" / "benchmark.parquet"))
    numbered = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, " + SCHEMA)
    verdict = {r.doc_id: r.kept for r in quality_rules.judge(numbered.drop("doc_id"), key="k").collect()}
    docs = expected(rows, [verdict[k] for k in range(len(rows))], items)
    results = []
    for parts in (1, 7):
        numbered.drop("k").repartition(parts).write.parquet(str(tmp_path / str(parts) / "documents.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / str(parts))).collect()
        results.append(sorted((r.doc_id is None, r.doc_id or 0, r.ids_sha256) for r in got))
    assert results[0] == results[1]             # neither order nor partitions count
    # of the two texts of document 70 one stays, whichever comes first by its hash
    twice = [r for r in docs if r[0] == 70]
    assert len(twice) == 2 and not any(r[1] == "junk" for r in docs)
    held = [decontaminate.Items([(i, t)]) for i, t in items if t]
    wants = []
    for one in twice:
        kept = cut([(r[0], r[1]) for r in docs if r[0] != 70 or r is one])
        kept = [(i, t) for i, t in kept if not any(h.matches([t]) for h in held)]
        wants.append(sorted((i is None, i or 0, sha(t)) for i, t in kept))
    assert results[0] in wants
    ids = [i for n, i, _ in results[0] if not n]
    assert len(ids) == len(set(ids)) and {70, 71, 1} <= set(ids) and not {2, 3, 4, 5, 8, 11, 12} & set(ids)
    assert sum(n for n, _, _ in results[0]) == 2        # of four rows without an id one is too short and one holds an item


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("_row", F.lit(1)).withColumn("kept", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs.drop("_row"), str(tmp_path))
        assert got.columns == docs.drop("_row").columns, name
        assert stage(spark, docs.drop("_row").limit(0), str(tmp_path)).count() == 0, name
    last = corpus_pipeline.STAGES[-1][1](spark, docs.drop("_row"), str(tmp_path))
    assert last.count() == len(rows)


def test_words_longer_than_the_hash_table(spark):
    """Words of the same letters at places a thousand apart are different words."""
    pairs = [(b"a" + b"x" * 1023 + b"b", b"b" + b"x" * 1023 + b"a"), (b"x" * 2048 + b"ab", b"x" * 1024 + b"ab" + b"x" * 1024),
             (b"q" * 5000, b"q" * 5001)]
    for a, b in pairs:
        x, y = common.hash_texts([a, b])
        assert len(x) == len(y) == 1 and x[0] != y[0]
        assert common.hash_texts([b"w " + a])[0][1] == x[0]
    docs = spark.createDataFrame([(k, w.decode()) for k, p in enumerate(pairs[:2]) for w in p], "n long, text string")
    docs = docs.select(F.monotonically_increasing_id().alias("doc_id"), "text")
    assert all(r.doc_id == r.component_id for r in jaccard_join.join_documents(docs, 4, 85).collect())


def test_long_words_count_apart(spark):
    from codestrata.llm import ppm

    docs = [(1, "a" + "x" * 1023 + "b"), (2, "b" + "x" * 1023 + "a")]
    got = {r.doc_id: r.n_known for r in ppm.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), F.col("doc_id") == 1).collect()}
    assert got == {1: 2, 2: 1}          # the end is known, the other document's word isn't


def test_items_with_spread_and_clustered_edits():
    """Edits in every other or third word, in one place, at random; within the limit by the exact search."""
    rng = random.Random(3)
    voc = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    items = [(k, " ".join(rng.choice(voc) for _ in range(rng.randint(15, 50)))) for k in range(80)]
    held = decontaminate.Items(items)

    def spread(text, every):
        w = text.split()
        for k in range(0, len(w), every):
            at = rng.randrange(len(w[k]))
            w[k] = w[k][:at] + "z" + w[k][at + 1:]
        return " ".join(w)

    def clustered(text):
        n = len(text) * 12 // 100
        at = rng.randrange(len(text) - n)
        return text[:at] + "z" * n + text[at + n:]

    def scattered(text):
        s = list(text)
        for _ in range(len(s) * 10 // 100):
            s[rng.randrange(len(s))] = rng.choice("xyz")
        return "".join(s)

    for name, edit in (("every other", lambda t: spread(t, 2)), ("every third", lambda t: spread(t, 3)), ("one place", clustered), ("anywhere", scattered)):
        texts = [(k, f"words before {edit(t)} words behind") for k, t in items]
        near = [(k, x) for k, x in texts if decontaminate.search(y := " ".join(dict(items)[k].split()).encode(), x.encode(), len(y) * 15 // 100) <= len(y) * 15 // 100]
        got = {(p, k) for p, k, _ in held.matches([x for _, x in near])}
        assert len(near) > 40 and sum((p, k) in got for p, (k, _) in enumerate(near)) >= 0.9 * len(near), name


@pytest.mark.parametrize("pairs", [1, 1 << 36])
def test_no_pair_within_the_limit_is_lost(monkeypatch, pairs):
    """Every pair of a text and an item that the exact search finds, with its distance: a letter changed in every word, short items, items at the ends."""
    rng = random.Random(8)
    voc = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(voc) for _ in range(n))
    items = [(k, say(rng.choice([1, 2, 3, 5, 8, 20, 40]))) for k in range(60)] + [(100, "q"), (101, "zq"), (102, "x z"), (103, "")]
    texts = [None, "", "q", "a q b", say(300)]
    for _, t in items[:60]:
        s = [w[:k] + "z" + w[k + 1:] for w in t.split() for k in [rng.randrange(len(w))]]      # a letter of each word
        most = len(t) * 15 // 100
        cut = list(t)
        for _ in range(most):               # as many edits as the limit allows, of all three kinds
            at = rng.randrange(len(cut))
            cut[at:at + 1] = rng.choice([[], ["z"], [cut[at], "z"]])
        texts += [" ".join(s), say(5) + " " + " ".join(s) + " " + say(5), "".join(cut), say(3) + "  " + "".join(cut).upper() + "\n" + say(4), t[most:]]
    monkeypatch.setattr(decontaminate, "PAIRS", pairs, raising=False)
    held = decontaminate.Items(items)
    norm = lambda t: " ".join((t or "").lower().split()).encode()
    want = []
    for p, t in enumerate(texts):
        for k, x in items:
            if x:
                most = len(norm(x)) * 15 // 100
                far = decontaminate.search(norm(x), norm(t), most)
                want += [(p, k, far)] if far <= most else []
    assert len(want) > 250 and sorted(held.matches(texts)) == want
    assert {p for p, _, _ in held.matches(texts, every=False)} == {p for p, _, _ in want}


def test_a_copy_is_searched_once_and_in_little_more_than_its_place():
    """The cost of the exact search: one window for a copy, with room for the edits on either side."""
    rng = random.Random(4)
    say = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(n))
    items = [(k, say(rng.randint(15, 50))) for k in range(40)]
    held = decontaminate.Items(items)
    texts = [f"{say(rng.randint(1, 60))} {t} {say(60)}".encode() for _, t in items]
    found = held.windows(texts)
    assert [(p, i) for p, i, _, _, _ in found] == [(k, k) for k in range(40)]
    assert all(end - start <= len(items[k][1]) + 3 * held.most[k] for k, _, _, start, end in found)


def test_hits_are_counted_across_parts_of_a_long_text(monkeypatch):
    """Copies anywhere in texts that are longer than what is counted at a time, and short texts among them."""
    rng = random.Random(6)
    say = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(n))
    items = [(k, say(rng.choice([2, 10, 30]))) for k in range(30)]
    edited = lambda t: "".join(c if rng.random() > 0.08 else "z" for c in t)
    long = lambda: " ".join(x for _, t in rng.sample(items, 20) for x in (say(rng.randint(0, 60)), edited(t)))
    texts = [long(), "", say(3), items[3][1], long(), long(), edited(items[5][1])]
    monkeypatch.setattr(decontaminate, "CHUNK", 1, raising=False)
    monkeypatch.setattr(decontaminate, "ASKED", 3, raising=False)
    want = []
    for p, t in enumerate(texts):
        t = " ".join(t.split()).encode()
        for k, x in items:
            most = len(x) * 15 // 100
            far = decontaminate.search(x.encode(), t, most)
            want += [(p, k, far)] if far <= most else []
    assert len(want) > 50 and decontaminate.Items(items).matches(texts) == want


def test_filters_are_as_large_as_their_keys_need(spark):
    """A filter holds all its keys and few others, and few keys have a small one."""
    for n, most in ((0, 1 << 10), (1000, 1 << 17), (300_000, 1 << 25)):
        keys = spark.range(n).select(F.xxhash64("id").alias("h"))
        own = keys.toPandas()["h"].to_numpy().astype("int64")
        bits = common.bit_filter(keys, "h")
        other = spark.range(n, n + 100_000).select(F.xxhash64("id").alias("h")).toPandas()["h"].to_numpy()
        assert common.holds(bits, own).all() and common.holds(bits, other).mean() < 0.04
        assert 32 * len(bits) <= most
