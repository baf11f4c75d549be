"""Salvage of archives, ranked search and periodic runs against brute force; the queries with SQL against DuckDB."""

from __future__ import annotations

import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from codestrata.llm import catalog, lexical_search, periodic_runs, warc

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", list(catalog.R.sql))
def test_query_against_sql(spark, duck, name):
    got = catalog.R.functions[name](spark, SF)
    want = duck.execute(catalog.R.sql[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=repr) == sorted(want.fetchall(), key=repr)


# ---- archives ------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, holder long, record string"


def pages(spark, rows):
    """Pages with two more columns whose names clash with ones that the operator makes."""
    return spark.createDataFrame([(*r, 5, "x") for r in rows], PAGES)


def page_brute(rows):
    big = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if len(p) >= 1000 and i is not None:
            big[p] = max(big.get(p, i), i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        own = big.get(p, i) == i
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "response" if own else "revisit", None if own else big[p]))
    return sorted(out, key=repr)


ODD_PAGES = [(1, "http://a/\r\nx y", "x" * 1500), (2, "http://ä/", "x" * 1500), (3, None, None), (4, "", ""), (5, "u", "x" * 999),
             (6, "u", "x" * 999), (7, "u", "é" * 500), (8, "u", "é" * 500), (None, "u", "x" * 1500), (None, "u", "n" * 2000),
             (None, "u", "n" * 2000), (2, "u", "x" * 1500), (-9, "u", "WARC/1.1\r\n" + "x\x1f" * 700), (10, "u", "\r\n\r\n"),
             (11, "u", "y " * 300_000)]


def test_round_trip(spark):
    events = warc.round_trip(pages(spark, ODD_PAGES))
    assert sorted((tuple(r) for r in warc.page_rows(events).collect()), key=repr) == page_brute(ODD_PAGES)
    assert warc.gaps(events).count() == 0
    uris = {r.target_uri for r in warc.records(events).collect()}
    assert {"http://a/%0D%0Ax%20y", "http://ä/", None} <= uris


def test_shared_payload_hot_and_cold(spark):
    rows = [(i, "u", "h" * 1200) for i in range(1500)] + [(i, "u", f"{i % 700} " * 500) for i in range(2000, 3400)]
    got = warc.page_rows(warc.round_trip(pages(spark, rows)))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == page_brute(rows)


def test_no_pages(spark):
    assert warc.page_rows(warc.round_trip(pages(spark, []))).collect() == []


def test_files_are_gzip_by_record(spark, tmp_path):
    warc.write_archives(pages(spark, ODD_PAGES), f"file://{tmp_path}/w")
    held = b"".join(gzip.open(p).read() for p in tmp_path.glob("w/part-*"))
    assert held.count(b"WARC-Type: ") == len(ODD_PAGES)


def test_long_member_ends_in_zero():
    data = b"abc" * 6_000_000
    got = warc.member(data)
    assert got[-1] == 0 and gzip.decompress(got) == data


def damaged(kind):
    """(archive, ids of records that remain, [(offset, length, reason)])"""
    payloads = [b"p%d " % i * (i * 40) for i in range(1, 7)]
    plain = [warc.record(i, "http://x/", p, None) for i, p in enumerate(payloads)]
    parts = [warc.member(r) for r in plain] if kind.startswith("gz") else list(plain)
    if kind == "mixed":
        parts = [warc.member(r) if i % 2 else r for i, r in enumerate(plain)]
    at = np.cumsum([0] + [len(p) for p in parts])
    bad, reason = {2}, None
    if kind == "gz flip":
        body = bytearray(parts[2])
        body[len(body) // 2] ^= 0xFF
        parts[2], reason = bytes(body), "gzip member"
    elif kind == "gz noise between":
        parts[2] = b"\x1f\x8b\x08\x00noise\x1f\x8b" + parts[2]
        return b"".join(parts), [0, 1, 2, 3, 4, 5], [(int(at[2]), 11, "gzip member")]
    elif kind == "gz digest":
        parts[2], reason = warc.member(plain[2].replace(b"p3 p3", b"p3 p4", 1)), "block digest"
    elif kind == "gz cut off":
        whole = b"".join(parts)[:-7]
        return whole, [0, 1, 2, 3, 4], [(int(at[5]), len(parts[5]) - 7, "truncated")]
    elif kind in ("plain length", "mixed"):
        wrong = re.sub(rb"\r\nContent-Length: \d+\r\n\r\nHTTP", b"\r\nContent-Length: 17\r\n\r\nHTTP", plain[2])
        parts[2], reason = wrong, "length"
    elif kind == "plain longer than the archive":
        wrong = re.sub(rb"\r\nContent-Length: \d+\r\n\r\nHTTP", b"\r\nContent-Length: 999999999999\r\n\r\nHTTP", plain[2])
        parts[2], reason = wrong, "truncated"
    elif kind == "plain two in a row":
        bad, reason = {2, 3}, "version line"
        parts[2], parts[3] = b"w" + parts[2][1:], parts[3].replace(b"Content-Length", b"Content-Width", 2)
    elif kind == "all noise":
        return b"noise" * 100, [], [(0, 500, "version line")]
    elif kind == "empty":
        return b"", [], []
    length = sum(len(parts[k]) for k in bad)
    return b"".join(parts), [i for i in range(6) if i not in bad], [(int(at[2]), length, reason)]


KINDS = ["gz flip", "gz noise between", "gz digest", "gz cut off", "plain length", "plain longer than the archive",
         "plain two in a row", "mixed", "all noise", "empty"]


@pytest.mark.parametrize("kind", KINDS)
def test_salvage(kind):
    data, left, lost = damaged(kind)
    got = list(warc.salvage(data))
    assert [int(r["record_id"].rsplit(":")[-1]) for r in got if "record_type" in r] == left
    assert [(r["offset"], r["length"], r["reason"]) for r in got if "reason" in r] == lost
    assert sum(r["length"] for r in got) == len(data)       # every byte is in a record or a gap


def test_salvage_in_spark(spark, tmp_path):
    want = {}
    for k, kind in enumerate(KINDS):
        data, left, lost = damaged(kind)
        (tmp_path / f"a{k}").write_bytes(data)
        want[f"a{k}"] = (len(left), sorted(lost))
    events = warc.read_archives(spark, f"file://{tmp_path}")
    n, lost = Counter(), {}
    for r in warc.records(events).collect():
        n[r.archive.rsplit("/", 1)[1]] += 1
    for r in warc.gaps(events).collect():
        lost.setdefault(r.archive.rsplit("/", 1)[1], []).append((r.offset, r.length, r.reason))
    assert {k: (n[k], sorted(lost.get(k, []))) for k in want} == want


# ---- ranked search -------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))


def search_brute(docs, items):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for i, c in held:
            m = 75 + 25 * sum(c.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 12 * m))
                    for t in terms(text) if c[t])
            if s > 0:
                scored.append((-s, i is None, i))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item_id, k + 1, i, -s) for k, (s, _, i) in enumerate(scored[:20])]
    return sorted(out, key=repr)


def test_terms():
    every = "".join(chr(c) for c in range(0x300)) + "aB9 Ünï_x y z"
    assert [t.decode() for t in lexical_search.terms_of(every.encode())] == terms(every)


@pytest.mark.parametrize("entries,cells,block,slice_", [(1 << 21, 1 << 20, 256, 4 << 20), (300, 400, 1, 200)])
def test_search(spark, monkeypatch, entries, cells, block, slice_):
    """Also with many shards, trees, walks and slices."""
    for k, v in (("ENTRIES", entries), ("CELLS", cells), ("BLOCK", block), ("SLICE", slice_)):
        monkeypatch.setattr(lexical_search, k, v)
    rng = random.Random(8)
    voc = [f"w{k}" for k in range(60)] + ["Éa", "ñ"]
    say = lambda n: " ".join(voc[min(int(rng.expovariate(.08)), 61)] for _ in range(n))
    docs = [(i, say(rng.randint(1, 40))) for i in range(150)]
    docs += [(i + 200, docs[i][1]) for i in range(60)] + [(3, docs[3][1]), (None, docs[5][1]), (None, "w1 w9"), (400, None),
                                                         (401, ""), (402, " .. "), (403, say(20_000)), (404, "W1-w2")]
    items = [(k, say(rng.randint(1, 30))) for k in range(8)]
    items += [(8, None), (9, ""), (10, "unheard of"), (1, "w1 w1 W1 w59"), (None, "w2"), (11, " ".join(voc) * 3)]
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, item_id long, score long").repartition(5)
    q = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id long")
    got = sorted((tuple(r) for r in lexical_search.search(d, q).collect()), key=repr)
    want = search_brute(docs, items)
    # rows of one score whose doc_ids are equal or null are interchangeable
    assert got == want


def test_search_walk_skips(spark):
    """Bounds keep most documents from being scored once the best are known."""
    rng = np.random.default_rng(2)
    n = 20_000
    tf = (rng.random((n, 12)) < np.linspace(.01, .6, 12)).astype(np.int64)
    tf[:40] = 3
    doc, term = np.nonzero(tf)
    df = {t: int((tf[:, t] > 0).sum()) for t in range(12)}
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}
    shard = lexical_search.Shard(np.arange(n), np.ones(n, bool), np.full(n, 100), doc, term, tf[doc, term])
    best = lexical_search.Best()
    scored = shard.search(lexical_search.Item(list(range(12)), weight, df), best)
    assert best.ids.tolist() == list(range(20)) and scored < n / 10


@pytest.mark.parametrize("n_docs,n_items", [(0, 3), (3, 0), (0, 0)])
def test_search_empty(spark, n_docs, n_items):
    d = spark.createDataFrame([(i, "a b") for i in range(n_docs)], "doc_id long, text string")
    q = spark.createDataFrame([(i, "a") for i in range(n_items)], "item_id long, text string")
    assert lexical_search.search(d, q).collect() == []


# ---- periodic runs -------------------------------------------------------------------

def runs_brute(w):
    n, found = len(w), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def digest_brute(doc_id, w):
    runs = runs_brute(w)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join("%d,%d,%d\n" % r for r in runs).encode()),
            sha(b" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_runs_of_random_texts():
    rng = random.Random(1)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 8)):
            n, k = rng.choice([0, 3, 23, 24, 25, 30, 80, 200, 400]), rng.choice([1, 2, 2, 3, 20])
            w = [rng.randrange(k) for _ in range(n)]
            for _ in range(rng.randint(0, 3) if n else 0):
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randint(3, 10)
                for i in range(a, rng.randint(a, n)):
                    w[i] = w[a + (i - a) % p]
            texts.append(np.array(w, np.int64))
        for t, got in zip(texts, periodic_runs.runs_of(texts)):
            assert [tuple(r) for r in got.tolist()] == runs_brute(t.tolist())


@pytest.mark.parametrize("pairs,group", [(1 << 20, 1 << 18), (50, 100)])
def test_find_runs(spark, monkeypatch, pairs, group):
    monkeypatch.setattr(periodic_runs, "PAIRS", pairs)
    monkeypatch.setattr(periodic_runs, "WORDS", group)
    texts = [(1, "a b " * 30), (2, None), (3, ""), (4, " \n"), (5, "x " * 24), (6, "x " * 23), (7, "a b c " * 8 + "z " + "q " * 40),
             (8, "a " * 3000 + "b"), (7, "x " * 30), (None, "x " * 30), (None, None), (9, "é ß  " * 20), (10, "w" * 100_000)]
    d = spark.createDataFrame([(*r, 1, "z") for r in texts], "doc_id long, text string, runs long, collapsed string")
    got = periodic_runs.digests(periodic_runs.find_runs(d)).collect()
    want = [digest_brute(i, (t or "").encode().split()) for i, t in texts]
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)
    assert periodic_runs.find_runs(d.limit(0)).collect() == []


def test_periodic_query(spark):
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        w = (r.text or "").encode().split()
        h, n = zlib.crc32(str(r.doc_id).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p, o = 1 + (n - a) // (3 + g % 8), list(w)
            w = [o[i] if i < a else o[a + (i - a) % p] for i in range(n)]
        want.append(digest_brute(r.doc_id, w))
    got = catalog.R.functions["op13_periodic_runs"](spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_planted_keeps_odd_rows(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    d = spark.createDataFrame([(ids[0], None), (ids[1], " "), (ids[2], "one"), (None, "a b")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in periodic_runs.with_planted_periods(d).collect()}
    assert got[None] == "a b" and got[ids[2]] == "one" and not (got[ids[0]] or "").split() and not got[ids[1]].split()
