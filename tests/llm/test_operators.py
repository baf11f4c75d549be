"""The ten operators and the pipeline against brute force, on small hand-made tables and sf0.001."""

from __future__ import annotations

import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codestrata.llm import (bpe, catalog, decontaminate, jaccard_join, ppm, quality_model, quality_rules, sharding,
                            substrings, token_counts, toxicity)

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, kept string"


def table(spark, texts, schema=SCHEMA):
    """Documents with two more columns whose names clash with ones that operators make."""
    rows = [(i, t, None if t is None else "en", None, None if t is None else len(t), "x", "y") for i, t in texts]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, repeated rows, ties, a long text, copies and near copies."""
    rng = random.Random(5)
    voc = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(voc) for _ in range(n))
    base, long = say(60), say(3000)
    words = base.split()
    near = [" ".join(words[:k] + ["zz"] + words[k + 1:]) for k in (3, 30, 59)]
    texts = [(1, base), (2, base), (3, near[0]), (4, near[1]), (5, near[2]), (6, None), (7, ""), (8, " \n\t"),
             (9, long), (10, long + " " + base), (11, "a b c"), (12, "A  b\tC"), (13, "é ß ß"),
             (14, "!!! ||| ###"), (None, base), (15, say(40) + " " + " ".join(words[5:40])), (15, say(30)), (16, "a b")]
    return table(spark, texts), texts


def words(text):
    return (text or "").encode().split()


def docs_of(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def linked_components(texts, width, percent):
    sets = []
    for i, t in texts:
        w = (t or "").encode().lower().split()
        k = min(width, len(w))
        sets.append((i, {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if w else set()))
    low = {i: i for i, _ in sets if i is not None}
    changed = True
    while changed:
        changed = False
        for i, a in sets:
            for j, b in sets:
                if None not in (i, j) and a and b and 100 * len(a & b) >= percent * len(a | b) and low[i] != low[j]:
                    low[i] = low[j] = min(low[i], low[j])
                    changed = True
    return sorted(((i, len(s), low.get(i)) for i, s in sets), key=repr)


def test_jaccard_join(spark, odd):
    docs, texts = odd
    for width, percent in ((4, 85), (5, 80)):
        got = sorted((tuple(r) for r in jaccard_join.join_documents(docs, width, percent).collect()), key=repr)
        assert got == linked_components(texts, width, percent)


def test_jaccard_many_groups(spark, monkeypatch):
    """Near copies over several groups, with links that only the matrix finds."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(50)]
    texts = []
    for i in range(40):
        w = list(base)
        for _ in range(i % 4):
            w[rng.randrange(50)] = f"x{rng.randrange(30)}"
        texts.append((i, " ".join(w)))
    got = sorted((tuple(r) for r in jaccard_join.join_documents(table(spark, texts), 2, 80).collect()), key=repr)
    assert got == linked_components(texts, 2, 80)


@pytest.mark.parametrize("crowd", [1, 16])
def test_jaccard_families(spark, monkeypatch, crowd):
    """Large families of near copies, chains between them and sets beside them, in many small groups."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    monkeypatch.setattr(jaccard_join, "CROWD", crowd)
    rng = random.Random(crowd)
    texts = []
    for family in range(4):
        base = [f"w{family}.{i}" for i in range(60)]
        for _ in range(100):
            w = list(base)
            for _ in range(rng.randrange(5)):
                w[rng.randrange(60)] = f"x{rng.randrange(50)}"
            texts.append((len(texts) * 7 % 1000, " ".join(w)))
            base = w if rng.random() < .2 else base         # some families wander
    texts += [(2000 + i, f"a{i} b c d e f g h") for i in range(20)] + [(5, texts[3][1]), (3000, texts[3][1])]
    got = sorted((tuple(r) for r in jaccard_join.join_documents(table(spark, texts), 2, 80).collect()), key=repr)
    assert got == linked_components(texts, 2, 80)


def test_common_names():
    got = jaccard_join.common_names(np.array([1, 1, 3, 3, 5]), np.array([9, 7, 7, 2, 4]))
    assert got.tolist() == [2, 2, 2, 2, 4]


def removed(texts):
    wins = {}
    for i, t in texts:
        w = words(t)
        for j in range(len(w) - 12):
            if i is not None:
                k = tuple(w[j:j + 13])
                wins[k] = min(i, wins.get(k, i))
    out = []
    for i, t in texts:
        w = words(t)
        gone = {j + k for j in range(len(w) - 12) if i is not None and wins[tuple(w[j:j + 13])] < i for k in range(13)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_substrings(spark, odd):
    docs, texts = odd
    assert sorted((tuple(r) for r in substrings.digests(docs).collect()), key=repr) == removed(texts)
    assert {"lang", "kept", "digest", "dedup"} <= set(substrings.dedup(docs).columns)


def test_window_minima():
    rng = random.Random(1)
    segs = [[rng.choice("abc") for _ in range(rng.randint(4, 12))] for _ in range(60)]
    docs = np.array([rng.randint(0, 99) for _ in segs])
    got = substrings.window_minima(segs, docs, 4)
    for s, mins in zip(segs, got):
        for j, m in enumerate(mins):
            w = s[j:j + 4]
            assert m == min(d for t, d in zip(segs, docs) if any(t[k:k + 4] == w for k in range(len(t) - 3)))


def rules(t):
    t = t or ""
    w = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    wins = Counter(tuple(w[j:j + 8]) for j in range(len(w) - 7))
    rep = {j + k for j in range(len(w) - 7) if wins[tuple(w[j:j + 8])] > 1 for k in range(8)}
    n = len(w)
    return (n, sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep),
            n < 20 or 100 * len(rep) > 30 * n)


def test_quality_rules(spark, odd):
    docs, texts = odd
    more = [(90, "one two three four five six seven eight nine\n" * 3), (91, "a " * 30)]
    got = quality_rules.judge(table(spark, texts + more)).collect()
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(((r.doc_id, *(r[c] for c in cols)) for r in got), key=repr) == sorted(
        ((i, *rules(t)) for i, t in texts + more), key=repr)
    assert all(not r.kept for r in got if r.base_failed)
    assert all(r.kept for r in got if not r.base_failed)          # the group is too small for an estimate


def test_quality_outliers(spark):
    rng = random.Random(3)
    text = lambda size: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, size))) for _ in range(80))
    docs = table(spark, [(i, text(8)) for i in range(80)] + [(100 + i, text(8).replace(" ", "### ")) for i in range(8)])
    kept = {r.doc_id: r.kept for r in quality_rules.judge(docs).collect()}
    assert all(kept[i] for i in range(80)) and not any(kept[100 + i] for i in range(8))


def test_quality_small_groups(spark):
    """Groups with too few rows are judged by their language, and a language with too few by the whole table."""
    rng = random.Random(4)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(80))
    many = [(i, text(), "en", f"s{i % 40}", 0, "", "") for i in range(120)]
    few = [(200 + i, text(), f"l{i}", "s", 0, "", "") for i in range(3)]
    junk = [(300 + i, text().replace(" ", "### "), lang, "s1", 0, "", "") for i, lang in enumerate(["en", "l0", None])]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(many + few + junk, SCHEMA)).collect()}
    assert all(r.distance is not None for r in got.values()) and len(got) == 126
    assert {i for i, r in got.items() if not r.kept} == {300, 301, 302}


def test_quality_copies_of_junk(spark):
    """Copies of one poor document that are a third of a group, or nearly half, don't become its centre."""
    rng = random.Random(6)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(80))
    rows = []
    for source, copies in (("a", 40), ("b", 64)):
        poor = text().replace(" ", "### ")
        rows += [(len(rows) + i, text() if i < 80 else poor, "en", source, 0, "", "good" if i < 80 else "") for i in range(80 + copies)]
    kept = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(kept) == len(rows) and all(kept[r[0]] == (r[-1] == "good") for r in rows)


def test_sharding(spark, odd):
    docs, texts = odd
    got = sharding.assign_shards(docs, limit=2000).collect()
    assert len(got) == len(texts)
    held = Counter()
    for r in got:
        held[r.depth, r.prefix] += r.n_bytes
    for r in got:
        assert r.shard_bytes == held[r.depth, r.prefix] and (r.fits == (r.shard_bytes <= 2000))
        assert r.fits or r.depth == sharding.BITS
    # prefixes name disjoint parts
    parts = {(r.depth, r.prefix) for r in got}
    assert not any(a != b and a[0] <= b[0] and b[1] >> (b[0] - a[0]) == a[1] for a in parts for b in parts)


def test_bpe(spark, odd):
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(catalog.vocabulary())
    docs, texts = odd
    more = [(50, "a<|endoftext|>b <|startoftext|>"), (51, "ΑΣ İ ﬁ café's 123 中文")]
    for r in bpe.encode_documents(table(spark, texts + more), catalog.vocabulary()).collect():
        choices = [theirs.encode(t or "", add_special_tokens=False).ids for i, t in texts + more if i == r.doc_id]
        assert r.ids in choices and r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(r.ids)}I", *r.ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(theirs.decode(r.ids, skip_special_tokens=False).encode()).hexdigest()
    ids = spark.createDataFrame([(1, [518, 49407]), (2, None)], "doc_id long, ids array<int>")
    assert sorted(map(tuple, bpe.decode_ids(ids, catalog.vocabulary()).collect())) == [(1, "the</w> <|endoftext|>"), (2, "")]


def test_token_counts(spark, odd):
    docs, texts = odd
    vocab = set(bpe.automaton(catalog.vocabulary()).ids)

    def greedy(w):
        s, i, n = w.decode("latin-1").translate(token_counts.BYTES), 0, 0
        while i < len(s):
            i = next(j for j in range(len(s), i, -1) if s[i:j] + ("</w>" if j == len(s) else "") in vocab)
            n += 1
        return n

    want = sorted(((i, len(w), sum(map(greedy, w))) for i, t in texts for w in [words((t or "").lower())]), key=repr)
    assert sorted((tuple(r) for r in token_counts.count_pieces(docs, catalog.vocabulary()).collect()), key=repr) == want


def test_ppm(spark):
    texts, c = docs_of(spark), Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            c.update([*(t or "").encode().lower().split(), None])
    total, distinct = sum(c.values()), len(c)
    for r in catalog.op7_ppm_scoring(spark, SF).collect():
        w = [*(texts[r.doc_id] or "").encode().lower().split(), None]
        base = sum(math.log10((c[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in c for x in w), total)
        assert r.base_score == pytest.approx(base) and r.score <= 0


def test_ppm_is_a_distribution(spark, odd):
    docs, _ = odd
    coder = ppm.Coder(*ppm.train(docs, F.lit(True)))
    assert np.allclose((10.0 ** coder.long.astype(float)).sum(1), 1, atol=1e-4)
    some = 10.0 ** coder.short.reshape(-1, 256)[[0, 97 << 8 | 98, 32 << 8 | 97, 65535]].astype(float)
    assert np.allclose(some.sum(1), 1, atol=1e-4)
    assert len(ppm.score_documents(docs, F.lit(False)).collect()) == docs.count()


def ppm_scores(texts):
    """Every context of three bytes and less is kept; probabilities straight from the definition."""
    tries = [{} for _ in range(4)]
    for t in texts:
        b = b"\0\0\0" + (t or "").encode().lower()
        for i in range(3, len(b)):
            for k in range(4):
                tries[k].setdefault(b[i - k:i], Counter())[b[i]] += 1

    def spread(context):
        lower = spread(context[1:]) if context else [1 / 256] * 256
        n = tries[len(context)].get(context)
        if not n:
            return lower
        room, left = sum(n.values()) + len(n), sum(p for x, p in enumerate(lower) if x not in n)
        return [n[x] / room if x in n else lower[x] / left * len(n) / room for x in range(256)]

    known = {}

    def score(t):
        b = b"\0\0\0" + (t or "").encode().lower()
        for i in range(3, len(b)):
            known.setdefault(b[i - 3:i], None)
            known[b[i - 3:i]] = known[b[i - 3:i]] or spread(b[i - 3:i])
        return sum(math.log10(known[b[i - 3:i]][b[i]]) for i in range(3, len(b)))

    return score


@pytest.mark.parametrize("hot", [None, 3, 40])
def test_ppm_keeps_every_context(spark, odd, monkeypatch, hot):
    """A language that another one outweighs keeps its long contexts, and so do all that stay in the table."""
    if hot:
        monkeypatch.setattr(ppm, "HOT", hot)
    texts = [(100, "the cat sat on the mat " * 6000), (101, "zwölf boxkämpfer jagen viktor"), (102, None), (103, "")]
    texts += [(i, t) for i, t in odd[1] if i is not None and i < 15]
    asked = [(200, "zwölf boxkämpfer qu\x7f"), (201, "the dog sat"), (202, "ж")]
    score = ppm_scores([t for _, t in texts])
    got = ppm.score_documents(table(spark, texts + asked), F.col("doc_id") < 200).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in texts + asked)
    for r in got:
        assert r.score == pytest.approx(score(dict(texts + asked)[r.doc_id]), rel=1e-4, abs=1e-4)


def test_decontamination(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rng, texts, want = random.Random(4), [], set()
    for k in range(60):
        item, text = items[k % len(items)]
        s = list(text)
        for _ in range(len(text) * 8 // 100):
            s[rng.randrange(len(s))] = rng.choice("abcdefgh")
        texts.append((k, "some words before it " + "".join(s) + " and after"))
        want.add((k, item))
    texts += [(100, None), (101, ""), (102, "and the of in to")]
    bench = spark.createDataFrame([*items, (900, None), (901, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_items(table(spark, texts), bench).collect()}
    norm = [(i, b" ".join(words((t or "").lower()))) for i, t in texts]
    exact = {(i, k) for i, t in norm for k, x in items for y in [b" ".join(words(x.lower()))]
             if decontaminate.search(y, t, len(y) * decontaminate.MAX_EDITS // 100) <= len(y) * decontaminate.MAX_EDITS // 100}
    assert want <= exact and got <= exact and len(got & exact) >= 0.9 * len(exact)


@pytest.mark.parametrize("name,label,by,rest", [("op2_toxicity", "toxic", 5, 0), ("op10_quality_classifier", "quality", 4, 2)])
def test_classifiers(spark, name, label, by, rest):
    got = catalog.R.functions[name](spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r[label] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % by == rest) and 0 <= r.score <= 1 for r in got)
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.9 * len(held)


def test_classifiers_take_odd_rows(spark, odd):
    docs, texts = odd
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for some in (labels, none):
        model = quality_model.train(docs, some, F.lit(True))
        assert quality_model.score_documents(docs, model).count() == len(texts)
        model = toxicity.train(docs, some, F.lit(True))
        assert toxicity.score_documents(docs, model).count() == len(texts)


def test_empty_tables(spark):
    import corpus_pipeline

    docs = table(spark, [])
    assert jaccard_join.join_documents(docs).count() == 0
    assert substrings.digests(docs).count() == 0
    assert quality_rules.judge(docs).count() == 0
    assert sharding.assign_shards(docs).count() == 0
    assert ppm.score_documents(docs, F.lit(True)).count() == 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_pipeline_stages(spark, odd):
    import corpus_pipeline

    docs, texts = odd
    stages = dict(corpus_pipeline.STAGES)
    low = dict((i, c) for i, _, c in linked_components(texts, 5, 80))
    left = stages["ngram_jaccard_join"](spark, docs, SF)
    assert left.columns == docs.columns
    assert sorted((r.doc_id for r in left.collect()), key=repr) == sorted([None, *{i for i, c in low.items() if i is not None and c == i}], key=repr)
    cut = stages["substring_dedup"](spark, docs, SF)
    n = Counter((i, k) for i, w, k, _ in removed(texts))
    gone = sum(1 for i, w, k, _ in removed(texts) if k and k == w)
    assert cut.columns == docs.columns and cut.count() == len(texts) - gone and n
    final = corpus_pipeline.run(spark, SF)
    assert final.count() > 0 and "ids" in final.columns
