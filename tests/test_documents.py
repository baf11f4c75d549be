"""Duplicate groups against the rule on every pair of files, on hand-made files that the given tables don't have."""

import random
from collections import Counter

import pytest

from codestrata.catalog import documents
from codestrata.plans import duplicates


def test_totals_without_duplicates(spark, tmp_path):
    spark.createDataFrame([(1, "a\nb")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [tuple(r) for r in documents.duplicate_totals(spark, str(tmp_path)).collect()] == [(0, 0)]


def pairs_brute(files):
    """{(a, b): (similarity, type)} by the rule, each pair of files by itself."""
    blocks, windows = {}, {}
    for i, t in files:
        sig = [x for x in (line.strip().lower() for line in (t or "").splitlines()) if len(x) > 3]
        every = [tuple(sig[k:k + 6]) for k in range(len(sig) - 5)]
        blocks[i], windows[i] = set(every), len(every)
    text, out = dict(files), {}
    for a in text:
        for b in text:
            if a < b and text[a] is not None and text[a] == text[b]:
                out[a, b] = (100, "exact")
            elif a < b and blocks[a] & blocks[b]:
                s = round(min(len(blocks[a] & blocks[b]) / min(windows[a], windows[b]) * 100, 100))
                if s >= 30:
                    out[a, b] = (s, "block")
    return out


def expanded(groups):
    """All pairs of files that the published rows stand for."""
    members = [tuple(r) for r in groups.membership.select("file", "content_leader", "block_leader").collect()]
    content, by_content, by_block = {f: c for f, c, _ in members}, {}, {}
    for f, c, b in members:
        by_content.setdefault(c, []).append(f)
        by_block.setdefault(b, []).append(f)
    out = {}
    for r in groups.report().collect():
        if r.type == "exact":
            mine = by_content[r.file1]
            out |= {(a, b): (100, "exact") for a in mine for b in mine if a < b}
        else:
            out |= {(min(a, b), max(a, b)): (r.similarity, "block") for a in by_block[r.file1] for b in by_block[r.file2] if content[a] != content[b]}
    return out


def case(kind):
    line = lambda k: f"statement number {k}"
    text = lambda ks: "\n".join(map(line, ks))
    base = list(range(40))
    if kind == "copies of near copies":
        near = base[:20] + [99] + base[21:]
        return [(1, text(base)), (2, text(base)), (3, text(near)), (4, text(near)), (5, text(near)), (6, text(base) + "\n"), (7, text(range(200, 240)))]
    if kind == "same blocks":       # other contents, the same lines; repeats bring a group's own similarity under 100
        return [(1, text(base)), (2, " " + text(base)), (3, text(base).upper()), (4, text(base)), (5, text(base * 4)), (6, text(base * 4) + "\n\n"),
                (7, text([1, 2, 3, 4, 5, 6] * 30)), (8, text([1, 2, 3, 4, 5, 6] * 30) + "\n"), (9, text([1, 2, 3, 4, 5, 6] * 30))]
    if kind == "random":
        rng, files = random.Random(4), []
        for i in range(60):
            ks = list(base[:rng.choice([5, 6, 10, 40])])
            for _ in range(rng.randrange(6)):
                ks[rng.randrange(len(ks))] = rng.randrange(100)
            files.append((i, text(ks)))
        return files + [(i + 100, t) for i, t in files[:25]] + [(300, None), (301, None), (302, ""), (303, ""), (304, "a\nb")]
    return []


@pytest.mark.parametrize("kind", ["copies of near copies", "same blocks", "random", "empty"])
def test_groups_stand_for_every_pair(spark, kind):
    files = case(kind)
    want = pairs_brute(files)
    groups = duplicates.Groups(spark.createDataFrame(files, "file long, content string"))
    assert expanded(groups) == want
    assert groups.membership.count() == len(files)
    n = Counter()
    for r in groups.by_file().collect():
        n[r.file] += r.n_files
    assert n == Counter([f for pair in want for f in pair])
    assert tuple(groups.totals().first()) == (len(want), len({f for pair in want for f in pair}))
