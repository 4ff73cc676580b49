"""The n-gram join against all pairs."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from planloom.llm import base as shared
from planloom.llm import ngram_join
from planloom.llm.components import components
from planloom.llm.shingles import shingle_sets


def sets_of(texts):
    out = []
    for text in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute_force(rows):
    """rows: (doc_id, text) -> {(doc_id, class_id, n_links, kept)} as a sorted list."""
    sets = sets_of([t for _, t in rows])
    at = defaultdict(list)
    for k, s in enumerate(sets):
        for gram in s:
            at[gram].append(k)
    links, parent = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in enumerate(sets):
        common = defaultdict(int)
        for gram in s:
            for j in at[gram]:
                common[j] += 1
        for j, n in common.items():
            if j != k and 5 * n >= 4 * (len(s) + len(sets[j]) - n):
                links[k] += 1
                parent[find(k)] = find(j)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[find(k)].append(k)
    out = []
    for members in groups.values():
        ids = [rows[k][0] for k in members if rows[k][0] is not None]
        for k in members:
            out.append((rows[k][0], min(ids) if ids else None, links[k]))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in df.collect()), key=str)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = ngram_join.near_duplicates(docs)
    assert got(out) == brute_force([(r.doc_id, r.text) for r in docs.collect()])
    rows = out.collect()
    assert sum(r.kept for r in rows) == len({r.class_id for r in rows})


@pytest.mark.parametrize("block, broadcast", [(2048, 16_000_000), (5, 0)])
def test_near_copies_in_one_and_many_blocks(spark, monkeypatch, block, broadcast):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block)
    monkeypatch.setattr(ngram_join, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(shared, "HOT_ROWS", 3 if not broadcast else 10_000)
    monkeypatch.setattr(shared, "BROADCAST_ROWS", broadcast)
    rng = random.Random(3)
    rows = []
    for base in range(4):
        words = [f"w{rng.randrange(500)}" for _ in range(150)]
        for copy in range(9):
            changed = list(words)
            for _ in range(rng.randrange(5)):
                changed[rng.randrange(150)] = f"x{rng.randrange(99)}"
            rows.append((base * 100 + copy, " ".join(changed)))
    rows += [(900, None), (901, ""), (902, "one two"), (903, "one\ttwo "), (None, "one two"), (904, " \n"), (905, "one two three four five"), (905, "one two three four five")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "'x' AS bands").repartition(3)
    want = brute_force(rows)
    assert got(ngram_join.near_duplicates(docs)) == want
    stay = Counter(r.doc_id for r in ngram_join.one_of_each(docs).collect())
    assert stay == Counter({c for _, c, _ in want if c is not None})


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.near_duplicates(docs).collect() == []


def test_shingles_of_short_and_odd_texts():
    texts = [b"", b" ", b"a", b"a b c d e", b"a b c d e f", b"a b c d e a b c d e a b c d e", "é\tü".encode()]
    grams, ends = shingle_sets(texts)
    assert (ends[1:] - ends[:-1]).tolist() == [len(s) for s in sets_of([t.decode() for t in texts])]
    for some in ([b"a b"], [b""], [b"a", b""], []):
        assert len(shingle_sets(some)[0]) == sum(bool(t) for t in some)


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(30)] + [(7, 7)]
    got = {r.row: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 131)}}
