"""The pruned index against plain scores, what it passes over, and tables kept by digest."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from planloom.operators import inverted, retrieval
from planloom.sources import artefacts, files


def _texts(rng, n):
    vocabulary = [f"w{k}" for k in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    return [" ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 40))) for _ in range(n)]


@pytest.mark.parametrize(("entries", "tokens", "a_pass"), [(2048, 1_000_000, 200_000), (7, 60, 40), (1, 1, 1)])
def test_pruned_lists_equal_plain_scores(spark, monkeypatch, entries, tokens, a_pass):
    monkeypatch.setattr(inverted, "BLOCK_ENTRIES", entries)
    monkeypatch.setattr(inverted, "BLOCK_TOKENS", tokens)
    monkeypatch.setattr(inverted, "TERMS_A_PASS", a_pass)
    rng = random.Random(entries)
    texts = _texts(rng, 120) + ["", None, "w1 w2 w3"] + ["w5 w9 w20 w20"] * 30  # thirty ties
    corpus = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "entry_id long, text string").repartition(3)
    asked = [*_texts(rng, 8), "w5 w20 w20", "w0", "none of these", "", None]
    queries = spark.createDataFrame([(f"q{k}", x) for k, x in enumerate(asked)], "query_id string, text string")
    plain = retrieval.ranked(retrieval.bm25_scores(queries, retrieval.bm25_weights(corpus)), "bm25", 10, 6)
    want = sorted((r.query_id, r["rank"], r.entry_id, r.bm25) for r in plain.collect())
    index = inverted.bm25_index(corpus)
    got = sorted((r.query_id, r["rank"], r.entry_id, r.bm25) for r in retrieval.bm25_top(queries, index, 10).collect())
    assert got == want and len(want) > 60
    every = {(r.query_id, r.entry_id): r.bm25 for r in retrieval.bm25_scores(queries, retrieval.bm25_weights(corpus)).collect()}
    again = {(r.query_id, r.entry_id): r.bm25 for r in inverted.scores(inverted.asked_terms(queries, index.terms), index.blocks, "bm25").collect()}
    assert every.keys() == again.keys() and all(abs(again[k] - v) < 1e-9 for k, v in every.items())


def test_index_of_nothing(spark):
    corpus = spark.createDataFrame([], "entry_id long, text string")
    queries = spark.createDataFrame([(1, "a word")], "query_id long, text string")
    assert retrieval.bm25_top(queries, inverted.bm25_index(corpus), 5).collect() == []


def _block(rng, least, most, n=200):
    sizes = rng.integers(20, n, 30)
    of = np.concatenate([rng.permutation(n)[:s] for s in sizes])
    impact = np.concatenate([np.sort(rng.uniform(least, most, s))[::-1] for s in sizes])
    return inverted.Block(pa.array(range(n)), pa.array([f"t{k}" for k in range(30)]), sizes, impact[np.cumsum(sizes) - sizes], of, impact)


def test_blocks_and_entries_are_passed_over():
    """A block that can't reach the k-th score isn't scored; of one that can, few entries are taken up; results stay those of all."""
    rng = np.random.default_rng(2)
    asked = [(f"t{k}", float(x)) for k, x in enumerate(rng.uniform(0.1, 3, 12))]
    strong, weak = _block(rng, 1.0, 2.0), _block(rng, 0.0, 0.2)
    first = strong.best(asked, [], 10, 6)
    assert len(first) == 10 and weak.best(asked, first, 10, 6) is None
    mixed = _block(rng, 0.2, 1.6)
    plain = np.zeros(200)
    for term, weight in asked:
        r = mixed.row[term]
        plain[mixed.of[mixed.ends[r] : mixed.ends[r + 1]]] += weight * mixed.impact[mixed.ends[r] : mixed.ends[r + 1]]
    want = sorted([*first, *((-round(float(s), 6), i, s) for i, s in enumerate(plain) if s)])[:10]
    assert [x[:2] for x in mixed.best(asked, first, 10, 6)] == [x[:2] for x in want]


def test_numbers_by_ranges_are_those_of_one_sort(spark):
    ids = [f"e{k}" for k in random.Random(3).sample(range(1000), 300)]
    got = retrieval.numbered(spark.createDataFrame([(x,) for x in ids], "entry_id string").repartition(5)).collect()
    assert {r.entry_id: r.place for r in got} == {x: k + 1 for k, x in enumerate(sorted(ids))}


def test_artefacts_are_built_once_for_the_same_texts(spark, tmp_path):
    kept = artefacts.Artefacts(spark, f"file://{tmp_path}/kept")
    rows = [(f"e{k}", x) for k, x in enumerate(_texts(random.Random(4), 40))]
    queries = spark.createDataFrame([(1, "w0 w3"), (2, "w7")], "query_id long, text string")
    entries = lambda rows: spark.createDataFrame(rows, "entry_id string, text string").repartition(2)
    folders = lambda: files.names(spark, f"file://{tmp_path}/kept/hybrid")
    result = lambda rows, kept=None: sorted(map(tuple, retrieval.hybrid(queries, entries(rows), 5, kept).select("query_id", "rank", "entry_id", F.round("bm25", 9), F.round("dense", 9)).collect()))
    first = result(rows, kept)
    assert first == result(rows) and len(folders()) == 1
    made = files.read(spark, f"file://{tmp_path}/kept/hybrid/{folders()[0]}/current")
    calls = []
    digest = artefacts.digest_of(entries(rows[::-1]), "entry_id", "text", made_by="bm25+tfidf:3-5")
    kept.get("hybrid", digest, lambda: calls.append(1))  # the order of rows is nothing to the digest
    assert not calls and result(rows[::-1], kept) == first and len(folders()) == 1
    changed = [("e0", "w299 w3"), *rows[1:]]
    assert result(changed, kept) == result(changed) and len(folders()) == 2
    assert made == files.read(spark, f"file://{tmp_path}/kept/hybrid/digest={digest}/current")
    assert digest != artefacts.digest_of(entries(rows), "entry_id", "text", made_by="another")
    assert digest != artefacts.digest_of(entries([*rows, rows[0]]), "entry_id", "text", made_by="bm25+tfidf:3-5")
