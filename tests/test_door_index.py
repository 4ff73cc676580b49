"""The index of doors by centre: the rows of all doors, and how many doors it scores for them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from planloom.functions import vectors
from planloom.operators import cache, door_index

DOORS = "plan_id string, seq long, vec array<float>"
QUERIES = "query_id long, article string, vec array<float>"
PLANS = "plan_id string, article string"


def _around(rng, centres, n, spread=0.05):
    x = centres[rng.integers(0, len(centres), n)] + rng.normal(0, spread, (n, centres.shape[1]))
    return (x / np.linalg.norm(x, axis=1)[:, None]).astype("float32")


def _tables(spark, doors, queries, plans, articles=(None,)):
    d = [(f"p{k % plans}", k, None if v is None else [float(c) for c in v]) for k, v in enumerate(doors)]
    q = [(k, articles[k % len(articles)], [float(c) for c in v]) for k, v in enumerate(queries)]
    p = [(f"p{k}", articles[k // 3 % len(articles)]) for k in range(plans)]
    return spark.createDataFrame(q, QUERIES).repartition(3), spark.createDataFrame(p, PLANS), spark.createDataFrame(d, DOORS).repartition(3)


def _rows(best):
    return sorted(map(tuple, cache.top_two(best).collect()))


@pytest.mark.parametrize(("articles", "a_block", "first"), [((None,), 8192, 256), ((None, "x", "y"), 50, 8), (("x", "y"), 7, 1)])
def test_index_gives_the_rows_of_all_doors(spark, monkeypatch, articles, a_block, first):
    """Copies, ties, articles, hot bands over several buckets and blocks of queries, lengths other than 1."""
    monkeypatch.setattr(vectors, "ENTRIES_A_BLOCK", a_block)
    monkeypatch.setattr(vectors, "QUERIES_A_BLOCK", 16)
    monkeypatch.setattr(door_index, "FIRST", first)
    rng = np.random.default_rng(a_block)
    spots = rng.normal(size=(9, 12))
    doors = np.concatenate([_around(rng, spots, 300), np.repeat(_around(rng, spots, 1), 120, 0), 3 * _around(rng, spots, 40), np.zeros((2, 12))])
    queries = np.concatenate([_around(rng, spots, 30), doors[::40], rng.normal(size=(4, 12)), np.zeros((1, 12))])
    q, p, d = _tables(spark, doors, queries, 25, articles)
    centres = door_index.fit(d)
    assert len(centres) == 22 and np.array_equal(centres, door_index.fit(d))
    indexed = door_index.homed(d, centres)
    assert indexed.where("home IS NULL").count() == 0
    want = _rows(cache.best_by_plan(q, p, d))
    assert _rows(cache.best_by_plan(q, p, indexed, centres)) == want and len(want) == len(queries)
    # Centres that were made of other doors lose nothing.
    other = rng.normal(size=(5, 12))
    assert _rows(cache.best_by_plan(q, p, door_index.homed(d, other), other)) == want


def test_few_doors_are_scored_where_vectors_have_centres(spark):
    rng = np.random.default_rng(5)
    spots = rng.normal(size=(40, 32))
    q, p, d = _tables(spark, _around(rng, spots, 6000), _around(rng, spots, 100), 500)
    centres = door_index.fit(d)
    indexed = door_index.homed(d, centres)
    assert door_index.share_scored(q, p, indexed, centres) < 0.15
    assert _rows(cache.best_by_plan(q, p, indexed, centres)) == _rows(cache.best_by_plan(q, p, d))


def test_doors_without_a_home_are_met(spark):
    rng = np.random.default_rng(6)
    q, p, d = _tables(spark, _around(rng, rng.normal(size=(4, 8)), 80), rng.normal(size=(7, 8)), 11)
    centres = door_index.fit(d)
    some = door_index.homed(d.where("seq % 3 <> 0"), centres)
    rest = d.where("seq % 3 = 0").selectExpr("*", "CAST(null AS int) AS home", "CAST(null AS double) AS reach", "CAST(null AS double) AS size")
    assert _rows(cache.best_by_plan(q, p, some.unionByName(rest), centres)) == _rows(cache.best_by_plan(q, p, d))


def test_nothing_to_index(spark):
    q, p, d = _tables(spark, [None], np.ones((2, 8)), 1)
    assert door_index.fit(d) is None
    centres = np.ones((1, 8))
    assert door_index.homed(d, centres).first().home is None
    none = door_index.homed(d.limit(0), centres)
    assert cache.best_by_plan(q, p, none, centres).collect() == []
    _, p, d = _tables(spark, np.ones((3, 8)), [], 1)
    assert cache.best_by_plan(q.limit(0), p, door_index.homed(d, centres), centres).collect() == []


def test_bounds_hold():
    rng = np.random.default_rng(7)
    centres, x, q = rng.normal(size=(6, 10)), rng.normal(size=(400, 10)) * rng.uniform(0, 3, (400, 1)), rng.normal(size=(50, 10))
    home = door_index._homes(x, centres)
    reach, size = np.linalg.norm(x - centres[home], axis=1), np.linalg.norm(x, axis=1)
    code = home * door_index.BANDS + np.minimum(reach // door_index.BAND, door_index.BANDS - 1).astype(int)
    lines = pd.DataFrame({"code": code, "reach": reach, "size": size}).groupby("code").agg(least=("reach", "min"), most=("reach", "max"), size=("size", "max")).reset_index()
    bound = door_index.bounds(q, lines.assign(home=lines.code // door_index.BANDS), centres)
    at = {c: k for k, c in enumerate(lines.code)}
    assert (q @ x.T <= bound[:, [at[c] for c in code]]).all()
