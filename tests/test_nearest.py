"""All vectors against all: what a task holds and hands on, and the rows of every vector."""

from __future__ import annotations

import numpy as np
import pytest
from oracle import AT
from planloom import queries_plans
from planloom.functions import vectors


def _plain(q_ids, q, e_ids, e, k, digits):
    out = set()
    for i, own in zip(q_ids, q, strict=True):
        scores = np.round((e * own).sum(axis=1), digits)
        near = sorted((-s, int(j)) for s, j in zip(scores, e_ids, strict=True) if j != i)[:k]
        out |= {(int(i), j, -s) for s, j in near}
    return out


@pytest.mark.parametrize("whole", [True, False])
def test_a_query_gets_its_k_nearest_and_no_more_rows(spark, whole):
    """Over more entries than were a block, with many ties, scores of all sizes and one query in a block's own batch."""
    rng = np.random.default_rng(5)
    n = 9000
    v = rng.integers(-2, 3, (n, 6)).astype(float) if whole else rng.normal(size=(n, 6)) * 10.0 ** rng.integers(-3, 4, (n, 1))
    ids = rng.permutation(n)
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v, strict=True)], "entry_id long, vec array<double>").repartition(3)
    asked = df.where("entry_id % 29 = 0").withColumnRenamed("entry_id", "query_id")
    got = [tuple(r) for r in vectors.nearest(asked, df, 5, 3).collect()]
    some = ids % 29 == 0
    want = {(i, j): s for i, j, s in _plain(ids[some], v[some], ids, v, 5, 3)}
    assert len(got) == 5 * some.sum()
    assert {(i, j) for i, j, _ in got} == set(want) and all(abs(s - want[i, j]) < 2e-3 for i, j, s in got)


def test_blocks_of_queries_in_one_task_keep_apart(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERIES_A_TASK", 7)
    monkeypatch.setattr(vectors, "ROWS_AT_ONCE", 3)
    v = np.random.default_rng(6).integers(-3, 4, (40, 4)).astype(float)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "entry_id long, vec array<double>")
    got = {tuple(r) for r in vectors.nearest(df.withColumnRenamed("entry_id", "query_id"), df, 50, 6).collect()}
    assert got == _plain(range(40), v, range(40), v, 50, 6) and len(got) == 40 * 39
    none = vectors.nearest(df.where("entry_id < 0").withColumnRenamed("entry_id", "query_id"), df, 3, 6)
    assert none.collect() == [] and vectors.nearest(df.withColumnRenamed("entry_id", "query_id"), df.where("entry_id < 0"), 3, 6).collect() == []


def test_every_vector_asks(spark):
    """And so does every benchmark item, whose list is fused with that of the vector of its number."""
    vec = {r.vec_id for r in spark.read.parquet(f"{AT}/embeddings.parquet").select("vec_id").collect()}
    got = {r.query_id for r in queries_plans.rrf_fusion(spark, AT).select("query_id").distinct().collect()}
    assert vec <= got
