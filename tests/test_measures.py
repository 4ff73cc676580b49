"""Partial ratio of long texts, and percentiles of groups that no task holds."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest

from planloom.functions import similarity
from planloom.operators import evaluation


def _common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for k, y in enumerate(b):
            row[k + 1] = before[k] + 1 if x == y else max(before[k + 1], row[k])
    return row[-1]


def _partial(a, b):
    short, long_ = sorted((a, b), key=len) if len(a) != len(b) else (a, b)
    n = len(short)
    if not n:
        return 0.0 if long_ else 100.0
    windows = [long_[i : i + n] for i in range(len(long_) - n + 1)] + [long_[:k] for k in range(1, n)] + [long_[-k:] for k in range(1, n)]
    return max(200.0 * _common(short, x) / (n + len(x)) for x in windows)


@pytest.mark.parametrize("n", [0, 1, 5, 63, 64, 65, 127, 128, 129, 200])
def test_partial_ratio_of_any_length(monkeypatch, n):
    monkeypatch.setattr(similarity, "WINDOWS_AT_ONCE", 50)
    rng = random.Random(n)
    for size in (n, n + 1, n + 40):
        a, b = ("".join(rng.choice("abcd é") for _ in range(k)) for k in (n, size))
        near = b[: size // 2] + a[n // 3 :]
        for x, y in ((a, b), (b, a), (a, near), (a, a)):
            assert abs(similarity.partial_ratio(x, y) - _partial(x, y)) < 1e-9, (x, y)


def test_partial_ratio_of_a_whole_article():
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefghij ") for _ in range(20_000))
    step = text[9000:9150].replace("a", "x") + "." * 20
    began = time.perf_counter()
    assert similarity.partial_ratio(step, text) > 75
    assert time.perf_counter() - began < 15


@pytest.mark.parametrize(("direct", "buckets"), [(100_000, 4096), (5, 4), (40, 3), (1, 2)])
def test_percentiles_of_hot_groups(spark, monkeypatch, direct, buckets):
    monkeypatch.setattr(evaluation, "DIRECT_ROWS", direct)
    monkeypatch.setattr(evaluation, "BUCKETS", buckets)
    rng = np.random.default_rng(4)
    groups = {"hot": rng.exponential(size=300) * 10.0 ** rng.integers(-8, 8, 300), "ties": rng.integers(0, 4, 90).astype(float), "one": np.array([7.5]), None: rng.normal(size=30), "same": np.full(60, -2.5), "wide": np.array([-1.7e308, 1.7e308, 0.0, 5e-324, 1.0, 2.0])}
    rows = [(k, float(v)) for k, values in groups.items() for v in values] + [("hot", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, value double").repartition(3)
    got = {r.g: r for r in evaluation.latency_percentiles(df, "value", ["g"], (0.0, 0.5, 0.95, 1.0), 9).collect()}
    assert got.keys() == groups.keys() | {"none"} and (got["none"].n, got["none"].p50) == (0, None)
    for k, values in groups.items():
        assert got[k].n == len(values)
        for share, name in ((0.0, "p0"), (0.5, "p50"), (0.95, "p95"), (1.0, "p100")):
            assert got[k][name] == pytest.approx(float(np.percentile(values, 100 * share)), rel=1e-9, abs=1e-8), (k, name)
    row = evaluation.latency_percentiles(df.where("g = 'hot'"), "value", digits=6).first()
    assert row.n == 300 and row.p50 == pytest.approx(float(np.percentile(groups["hot"], 50)), abs=1e-6)
