"""The plan store's log: what a write costs, two writers, compaction, earlier versions; batches of a stream that run again."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import numpy as np
import pytest

from planloom.operators import cache
from planloom.plans.pipeline import BagOfWords, answer
from planloom.sources import files
from planloom.sources.plan_store import DOORS, PLANS, PlanStore
from planloom.streaming.answers import answer_batch
from test_plans import ARTICLE, catalog  # noqa: F401


def _tables(spark, plans):
    """Of {plan_id: response}: two doors each."""
    rows = [(k, f"query {k}", v, [], None, 0.0) for k, v in plans.items()]
    doors = [(k, "query", f"{k} {n}", f"{k} {n}", [1.0], 2 * at + n) for at, k in enumerate(plans) for n in range(2)]
    return spark.createDataFrame(rows, PLANS), spark.createDataFrame(doors, DOORS)


def _held(store, version=None):
    plans, doors, _ = store.read(version)
    found, rows = {r.plan_id: r.response for r in plans.collect()}, doors.collect()
    assert sorted(r.plan_id for r in rows) == sorted(list(found) * 2) and len({r.seq for r in rows}) == len(rows)
    return found


def _size(path):
    return sum(p.stat().st_size for p in Path(path).rglob("*.parquet"))


def test_versions(spark, tmp_path):
    store = PlanStore(spark, f"file://{tmp_path}/s")
    assert _held(store) == {} and store.last() == 0
    store.put(*_tables(spark, {"a": "1", "b": "1"}), "e")
    store.put(*_tables(spark, {"b": "2", "c": "2"}), "e")
    seq = {r.plan_id: r.seq for r in store.read()[1].collect()}
    assert _held(store) == {"a": "1", "b": "2", "c": "2"} and min(seq["b"], seq["c"]) > seq["a"] and store.read()[2] == "e"
    assert _held(store, 1) == {"a": "1", "b": "1"}
    with pytest.raises(ValueError, match="not of other"):
        store.put(*_tables(spark, {"d": "1"}), "other")
    store.clear("other")
    assert _held(store) == {} and _held(store, 2) == {"a": "1", "b": "2", "c": "2"} and store.read()[2] == "other"
    store.vacuum(3)
    assert len(files.names(spark, f"file://{tmp_path}/s/data")) == 1 and _held(store) == {}


def test_a_write_is_as_large_as_its_changes(spark, tmp_path):
    store = PlanStore(spark, f"file://{tmp_path}/s")
    store.write(*_tables(spark, {f"p{k}": "x" * 50 + str(k) for k in range(4000)}), "e")
    whole = _size(tmp_path)
    store.put(*_tables(spark, {"p7": "new", "q": "new"}), "e")
    assert _size(tmp_path) - whole < whole / 10
    held = _held(store)
    assert len(held) == 4001 and held["p7"] == held["q"] == "new"


def test_compaction(spark, tmp_path):
    store = PlanStore(spark, f"file://{tmp_path}/s", compact_after=3)
    want = {}
    for k in range(8):
        new = {f"p{k % 5}": str(k), f"q{k}": str(k)}
        want |= new
        store.put(*_tables(spark, new), "e")
    assert _held(store) == want and max(len(store._chain(n)) for n in range(1, store.last() + 1)) <= 4
    assert sum(store.commit(n)["whole"] for n in range(1, store.last() + 1)) >= 2
    last = store.last()
    assert store.compact(last - 1) is None and store.last() == last  # another version has come since


def test_two_writers_lose_nothing(spark, tmp_path):
    stores = [PlanStore(spark, f"file://{tmp_path}/s", compact_after=4) for _ in range(2)]
    tables = [[_tables(spark, {f"w{n}-{k}": str(k), "both": f"{n}-{k}"}) for k in range(5)] for n in range(2)]
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda n: [stores[n].put(*t, "e") for t in tables[n]], range(2)))
    held = _held(stores[0])
    assert held.keys() == {"both", *(f"w{n}-{k}" for n in range(2) for k in range(5))} and held["both"] in ("0-4", "1-4")


def test_one_of_many_claims_wins(spark, tmp_path):
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: files.claim(spark, f"file://{tmp_path}/c/one", f"writer {k}"), range(24)))
    assert sum(won) == 1 and files.read(spark, f"file://{tmp_path}/c/one") == f"writer {won.index(True)}"
    assert files.names(spark, f"file://{tmp_path}/c") == ["one"]


def test_a_batch_that_runs_again(spark, catalog, tmp_path):  # noqa: F811
    """After its plans were written and its replies lost: equal replies, one version; the next batch finds its plans."""
    schema = "query_id long, query string, title string, content string"
    store = PlanStore(spark, f"file://{tmp_path}/s")
    one = spark.createDataFrame([(1, "screen does not rotate", "Screen does not rotate", ARTICLE), (2, "battery", None, None)], schema)
    run = lambda batch, number, stream="st": answer_batch(batch, number, catalog, store, f"{tmp_path}/out", stream)
    replies = lambda number: sorted((r.query_id, r.cache_hit, r.response) for r in spark.read.parquet(f"{tmp_path}/out/batch={number}").collect())
    run(one, 0)
    first, versions, held = replies(0), store.last(), _size(f"{tmp_path}/s")
    assert not first[0][1] and versions == 1
    run(one, 0)
    assert replies(0) == first and store.last() == versions and _size(f"{tmp_path}/s") == held
    run(one, 1)
    assert replies(1)[0][1] and replies(1)[0][2] == first[0][2]
    run(one, 0, stream="another")  # its batch 0 hasn't been before
    assert replies(0)[0][1]


def test_another_embedder_writes_the_store_whole(spark, catalog, tmp_path):  # noqa: F811
    schema = "query_id long, query string, title string, content string"
    store = PlanStore(spark, f"file://{tmp_path}/s")
    one = spark.createDataFrame([(1, "screen does not rotate", "Screen does not rotate", ARTICLE)], schema)
    first = json.loads(answer(one, catalog, store).first().response)
    two = spark.createDataFrame([(1, "the screen will not rotate", "Screen does not rotate", ARTICLE), (2, "screen does not rotate", None, None)], schema)
    got = {r.query_id: r for r in answer(two, catalog, store, BagOfWords(64)).collect()}
    assert got[2].cache_hit and json.loads(got[2].response) == first
    plans, doors, made_by = store.read()
    assert made_by == BagOfWords(64).name and {len(r.vec) for r in doors.collect()} == {64} and plans.count() >= 1


def test_writes_extend_the_index_of_doors(spark, tmp_path):
    """Doors of every version have homes, a search of the store gives the rows of all doors, and a whole version gets new centres."""
    store = PlanStore(spark, f"file://{tmp_path}/s", compact_after=3)
    rng = np.random.default_rng(3)

    def put(first, n):
        rows = [(f"p{k}", f"q{k}", "r", [], None, 0.0) for k in range(first, first + n)]
        doors = [(r[0], "query", r[1], r[1], [float(x) for x in rng.normal(size=6)], k) for k, r in enumerate(rows)]
        return store.put(spark.createDataFrame(rows, PLANS), spark.createDataFrame(doors, DOORS), "e")

    def same():
        plans, doors, _ = store.read()
        queries = spark.createDataFrame([(k, None, [float(x) for x in rng.normal(size=6)]) for k in range(20)], "query_id long, article string, vec array<float>")
        rows = lambda centres: sorted(map(tuple, cache.top_two(cache.best_by_plan(queries, plans, doors, centres)).collect()))
        assert rows(store.centres()) == rows(None)

    put(0, 40)
    first = store.commit(1)
    assert first["centres"] == first["placed_by"] and len(store.centres()) == 7
    put(30, 20)
    assert store.commit(2)["centres"] == first["centres"] and store.read()[1].where("home IS NULL").count() == 0
    same()
    # One that placed its doors by other centres, as a writer does that began with an empty store.
    rows = [("late", "q", "r", [], None, 0.0)]
    other = store._written(spark.createDataFrame(rows, PLANS), spark.createDataFrame([("late", "query", "q", "q", [9.0] * 6, 0)], DOORS))
    store._claimed(False, other, "e")
    assert [r.plan_id for r in store.read()[1].where("home IS NULL").collect()] == ["late"]
    same()
    put(60, 5)
    assert store.commit(store.last())["whole"] and store.commit(store.last())["centres"] != first["centres"]
    assert store.read()[1].where("home IS NULL").count() == 0
    same()
    store.vacuum(store.last())
    assert len(files.names(spark, f"file://{tmp_path}/s/centres")) == 1
