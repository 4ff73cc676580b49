"""Exact top-k search (3) by inner product with pivot-table elimination.

Every vector has its distances to PIVOTS pivots computed beforehand; the nearest pivot is its home. By the triangle
inequality the largest difference of two vectors' distances to a pivot bounds their own distance from below, and with
their lengths the inner product from above. The search has two passes:

* a query meets the vectors of the homes nearest to it, FLOOR_ROWS of them at least; the k-th score it finds is its floor;
* each other home has the range of its members' distances to every pivot, and so a bound for the whole home. A query is
  sent only to homes whose bound reaches its floor.

A task has one block of candidates of a home and one block of queries; it evaluates a query's candidates in the order of
their bounds and stops once no bound reaches the floor or the k-th score. The lists of all blocks merge by a ranking per
query. Large homes are dealt to blocks by a hash of the row's id and number, so neither repeated vectors nor any home
make a block large. How much is eliminated depends on the vectors, the result doesn't: see `evaluated`.

Vectors null or holding null or non-finite components take no part. Only vectors of the query's length are its
candidates. Rows with the query's vec_id are not its candidates; of several query rows with one vec_id the least
vector asks. Repeated candidate rows are candidates each. Null vec_ids take no part. Ties go to the smaller vec_id.
Scores have to fit into 63 bits. An empty table, or one without queries, gives no rows. Columns other than vec_id and
embedding are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import BROADCAST_ROWS, table, written

SCALE, K, EVERY = 1024, 10, 100
PIVOTS, PIVOT_SAMPLE = 128, 4096
CANDIDATES_A_BLOCK, QUERIES_A_BLOCK = 8192, 4096
#: Candidates that a query's first pass meets at least, if there are so many.
FLOOR_ROWS = 512
#: Candidates evaluated between two looks at the bound.
STEP = 64


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, x (integers), dim of the rows that take part."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (
        vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
        .where(F.coalesce(finite, F.lit(False)))
        .select("vec_id", F.transform(x, lambda v: F.floor(v * SCALE).cast("long")).alias("x"))
        .withColumn("dim", F.size("x"))
    )


def choose_pivots(vectors: DataFrame) -> dict[int, np.ndarray]:
    """By dimension, up to PIVOTS vectors far from each other, from PIVOT_SAMPLE rows taken by a hash of their id."""
    rows = vectors.orderBy(F.xxhash64("vec_id", "x"), "vec_id").select("dim", "x").limit(PIVOT_SAMPLE).collect()
    out = {}
    for dim in {r.dim for r in rows}:
        x = np.array([r.x for r in rows if r.dim == dim], dtype=float).reshape(-1, dim)
        chosen, far = [0], np.full(len(x), np.inf)
        while len(chosen) < min(PIVOTS, len(x)):
            far = np.minimum(far, np.sqrt(((x - x[chosen[-1]]) ** 2).sum(1)))
            chosen.append(int(far.argmax()))
        out[dim] = x[chosen]
    return out


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * (x @ pivots.T), 0))


def pivot_table(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """vec_id, x, dim, near: the distances to the pivots, home: the nearest one (-1: a dimension without pivots)."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            near, home = pd.Series([np.zeros(0)] * len(batch), index=batch.index, dtype=object), pd.Series(-1, index=batch.index, dtype="int32")
            for dim, rows in batch.groupby("dim"):
                if dim in pivots:
                    found = distances(np.array(rows.x.to_list(), dtype=float).reshape(len(rows), dim), pivots[dim])
                    near[rows.index] = pd.Series(list(found), index=rows.index, dtype=object)
                    home[rows.index] = found.argmin(1).astype("int32")
            yield batch.assign(near=near, home=home)

    return vectors.mapInPandas(add, "vec_id long, x array<long>, dim int, near array<double>, home int")


class Homes(NamedTuple):
    """The homes of one dimension: names, members, greatest squared length, and per home and pivot the range of distances."""

    name: np.ndarray
    members: np.ndarray
    norm: np.ndarray
    low: np.ndarray
    high: np.ndarray


def homes_of(rows: DataFrame) -> dict[int, Homes]:
    """By dimension; at most PIVOTS homes with as many ranges each, whatever the number of rows."""

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            for key, part in batch.groupby(["dim", "home"]):
                near = np.array(part.near.to_list(), dtype=float).reshape(len(part), -1)
                n, norm, low, high = held.get(key, (0, 0.0, np.inf, -np.inf))
                norms = max(float((np.array(x, dtype=float) ** 2).sum()) for x in part.x)
                held[key] = (n + len(part), max(norm, norms), np.minimum(low, near.min(0)), np.maximum(high, near.max(0)))
        yield pd.DataFrame([(*key, *of) for key, of in held.items()], columns=["dim", "home", "n", "norm", "low", "high"])

    parts = rows.mapInPandas(ranges, "dim int, home int, n long, norm double, low array<double>, high array<double>")
    totals = parts.groupBy("dim", "home").agg(F.sum("n").alias("n"), F.max("norm").alias("norm")).orderBy("dim", "home").collect()
    each = parts.select("dim", "home", F.posexplode(F.arrays_zip("low", "high")).alias("pivot", "r"))
    found = {(r.dim, r.home, r.pivot): (r.low, r.high) for r in each.groupBy("dim", "home", "pivot").agg(F.min("r.low").alias("low"), F.max("r.high").alias("high")).collect()}
    out = {}
    for dim in {r.dim for r in totals}:
        of = [r for r in totals if r.dim == dim]
        width = 1 + max((p for d, _, p in found if d == dim), default=-1)
        both = np.array([[found[dim, r.home, p] for p in range(width)] for r in of], dtype=float).reshape(len(of), width, 2)
        out[dim] = Homes(np.array([r.home for r in of]), np.array([r.n for r in of]), np.array([r.norm for r in of]), both[:, :, 0], both[:, :, 1])
    return out


def upper_bounds(q: np.ndarray, norms: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Of the inner products of q and vectors of these squared lengths and least distances; a little more than floating
    point may lose (a distance that is small beside the lengths has half their digits)."""
    length = (q.astype(float) ** 2).sum()
    apart = np.maximum(apart - 1e-6 * (np.sqrt(length) + np.sqrt(norms)), 0)
    return (length + norms - apart**2) / 2 + 1e-9 * (length + norms) + 1e-3


def nearest_homes(near: np.ndarray, homes: Homes) -> np.ndarray:
    """The homes that a query meets first."""
    distance = near[homes.name] if len(near) else np.zeros(len(homes.name))
    order = np.argsort(distance, kind="stable")
    enough = int(np.searchsorted(np.cumsum(homes.members[order]), FLOOR_ROWS)) + 1
    return homes.name[order[:enough]]


def reachable_homes(q: np.ndarray, near: np.ndarray, floor: float, met: np.ndarray, homes: Homes) -> np.ndarray:
    """The other homes that may hold a score of the floor or more."""
    apart = np.maximum(np.maximum(homes.low - near, near - homes.high).max(1, initial=0.0), 0.0)
    return homes.name[(upper_bounds(q, homes.norm, apart) >= floor) & ~np.isin(homes.name, met)]


#: vec_id is null in the rows that say how many candidates a block evaluated for a query.
SCORED = "query_id long, vec_id long, score long, evaluated long"


def _rows(table_: pa.Table, name: str, kind: type) -> np.ndarray:
    """A column of lists of one length, as the rows of an array."""
    return table_.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(table_.num_rows, -1)


def search_block(queries: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    """SCORED: the k best candidates of one block for each query of one block; both have vectors of one length.

    queries: vec_id, x, near, floor (candidates below it are not wanted). Ids and scores stay integers of 64 bits.
    """
    found: list[tuple] = []
    if queries.num_rows and candidates.num_rows:
        ids = candidates.column("vec_id").to_numpy()
        x, near = _rows(candidates, "x", np.int64), _rows(candidates, "near", float)
        norms = (x.astype(float) ** 2).sum(1)
        asked = zip(queries.column("vec_id").to_pylist(), _rows(queries, "x", np.int64), _rows(queries, "near", float), queries.column("floor").to_pylist(), strict=True)
        for query_id, q, q_near, floor in asked:
            bound = upper_bounds(q, norms, np.abs(near - q_near).max(1, initial=0.0))
            order = np.flatnonzero((bound >= floor) & (ids != query_id))
            order = order[np.argsort(-bound[order])]
            best: list[tuple[int, int]] = []
            evaluated = 0
            for at in range(0, len(order), STEP):
                if len(best) == k and bound[order[at]] < -best[-1][0]:
                    break
                some = order[at : at + STEP]
                evaluated += len(some)
                best = sorted(best + list(zip((-(x[some] @ q)).tolist(), ids[some].tolist(), strict=True)))[:k]
            found += [(query_id, vec_id, -score, None) for score, vec_id in best]
            found.append((query_id, None, None, evaluated))
    columns = zip(*found, strict=True) if found else [()] * 4
    return pa.table({name: pa.array(column, pa.int64()) for name, column in zip(("query_id", "vec_id", "score", "evaluated"), columns, strict=True)})


def search(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """SCORED, from all blocks of both passes; the k best rows of each query are among them."""
    rows = usable(vectors)
    rows = written(pivot_table(rows, choose_pivots(rows)), "pivot-table")
    homes = homes_of(rows)
    asking = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("x", "dim", "near")).alias("v")).select("vec_id", "v.*")
    asking = written(asking, "pivot-queries")
    query_blocks = max(1, -(-asking.count() // QUERIES_A_BLOCK))
    blocks = [(dim, int(name), int(-(-n // CANDIDATES_A_BLOCK))) for dim, of in homes.items() for name, n in zip(of.name, of.members, strict=True)]
    blocks = F.broadcast(vectors.sparkSession.createDataFrame(blocks, "dim int, home int, blocks int"))
    keys = ["dim", "home", "block", "query_block"]
    base = "vec_id long, x array<long>, dim int, near array<double>, "

    def add_first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(floor=-np.inf, homes=[nearest_homes(np.asarray(near, float), homes[dim]) for dim, near in zip(b.dim, b.near, strict=True)])

    def add_others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            more = [
                reachable_homes(np.asarray(x, np.int64), np.asarray(near, float), floor, nearest_homes(np.asarray(near, float), homes[dim]), homes[dim])
                for x, dim, near, floor in zip(b.x, b.dim, b.near, b.floor, strict=True)
            ]
            yield b.assign(homes=more)

    def scored(queries: DataFrame, name: str) -> DataFrame:
        spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        met = queries.withColumn("query_block", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int")).withColumn("home", F.explode("homes"))
        met = written(met.join(blocks, ["dim", "home"]).withColumn("block", spread(F.col("blocks"))).drop("homes", "blocks"), f"{name}-queries")
        # Candidates go only where a query asks.
        where = written(met.select("dim", "home", "query_block").distinct(), f"{name}-where")
        if where.count() <= BROADCAST_ROWS:
            where = F.broadcast(where)
        dealt = rows.join(blocks, ["dim", "home"]).withColumn("block", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.col("blocks")).cast("int"))
        dealt = dealt.join(where, ["dim", "home"]).drop("blocks")
        return written(met.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(lambda q, c: search_block(q, c, k), SCORED), name)

    first = scored(asking.mapInPandas(add_first, base + "floor double, homes array<int>"), "pivot-first")
    held = ranked(first, k).groupBy(F.col("query_id").alias("vec_id")).agg(F.min("score").alias("least"), F.count("*").alias("n"))
    floors = asking.join(held, "vec_id", "left").select("vec_id", "x", "dim", "near", F.when(F.col("n") == k, F.col("least").cast("double")).otherwise(float("-inf")).alias("floor"))
    return first.unionByName(scored(floors.mapInPandas(add_others, base + "floor double, homes array<int>"), "pivot-others"))


def ranked(scored: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return scored.where("vec_id IS NOT NULL").withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose vec_id is divisible by `every`."""
    return ranked(search(vectors, k, every), k)


def evaluated(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, evaluated: for how many candidates the inner product was worked out."""
    return search(vectors, k, every).where("evaluated IS NOT NULL").groupBy("query_id").agg(F.sum("evaluated").alias("evaluated"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 10
"""
