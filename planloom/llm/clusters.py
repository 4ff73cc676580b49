"""Centroid clustering (11): k-means rounds filtered by partition-local ball trees.

Every partition of vectors becomes ball trees of up to TREE_ROWS vectors, built once and written to the shared folder: a
ball has the count and the integer sum of its vectors, a centre and a radius, and is halved across the two vectors far
from each other until LEAF_ROWS are left. A round walks each tree with the few centroids. By the triangle inequality a
centroid whose distance to a ball's centre less the radius exceeds the nearest centroid's distance plus the radius owns
none of the ball's vectors; a ball with one centroid left goes to it whole, by count and sum, others descend with the
centroids that are left, and leaves are settled by exact integer distances. Trees return one row of sums for each
centroid; the driver divides them: k rows of sums, whatever the number of vectors.

Components become integers floor(scale * x). Distances and sums are exact integers; the floating point of centres and
radii only decides what descends, with room for its error. Components beyond LARGEST after scaling raise an error, as their
distances would not fit into 63 bits. Vectors that are null, of another length, or hold null or non-finite components
take no part. The start is the k vectors with the least hash of their vec_id, of equal hashes the least vector; repeated
rows are vectors of their own, and may be several centroids, of which the one of the smaller number gets all their
vectors. A null vec_id hashes last. With fewer than k vectors there are as many centroids. Ties go to the smaller
number, and a centroid without vectors stays where it is. An empty table gives no rows. Columns other than vec_id and
embedding are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import table, written

K, ROUNDS, DIM, SCALE = 16, 3, 64, 64
TREE_ROWS, LEAF_ROWS = 4096, 32
#: Greatest size of a scaled component: squared distances of up to 1,024 of them fit into 63 bits.
LARGEST = 2**25


def usable(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """vec_id, x: the vectors that take part, as integers."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = vectors.where((F.size("embedding") == dim) & F.coalesce(finite, F.lit(False)))
    too_large = F.raise_error(F.lit(f"a scaled component is larger than {LARGEST}"))
    whole = lambda v: F.when(F.abs(v * scale) <= LARGEST, F.floor(v * scale).cast("long")).otherwise(too_large.cast("long"))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, whole).alias("x"))


def grown(x: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """(order of the rows, balls): a ball is (first, stop, left, right, radius, centre, sum) over the rows in that order;
    left and right number its halves, 0 in a leaf."""
    order, balls, todo = np.arange(len(x)), [], [(0, len(x))]
    children: list[list[int]] = []
    parent_of = [None]
    while todo:
        (first, stop), parent = todo.pop(), parent_of.pop()
        if parent is not None:
            children[parent].append(len(balls))
        own = x[order[first:stop]]
        centre = own.mean(0)
        apart = np.sqrt(((own - centre) ** 2).sum(1))
        balls.append((first, stop, float(apart.max()), centre, own.sum(0)))
        children.append([])
        if stop - first <= LEAF_ROWS or not apart.max():
            continue
        far = own[int(apart.argmax())]
        other = own[int(((own - far) ** 2).sum(1).argmax())]
        by = np.argsort(own @ (other - far), kind="stable")
        order[first:stop] = order[first:stop][by]
        middle = first + len(by) // 2
        todo += [(first, middle), (middle, stop)]
        parent_of += [len(balls) - 1] * 2
    return order, [(a, b, *(children[k] or (0, 0)), radius, centre, total) for k, (a, b, radius, centre, total) in enumerate(balls)]


TREE = "ids array<long>, x binary, spans array<int>, radius array<double>, centres binary, sums binary"


def ball_trees(vectors: DataFrame, tree_rows: int = TREE_ROWS) -> DataFrame:
    """A row of TREE for each tree of up to tree_rows vectors of one partition; vectors have one length."""

    def tree(ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        order, balls = grown(x)
        spans = np.array([ball[:4] for ball in balls], np.int32)
        columns = [
            [ids.take(pa.array(order)).to_pylist()],
            [x[order].astype(np.int32).tobytes()],
            [spans.ravel().tolist()],
            [[ball[4] for ball in balls]],
            [np.array([ball[5] for ball in balls]).tobytes()],
            [np.array([ball[6] for ball in balls], np.int64).tobytes()],
        ]
        kinds = [pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["ids", "x", "spans", "radius", "centres", "sums"])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray]] = []

        def whole() -> pa.RecordBatch:
            return tree(pa.concat_arrays([ids for ids, _ in held]), np.concatenate([x for _, x in held]))

        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            at = 0
            while at < batch.num_rows:
                n = min(tree_rows - sum(len(rows) for _, rows in held), batch.num_rows - at)
                held.append((batch.column(0).slice(at, n), x[at : at + n]))
                at += n
                if sum(len(rows) for _, rows in held) == tree_rows:
                    yield whole()
                    held = []
        if held:
            yield whole()

    return vectors.mapInArrow(grow, TREE)


def opened(batch: pa.RecordBatch, row: int, dim: int) -> tuple:
    """ids, x, spans, radius, centres, sums of one tree."""
    ids, spans, radius = (batch.column(k)[row].values for k in (0, 2, 3))
    x, centres, sums = (np.frombuffer(batch.column(k)[row].as_py(), kind).reshape(-1, dim) for k, kind in ((1, np.int32), (4, np.float64), (5, np.int64)))
    return ids, x.astype(np.int64), spans.to_numpy().reshape(-1, 4), radius.to_numpy(), centres, sums


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows."""
    return (x**2).sum(1)[:, None] + (centroids**2).sum(1) - 2 * (x @ centroids.T)


def walked(x: np.ndarray, spans: np.ndarray, radius: np.ndarray, centres: np.ndarray, centroids: np.ndarray) -> Iterator[tuple[int, int, np.ndarray | int]]:
    """(ball, -1, centroid) for balls that go whole to a centroid, (first, stop, centroids by row) for leaves that don't."""
    todo = [(0, np.arange(len(centroids)))]
    while todo:
        ball, left = todo.pop()
        apart = np.sqrt(((centroids[left] - centres[ball]) ** 2).sum(1))
        # Room for the error of floating point, in proportion to what was added up.
        room = radius[ball] * (1 + 1e-9) + 1e-9 * (1 + np.abs(centres[ball]).max() + apart.max())
        left = left[apart - room <= apart.min() + room]
        first, stop, a, b = spans[ball]
        if len(left) == 1:
            yield ball, -1, int(left[0])
        elif a:
            todo += [(a, left), (b, left)]
        else:
            yield first, stop, left[squared(x[first:stop], centroids[left]).argmin(1)]


SUMS = "cluster int, n long, sums array<long>, whole long"


def round_sums(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """SUMS: from each tree a row for each centroid that got vectors; whole: how many of them came in whole balls."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                _, x, spans, radius, centres, sums = opened(batch, row, dim)
                n, total, whole = np.zeros(k, np.int64), np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
                for first, stop, to in walked(x, spans, radius, centres, centroids):
                    if stop < 0:
                        members = spans[first, 1] - spans[first, 0]
                        n[to] += members
                        whole[to] += members
                        total[to] += sums[first]
                    else:
                        np.add.at(total, to, x[first:stop])
                        n += np.bincount(to, minlength=k)
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array(n[some]), pa.array(total[some].tolist(), pa.list_(pa.int64())), pa.array(whole[some])],
                    ["cluster", "n", "sums", "whole"],
                )

    return trees.mapInArrow(run, SUMS)


def moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: floor(sum / count) of their vectors."""
    wide = "decimal(38,0)"  # sums over all trees may exceed 63 bits
    each = round_sums(trees, centroids).select("cluster", "n", F.posexplode("sums").alias("at", "sum"))
    rows = each.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("sum").cast(wide)).alias("sum")).collect()
    out = centroids.copy()
    for r in rows:
        out[r["cluster"], r["at"]] = int(r["sum"]) // r["n"]
    return out


def starts(vectors: DataFrame, k: int) -> np.ndarray:
    """k vectors by the hash of their ids."""
    by_hash = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select("x", by_hash.alias("h")).orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r.x for r in rows], np.int64)


def assigned(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of every vector."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, x, spans, radius, centres, _ = opened(batch, row, dim)
                to = np.zeros(len(x), np.int64)
                for first, stop, found in walked(x, spans, radius, centres, centroids):
                    to[slice(*spans[first, :2]) if stop < 0 else slice(first, stop)] = found
                distance = ((x - centroids[to]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([ids, pa.array(to, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    return trees.mapInArrow(run, "vec_id long, cluster int, distance long")


def clustered(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance for each vector that takes part; the centroids, in order of their numbers)."""
    rows = usable(vectors, dim, scale)
    centroids = starts(rows, k)
    if not len(centroids):
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids.reshape(0, dim)
    trees = written(ball_trees(rows), "ball-trees")
    for _ in range(rounds):
        centroids = moved(trees, centroids)
    return written(assigned(trees, centroids), "ball-assigned"), centroids


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = clustered(table(spark, sf_dir, "embeddings"))
    names = [(k, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids.tolist())]
    names = spark.createDataFrame(names, "cluster int, centroid_sha256 string")
    wide = F.sum(F.col("distance").cast("decimal(38,0)"))
    # One row for each of the few clusters.
    sums = rows.groupBy("cluster").agg(wide.alias("own")).join(names, "cluster")
    total = sums.agg(F.sum("own").cast("long").alias("inertia"))
    sums = sums.select("cluster", F.col("own").cast("long").alias("cluster_inertia"), "centroid_sha256").join(F.broadcast(total))
    return rows.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _rounds_sql() -> str:
    """The assignment, ROUNDS times followed by new centroids."""
    x_to_c = "CAST(list_dot_product(v.x, v.x) - 2 * list_dot_product(v.x, c.x) + list_dot_product(c.x, c.x) AS BIGINT)"
    nearest = "SELECT v.row, v.vec_id, v.x, arg_min(c.cluster, {d} * 16 + c.cluster) AS cluster, min({d}) AS distance FROM v, c{k} c GROUP BY v.row, v.vec_id, v.x"
    parts = []
    for k in range(ROUNDS + 1):
        parts.append(f"a{k} AS MATERIALIZED (" + nearest.format(d=x_to_c, k=k) + ")")
        if k < ROUNDS:
            parts.append(
                f"e{k} AS (SELECT cluster, place, floor(sum(x[place]) / count(*)) AS m FROM a{k}, range(1, {DIM} + 1) t(place) GROUP BY cluster, place), "
                f"c{k + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(n.x, c.x) AS x FROM c{k} c LEFT JOIN (SELECT cluster, list(m ORDER BY place) AS x FROM e{k} GROUP BY cluster) n ON c.cluster = n.cluster)"
            )
    return ", ".join(parts)


ORACLE_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM}
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)), x) - 1 AS INTEGER) AS cluster, x FROM v
  ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)), x LIMIT {K}
), {_rounds_sql()}, i AS (
  SELECT cluster, CAST(sum(distance) AS BIGINT) AS cluster_inertia FROM a{ROUNDS} GROUP BY cluster
), s AS (
  SELECT cluster, sha256(array_to_string(list_transform(x, lambda m: CAST(CAST(m AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256 FROM c{ROUNDS}
)
SELECT a.vec_id, a.cluster, a.distance, i.cluster_inertia, (SELECT CAST(sum(cluster_inertia) AS BIGINT) FROM i) AS inertia, s.centroid_sha256
FROM a{ROUNDS} a JOIN i ON a.cluster = i.cluster JOIN s ON a.cluster = s.cluster
"""
