"""Vectors against vectors: a stated query set against all rows, block by block, in NumPy within tasks.

Each pair of a block of queries and a block of entries is one group; what it returns is bounded by its queries, not by
its pairs. `nearest` has one task for a block of queries, which all entries pass by. Blocks are dealt by a hash of the row's number and id, so equal ids don't make a block large.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES_A_BLOCK, ENTRIES_A_BLOCK = 2048, 8192
#: Queries of a block whose products a task holds at once.
QUERIES_AT_ONCE = 64
#: Queries that a task of `nearest` has at most, and no fewer unless there are no more; rows of them and of entries that meet at once.
QUERIES_A_TASK, QUERIES_AT_LEAST, ROWS_AT_ONCE = 32768, 256, 1024
#: Pairs whose vectors are held at once.
PAIRS_AT_ONCE = 1 << 14


def in_blocks(queries: DataFrame, entries: DataFrame, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """run over each pair of blocks; queries have query_id, entries entry_id."""
    many = lambda df, rows: max(1, -(-df.count() // rows))
    of_queries, of_entries = many(queries, QUERIES_A_BLOCK), many(entries, ENTRIES_A_BLOCK)
    own = lambda key, n: F.pmod(F.xxhash64(key, F.monotonically_increasing_id()), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("query_block", own("query_id", of_queries)).withColumn("entry_block", every(of_entries))
    right = entries.withColumn("entry_block", own("entry_id", of_entries)).withColumn("query_block", every(of_queries))
    keys = ["query_block", "entry_block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.to_list(), dtype=float).reshape(len(vectors), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products; summed in one order for all pairs, so that equal vectors get equal results."""
    return np.einsum("ij,kj->ik", a, b)


def in_slices(q: pd.DataFrame, run: Callable[[pd.DataFrame], list[tuple]]) -> list[tuple]:
    """What run finds, for QUERIES_AT_ONCE queries after another: memory is that of their products, whatever the block."""
    return [row for at in range(0, len(q), QUERIES_AT_ONCE) for row in run(q.iloc[at : at + QUERIES_AT_ONCE])]


def rows_of(vectors: pa.Array) -> np.ndarray:
    """The vectors of a list array, in their own type."""
    size = int(vectors.value_lengths()[0].as_py() or 0) if len(vectors) else 0
    if vectors.null_count or not pc.all(pc.equal(vectors.value_lengths(), size)).as_py():
        raise ValueError("vectors of one length and none null are expected")
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), size)


class Nearest:
    """The k best entries that some queries have met, by rounded score and then the smaller id. What it holds is bounded by its queries.

    Entries are told apart by single-precision products with a bound of their error; what may be among the k best is scored exactly.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, digits: int):
        self.ids, self.vectors, self.k, self.digits = ids, vectors.astype(float), k, digits
        self.norms = np.sqrt(np.einsum("ij,ij->i", self.vectors, self.vectors))
        self.score, self.entry = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        vectors = vectors.astype(float)
        longest = float(np.sqrt(np.einsum("ij,ij->i", vectors, vectors)).max(initial=0.0))
        kind = np.float32 if max(longest, self.norms.max(initial=0.0)) < 1e15 else float
        rough = self.vectors.astype(kind) @ vectors.astype(kind).T
        slack = self.norms * longest * (vectors.shape[1] + 8) * 2.0**-23 + 10.0**-self.digits
        least = self.score[:, -1] - slack
        if len(ids) > self.k and least.min() == -np.inf:
            rough[self.ids[:, None] == ids[None, :]] = -np.inf
            least = np.maximum(least, np.partition(rough, len(ids) - self.k, axis=1)[:, len(ids) - self.k] - 2 * slack)
        # In the products' own type, and no higher for it.
        at, of = np.divmod(np.flatnonzero(rough >= np.nextafter(least.astype(kind), kind(-np.inf))[:, None]), len(ids))
        other = self.ids[at] != ids[of]
        at, of = at[other], of[other]
        for k in range(0, len(at), PAIRS_AT_ONCE):
            a, e = at[k : k + PAIRS_AT_ONCE], of[k : k + PAIRS_AT_ONCE]
            score = np.round(np.einsum("ij,ij->i", self.vectors[a], vectors[e]), self.digits)
            keep = score >= self.score[a, -1]
            self.new.append((a[keep], ids[e[keep]], score[keep]))
        if sum(len(a) for a, _, _ in self.new) >= self.score.size:
            self.settle()

    def settle(self) -> None:
        own = np.repeat(np.arange(len(self.ids)), self.k)
        at, entry, score = map(np.concatenate, zip((own, self.entry.ravel(), self.score.ravel()), *self.new, strict=True))
        order = np.lexsort((entry, -score, at))
        first = np.searchsorted(at[order], np.arange(len(self.ids)))
        best = order[first[:, None] + np.arange(self.k)]
        self.entry, self.score, self.new = entry[best], score[best], []

    def rows(self) -> pa.RecordBatch:
        self.settle()
        found = self.score > -np.inf
        columns = np.repeat(self.ids, self.k)[found.ravel()], self.entry[found], self.score[found]
        return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["query_id", "entry_id", "dense"])


def nearest(queries: DataFrame, entries: DataFrame, k: int, digits: int) -> DataFrame:
    """query_id, entry_id, dense: the k nearest other entries of each query (query_id, vec against entry_id, vec).

    Scores are rounded before they are ranked, and ties go to the smaller entry_id. A task has QUERIES_A_TASK queries at
    most, and the entries, sorted behind them, pass by it in batches: it hands on k rows a query, and holds no more.
    """
    n, tasks = queries.count(), queries.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n // QUERIES_A_TASK), min(tasks, -(-n // QUERIES_AT_LEAST)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            key = 2 * batch.column(0).to_numpy().astype(np.int64) + batch.column(1).to_numpy(zero_copy_only=False)
            for part in np.split(np.arange(len(key)), np.flatnonzero(np.diff(key)) + 1):
                if not len(part):
                    continue
                block, entry = divmod(int(key[part[0]]), 2)
                if block != now:
                    yield from (own.rows() for own in held)
                    now, held = block, []
                for at in range(int(part[0]), int(part[-1]) + 1, ROWS_AT_ONCE):
                    some = batch.slice(at, min(ROWS_AT_ONCE, int(part[-1]) + 1 - at))
                    ids, vectors = some.column(2).to_numpy(), rows_of(some.column(3))
                    if entry:
                        for own in held:
                            own.meet(ids, vectors)
                    else:
                        held.append(Nearest(ids, vectors, k, digits))
        yield from (own.rows() for own in held)

    own = F.pmod(F.xxhash64("query_id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("block")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    asked = queries.select(own, F.lit(0).alias("entry"), F.col("query_id").cast("long").alias("id"), "vec")
    met = entries.select(every, F.lit(1).alias("entry"), F.col("entry_id").cast("long").alias("id"), "vec")
    rows = asked.unionByName(met).repartitionById(blocks, "block").sortWithinPartitions("block", "entry")
    return rows.mapInArrow(run, "query_id long, entry_id long, dense double")


def two_of_block(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
    """query_id, plan_id, similarity, seq of the two plans of d (plan_id, held, entry_id, vec) nearest to each of q (query_id, article, asked_vec)."""
    found = []
    if len(q) and len(d):
        d = d.sort_values(["plan_id", "entry_id"])
        plans, start = np.unique(d.plan_id.to_numpy(dtype=str), return_index=True)
        seq, owner = d.entry_id.to_numpy(), np.repeat(np.arange(len(plans)), np.diff([*start, len(d)]))
        vectors, held = matrix(d.vec), d.held.to_numpy(dtype=object)
        open_ = np.array([h is None or h != h for h in held])

        def of(part: pd.DataFrame) -> list[tuple]:
            scores = products(matrix(part.asked_vec), vectors)
            asked = part.article.to_numpy(dtype=object)
            free = np.array([a is None or a != a for a in asked])[:, None] | open_[None, :]
            scores[~(free | (asked[:, None] == held[None, :]))] = -np.inf
            best = np.maximum.reduceat(scores, start, axis=1)
            first = np.minimum.reduceat(np.where(scores == best[:, owner], seq, np.iinfo(np.int64).max), start, axis=1)
            order = np.argsort(-best, axis=1, kind="stable")[:, :2]
            return [(query_id, plans[j], best[i, j], first[i, j]) for i, query_id in enumerate(part.query_id) for j in order[i] if best[i, j] > -np.inf]

        found = in_slices(q, of)
    return pd.DataFrame(found, columns=["query_id", "plan_id", "similarity", "seq"]).astype({"query_id": "int64", "similarity": "float64", "seq": "int64"})


NEAREST_PLAN = "query_id long, plan_id string, similarity double, seq long"


def two_nearest_plans(queries: DataFrame, doors: DataFrame) -> DataFrame:
    """query_id, plan_id, similarity, seq: the two nearest plans within each block, which the two nearest of all are among.

    queries: query_id, article, vec. doors: plan_id, held (the plan's article), seq, vec. Of a plan's equally near doors
    the first counts, of equally near plans the smaller id.
    """
    entries = doors.select(F.col("seq").alias("entry_id"), "plan_id", "held", "vec")
    return in_blocks(queries.select("query_id", "article", F.col("vec").alias("asked_vec")), entries, two_of_block, NEAREST_PLAN)
