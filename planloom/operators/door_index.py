"""An index of the cache's doors by centre: a query's two nearest plans without a score for every door.

Centres are fitted on a bounded sample of doors (SAMPLE), every door is indexed: its `home` is the nearest centre, `reach`
its distance from it and `size` its length. Doors of one home at about the same reach are a band. A band's least and
greatest reach bound what any of its doors can score, by two rules of which the smaller bound counts:
q.d <= q.c + |q| reach, and by the triangle inequality q.d <= (|q|^2 + size^2 - gap^2) / 2, where gap is how far |q - c|
lies outside the band's reaches.

A search meets the bands of the greatest bounds first, until FIRST doors are in, and takes the second plan found as the
query's floor; after that only bands whose bound reaches the floor are met. Results equal those of all doors, whatever the
centres: they decide only how much is passed over. Where vectors are all about equally far from each other, that is little.

Bands are dealt to buckets of about ENTRIES_A_BLOCK doors, larger ones to several, so that a hot centre isn't one task. At
most (MOST_CENTRES + 1) * BANDS lines about bands reach the driver and the tasks. Doors without a home (written before
there were centres, or by others) are met by every query, as are those with components that aren't finite.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..session import settled

#: Doors that the centres are fitted on, centres at most, rounds of fitting.
SAMPLE, MOST_CENTRES, ROUNDS = 8192, 1024, 4
#: Width of a band, and bands of a centre at most; the last one takes all that is farther.
BAND, BANDS = 1 / 16, 48
#: Doors that a query meets before its floor is set.
FIRST = 256
#: Queries whose bounds are worked out at once.
_AT_ONCE = 64


def fit(doors: DataFrame) -> np.ndarray | None:
    """Centres for doors (plan_id, seq, vec), one a row; None if no door has finite numbers.

    About the root of the number of doors, by a few rounds of means over a sample by hash. Reruns agree.
    """
    x = F.transform("vec", lambda v: v.cast("double"))
    good = doors.where((F.size("vec") > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    n = good.count()
    if not n:
        return None
    order = F.pmod(F.xxhash64("plan_id", "seq"), F.lit(2**32))
    rows = good.where(order <= math.ceil(2**32 * min(1.0, SAMPLE / n))).orderBy(order, "plan_id", "seq").limit(SAMPLE).select("vec").toPandas()
    if rows.empty:  # of few doors the hash can leave none
        rows = good.select("vec").limit(1).toPandas()
    sample = vectors.matrix(rows.vec)
    _, at = np.unique(sample, axis=0, return_index=True)
    centres = sample[np.sort(at)[: min(MOST_CENTRES, math.isqrt(n - 1) + 1)]]
    for _ in range(ROUNDS):
        own = _homes(sample, centres)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def _homes(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1)[None, :] - 2 * (x @ centres.T), axis=1)


def homed(doors: DataFrame, centres: np.ndarray) -> DataFrame:
    """doors with home, reach and size (those of these names are replaced); home is null where numbers aren't finite."""

    @F.pandas_udf("home int, reach double, size double")
    def place(vec: pd.Series) -> pd.DataFrame:
        good = np.array([v is not None and len(v) == centres.shape[1] and bool(np.isfinite(np.asarray(v, dtype=float)).all()) for v in vec], dtype=bool)
        out = pd.DataFrame({"home": pd.array([None] * len(vec), dtype="Int32"), "reach": np.nan, "size": np.nan})
        if good.any():
            x = vectors.matrix(vec[good])
            own = _homes(x, centres)
            out.loc[good, "home"] = own.astype("int32")
            out.loc[good, "reach"] = np.linalg.norm(x - centres[own], axis=1)
            out.loc[good, "size"] = np.linalg.norm(x, axis=1)
        return out

    kept = [c for c in doors.columns if c not in ("home", "reach", "size")]
    return doors.select(*kept, place("vec").alias("place")).select(*kept, "place.home", "place.reach", "place.size")


def _code() -> Column:
    """A door's band, as one number; -1 without a home."""
    band = F.least(F.floor(F.col("reach") / BAND), F.lit(BANDS - 1))
    return F.coalesce(F.col("home").cast("long") * BANDS + band, F.lit(-1))


def bands(doors: DataFrame) -> pd.DataFrame:
    """code, home, least, most, size, n, bucket, parts: a line for each band, in order of code. Vectors are not read."""
    found = doors.select(_code().alias("code"), "reach", "size").groupBy("code").agg(
        F.min("reach").alias("least"), F.max("reach").alias("most"), F.max("size").alias("size"), F.count("*").alias("n")
    )
    lines = found.toPandas().sort_values("code", ignore_index=True)
    lines["home"] = lines.code // BANDS
    bucket, parts, full, at = [], [], 0, 0
    for n in lines.n:
        if full and full + n > vectors.ENTRIES_A_BLOCK:
            at, full = at + 1, 0
        bucket.append(at)
        parts.append(max(1, -(-n // vectors.ENTRIES_A_BLOCK)))
        full += n
        if parts[-1] > 1:
            at, full = at + parts[-1], 0
    return lines.assign(bucket=bucket, parts=parts)


def bounds(q: np.ndarray, lines: pd.DataFrame, centres: np.ndarray) -> np.ndarray:
    """What a door of each band (columns) can score at most with each query (rows)."""
    home, out = lines.home.to_numpy(), np.full((len(q), len(lines)), np.inf)
    at = np.flatnonzero(home >= 0)
    if len(at):
        length = np.linalg.norm(q, axis=1)[:, None]
        least, most, size = (lines[c].to_numpy(dtype=float)[at] for c in ("least", "most", "size"))
        inner = q @ centres.T
        away = np.sqrt(np.maximum(length**2 + (centres * centres).sum(1)[None, :] - 2 * inner, 0))[:, home[at]]
        # Errors of the distances are about the root of a number's precision where they are small.
        gap = np.maximum(np.maximum(away - most, least - away) - 1e-6 * (length + size + 1), 0)
        by_reach = inner[:, home[at]] + length * most
        out[:, at] = np.minimum(by_reach, (length**2 + size**2 - gap**2) / 2) + 1e-9 * (1 + length * size + length**2 + size**2)
    return out


def _first(bound: np.ndarray, n: np.ndarray, doors: int) -> np.ndarray:
    """Which bands come first: those of the greatest bounds, until they hold that many doors."""
    k, out = min(doors, bound.shape[1]), np.zeros(bound.shape, dtype=bool)
    top = np.argpartition(-bound, k - 1, axis=1)[:, :k]
    top = np.take_along_axis(top, np.argsort(-np.take_along_axis(bound, top, 1), axis=1, kind="stable"), 1)
    np.put_along_axis(out, top, np.cumsum(n[top], axis=1) - n[top] < doors, 1)
    return out


def met(queries: DataFrame, lines: pd.DataFrame, centres: np.ndarray, floors: bool) -> DataFrame:
    """query_id, article, asked_vec, bucket, spans, doors: the bands that a query meets, by bucket, and the doors in them.

    spans: numbers of the first line and the one after the last, for each run of neighbouring lines, one after another.

    queries: query_id, article, vec, and where `floors` is set floor (null: none): then the bands after the first ones
    whose bound reaches it.
    """
    n, bucket, parts = (lines[c].to_numpy(dtype=np.int64) for c in ("n", "bucket", "parts"))
    first = FIRST

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin in range(0, len(batch), _AT_ONCE):
                some = batch.iloc[begin : begin + _AT_ONCE]
                bound = bounds(vectors.matrix(some.vec), lines, centres)
                chosen = _first(bound, n, first)
                if floors:
                    floor = some.floor.to_numpy(dtype=float)
                    chosen = ~chosen & ~(bound < np.where(np.isnan(floor), -np.inf, floor)[:, None])
                rows = []
                for i, (query_id, article, vec) in enumerate(zip(some.query_id, some.article, some.vec)):
                    own = np.flatnonzero(chosen[i])
                    spread = parts[own]
                    at = np.repeat(bucket[own] - np.cumsum(spread) + spread, spread) + np.arange(spread.sum())
                    cuts = np.flatnonzero(np.diff(at)) + 1
                    every, share = np.repeat(own, spread), np.repeat(n[own] / spread, spread)
                    for k, at_lines, doors in zip(np.split(at, cuts), np.split(every, cuts), np.split(share, cuts)):
                        if len(k):
                            gaps = np.flatnonzero(np.diff(at_lines) != 1)
                            spans = np.stack([at_lines[[0, *(gaps + 1)]], at_lines[[*gaps, -1]] + 1], axis=1).ravel()
                            rows.append((query_id, article, vec, k[0], spans, doors.sum()))
                yield pd.DataFrame(rows, columns=["query_id", "article", "asked_vec", "bucket", "spans", "doors"])

    columns = ["query_id", "article", F.col("vec").cast("array<double>").alias("vec"), *(["floor"] if floors else [])]
    return queries.select(*columns).mapInPandas(run, "query_id long, article string, asked_vec array<double>, bucket long, spans array<long>, doors double")


def _scored(asked: DataFrame, plans: DataFrame, doors: DataFrame, lines: pd.DataFrame, blocks: int) -> DataFrame:
    """The two nearest plans within the bands of each bucket that a query meets."""
    spark = asked.sparkSession
    asked = asked.withColumn("query_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))

    def once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met_here = np.zeros(of_lines, dtype=bool)
        for batch in batches:
            for spans in batch.spans:
                for first, stop in spans.reshape(-1, 2):
                    met_here[first:stop] = True
        yield pd.DataFrame({"line": np.flatnonzero(met_here)})

    of_lines = len(lines)
    # Each task names a band once, so what is collected is a line for each of the few bands.
    needed = sorted(r.line for r in asked.select("spans").mapInPandas(once, "line long").distinct().collect())
    own = [(line, *map(int, lines.loc[line, ["code", "bucket", "parts"]])) for line in needed]
    of_band = F.broadcast(spark.createDataFrame(own, "line long, code long, bucket long, parts long"))
    homes = sorted({code // BANDS for _, code, _, _ in own if code >= 0})
    near = doors.where(F.col("home").isin(homes) | F.col("home").isNull()).select("plan_id", F.col("seq").alias("entry_id"), "vec", _code().alias("code"))
    near = near.join(of_band, "code").withColumn("bucket", F.col("bucket") + F.pmod(F.xxhash64("plan_id", "entry_id"), F.col("parts"))).drop("parts", "code")
    near = near.join(plans.select("plan_id", F.col("article").alias("held")), "plan_id")
    near = near.join(asked.select(F.col("query_block").alias("for_block"), F.col("bucket").alias("bucket")).distinct(), "bucket")

    def run(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        wants = np.zeros((len(q), of_lines), dtype=bool)
        for row, spans in zip(wants, q.spans):
            for first, stop in spans.reshape(-1, 2):
                row[first:stop] = True
        q = q[["query_id", "article", "asked_vec"]]
        out = [vectors.two_of_block(q[wants[:, line]], of_line) for line, of_line in d.groupby("line") if wants[:, line].any()]
        if not out:
            return vectors.two_of_block(q[:0], d)
        best = pd.concat(out).sort_values(["similarity", "seq"], ascending=[False, True]).drop_duplicates(["query_id", "plan_id"])
        return best.sort_values(["query_id", "similarity", "plan_id"], ascending=[True, False, True]).groupby("query_id").head(2)

    return asked.groupBy("query_block", "bucket").cogroup(near.groupBy("for_block", "bucket")).applyInPandas(run, vectors.NEAREST_PLAN)


def two_nearest_plans(queries: DataFrame, plans: DataFrame, doors: DataFrame, centres: np.ndarray) -> DataFrame:
    """query_id, plan_id, similarity, seq: rows that a query's two nearest plans are among, as `vectors.two_nearest_plans` gives.

    queries: query_id, article, vec. plans: plan_id, article. doors: plan_id, seq, vec, home, reach, size.
    """
    return search(queries, plans, doors, centres)[0]


def search(queries: DataFrame, plans: DataFrame, doors: DataFrame, centres: np.ndarray) -> tuple[DataFrame, list[DataFrame], pd.DataFrame]:
    """(what two_nearest_plans returns, the bands that were met in each of two passes, all bands)."""
    lines = bands(doors)
    if lines.empty:
        return queries.sparkSession.createDataFrame([], vectors.NEAREST_PLAN), [], lines
    blocks = max(1, -(-queries.count() // vectors.QUERIES_A_BLOCK))
    asked = settled(met(queries, lines, centres, floors=False), "doors-first")
    found = settled(_scored(asked, plans, doors, lines, blocks), "doors-found")
    best = found.groupBy("query_id", "plan_id").agg(F.max("similarity").alias("similarity"))
    floor = best.groupBy("query_id").agg(F.get(F.sort_array(F.collect_list("similarity"), asc=False), 1).alias("floor"))
    more = settled(met(queries.join(floor, "query_id", "left"), lines, centres, floors=True), "doors-more")
    return found.unionByName(_scored(more, plans, doors, lines, blocks)), [asked, more], lines


def share_scored(queries: DataFrame, plans: DataFrame, doors: DataFrame, centres: np.ndarray) -> float:
    """Of all pairs of a query and a door, how many a search scores."""
    _, passes, lines = search(queries, plans, doors, centres)
    pairs = queries.count() * int(lines.n.sum())
    return sum(p.agg(F.coalesce(F.sum("doors"), F.lit(0.0))).first()[0] for p in passes) / max(1, pairs)
