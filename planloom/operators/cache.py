"""The plan cache: exact lookup by normalised text, then the nearest plan by vector with a threshold and a margin.

Tables: plans (plan_id, query, response, variations, article, created), doors (plan_id, kind, text, norm, vec, seq).
A door is a phrasing of a plan's query; seq orders them, the last of equal norms wins. `dim` numbers of equal length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t
from ..functions import wordlists as w
from ..functions.vectors import two_nearest_plans
from . import door_index
from .relational import upsert

def allowed(asked: Column, held: Column) -> Column:
    """Whether a plan may serve a complaint: unless both name an article, and not the same."""
    return asked.isNull() | held.isNull() | (asked == held)


def exact_hits(queries: DataFrame, plans: DataFrame, doors: DataFrame) -> DataFrame:
    """query_id, plan_id for queries (query_id, text, article) whose normalised text is a door's."""
    last = doors.groupBy("norm").agg(F.max(F.struct("seq", "plan_id")).alias("d")).select("norm", "d.plan_id")
    held = last.join(plans.select("plan_id", F.col("article").alias("held")), "plan_id")
    asked = queries.select("query_id", "article", t.normalize_query(F.col("text")).alias("norm"))
    return asked.join(held, "norm").where(allowed(F.col("article"), F.col("held"))).select("query_id", "plan_id")


def best_by_plan(queries: DataFrame, plans: DataFrame, doors: DataFrame, centres: np.ndarray | None = None) -> DataFrame:
    """query_id, plan_id, similarity, seq of the nearest door of the plans that can be a query's first or second.

    queries: query_id (long), vec, article. Nothing as large as all pairs leaves a task. centres: those that the doors'
    home, reach and size come from; then doors that can't matter are passed over, and the rows of a query's first and
    second plan are the same.
    """
    if centres is not None:
        pairs = door_index.two_nearest_plans(queries, plans, doors, centres)
    else:
        held = doors.select("plan_id", "seq", "vec").join(plans.select("plan_id", F.col("article").alias("held")), "plan_id")
        pairs = two_nearest_plans(queries, held)
    nearest = F.max(F.struct("similarity", (-F.col("seq")).alias("first")))
    return pairs.groupBy("query_id", "plan_id").agg(nearest.alias("d")).select("query_id", "plan_id", "d.similarity", (-F.col("d.first")).alias("seq"))


def top_two(best: DataFrame) -> DataFrame:
    """query_id, plan_id, similarity, margin, seq: the nearest plan, and its lead over the nearest other one (over 0 if alone)."""
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "plan_id")
    ranked = best.withColumns({"rank": F.row_number().over(order), "second": F.lead("similarity", 1, 0.0).over(order)}).where("rank = 1")
    return ranked.select("query_id", "plan_id", F.round("similarity", 4).alias("similarity"), F.round(F.col("similarity") - F.col("second"), 4).alias("margin"), "seq")


def is_hit(threshold: float = w.CACHE_THRESHOLD, margin: float = w.CACHE_MARGIN) -> Column:
    return (F.col("similarity") >= threshold) & (F.col("margin") >= margin)


def lookup(queries: DataFrame, plans: DataFrame, doors: DataFrame, threshold: float = w.CACHE_THRESHOLD, margin: float = w.CACHE_MARGIN, centres: np.ndarray | None = None) -> DataFrame:
    """query_id, plan_id, match, similarity, margin of the queries (query_id, text, article, vec) that hit.

    Vectors are compared only for what has no exact hit. centres: as `best_by_plan` takes them.
    """
    exact = exact_hits(queries, plans, doors).select("query_id", "plan_id", F.lit("exact").alias("match"), F.lit(1.0).alias("similarity"), F.lit(1.0).alias("margin"))
    rest = queries.join(exact.select("query_id"), "query_id", "left_anti")
    near = top_two(best_by_plan(rest, plans, doors, centres)).where(is_hit(threshold, margin))
    return exact.unionByName(near.select("query_id", "plan_id", F.lit("semantic").alias("match"), "similarity", "margin"))


def doors_of(plans: DataFrame) -> DataFrame:
    """plan_id, kind, text, norm, place: a plan's phrasings (query, normalized_query, variations), the first of equal norms."""
    door = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"), t.normalize_query(text).alias("norm"))
    every = F.concat(
        F.array(door("query", F.col("query")), door("normalized", F.col("normalized_query"))),
        F.transform(F.coalesce("variations", F.array().cast("array<string>")), lambda v: door("variation", v)),
    )
    rows = plans.withColumn("_doors", F.filter(every, lambda d: d["norm"] != ""))
    norms = F.transform("_doors", lambda d: d["norm"])
    first = F.filter("_doors", lambda d, i: F.array_position(norms, d["norm"]) == i + 1)
    return rows.select("plan_id", F.posexplode(first).alias("place", "door")).select("plan_id", "door.*", "place")


def put(plans: DataFrame, doors: DataFrame, new_plans: DataFrame, new_doors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after new plans replaced those with their ids, doors included."""
    kept = doors.join(new_plans.select("plan_id").distinct(), "plan_id", "left_anti")
    return upsert(plans, new_plans, "plan_id"), kept.unionByName(new_doors)
