"""Small relational operators that the plans are made of: pairing, membership, first-of, upserts, counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import settled, spread


def first_of(df: DataFrame, key: Sequence[str], *order: Column) -> DataFrame:
    """One row for each key, the first in the order, which has to be total for the result to be defined."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def equi_pair(left: DataFrame, right: DataFrame, on: Column, *right_order: Column, key: Sequence[str]) -> DataFrame:
    """Each left row (told by key) with the first right row that matches, or with nulls."""
    return first_of(left.join(right, on, "left"), key, *right_order)


def cached(df: DataFrame, plans: DataFrame, key: str) -> DataFrame:
    return df.join(plans.select(key).distinct(), key, "left_semi")


def uncached(df: DataFrame, plans: DataFrame, key: str) -> DataFrame:
    return df.join(plans.select(key).distinct(), key, "left_anti")


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """existing without the rows of new's keys, and all of new."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def merge_by_name(items: DataFrame, key: Sequence[str], position: str, value: str) -> DataFrame:
    """A row for each key: its first position, and its distinct values in first-seen order."""
    first = items.groupBy(*key, value).agg(F.min(position).alias("at"))
    return first.groupBy(*key).agg(F.min("at").alias("first_at"), F.transform(F.sort_array(F.collect_list(F.struct("at", value))), lambda x: x[value]).alias("merged"))


def running_seen(df: DataFrame, flag: Column, key: Sequence[str], *order: Column) -> Column:
    """Whether the flag held in an earlier row of the key."""
    before = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.max(flag.cast("int")).over(before), F.lit(0)) == 1


def once_each(rows: DataFrame, given: Sequence[str], made: dict[str, Column]) -> DataFrame:
    """rows with the columns of made, which rest on the given columns alone: worked out once for each different row of
    these, by as many tasks as the cluster runs at once, and joined to all that are alike."""
    different = spread(settled(rows.select(*given).distinct(), "different-rows"))
    done = settled(different.select(F.struct(*given).alias("_given"), F.struct(*(c.alias(name) for name, c in made.items())).alias("_made")), "made-once")
    same = [rows[c].eqNullSafe(done["_given"][c]) for c in given]
    return rows.join(done, same).select(*(rows[c] for c in rows.columns), *(F.col("_made")[name].alias(name) for name in made))
