"""Evaluation queries: latencies, hit rates over thresholds, determinism, counters and coverage of a set of replies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import settled

#: Values of a group that one task may hold, and parts of a histogram.
DIRECT_ROWS, BUCKETS = 100_000, 4096
THRESHOLDS = tuple(round(0.70 + 0.025 * k, 3) for k in range(11))


def latency_percentiles(df: DataFrame, value: str, key: Sequence[str] = (), shares: Sequence[float] = (0.5, 0.95), digits: int = 1) -> DataFrame:
    """Exact percentiles with linear interpolation, named p50, p95 and so on, and n. Nulls don't count.

    Groups of up to DIRECT_ROWS values are aggregated as they are. Of larger ones no task holds the values: see `selected`.
    """
    names = {s: f"p{round(100 * s)}" for s in shares}
    rows = df.select(*key, F.col(value).cast("double").alias("v"))
    sizes = settled(rows.groupBy(*key).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")), "percentile-sizes")
    large = sizes.where(F.col("n") > DIRECT_ROWS)
    direct = lambda part: part.groupBy(*key).agg(F.count("v").alias("n"), *(F.round(F.percentile("v", F.lit(s)), digits).alias(name) for s, name in names.items()))
    if large.isEmpty():
        return direct(rows)
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in key] or [F.lit(True)]
    hot = F.broadcast(large.select(*key))  # at most one group in DIRECT_ROWS rows
    small = direct(rows.join(hot, same(rows, hot), "left_anti")) if key else None
    place = (F.col("n") - 1) * F.col("share")
    asked = large.select("*", F.explode(F.array(*map(F.lit, shares))).alias("share")).withColumn("rank", F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))))
    found = selected(rows, asked.select(*key, "rank", "low", "high").distinct(), key)
    both = asked.join(found.withColumnsRenamed({k: f"{k} of" for k in key} | {"rank": "found_rank"}), [F.col("rank") == F.col("found_rank"), *(F.col(k).eqNullSafe(F.col(f"`{k} of`")) for k in key)])
    part = F.abs(place - F.col("rank"))
    # Between the two ranks; one rank alone counts whole.
    each = both.groupBy(*key, "n", "share").agg((F.sum(F.col("v") * (1 - part))).alias("p"))
    pivot = [F.round(F.max(F.when(F.col("share") == s, F.col("p"))), digits).alias(name) for s, name in names.items()]
    result = each.groupBy(*key, "n").agg(*pivot).select(*key, "n", *names.values())
    return result if small is None else small.unionByName(result)


def selected(rows: DataFrame, asked: DataFrame, key: Sequence[str]) -> DataFrame:
    """key, rank, v: the value of each rank (from 0) in its group, by histograms that are refined where the ranks lie.

    rows: key, v. asked: key, rank, low, high (the group's least and greatest value). A round counts the values between
    low and high in BUCKETS equal parts, and goes on within the part that holds the rank, between the least and the
    greatest value there, until all of it is one value or it has DIRECT_ROWS values at most, which are sorted.
    """
    alike = [F.col(k).eqNullSafe(F.col(f"`{k} of`")) for k in key]
    todo = asked.select(*(F.col(k).alias(f"{k} of") for k in key), "rank", "low", "high", F.lit(0).cast("long").alias("before"), F.lit(None).cast("long").alias("held"))
    own = [F.col(f"`{k} of`") for k in key]
    open_ = (F.col("low") < F.col("high")) & (F.col("held").isNull() | (F.col("held") > DIRECT_ROWS))
    inside = [*alike, F.col("v").between(F.col("low"), F.col("high"))]
    while True:
        todo = settled(todo, "percentile-ranges")
        if todo.where(open_).isEmpty():
            break
        # A row for each rank asked of a large group, of which there is one in DIRECT_ROWS rows at most.
        met = rows.join(F.broadcast(todo.where(open_)), inside)
        # Halves, so that no difference overflows; where they are too small to differ, what is above the least is one part.
        share = F.try_divide(F.col("v") / 2 - F.col("low") / 2, F.col("high") / 2 - F.col("low") / 2)
        share = F.coalesce(share, (F.col("v") > F.col("low")).cast("double"))
        bucket = F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1))
        counts = met.groupBy(*own, "rank", "before", bucket.alias("bucket")).agg(F.count("*").alias("held"), F.min("v").alias("low"), F.max("v").alias("high"))
        ahead = F.sum("held").over(Window.partitionBy(*own, "rank").orderBy("bucket")) - F.col("held") + F.col("before")
        here = counts.withColumn("ahead", ahead).where((F.col("ahead") <= F.col("rank")) & (F.col("rank") < F.col("ahead") + F.col("held")))
        todo = todo.where(~open_).unionByName(here.select(*own, "rank", "low", "high", F.col("ahead").alias("before"), "held"))
    few = rows.join(F.broadcast(todo.where("low < high")), inside)
    place = F.row_number().over(Window.partitionBy(*own, "rank").orderBy("v")) - 1 + F.col("before")
    sorted_ = few.withColumn("place", place).where(F.col("place") == F.col("rank")).select(*own, "rank", "v")
    return sorted_.unionByName(todo.where("low = high").select(*own, "rank", F.col("low").alias("v"))).withColumnsRenamed({f"{k} of": k for k in key})


def rate(hits: Column, of: Column, digits: int = 3) -> Column:
    """A share; 0 where there is nothing to share."""
    return F.round(hits / F.greatest(of, F.lit(1)), digits)


def hit_rates(outcomes: DataFrame, threshold: Column, margin: Column, key: Sequence[str] = ()) -> DataFrame:
    """outcomes: expected, got, similarity, margin, in_cache, expected_article, got_article.

    hit_rate is right hits over the queries whose plan is cached; hits of another plan with the same article are counted
    apart from wrong ones, and hits of queries without a cached plan are false.
    """
    hit = F.coalesce((F.col("similarity") >= threshold) & (F.col("margin") >= margin), F.lit(False))
    right = hit & F.col("in_cache") & (F.col("got") == F.col("expected"))
    sibling = hit & F.col("in_cache") & (F.col("got") != F.col("expected")) & F.col("expected_article").eqNullSafe(F.col("got_article"))
    wrong = hit & F.col("in_cache") & (F.col("got") != F.col("expected")) & ~F.col("expected_article").eqNullSafe(F.col("got_article"))
    count = lambda c: F.count_if(c)
    counted = outcomes.groupBy(*key).agg(
        count(F.col("in_cache")).alias("cached"),
        count(right).alias("right_hits"),
        count(sibling).alias("same_article"),
        count(wrong).alias("wrong_plan"),
        count(hit & ~F.col("in_cache")).alias("false_hits"),
        count(~F.col("in_cache")).alias("uncached"),
    )
    return counted.withColumn("hit_rate", rate(F.col("right_hits"), F.col("cached")))


def threshold_sweep(outcomes: DataFrame, thresholds: Sequence[float] = THRESHOLDS, margin: float = 0.02) -> DataFrame:
    """hit_rates for each threshold: the outcomes are read once, and a row meets all thresholds where it is."""
    crossed = outcomes.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    return hit_rates(crossed, F.col("threshold"), F.lit(margin), ["threshold"])


def sizes(plans: DataFrame, doors: DataFrame, entries: DataFrame) -> DataFrame:
    """plans, doors, entries: how many there are, in one row."""
    counted = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("of"), "n") for name, df in (("plans", plans), ("doors", doors), ("entries", entries))]
    return counted[0].unionByName(counted[1]).unionByName(counted[2]).groupBy().pivot("of", ["plans", "doors", "entries"]).agg(F.first("n"))


def determinism(replies: DataFrame, query: str, response: str) -> DataFrame:
    """n_queries, n_stable: whether each query always got one response."""
    by_query = replies.groupBy(query).agg(F.count_distinct(response).alias("n"))
    return by_query.agg(F.count("*").alias("n_queries"), F.count_if(F.col("n") <= 1).alias("n_stable"))


def stage_counters(replies: DataFrame, category: str, flags: dict[str, Column]) -> DataFrame:
    """Rows and the number for which each flag holds, by category."""
    return replies.groupBy(category).agg(F.count("*").alias("rows"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()))


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("code", "severity").agg(F.count("*").alias("n"))


def compliance(plans: DataFrame, issues: DataFrame) -> DataFrame:
    """plans, clean, compliance: the share of plans without an error."""
    bad = issues.where("severity = 'error'").select("plan_id").distinct().withColumn("bad", F.lit(True))
    counted = plans.select("plan_id").join(bad, "plan_id", "left").agg(F.count("*").alias("plans"), F.count_if(F.col("bad").isNull()).alias("clean"))
    return counted.withColumn("compliance", rate(F.col("clean"), F.col("plans")))


def link_coverage(actions: DataFrame, catalog: DataFrame) -> DataFrame:
    """Of actions (category, link): how many auto ones have a link, and how many links the catalog has."""
    known = catalog.select(F.col("uri").alias("known")).distinct()
    rows = actions.select("category", F.col("link.deeplink").alias("uri")).join(known, F.col("uri") == F.col("known"), "left")
    auto, linked = F.col("category") == "auto", F.col("uri").isNotNull()
    counted = rows.agg(
        F.count_if(auto).alias("auto"), F.count_if(auto & linked).alias("auto_linked"), F.count_if(linked).alias("links"), F.count_if(F.col("known").isNotNull()).alias("valid")
    )
    return counted.withColumns({"auto_coverage": rate(F.col("auto_linked"), F.col("auto")), "validity": rate(F.col("valid"), F.col("links"))})


def ablation(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """How often the first candidate (action_id, entry_id, rank from 0) is the entry that the gate chose (action_id, chosen_id)."""
    first = candidates.where("rank = 0").select("action_id", "entry_id")
    rows = decisions.where("chosen_id IS NOT NULL").join(first, "action_id", "left")
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("entry_id") == F.col("chosen_id")).alias("agree"), F.count_if(~F.coalesce(F.col("entry_id") == F.col("chosen_id"), F.lit(False))).alias("decoys"))


def worst_misses(outcomes: DataFrame, threshold: float, margin: float, n: int = 8) -> DataFrame:
    """The n misses of cached plans that were least like what they found."""
    missed = outcomes.where(F.col("in_cache") & ~((F.col("similarity") >= threshold) & (F.col("margin") >= margin)))
    return missed.orderBy("similarity", "query_id").limit(n)


def cost(prompt_tokens: Column, completion_tokens: Column, price_in: float = 0.15, price_out: float = 0.60) -> Column:
    """US dollars, from prices for a million tokens."""
    return (prompt_tokens * price_in + completion_tokens * price_out) / 1_000_000
