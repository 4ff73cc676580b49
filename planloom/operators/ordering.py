"""Categories of actions, and the order of a plan: settings first, then physical checks, then what disrupts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import wordlists as w


def _has(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?iU){pattern}")


def _hits(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(f"(?iU){pattern}"))


def categorize(name: Column, steps: Column, has_link: Column | None = None) -> Column:
    """auto, manual or critical; null counts as an empty name, no steps, no link."""
    name, body = F.coalesce(name, F.lit("")), F.array_join(F.coalesce(steps, F.array().cast("array<string>")), " ")
    linked = F.lit(False) if has_link is None else F.coalesce(has_link, F.lit(False))
    by_hits = F.when(_hits(body, w.MANUAL) > _hits(body, w.SETTINGS) + _hits(name, w.SETTINGS), "manual").otherwise("auto")
    return (
        F.when(_has(name, w.CRITICAL), "critical")
        .when(_has(name, w.MANUAL), "manual")
        .when(_has(body, w.CRITICAL) & ~_has(name, w.SETTINGS), "critical")
        .when(linked, "auto")
        .when(_has(body, w.SETTINGS) | _has(name, w.SETTINGS), by_hits)
        .otherwise("manual")
    )


def group_rank(category: Column) -> Column:
    return F.when(category == "auto", 0).when(category == "manual", 1).otherwise(2)


def sub_rank(category: Column, name: Column, steps: Column) -> Column:
    def severity(text: Column) -> Column:
        out = F.lit(None).cast("int")
        for rank, pattern in enumerate(w.SEVERITY):
            out = F.when(_has(text, pattern), rank).otherwise(out)
        return out

    whole = F.concat_ws(" ", name, F.array_join(steps, " "))
    return (
        F.when(category == "manual", _has(name, w.MANUAL_LAST).cast("int"))
        .when(category == "critical", F.coalesce(severity(name), severity(whole), F.lit(2)))
        .otherwise(0)
    )


def order_actions(actions: Column) -> Column:
    """An array of actions (name, category, steps, ...) in plan order; equal ranks keep their order."""
    keyed = F.transform(
        actions,
        lambda a, i: F.struct(group_rank(a["category"]).alias("g"), sub_rank(a["category"], a["name"], a["steps"]).alias("s"), i.alias("i"), a.alias("a")),
    )
    by_key = lambda x, y: F.when(F.struct(x["g"], x["s"], x["i"]) < F.struct(y["g"], y["s"], y["i"]), -1).otherwise(1)
    return F.transform(t.let(keyed, lambda k: F.array_sort(k, by_key)), lambda k: k["a"])
