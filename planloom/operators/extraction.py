"""From complaint and article to a plan's actions: rules extraction, grounding, and the rules that every plan meets.

Everything stays within the row of its complaint, so nothing is shuffled; the one measure that Spark lacks runs in an
Arrow UDF over the steps whose token overlap doesn't ground them already.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity
from ..functions import text as t
from ..functions import wordlists as w
from .ordering import categorize

#: What an extractor adds to complaints: columns of this type. rules_extractor is one; a language model's may be another.
RAW_PLAN = """struct<no_match:boolean,relevance:double,topic:string,goal_kind:string,title:string,normalized_query:string,
query_variations:array<string>,actions:array<struct<name:string,description:string,steps:array<string>>>>"""
Extractor = Callable[[DataFrame], DataFrame]


def rules_extractor(complaints: DataFrame) -> DataFrame:
    """complaints (query, title, content: cleaned) with raw: the plan that rules alone find."""

    def action(section: Column) -> Column:
        steps = F.filter(F.transform(t.sentences(section["body"]), lambda s: t.imperative(s)), lambda s: s.isNotNull())
        return F.struct(section["heading"].alias("heading"), steps.alias("steps"))

    found = F.filter(F.transform(t.sections(F.col("content")), action), lambda a: F.size(a["steps"]) > 0)
    named = F.transform(found, lambda a: F.struct(t.rule_action_name(a["heading"], a["steps"]).alias("name"), a["steps"].alias("steps")))
    actions = F.transform(named, lambda a: F.struct(a["name"].alias("name"), t.rule_description(a["name"]).alias("description"), a["steps"].alias("steps")))
    wanted = F.array_except(t.content_tokens(F.col("query")), F.array(*map(F.lit, w.QUERY_NOISE)))
    source = t.content_tokens(F.concat_ws(" ", "title", "content"))
    rows = complaints.withColumns({"_actions": actions, "_topic": t.rule_topic(F.col("title")), "_kind": t.goal_kind(F.col("title"))})
    raw = F.struct(
        (F.size("_actions") == 0).alias("no_match"),
        F.round(t.overlap(wanted, source, 0.0), 3).alias("relevance"),
        F.col("_topic").alias("topic"),
        F.col("_kind").alias("goal_kind"),
        t.rule_title(F.col("_topic"), F.col("_kind")).alias("title"),
        F.lit(None).cast("string").alias("normalized_query"),
        F.array().cast("array<string>").alias("query_variations"),
        F.col("_actions").alias("actions"),
    )
    return rows.withColumn("raw", raw.cast(RAW_PLAN)).drop("_actions", "_topic", "_kind")


def grounded(steps: Column, source: Column) -> tuple[Column, Column]:
    """(overlap scores, texts to compare with the source): a null text is grounded by its overlap already."""
    tokens = t.content_tokens(source)
    scores = F.transform(steps, lambda s: t.overlap(t.content_tokens(s), tokens, 1.0))
    asked = F.zip_with(steps, scores, lambda s, x: F.when(x < w.GROUNDING_THRESHOLD, F.regexp_replace(F.lower(s), r"\.+$", "")))
    return scores, asked


def postprocess(plans: DataFrame) -> DataFrame:
    """plans (raw, title, content) with fixed actions and plan fields, dropped steps, and no_match where nothing is left."""
    source = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))
    fixed = F.transform(
        "raw.actions",
        lambda a: F.struct(t.fix_action_name(a["name"]).alias("name"), a["description"].alias("description"), t.clean_steps(a["steps"]).alias("steps")),
    )
    rows = plans.withColumn("_fixed", fixed).withColumn("_source", source)
    flat = F.flatten(F.transform("_fixed", lambda a, i: F.transform(a["steps"], lambda s: F.struct(i.alias("action"), a["name"].alias("name"), s.alias("step")))))
    rows = rows.withColumn("_flat", flat)
    scores, asked = grounded(F.transform("_flat", lambda f: f["step"]), F.col("_source"))
    rows = rows.withColumns({"_overlap": scores, "_asked": asked})
    needed = F.exists("_asked", lambda x: x.isNotNull())
    rows = rows.withColumn("_fuzzy", similarity.partial_all(F.when(needed, F.col("_asked")), F.when(needed, F.lower("_source"))))
    best = F.transform(
        F.arrays_zip("_flat", "_overlap", F.coalesce("_fuzzy", F.transform("_overlap", lambda x: F.lit(None).cast("double"))).alias("_fuzzy")),
        lambda z: F.struct(
            z["_flat"]["action"].alias("action"),
            z["_flat"]["name"].alias("name"),
            z["_flat"]["step"].alias("step"),
            F.round(F.greatest(z["_overlap"], F.coalesce(z["_fuzzy"] / 100.0, F.lit(0.0))), 3).alias("grounding"),
        ),
    )
    rows = rows.withColumn("_scored", best)
    kept = F.filter("_scored", lambda s: s["grounding"] >= w.GROUNDING_THRESHOLD)
    rows = rows.withColumn("_kept", kept).withColumn("dropped_steps", F.filter("_scored", lambda s: s["grounding"] < w.GROUNDING_THRESHOLD))
    # Actions of one name are one action: where it is first seen, with its first description and all of its steps.
    merged = F.transform(
        F.array_distinct(F.transform("_kept", lambda s: s["name"])),
        lambda n: F.struct(
            n.alias("name"),
            F.get(F.filter("_kept", lambda s: s["name"] == n), F.lit(0))["action"].alias("action"),
            F.array_distinct(F.transform(F.filter("_kept", lambda s: s["name"] == n), lambda s: s["step"])).alias("steps"),
        ),
    )
    actions = F.transform(
        merged,
        lambda m: F.struct(m["name"].alias("name"), t.fix_description(F.element_at("_fixed", m["action"] + 1)["description"], m["name"]).alias("description"), m["steps"].alias("steps")),
    )
    topic = F.when(F.coalesce("raw.topic", F.lit("")) != "", F.col("raw.topic")).otherwise(F.col("raw.title"))
    variations = F.filter(F.transform("raw.query_variations", lambda v: t.strip(t.scrub(v))), lambda v: v != "")
    rows = rows.withColumns({"actions": actions, "topic": topic})
    return rows.select(
        *[c for c in plans.columns if c != "raw"],
        "actions",
        "dropped_steps",
        "topic",
        F.col("raw.goal_kind").alias("goal_kind"),
        t.fix_title(F.col("raw.title"), F.col("topic")).alias("plan_title"),
        t.clamp_score(F.col("raw.relevance")).alias("relevance"),
        t.scrub(F.col("raw.normalized_query")).alias("normalized_query"),
        F.slice(t.let(variations, t.first_of_each), 1, w.VARIATIONS_MAX).alias("query_variations"),
        (F.col("raw.no_match") | (F.size("actions") == 0)).alias("no_match"),
    )


def extract(complaints: DataFrame, extractor: Extractor = rules_extractor, kind: str = "rules") -> DataFrame:
    """Complaints (query, title, content) with the goal of their plan, provisional categories, or a fallback.

    An article without content gives no_siis_context, a plan without actions or of too little relevance no_match. An
    extractor that fails on a row leaves raw null there: extraction_error.
    """
    rows = complaints.withColumns({"title": F.coalesce("title", F.lit("")), "content": t.clean_article(F.col("content"))})
    plans = postprocess(extractor(rows))
    score = F.col("relevance") if kind == "llm" else 0.5 + 0.45 * F.col("relevance")
    fallback = (
        F.when(F.col("content") == "", "no_siis_context")
        .when(F.col("no_match").isNull(), "extraction_error")
        .when(F.col("no_match") | (F.col("relevance") < w.RELEVANCE_MIN[kind]), "no_match")
    )
    categorized = F.transform(
        "actions",
        lambda a: F.struct(a["name"].alias("name"), a["description"].alias("description"), categorize(a["name"], a["steps"]).alias("category"), a["steps"].alias("steps")),
    )
    return plans.withColumns(
        {"fallback": fallback, "goal": t.build_goal(F.col("topic"), F.col("goal_kind")), "score": t.clamp_score(score), "actions": categorized}
    )
