"""The audit of finished plans: a row for each broken rule.

plans: plan_id, goal, title, score, actions: array<struct<name, description, category, groups: array<struct<steps, link,
check>>>>; links have deeplink, description, message, checks a deeplink. Only errors keep a plan out of the cache.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t
from ..functions import wordlists as w

ERROR, WARNING = "error", "warning"
CODES = (
    "GOAL_FORMAT", "TITLE_WORDS", "TITLE_CASE", "SCORE_RANGE", "NO_ACTIONS", "ACTION_NAME_CASE", "DESC_PREFIX", "DESC_WORDS",
    "ORDER_CRITICAL_NOT_LAST", "NO_STEPGROUPS", "EMPTY_STEPS", "MANUAL_HAS_DEEPLINK", "AUTO_NO_DEEPLINK", "DEEPLINK_NOT_IN_CATALOG", "URL_LEAK",
)


def _issues(rows: DataFrame, path: Column, rules: dict[str, Column]) -> DataFrame:
    """A row of plan_id, code, severity, path for each rule that a row breaks, in one pass over rows."""
    found = [F.when(broken, F.struct(F.lit(code).alias("code"), F.lit(WARNING if code == "AUTO_NO_DEEPLINK" else ERROR).alias("severity"))) for code, broken in rules.items()]
    issues = F.filter(F.array(*found), lambda x: x.isNotNull())
    return rows.select("plan_id", path.alias("path"), F.explode(issues).alias("issue")).select("plan_id", "issue.code", "issue.severity", "path")


def _between(n: Column, limits: tuple[int, int]) -> Column:
    return n.between(*limits)


def audit(plans: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """plan_id, code, severity, path. catalog: uri column of all legal addresses; without it addresses aren't checked."""
    goal = {
        "GOAL_FORMAT": ~F.coalesce("goal", F.lit("")).rlike(w.GOAL),
        "TITLE_WORDS": ~_between(F.size(t.words(F.col("title"))), w.TITLE_WORDS),
        "TITLE_CASE": (F.coalesce("title", F.lit("")) != "") & (t.sentence_case(F.col("title")) != F.col("title")),
        "SCORE_RANGE": ~F.coalesce(F.col("score").between(0.0, 1.0), F.lit(False)),
        "NO_ACTIONS": F.coalesce(F.size("actions"), F.lit(0)) <= 0,
    }
    found = _issues(plans, F.lit("goal"), goal)
    actions = plans.select("plan_id", F.posexplode("actions").alias("a", "action")).select("plan_id", "a", "action.*")
    before = Window.partitionBy("plan_id").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max((F.col("category") == "critical").cast("int")).over(before), F.lit(0)) == 1
    actions = actions.withColumn("seen", seen).withColumn("description", F.coalesce("description", F.lit("")))
    path = F.concat(F.lit("actions["), F.col("a"), F.lit("]"))
    of_action = {
        "ACTION_NAME_CASE": t.title_case(F.col("name")) != F.col("name"),
        "DESC_PREFIX": ~F.col("description").startswith("It will"),
        "DESC_WORDS": ~_between(F.size(t.words(F.col("description"))), w.DESCRIPTION_WORDS),
        "ORDER_CRITICAL_NOT_LAST": F.col("seen") & (F.col("category") != "critical"),
        "NO_STEPGROUPS": F.coalesce(F.size("groups"), F.lit(0)) <= 0,
    }
    found = found.unionByName(_issues(actions, path, of_action))
    groups = actions.select("plan_id", "a", "category", F.posexplode("groups").alias("g", "group")).select("plan_id", "a", "g", "category", "group.*")
    at_group = F.concat(F.lit("actions["), F.col("a"), F.lit("].groups["), F.col("g"), F.lit("]"))
    linked, checked = F.col("link").isNotNull(), F.col("check").isNotNull()
    of_group = {
        "EMPTY_STEPS": F.coalesce(F.size("steps"), F.lit(0)) <= 0,
        "MANUAL_HAS_DEEPLINK": (F.col("category") == "manual") & (linked | checked),
        "AUTO_NO_DEEPLINK": (F.col("category") == "auto") & ~linked,
    }
    found = found.unionByName(_issues(groups, at_group, of_group))
    texts = actions.select("plan_id", path.alias("path"), F.explode(F.array("name", "description")).alias("text")).unionByName(
        groups.select("plan_id", at_group.alias("path"), F.explode(F.concat("steps", F.array("link.description", "link.message"))).alias("text"))
    )
    found = found.unionByName(_issues(texts, F.col("path"), {"URL_LEAK": t.contains_url(F.col("text"))}))
    if catalog is not None:
        uris = groups.select("plan_id", at_group.alias("path"), F.explode(F.array("link.deeplink", "check.deeplink")).alias("uri")).where("uri IS NOT NULL")
        unknown = uris.join(catalog.select("uri").distinct(), "uri", "left_anti")
        found = found.unionByName(_issues(unknown, F.col("path"), {"DEEPLINK_NOT_IN_CATALOG": F.lit(True)}))
    return found


def clean_plans(plans: DataFrame, issues: DataFrame) -> DataFrame:
    """Plans without an error: what the cache admits."""
    return plans.join(issues.where(F.col("severity") == ERROR).select("plan_id").distinct(), "plan_id", "left_anti")
