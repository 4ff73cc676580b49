"""Which settings screen an action opens: targets named in its steps, gated candidates of the hybrid index, a decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import similarity
from ..functions import text as t
from ..functions import wordlists as w
from ..session import settled
from ..sources.artefacts import Artefacts
from .ordering import categorize
from .retrieval import hybrid

LINK = "struct<deeplink:string,description:string,message:string,originalType:string>"
CHECK = "struct<deeplink:string,key:string,resultType:string,condition:string,value:string>"


def _trimmed(target: Column) -> Column:
    bare = F.regexp_replace(t.strip(target, r" .,'\""), r"(?iU)^(?:the|your|a|an)\s+", "")
    tokens = t.words(bare)
    # All words may go here, unlike in strip_trailing.
    last = F.array_max(F.filter(F.sequence(F.lit(0), F.size(tokens)), lambda i: (i == 0) | ~t.is_in(t.strip(F.lower(F.get(tokens, i - 1)), ","), w.TARGET_TAIL)))
    return F.array_join(F.slice(tokens, F.lit(1), last), " ")


def targets(steps: Column, strict: bool = True) -> Column:
    """Screens and options that steps name, the last named first. strict: verb patterns only before capitals."""
    every = lambda s, pattern, group=1: F.regexp_extract_all(s, F.lit(f"(?iU){pattern}"), F.lit(group))

    def of_step(s: Column) -> Column:
        chained = F.filter(F.flatten(F.transform(every(s, w.CHAIN), lambda c: F.split(c, r"(?U)\s*>\s*|,"))), lambda x: t.strip(x) != "")
        by_verb = every(s, w.TARGET)
        if strict:
            by_verb = F.filter(by_verb, lambda x: x.rlike(r"^\p{Lu}"))
        return F.concat(chained, every(s, w.QUOTED), every(s, w.PANEL, 0), by_verb, every(s, w.NEXT_TO))

    found = F.transform(F.flatten(F.transform(steps, of_step)), _trimmed)
    good = F.filter(
        found,
        lambda x: (F.length(x) > 2) & ~t.is_in(F.lower(x), w.GENERIC_TARGETS) & ~F.exists(t.words(x), lambda y: F.length(y) > 18),
    )
    return F.reverse(t.let(good, t.first_of_each))


def direction(text: Column) -> Column:
    off, on = text.rlike(f"(?iU){w.TURN_OFF}"), text.rlike(f"(?iU){w.TURN_ON}")
    return F.when(off & ~on, "off").when(on & ~off, "on")


def placeholder_target(found: Column, name: Column) -> Column:
    """The target that shares most words with the action's name; else the first; else the name without its verb."""
    content = lambda x: F.array_except(F.filter(F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0)), lambda y: ~t.is_in(y, w.NAME_STOPWORDS)), F.array(*map(F.lit, w.PLACEHOLDER_GENERIC)))
    scored = F.transform(found, lambda x, i: F.struct(F.size(F.array_intersect(content(x), content(name))).alias("n"), (-i).alias("i"), x.alias("t")))
    best = F.array_max(scored)
    return F.when(best["n"] > 0, best["t"]).otherwise(F.coalesce(F.get(found, F.lit(0)), F.regexp_replace(name, r"(?U)^(\w+)\s+", "")))


def placeholder_link(target: Column) -> Column:
    short = F.array_join(t.strip_trailing(F.slice(t.words(target), 1, 3), w.PLACEHOLDER_TAIL, 1, r"\x00"), " ")
    return F.struct(
        F.lit(w.PLACEHOLDER_URI).alias("deeplink"),
        F.concat(F.lit("Open "), short, F.lit(" screen in Settings")).alias("description"),
        F.concat(F.lit("Go to "), short, F.lit(" in Settings")).alias("message"),
        F.lit("placeholder").alias("originalType"),
    ).cast(LINK)


def entry_links(entry: Column) -> tuple[Column, Column]:
    """(link, check) of a catalog entry; only on and off entries carry a value to check."""
    link = F.struct(entry["deeplink"].alias("deeplink"), entry["description"].alias("description"), entry["message"].alias("message"), entry["original_type"].alias("originalType")).cast(LINK)
    switch = entry["original_type"].isin("onURL", "offURL")
    check = F.struct(
        entry["validation_link"].alias("deeplink"),
        entry["key"].alias("key"),
        F.when(switch, "boolean").alias("resultType"),
        F.when(switch, "equal").alias("condition"),
        F.when(entry["original_type"] == "onURL", "True").when(switch, "False").alias("value"),
    ).cast(CHECK)
    return link, F.when((F.coalesce(entry["validation_link"], F.lit("")) != "") & (entry["key"] != ""), check)


def best_entries(actions: DataFrame, entries: DataFrame, artefacts: Artefacts | None = None) -> DataFrame:
    """action_id, entry_id, name_score: the gated candidate of the highest total for each action (action_id, name, steps).

    Each distinct pair of target and name is compared once.
    """
    rows = actions.withColumn("targets", targets(F.col("steps"), strict=False))
    queries = rows.select(F.col("action_id").alias("query_id"), F.concat_ws(" ", "name", F.array_join("targets", " "), F.array_join("steps", " ")).alias("text"))
    candidates = hybrid(queries, entries, artefacts=artefacts).withColumnRenamed("query_id", "action_id")
    named = (
        candidates.join(rows.select("action_id", F.posexplode("targets").alias("at", "target"), F.size("targets").alias("n")), "action_id")
        .join(entries.select("entry_id", "original_type", F.explode("names").alias("setting")), "entry_id")
    )
    scored = similarity.distinct_pairs(named, "target", "setting", similarity.names, "match")
    gated = (
        scored.groupBy("action_id", "entry_id", "original_type", "rank", "dense", "n")
        .agg(F.max("match").alias("name_score"), F.min(F.when(F.col("match") >= w.MIN_NAME_MATCH, F.col("at"))).alias("first_hit"))
        .where(F.col("name_score") >= w.MIN_NAME_MATCH)
        .join(rows.select("action_id", direction(F.concat_ws(" ", F.array_join("steps", " "), "name")).alias("direction")), "action_id")
    )
    wanted = F.when(F.col("direction") == "on", "onURL").when(F.col("direction") == "off", "offURL")
    switch = F.col("original_type").isin("onURL", "offURL")
    adjusted = F.when(switch & (F.col("original_type") == wanted), 0.05).when(switch & wanted.isNotNull(), -0.2).when(F.col("original_type") == "offURL", -0.03).otherwise(0.0)
    total = F.col("name_score") + 0.02 * (1 - F.col("first_hit") / F.col("n")) + adjusted + 0.01 * F.col("dense") - 0.0005 * F.col("rank")
    rank = F.row_number().over(Window.partitionBy("action_id").orderBy(F.col("total").desc(), "rank"))
    return gated.withColumn("total", total).where("total > 0").withColumn("_r", rank).where("_r = 1").select("action_id", "entry_id", "name_score")


def map_actions(actions: DataFrame, entries: DataFrame, artefacts: Artefacts | None = None) -> DataFrame:
    """Actions (action_id, name, category, steps, ...) with kind (catalog, dummy, none), link, check, chosen_id, name_score
    and their final category. Manual actions never get a link, and so aren't searched for one. artefacts: where the entries'
    index is kept from call to call.

    What an action gets rests on its name, category and steps alone: each different action is mapped once, and joined to
    all that are alike.
    """
    said = ["name", "category", "steps"]
    alike = settled(actions.select(*said).distinct().withColumn("action_id", F.monotonically_increasing_id()), "different-actions")
    mapped = _mapped(alike, entries, artefacts).select(F.struct(*said).alias("said"), F.struct("kind", "link", "check", "chosen_id", "name_score", F.col("final").alias("category")).alias("got"))
    mapped = settled(mapped, "mapped-actions")
    same = [actions[c].eqNullSafe(mapped["said"][c]) for c in said]
    new = ["kind", "link", "check", "chosen_id", "name_score", "category"]
    return actions.join(mapped, same).withColumns({c: F.col("got")[c] for c in new}).drop("said", "got")


def _mapped(actions: DataFrame, entries: DataFrame, artefacts: Artefacts | None) -> DataFrame:
    """Different actions (action_id, name, category, steps) with what they get; final: their category after that."""
    searched = actions.where("category <> 'manual'").select("action_id", "name", "steps")
    best = best_entries(searched, entries, artefacts).join(entries, "entry_id").select("action_id", F.struct("entry_id", "deeplink", "description", "message", "original_type", "key", "validation_link").alias("entry"), F.round("name_score", 3).alias("name_score"))
    rows = actions.join(best, "action_id", "left")
    body = F.array_join("steps", " ")
    auto, critical = F.col("category") == "auto", F.col("category") == "critical"
    dummy = (auto & body.rlike(f"(?iU){w.SETTINGS_SCREEN}")) | (critical & body.rlike(f"(?iU){w.OPENS_SETTINGS}"))
    kind = F.when(F.col("category") == "manual", "none").when(F.col("entry").isNotNull(), "catalog").when(dummy, "dummy").otherwise("none")
    rows = rows.withColumn("kind", kind)
    link, check = entry_links(F.col("entry"))
    again = categorize(F.col("name"), F.col("steps"), F.lit(False))
    category = (
        F.when((F.col("kind") == "catalog") & ~critical, "auto")
        .when((F.col("kind") == "none") & auto, F.when(again == "auto", "manual").otherwise(again))
        .otherwise(F.col("category"))
    )
    return rows.withColumns(
        {
            "link": F.when(F.col("kind") == "catalog", link).when(F.col("kind") == "dummy", placeholder_link(placeholder_target(targets(F.col("steps")), F.col("name")))),
            "check": F.when(F.col("kind") == "catalog", check),
            "chosen_id": F.when(F.col("kind") == "catalog", F.col("entry.entry_id")),
            "name_score": F.coalesce("name_score", F.lit(0.0)),
            "final": category,
        }
    )
