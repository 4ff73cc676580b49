"""Batch jobs over files between the stages: extract, map, warm the cache, report figures, audit samples.

Each stage writes JSON lines that the next one reads, so that a language model is asked once however often links are
mapped again. Counters come back as one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t
from ..functions import wordlists as w
from ..operators import evaluation
from ..operators.audit import ERROR, audit
from ..operators.extraction import Extractor, extract, rules_extractor
from ..operators.mapping import CHECK, LINK
from ..operators.pairing import paired
from ..operators.validation import CATEGORIES, CONDITIONS, RESULT_TYPES, well_typed
from ..session import settled
from ..sources import readers
from ..sources.artefacts import Artefacts
from ..sources.readers import GOAL, PlanStore
from .pipeline import BagOfWords, admit, finish, response

STAGE = f"query_id long, query string, article string, normalized_query string, query_variations array<string>, fallback string, response struct<contexts:array<{GOAL}>>"
#: Codes of rules about form, which the report counts apart.
FORM = ("GOAL_FORMAT", "TITLE_WORDS", "TITLE_CASE", "ACTION_NAME_CASE", "DESC_PREFIX", "DESC_WORDS")


def well_formed(reply: Column) -> Column:
    """Whether each plan of a reply has all that a plan must have, with legal kinds. No plans, or a null reply, is legal.

    It judges a reply as read, by a reader that casts; `validation.well_typed` judges what stood there.
    """
    known = lambda c, legal: F.coalesce(c.isin(*legal), F.lit(True))
    every = lambda items, rule: items.isNotNull() & F.coalesce(F.forall(items, lambda x: F.coalesce(rule(x), F.lit(False))), F.lit(False))

    def link(x: Column) -> Column:
        return x.isNull() | (x["deeplink"].isNotNull() & x["description"].isNotNull())

    def check(x: Column) -> Column:
        return x.isNull() | (x["deeplink"].isNotNull() & x["key"].isNotNull() & known(x["resultType"], RESULT_TYPES) & known(x["condition"], CONDITIONS))

    def group(x: Column) -> Column:
        return every(x["steps"], lambda s: s.isNotNull()) & link(x["actionableDeeplink"]) & check(x["validationDeeplink"])

    def action(x: Column) -> Column:
        return x["actionName"].isNotNull() & x["description"].isNotNull() & known(x["category"], CATEGORIES) & every(x["stepGroups"], group)

    def plan(x: Column) -> Column:
        return x["goal"].isNotNull() & x["title"].isNotNull() & x["score"].isNotNull() & every(x["actions"], action)

    return reply["contexts"].isNull() | every(reply["contexts"], plan)


def plans_of(replies: DataFrame, key: str) -> DataFrame:
    """The plans of replies (key, response) as the audit takes them; plan_id is key:number. Actions of no category are manual."""
    actions = F.transform(
        "c.actions",
        lambda a: F.struct(
            a["actionName"].alias("name"), a["description"].alias("description"), F.coalesce(a["category"], F.lit("manual")).alias("category"),
            F.transform(a["stepGroups"], lambda g: F.struct(g["steps"].alias("steps"), g["actionableDeeplink"].alias("link"), g["validationDeeplink"].alias("check"))).alias("groups"),
        ),
    )
    each = replies.select(key, F.posexplode("response.contexts").alias("n", "c"))
    return each.select(key, F.concat_ws(":", F.col(key).cast("string"), "n").alias("plan_id"), "c.goal", "c.title", "c.score", actions.alias("actions"))


def audited(replies: DataFrame, key: str, uris: DataFrame) -> DataFrame:
    """key, schema_valid, errors, warnings, codes (of errors): a row for each reply. Ill-formed replies are not audited.

    raw, if there is such a column, is the reply before it was cast, whose types are judged as well.
    """
    valid = well_formed(F.col("response"))
    judged = replies.withColumn("schema_valid", well_typed(F.col("raw")) & valid if "raw" in replies.columns else valid)
    plans = plans_of(judged.where("schema_valid"), key)
    issues = audit(plans.drop(key), uris).join(plans.select("plan_id", key), "plan_id")
    is_error = F.col("severity") == ERROR
    counted = issues.groupBy(key).agg(F.count_if(is_error).alias("errors"), F.count_if(~is_error).alias("warnings"), F.sort_array(F.collect_set(F.when(is_error, F.col("code")))).alias("codes"))
    rows = judged.select(key, "schema_valid").join(counted, key, "left").na.fill(0, ["errors", "warnings"])
    return rows.withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))


def legal_uris(catalog: DataFrame) -> DataFrame:
    return readers.catalog_uris(catalog).union(catalog.sparkSession.createDataFrame([(w.PLACEHOLDER_URI,)], "uri string"))


def _counters(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """rows, schema_valid, plans, clean_plans."""
    has_plan = F.size("response.contexts") > 0
    return rows.join(judged, "query_id").agg(
        F.count("*").alias("rows"), F.count_if("schema_valid").alias("schema_valid"), F.count_if(has_plan).alias("plans"),
        F.count_if(has_plan & F.col("schema_valid") & (F.col("errors") == 0)).alias("clean_plans"),
    )


def _stage_rows(asked: DataFrame, plans: DataFrame) -> DataFrame:
    held = plans.select("query_id", response(plans).alias("response"))
    none = F.from_json(F.lit('{"contexts":[]}'), f"struct<contexts:array<{GOAL}>>")
    rows = asked.join(held, "query_id", "left").withColumn("response", F.coalesce("response", none))
    return rows.select("query_id", "query", "article", "normalized_query", "query_variations", "fallback", "response")


def extract_stage(complaints: DataFrame, articles: DataFrame, catalog: DataFrame, path: str, extractor: Extractor = rules_extractor, kind: str = "rules") -> DataFrame:
    """complaints (query_id, query) with their articles' plans, without links, written to path. Returns the counters."""
    asked = paired(complaints.select("query_id", "query"), articles)
    asked = asked.withColumn("article", F.when(F.trim(F.coalesce("content", F.lit(""))) != "", t.article_hash(F.col("title"), F.col("content"))))
    extracted = settled(extract(asked, extractor, kind), "extracted")
    group = lambda a: F.array(F.struct(a["steps"].alias("steps"), F.lit(None).cast(LINK).alias("link"), F.lit(None).cast(CHECK).alias("check")))
    actions = F.transform("actions", lambda a: F.struct(a["name"].alias("name"), a["description"].alias("description"), a["category"].alias("category"), group(a).alias("groups")))
    plans = extracted.where("fallback IS NULL").select("query_id", "goal", F.col("plan_title").alias("title"), "score", actions.alias("actions"))
    readers.write_jsonl(_stage_rows(extracted, plans), path)
    rows = catalog.sparkSession.read.schema(STAGE).json(path)
    return _counters(rows, audited(rows, "query_id", legal_uris(catalog)))


def map_stage(catalog: DataFrame, source: str, path: str, artefacts: Artefacts | None = None) -> DataFrame:
    """What extract_stage wrote to source with links and final order, written to path.

    Of a reply the first plan is mapped. Returns the counters, the actions of each category, how many auto ones have a link,
    and links by kind. artefacts: where the catalog's index is kept.
    """
    spark = catalog.sparkSession
    rows = spark.read.schema(STAGE).json(source)
    first = F.get("response.contexts", F.lit(0))
    flat = F.transform(first["actions"], lambda a: F.struct(a["actionName"].alias("name"), a["description"].alias("description"), a["category"].alias("category"), F.get(a["stepGroups"], F.lit(0))["steps"].alias("steps")))
    extracted = rows.withColumns({"goal": first["goal"], "plan_title": first["title"], "score": first["score"], "actions": flat})
    done = settled(finish(extracted.where(first.isNotNull()).drop("response"), catalog, artefacts), "plans")
    readers.write_jsonl(_stage_rows(rows.drop("response"), done), path)
    mapped = spark.read.schema(STAGE).json(path)
    of_category = [F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES]
    linked = F.col("link").isNotNull()
    dummy = F.col("link.originalType") == "placeholder"
    links = plans_of(mapped, "query_id").select(F.explode("actions").alias("a")).select("a.category", F.get("a.groups", F.lit(0))["link"].alias("link")).agg(
        *of_category, F.count_if((F.col("category") == "auto") & linked).alias("auto_linked"), F.count_if(linked & F.coalesce(dummy, F.lit(False))).alias("placeholder_links"),
        F.count_if(linked & ~F.coalesce(dummy, F.lit(False))).alias("catalog_links"),
    )
    return _one_row(spark, _counters(mapped, audited(mapped, "query_id", legal_uris(catalog))).first().asDict() | links.first().asDict())


def warm(catalog: DataFrame, source: str, store: PlanStore, embedder: BagOfWords | None = None, rebuild: bool = False) -> int:
    """Writes the plans that map_stage left in source, and that have no error, through to the cache; how many these are.

    Of complaints with one normalised text the last query_id counts. rebuild empties the cache first.
    """
    embedder = embedder or BagOfWords()
    rows = catalog.sparkSession.read.schema(STAGE).json(source).where(F.size("response.contexts") > 0)
    good = rows.join(audited(rows, "query_id", legal_uris(catalog)).where("schema_valid AND errors = 0").select("query_id"), "query_id")
    last = Window.partitionBy("plan_id").orderBy(F.col("query_id").desc())
    new = good.withColumn("plan_id", t.plan_id(F.col("query"))).withColumn("_r", F.row_number().over(last)).where("_r = 1").select(
        "plan_id", "query", F.to_json("response", {"ignoreNullFields": "false"}).alias("response"), F.col("query_variations").alias("variations"), "article",
        F.unix_timestamp().cast("double").alias("created"), "normalized_query",
    )
    new = settled(new, "warmed")
    if rebuild:
        store.clear(embedder.name)
    admit(new, store, embedder, store.last())
    return new.count()


def _one_row(spark: SparkSession, figures: dict[str, object]) -> DataFrame:
    return spark.range(1).select(*(F.lit(v).cast("double").alias(k) if v is None else F.lit(v).alias(k) for k, v in figures.items()))


def figures(catalog: DataFrame, source: str, review: str | None = None, **measured: DataFrame | None) -> DataFrame:
    """One row of figures for the report over the replies in source: shares of form, rules, links and leaks, manual scores, and
    the columns of each measured row under its name. A review file or a row that is missing leaves its figures null."""
    spark = catalog.sparkSession
    rows = spark.read.schema(STAGE).json(source)
    judged = audited(rows, "query_id", legal_uris(catalog))
    share = lambda c: F.round(F.count_if(c) / F.count("*"), 3)
    of_form = F.arrays_overlap("codes", F.array(*map(F.lit, FORM)))
    found = judged.agg(
        F.count("*").alias("replies"), share(F.col("schema_valid")).alias("schema_valid"), share(~of_form).alias("form"), share(F.col("errors") == 0).alias("without_error"),
        F.count_if(F.array_contains("codes", "URL_LEAK")).alias("leaks"),
    ).first().asDict()
    first_links = plans_of(rows, "query_id").select(F.explode("actions").alias("a")).select("a.category", F.get("a.groups", F.lit(0))["link"].alias("link"))
    found |= evaluation.link_coverage(first_links, legal_uris(catalog)).first().asDict()
    scores = readers.review(spark, review).first().asDict() if review and readers.exists(spark, review) else {}
    found |= {k: scores.get(k) for k in ("n_step_accuracy", "mean_step_accuracy", "mean_deeplink_relevance")}
    for name, row in measured.items():
        held = row.first() if row is not None else None
        found |= {f"{name}_{k}": v for k, v in held.asDict().items()} if held else {name: None}
    return _one_row(spark, found)


def sample_audit(spark: SparkSession, glob: str, catalog: DataFrame) -> DataFrame:
    """file, schema_valid, errors, warnings, codes, passed: the replies of the JSON files that glob names, one a file."""
    judged = audited(readers.samples(spark, glob), "file", legal_uris(catalog))
    return judged.withColumn("passed", F.col("schema_valid") & (F.col("errors") == 0))


def status(samples: DataFrame, strict: bool) -> int:
    """1 if a sample failed and strict is set, else 0: what a job ends with."""
    return int(strict and not samples.where("NOT passed").isEmpty())
