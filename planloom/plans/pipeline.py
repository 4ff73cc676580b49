"""The whole flow over many complaints at once: cache, extraction, mapping, order, audit, replies, write-through."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t
from ..functions import wordlists as w
from ..operators import cache
from ..operators.audit import audit, clean_plans
from ..operators.extraction import Extractor, extract, rules_extractor
from ..operators.mapping import map_actions
from ..operators.ordering import order_actions
from ..operators.retrieval import usable_entries
from ..session import settled
from ..sources.artefacts import Artefacts
from ..sources.readers import GOAL, PlanStore, catalog_uris


class BagOfWords:
    """An embedder without a model: words hashed into buckets, counted, to unit length. Any object with name and encode will do."""

    def __init__(self, buckets: int = 512):
        self.buckets, self.name = buckets, f"words:{buckets}"

    def encode(self, text: Column) -> Column:
        words = F.filter(F.split(t.normalize_query(text), " "), lambda x: x != "")
        hashed = F.transform(words, lambda x: (F.crc32(x.cast("binary")) % self.buckets).cast("int"))
        counts = F.transform(F.sequence(F.lit(0), F.lit(self.buckets - 1)), lambda b: F.size(F.filter(hashed, lambda h: h == b)).cast("double"))
        length = lambda c: F.greatest(F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)), F.lit(1.0))
        return t.let(counts, lambda c: t.let(length(c), lambda n: F.transform(c, lambda x: (x / n).cast("float"))))


@dataclass(frozen=True)
class Settings:
    threshold: float = w.CACHE_THRESHOLD
    margin: float = w.CACHE_MARGIN
    kind: str = "rules"


def finish(extracted: DataFrame, catalog: DataFrame, artefacts: Artefacts | None = None) -> DataFrame:
    """Extracted complaints (query_id, ...) with mapped, ordered actions: plan_id, goal, title, score, actions with groups."""
    good = extracted.where("fallback IS NULL")
    exploded = good.select("query_id", F.posexplode("actions").alias("action_no", "a")).select(
        F.concat_ws(":", F.col("query_id").cast("string"), F.col("action_no").cast("string")).alias("action_id"), "query_id", "action_no", "a.*"
    )
    mapped = map_actions(exploded, usable_entries(catalog), artefacts)
    row = F.struct("action_no", "name", "description", "category", "steps", "link", "check")
    nested = mapped.groupBy("query_id").agg(F.sort_array(F.collect_list(row)).alias("actions"))
    actions = F.transform(
        order_actions(F.col("actions")),
        lambda a: F.struct(
            a["name"].alias("name"), a["description"].alias("description"), a["category"].alias("category"),
            F.array(F.struct(a["steps"].alias("steps"), a["link"].alias("link"), a["check"].alias("check"))).alias("groups"),
        ),
    )
    plans = good.select("query_id", t.plan_id(F.col("query")).alias("plan_id"), "query", "goal", F.col("plan_title").alias("title"), "score", "normalized_query", "query_variations", "article")
    return plans.join(nested.select("query_id", actions.alias("actions")), "query_id")


def response(plans: DataFrame) -> Column:
    """The nested answer in its published shape."""
    actions = F.transform(
        "actions",
        lambda a: F.struct(
            a["name"].alias("actionName"), a["description"].alias("description"), a["category"].alias("category"),
            F.transform(a["groups"], lambda g: F.struct(
                g["steps"].alias("steps"),
                F.when(g["link"].isNotNull(), F.struct(g["link"]["deeplink"].alias("deeplink"), g["link"]["description"].alias("description"), g["link"]["message"].alias("message"), F.lit(None).cast("map<string,string>").alias("classes"), g["link"]["originalType"].alias("originalType"))).alias("actionableDeeplink"),
                g["check"].alias("validationDeeplink"),
            )).alias("stepGroups"),
        ),
    )
    return F.struct(F.array(F.struct("goal", "title", "score", actions.alias("actions"))).alias("contexts")).cast(f"struct<contexts:array<{GOAL}>>")


def admit(new: DataFrame, store: PlanStore, embedder: BagOfWords, version: int, stream: dict | None = None) -> None:
    """Writes a version of the store in which new (its columns and normalized_query; one row a plan_id) replaced plans of their ids.

    version: the one that was read. Vectors of another embedder are made anew, and the store is written whole.
    """
    new = settled(new, "new-plans")
    # Sorted by ranges of plans: the numbers of the rows rise with plan_id and place, though no task has all of them.
    ordered = cache.doors_of(new).orderBy("plan_id", "place").withColumn("seq", F.monotonically_increasing_id())
    new_doors = ordered.withColumn("vec", embedder.encode(F.col("text"))).select("plan_id", "kind", "text", "norm", "vec", "seq")
    made_by = store.commit(version)["embedder"]
    if made_by not in (None, embedder.name):
        plans, doors, _ = store.read(version)
        store.write(plans, doors.withColumn("vec", embedder.encode(F.col("text"))), embedder.name)
    if stream or not new.isEmpty():
        store.put(new.drop("normalized_query"), new_doors, embedder.name, stream)


def answer(complaints: DataFrame, catalog: DataFrame, store: PlanStore, embedder: BagOfWords | None = None, extractor: Extractor = rules_extractor, settings: Settings = Settings(), batch: tuple[str, int] | None = None, artefacts: Artefacts | None = None) -> DataFrame:
    """A reply for each complaint (query_id, query, title, content): from the cache, from its article, or a fallback.

    New plans without an audit error are written through. Articles without content count as no article. batch: name of a
    stream and number in it; a batch that was written through before is answered from the version that it read then.
    artefacts: where the catalog's index is kept, so that it is built once for the same entries.
    """
    embedder = embedder or BagOfWords()
    before = store.batch_of(batch[0]) if batch else None
    again = before is not None and before["batch"] == batch[1]
    version = before["read"] if again else store.last()
    plans, doors, made_by = store.read(version)
    centres = store.centres(version)
    if made_by and made_by != embedder.name:  # the vectors mean nothing to this embedder
        doors, centres = doors.withColumn("vec", embedder.encode(F.col("text"))), None
    asked = complaints.withColumn("article", F.when(F.trim(F.coalesce("content", F.lit(""))) != "", t.article_hash(F.col("title"), F.col("content"))))
    asked = settled(asked, "complaints")
    queries = settled(asked.select("query_id", F.col("query").alias("text"), "article", embedder.encode(F.col("query")).alias("vec")), "vectors")
    hits = cache.lookup(queries, plans, doors, settings.threshold, settings.margin, centres).join(plans.select("plan_id", F.col("response").alias("held"), "variations"), "plan_id")
    hits = settled(hits, "hits")
    served = hits.join(asked.select("query_id", "query"), "query_id").select(
        "query_id", "query", F.col("variations").alias("query_variations"), F.col("held").alias("response"), F.lit(True).alias("cache_hit"),
        "match", "similarity", F.lit(None).cast("string").alias("fallback"),
    )
    missed = asked.join(hits.select("query_id"), "query_id", "left_anti")
    extracted = settled(extract(missed, extractor, settings.kind), "extracted")
    done = settled(finish(extracted, catalog, artefacts), "plans")
    issues = audit(done.select("plan_id", "goal", "title", "score", "actions"), catalog_uris(catalog).union(catalog.sparkSession.createDataFrame([(w.PLACEHOLDER_URI,)], "uri string")))
    answered = done.withColumn("response", F.to_json(response(done), {"ignoreNullFields": "false"}))
    fresh = missed.select("query_id", "query").join(answered.select("query_id", "response", "query_variations"), "query_id", "left").join(extracted.select("query_id", "fallback"), "query_id").select(
        "query_id", "query", F.coalesce("query_variations", F.array().cast("array<string>")).alias("query_variations"),
        F.coalesce("response", F.lit('{"contexts":[]}')).alias("response"), F.lit(False).alias("cache_hit"),
        F.lit(None).cast("string").alias("match"), F.lit(None).cast("double").alias("similarity"), "fallback",
    )
    new = clean_plans(answered, issues)
    last = Window.partitionBy("plan_id").orderBy(F.col("query_id").desc())
    new = new.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r").select(
        "plan_id", "query", "response", F.col("query_variations").alias("variations"), "article", F.unix_timestamp().cast("double").alias("created"), "normalized_query"
    )
    # A reply has to be settled before the store it was looked up in changes.
    replies = settled(served.unionByName(fresh), "replies")
    if not again:
        admit(new, store, embedder, version, {"name": batch[0], "batch": batch[1], "read": version} if batch else None)
    return replies
