"""Sources and sinks: catalogs, articles, complaint lines, stage outputs, evaluation files, the plan store, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import exists
from .plan_store import DOORS, PLANS, PlanStore

__all__ = ["DOORS", "PLANS", "PlanStore", "exists"]  # beside what this module defines

LINK_ROW = """id string, deeplink string, description string, message string, originalType string, qna_description string,
validation struct<deeplink:string,key:string>"""
CATALOG = f"deeplinks array<struct<{LINK_ROW.replace(' string', ':string').replace('validation struct', 'validation:struct')}>>"
ARTICLES = "responses array<struct<id:string,original_query:string,siis_response:struct<title:string,content:string>>>"
HELD_OUT = "_readme string, items array<struct<input_line:int,paraphrases:array<string>>>"
REVIEW = "_readme string, scores array<struct<input_line:int,step_accuracy:double,deeplink_relevance:double>>"
GOAL = """struct<goal:string,title:string,score:double,actions:array<struct<actionName:string,description:string,
category:string,stepGroups:array<struct<steps:array<string>,
actionableDeeplink:struct<deeplink:string,description:string,message:string,classes:map<string,string>,originalType:string>,
validationDeeplink:struct<deeplink:string,key:string,resultType:string,condition:string,value:string>>>>>>"""
REPLY = f"query string, query_variations array<string>, response struct<contexts:array<{GOAL}>>, meta map<string,string>"


def catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CATALOG).json(path, multiLine=True).select(F.inline("deeplinks"))


def catalog_uris(entries: DataFrame) -> DataFrame:
    """uri: all addresses that a plan may carry."""
    return entries.select(F.col("deeplink").alias("uri")).union(entries.select("validation.deeplink")).where("uri IS NOT NULL").distinct()


def articles(spark: SparkSession, path: str) -> DataFrame:
    """position, id, original_query, title, content; position keeps the file's order."""
    rows = spark.read.schema(ARTICLES).json(path, multiLine=True).select(F.posexplode("responses").alias("position", "r"))
    return rows.select("position", "r.id", "r.original_query", "r.siis_response.title", "r.siis_response.content")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line (from 1, blank ones not counted), text: the lines of one small file, whose order is a key."""
    whole = spark.read.text(path, wholetext=True)
    kept = F.filter(F.transform(F.split("value", r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")
    return whole.select(F.posexplode(kept).alias("line", "text")).select((F.col("line") + 1).alias("line"), "text")


def replies(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPLY).json(path)


def held_out(spark: SparkSession, path: str) -> DataFrame:
    """line, paraphrase."""
    items = spark.read.schema(HELD_OUT).json(path, multiLine=True).select(F.inline("items"))
    return items.select(F.col("input_line").alias("line"), F.explode("paraphrases").alias("paraphrase"))


def review(spark: SparkSession, path: str) -> DataFrame:
    """n and mean of the manual scores that are filled in."""
    rows = spark.read.schema(REVIEW).json(path, multiLine=True).select(F.inline("scores"))
    return rows.agg(*(f("step_accuracy").alias(f"{n}_step_accuracy") for n, f in (("n", F.count), ("mean", F.avg))), F.avg("deeplink_relevance").alias("mean_deeplink_relevance"))


def samples(spark: SparkSession, glob: str) -> DataFrame:
    """file and reply of each JSON file that the glob names; raw: the response as it stands, before it is cast (null then, if it can't be)."""
    rows = spark.read.schema("query string, response variant").json(glob, multiLine=True).withColumn("file", F.col("_metadata.file_name"))
    cast = F.from_json(F.to_json("response"), f"struct<contexts:array<{GOAL}>>".replace("\n", ""))
    return rows.select("query", F.col("response").alias("raw"), cast.alias("response"), "file")


def to_article(raw: Column) -> Column:
    """struct(title, content) of raw text, or of JSON with title and content or with a whole response row around them."""
    parsed = F.from_json(raw, "struct<title:string,content:string,siis_response:struct<title:string,content:string>>")
    inner = F.coalesce(parsed["siis_response"], F.struct(parsed["title"].alias("title"), parsed["content"].alias("content")))
    is_object = F.coalesce(F.trim(raw).startswith("{"), F.lit(False)) & parsed.isNotNull() & (inner["content"].isNotNull() | inner["title"].isNotNull())
    text = F.struct(F.lit("").alias("title"), raw.alias("content"))
    return F.when(raw.isNull(), F.lit(None)).when(is_object, inner).otherwise(text)


def write_jsonl(df: DataFrame, path: str) -> None:
    """UTF-8 as it is, one reply a line."""
    df.write.mode("overwrite").json(path)


def write_report(metrics: DataFrame, path: str) -> None:
    """One row of figures as one JSON file."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def markdown_report(metrics: DataFrame, title: str) -> str:
    """A row of figures as a table; what is missing reads n/a."""
    first = metrics.first()
    row = first.asDict() if first else {}
    shown = lambda v: "n/a" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    return "\n".join([f"# {title}", "", "| figure | value |", "|---|---|", *(f"| {k} | {shown(v)} |" for k, v in row.items()), ""])
