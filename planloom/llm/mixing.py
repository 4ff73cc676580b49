"""Mixing sources to target weights (8) by hash-threshold histograms. DataFrame functions only.

Sources in code point order (null last) weigh 1, 2, 3, repeating, and share the words of the whole corpus. A target
stops at ``MOST`` times its source's words; the excess goes to the other sources by weight. A document enters whole:
as often as the whole part of target / source size says, and once more if its hash is below its source's threshold.
The thresholds come from nested histograms: words by source and hash bucket, then by finer buckets within the bucket
in which the budget runs out, three times over, until that bucket is one hash value, which is taken if that brings
the source nearer to its target. No rows are sorted, and the same rows give the same mix.

The hash is taken from doc_id, source and text, so only rows that repeat in all three enter together, and a source ends
within the words of one such group from its target. Null texts have no words; a source without words has target 0, and
none of its rows enter. No row enters more than ``MOST`` times. Very long texts count like others: whole. An empty table
gives an empty mix. Columns of any name pass `mixed`; `mix` reads doc_id, source and text only. The targets need the
sources in one order, so one task has a row of three numbers for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import columns_of, table, unused, written

WEIGHTS = (1, 2, 3)
MOST = 3
#: Bits of the hash that each histogram resolves, leading bits first.
LEVELS = (12, 16, 32)
HASH_BITS = sum(LEVELS)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hash60() -> Column:
    parts = (F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("doc_id", "source", "text"))
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target: a row for each source, from one row of words for each source.

    The windows below span the sources, never the documents.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    sources = sources.withColumn("weight", weight).withColumn("most", MOST * F.col("source_size"))
    # Water filling: in order of most / weight, the sources before the level's peak are full, the others share the rest.
    filling = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    none = F.lit(0).cast("long")
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), none)) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), none)
    )
    return (
        sources.withColumn("level", level)
        .withColumn("level", F.max("level").over(everything))
        .select("source", "source_size", F.least(F.col("most").cast("double"), F.col("weight") * F.col("level")).alias("target"))
    )


def thresholds(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """source, below: documents whose hash is less than below enter once more than `copies` says.

    sizes: source, size, hash. plan: source, rest (words still wanted).
    """
    inside = sizes.select("source", "size", "hash")
    bound = plan.select("source", "rest", F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("prefix"))
    left = HASH_BITS
    for bits in LEVELS:
        left -= bits
        bucket = F.shiftright("hash", left)
        histogram = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
        bound = bound.select(F.col("source").alias("bound_source"), "rest", "taken")
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) + F.col("taken")
        crossed = histogram.join(bound, F.col("source").eqNullSafe(F.col("bound_source"))).withColumn("upto", upto)
        bound = written(
            crossed.where("upto > rest")
            .groupBy("source")
            .agg(F.min(F.struct("bucket", "words", "upto", "rest")).alias("b"))
            .select("source", "b.rest", (F.col("b.upto") - F.col("b.words")).alias("taken"), F.col("b.bucket").alias("prefix"), "b.words"),
            "mix-bound",
        )
        edge = bound.select(F.col("source").alias("edge_source"), "prefix")
        inside = inside.join(edge, F.col("source").eqNullSafe(F.col("edge_source")) & (bucket == F.col("prefix"))).drop(
            "edge_source", "prefix"
        )
    over, under = F.col("taken") + F.col("words") - F.col("rest"), F.col("rest") - F.col("taken")
    return bound.select("source", (F.col("prefix") + (over < under).cast("long")).alias("below"))


def sized(docs: DataFrame) -> DataFrame:
    return written(docs.select("doc_id", "source", words(F.col("text")).alias("size"), hash60().alias("hash")), "mix-sizes")


def plan_mix(sizes: DataFrame) -> DataFrame:
    """source, source_size, target, copies (of all documents), below (documents of a lesser hash enter once more)."""
    plan = targets(sizes)
    copies = F.when(F.col("source_size") == 0, F.lit(0)).when(F.col("target") >= MOST * F.col("source_size"), F.lit(MOST)).otherwise(
        F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)))
    )
    plan = plan.withColumn("copies", copies.cast("long"))
    plan = written(plan.withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")), "mix-plan")
    open_ = plan.where((F.col("copies") < MOST) & (F.col("rest") > 0)).select("source", "rest")
    below = thresholds(sizes, open_).withColumnRenamed("source", "below_source")
    return plan.join(below, F.col("source").eqNullSafe(F.col("below_source")), "left").drop("below_source", "rest")


def _times(hash_: Column, copies: str, below: str) -> Column:
    return F.col(copies) + F.coalesce((hash_ < F.col(below)).cast("long"), F.lit(0).cast("long"))


def mix(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, size, source_size, target, taken."""
    sizes = sized(docs)
    plan = plan_mix(sizes).withColumnRenamed("source", "of_source")
    every = sizes.join(plan, F.col("source").eqNullSafe(F.col("of_source")))
    return every.select("doc_id", "size", "source_size", "target", (F.col("size") * _times(F.col("hash"), "copies", "below")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: the rows of docs, each as often as the mix takes it, with all their columns."""
    source, copies, below, again = unused(docs.columns, "mix_source", "mix_copies", "mix_below", "mix_again")
    plan = written(plan_mix(sized(docs)), "mix-final")
    plan = plan.select(F.col("source").alias(source), F.col("copies").alias(copies), F.col("below").alias(below))
    times = docs.join(plan, F.col("source").eqNullSafe(F.col(source)))
    # A row that is to enter no time has an empty array, and so no row.
    repeated = F.array_repeat(F.lit(0), _times(hash60(), copies, below).cast("int"))
    return times.select(*columns_of(docs), F.explode(repeated).alias(again)).select(*columns_of(docs))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(source, 'null') || ':' || coalesce(text, 'null')), 1, 15) AS BIGINT) AS hash
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3 * CAST(sum(size) AS BIGINT) AS most,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source
), f AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM s WINDOW w AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(CAST(most AS DOUBLE), weight * max(level) OVER ()) AS target FROM f
), p AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 WHEN target >= 3 * source_size THEN 3
                 ELSE CAST(floor(target / nullif(source_size, 0)) AS BIGINT) END AS copies FROM t
), h AS (
  SELECT d.source, hash, sum(d.size) AS words, any_value(target - copies * source_size) AS rest
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source WHERE copies < 3 AND target > copies * source_size GROUP BY d.source, hash
), c AS (
  SELECT *, sum(words) OVER (PARTITION BY source ORDER BY hash) AS upto FROM h
), b AS (
  SELECT source, min(hash + CASE WHEN upto - rest < rest - (upto - words) THEN 1 ELSE 0 END) AS below
  FROM c WHERE upto > rest AND upto - words <= rest GROUP BY source
)
SELECT doc_id, size, source_size, target, CAST(size * (copies + CASE WHEN hash < below THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source
"""
