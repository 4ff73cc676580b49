"""Exact dedup (6) over an extendible-hash index on shared files. DataFrame functions only.

Texts are equal when they are identical after all white space is deleted. Each row gets a 64-bit key of its normalised
text. A directory over the keys' leading bits starts from one bucket; a bucket over ``capacity`` different keys is split
in two by one more bit, which doubles the directory where that bit is new. There is no bound on its depth but the key's
64 bits: a bucket of one key can't be split, and its texts are one chain.

Rows look their bucket up in the directory. Copies are merged where they are read (a hot text moves once a task), then
owner tasks take ranges of buckets, that is of keys: they chain the texts of a key in order of their bytes, which tells
different texts of one key apart, name the row of each text that stays, and write their buckets to the index file in the
shared folder. Every result is looked up in these files, by bucket, key and digest.

Null texts count as empty, and all empty texts form one group. Ties on length go to the smaller doc_id (null last),
then to one of the repeated rows: exactly one row of a group is kept. Very long texts are hashed and compared whole. An
empty table gives an empty result. Columns of the input other than doc_id and text are neither read nor returned,
whatever their names; `deduplicated` returns them as they are.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import BROADCAST_ROWS, digest, joined_by, marked, table, without_spaces, written

#: Different keys that a bucket may hold before it is split.
CAPACITY = 4096
KEY_BITS = 64


def leading(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, KEY_BITS - bits) if bits else F.lit(0).cast("long")


def hashed_rows(docs: DataFrame) -> DataFrame:
    """A small row for each row of docs, written once: doc_id, key, text_sha256, n_code_points, a row number, a digest."""
    text = without_spaces(F.col("text"))
    small = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(text).alias("key"),
        F.sha2(text, 256).alias("text_sha256"),
        F.coalesce(F.length("text"), F.lit(0)).alias("n_code_points"),
        F.monotonically_increasing_id().alias("row"),
        digest().alias("digest"),
    )
    return written(small, "dedup-rows")


def directory(keys: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """(slot, bucket, depth for each slot of the directory that holds keys; the directory's depth).

    keys: key, different ones. A bucket is named by its first slot; depth is its own, at most the directory's.
    """
    depth = max(0, ceil(log2(keys.count() / capacity + 1)))
    while True:
        slots = written(keys.groupBy(leading(F.col("key"), depth).alias("slot")).agg(F.count("*").alias("n")), "dedup-slots")
        most = slots.agg(F.max("n")).first()[0] or 0
        if most <= capacity or depth == KEY_BITS:
            break
        depth = min(KEY_BITS, depth + max(1, ceil(log2(most / capacity))))
    # The counts of every bucket on the way from the whole (depth 0) to the slots, and of the bucket that it was split from.
    every = slots.select("n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("depth"), "slot")
    prefix = lambda d: F.expr(f"shiftrightunsigned(slot, {depth} - ({d}))")
    counts = every.withColumn("prefix", prefix("depth")).groupBy("depth", "prefix").agg(F.sum("n").alias("n"))
    fits = (F.col("n") <= capacity) | (F.col("depth") == depth)
    own = every.select("slot", "depth", prefix("depth").alias("prefix")).join(counts.where(fits).select("depth", "prefix"), ["depth", "prefix"])
    own = own.groupBy("slot").agg(F.min("depth").alias("depth"))
    first = F.expr(f"shiftleft(shiftrightunsigned(slot, {depth} - depth), {depth} - depth)")
    return written(own.select("slot", first.alias("bucket"), "depth"), "dedup-directory"), depth


def in_buckets(rows: DataFrame, slots: DataFrame, depth: int, n_slots: int) -> DataFrame:
    """rows (with a key) with the bucket that the directory names."""
    if n_slots <= BROADCAST_ROWS:
        slots = F.broadcast(slots)
    return rows.withColumn("slot", leading(F.col("key"), depth)).join(slots, "slot").drop("slot")


def build_index(docs: DataFrame, rows: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """(the index file: bucket, depth, key, place in the key's chain, text_sha256, group_size, keep_id, keep_row; rows
    with their buckets)."""
    best = F.max(F.struct("n_code_points", F.col("doc_id").isNotNull().alias("b"), (-1 - F.col("doc_id")).alias("c"))).alias("best")
    keys = written(rows.groupBy("key").agg(F.count("*").alias("n"), F.any_value("text_sha256").alias("text_sha256"), best), "dedup-keys")
    slots, depth = directory(keys.select("key"), capacity)
    n_slots = slots.count()
    # Texts are moved only for keys that occur more than once.
    twice = written(keys.where("n > 1").select("key"), "dedup-twice")
    if twice.count() <= BROADCAST_ROWS:
        twice = F.broadcast(twice)
    text = without_spaces(F.col("text"))
    copied = docs.select(
        F.xxhash64(text).alias("key"), text.alias("normal"), F.coalesce(F.length("text"), F.lit(0)).alias("n_code_points"), F.col("doc_id").cast("long").alias("doc_id")
    ).join(twice, "key", "left_semi")
    merged = copied.groupBy("key", "normal").agg(F.count("*").alias("n"), best)
    single = keys.where("n = 1").select("key", F.lit(None).cast("string").alias("normal"), "n", "best", "text_sha256")
    entries = merged.select("key", "normal", "n", "best", F.lit(None).cast("string").alias("text_sha256")).unionByName(single)
    owned = in_buckets(entries, slots, depth, n_slots).repartitionByRange("bucket", "key")
    chain = owned.withColumn("place", F.dense_rank().over(Window.partitionBy("bucket", "key").orderBy("normal")))
    index = chain.select(
        "bucket",
        "depth",
        "key",
        "place",
        F.coalesce("text_sha256", F.sha2("normal", 256)).alias("text_sha256"),
        F.col("n").alias("group_size"),
        F.when(F.col("best.b"), -1 - F.col("best.c")).alias("keep_id"),
        F.col("best.n_code_points").alias("keep_points"),
    )
    return written(index, "dedup-index"), in_buckets(rows, slots.drop("depth"), depth, n_slots)


def exact_duplicates(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """A row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    return _decided(docs, capacity).drop("digest")


def _decided(docs: DataFrame, capacity: int) -> DataFrame:
    rows = hashed_rows(docs)
    index, rows = build_index(docs, rows, capacity)
    key = ["bucket", "key", "text_sha256"]
    found = joined_by(rows, index.select(*key, "group_size", "keep_id", "keep_points", F.col("group_size").alias("n")), key, "n")
    # Rows that agree with the kept one in doc_id and length are repeated, but for white space: the first stays.
    same = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_code_points") == F.col("keep_points"))
    found = written(found.withColumn("same", same), "dedup-found")
    again = found.where("same AND group_size > 1").groupBy(*key).agg(F.min("row").alias("keep_row"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = written(again, "dedup-again")
    if again.count() <= BROADCAST_ROWS:
        again = F.broadcast(again)
    every = found.join(again, key, "left").withColumn("kept", F.col("same") & (F.col("row") == F.coalesce("keep_row", "row")))
    return every.select("doc_id", "keep_id", "group_size", "kept", "text_sha256", "digest")


def deduplicated(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    return marked(docs, _decided(docs, capacity))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS normal
  FROM documents
), g AS (
  SELECT doc_id, normal, count(*) OVER (PARTITION BY normal) AS group_size,
         first_value(doc_id) OVER (PARTITION BY normal ORDER BY n DESC, doc_id) AS keep_id
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(normal) AS text_sha256 FROM g
"""
