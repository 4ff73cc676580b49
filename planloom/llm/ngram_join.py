"""N-gram Jaccard join (1) by MinHash banding: five-word shingles, similarity 0.8 and more.

BANDS bands of ROWS minima each find a pair of similarity 0.8 with probability 1 - (1 - 0.8**6)**36 > 0.99998, and a
more similar one with more. Rows with equal shingle sets form one class, and classes join once. Band hashes alone are
shuffled first; links from each row of a bucket to its least row chain the buckets to candidate groups, so that a
group's texts are moved once and not once a band. A large group is dealt out by blocks, and each pair of blocks is a
task: it verifies the pairs that agree in a band on their full shingle sets, and returns a row for each member, with
the number of its links and a link to the least member it reaches, never a row for each pair.

Words are runs of characters other than white space, case and signs kept. A text of one to four words has one shingle
of all of them; a text without words (null ones too) has no links and is a class of its own. Repeated rows and equal
texts are linked to each other. class_id is the least doc_id of the connected rows (null only if all are null),
kept marks one row of each class, that of the least doc_id. n_links counts the other rows at 0.8 or more, copies
included. An empty table gives no rows. Columns other than doc_id and text are not read. Very long texts are shingled
whole. Shingles are compared by 64-bit hashes, and sets that agree in a 128-bit digest of their sorted hashes are equal.

Links are counted exactly, so the work of one candidate group grows with the square of its different texts; its pairs
of blocks are tasks of their own, each with two blocks of texts, and the texts of a group of b blocks are sent b times.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import digest, in_parts, joined_by, marked, table, written
from .components import components
from .shingles import BLOCK_BYTES, mix, shingle_sets

ORACLE_SQL = None

BANDS, ROWS = 36, 6
#: Jaccard similarity of at least 4/5.
LEAST = (4, 5)
#: Members and shingles of a block of a candidate group.
BLOCK_ROWS, BLOCK_SHINGLES = 2048, 1_000_000
#: Candidates are broadcast to the documents' scan up to this many bytes, else both are shuffled.
BROADCAST_BYTES = 16_000_000
#: Bytes of a candidate row: its bands and eight numbers, and four bytes for each block that it meets.
ROW_BYTES = 8 * (BANDS + 8)
_FACTORS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def bands(grams: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row of BANDS hashes for each text with shingles."""
    starts = ends[:-1][np.diff(ends) > 0]
    out = np.zeros((len(starts), BANDS), np.uint64)
    if len(starts):
        for band in range(BANDS):
            hashed = np.full(len(starts), band + 1, np.uint64)
            for factor in _FACTORS[band * ROWS : (band + 1) * ROWS]:
                hashed = mix(hashed * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(grams * factor, starts))
            out[:, band] = hashed
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """row, doc_id, digest (of the text), n_shingles, set_a, set_b (a 128-bit hash of the shingle set), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_parts(batches, 3, BLOCK_BYTES):
            grams, ends = shingle_sets([t or b"" for t in part.column(3).to_pylist()])
            n, some = np.diff(ends), np.diff(ends) > 0
            sets = np.frombuffer(b"".join(blake2b(grams[a:b].tobytes(), digest_size=16).digest() for a, b in zip(ends[:-1], ends[1:], strict=True)), np.int64).reshape(-1, 2)
            found = np.zeros((len(n), BANDS), np.uint64)
            found[some] = bands(grams, ends)
            each = pa.ListArray.from_arrays(np.arange(len(n) + 1, dtype=np.int32) * BANDS, found.view(np.int64).ravel())
            numbers = [pa.array(n.astype(np.int64)), pa.array(sets[:, 0]), pa.array(sets[:, 1])]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], *numbers, each], ["row", "doc_id", "digest", "n_shingles", "set_a", "set_b", "bands"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), digest().alias("digest"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "row long, doc_id long, digest long, n_shingles long, set_a long, set_b long, bands array<long>")


def candidate_groups(classes: DataFrame) -> DataFrame:
    """row, root: rows that a chain of common buckets connects. Rows of a bucket of very many meet its head where they are."""
    buckets = written(classes.select("row", F.explode("bands").alias("bucket")), "ngram-buckets")
    heads = buckets.groupBy("bucket").agg(F.min("row").alias("head"), F.count("*").alias("n")).where("n > 1")
    linked = joined_by(buckets, written(heads, "ngram-bucket-heads"), ["bucket"], "n")
    return components(linked.where("row <> head").select(F.col("row").alias("a"), F.col("head").alias("b")))


def verify_blocks(left: pd.DataFrame, right: pd.DataFrame | None) -> list[tuple[int, int, int]]:
    """(row, links, root) of the rows of one block, or of two blocks of one group. Columns: row, copies, bands, text."""
    both = left if right is None else pd.concat([left, right])
    grams, ends = shingle_sets(both.text.to_list())
    values, ids = np.unique(grams, return_inverse=True)
    counts, split = np.diff(ends), len(left)
    band = np.array(both.bands.to_list(), dtype=np.int64).reshape(len(both), BANDS)
    copies, rows = both.copies.to_numpy(), both.row.to_numpy()
    flags = np.zeros(len(values), bool)
    links, parent = np.zeros(len(both), np.int64), list(range(len(both)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(split):
        low = i + 1 if right is None else split
        near = low + np.flatnonzero((band[low:] == band[i]).any(1))
        if not len(near):
            continue
        flags[ids[ends[i] : ends[i + 1]]] = True
        common = np.add.reduceat(flags[np.concatenate([ids[ends[j] : ends[j + 1]] for j in near])].astype(np.int64), np.cumsum([0, *counts[near[:-1]]]))
        flags[ids[ends[i] : ends[i + 1]]] = False
        linked = near[LEAST[1] * common >= LEAST[0] * (counts[i] + counts[near] - common)]
        links[i] += copies[linked].sum()
        links[linked] += copies[i]
        for j in linked:
            a, b = find(i), find(int(j))
            if a != b:
                parent[max(a, b, key=lambda x: rows[x])] = min(a, b, key=lambda x: rows[x])
    return [(int(rows[k]), int(links[k]), int(rows[find(k)])) for k in range(len(both)) if links[k]]


def verified(docs: DataFrame, members: DataFrame) -> DataFrame:
    """row, links, root: for each pair of blocks in which a row has links.

    members: row, doc_id, digest, copies, bands, n_shingles, root.
    """
    sizes = members.groupBy("root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    sizes = sizes.withColumn("blocks", F.ceil(F.greatest(F.col("n") / BLOCK_ROWS, F.col("s") / BLOCK_SHINGLES)).cast("int")).drop("s")
    members = joined_by(members, written(sizes, "ngram-sizes"), ["root"], "n").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    members = written(members, "ngram-members")
    n, n_bytes = members.agg(F.count("*"), F.sum(ROW_BYTES + 4 * F.col("blocks"))).first()
    # Small groups are verified many to a task's data frame; each pair of blocks of a large one has a data frame of its own.
    dealt = max(1, n // 500)
    keyed = members.select(
        "row",
        "doc_id",
        "digest",
        "copies",
        "bands",
        "root",
        "block",
        F.when(F.col("blocks") == 1, F.array(F.lit(0)))
        .otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
        .alias("others"),
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(dealt))).otherwise(F.col("root")).alias("deal"),
    )
    if (n_bytes or 0) <= BROADCAST_BYTES:
        keyed = F.broadcast(keyed)
    texts = docs.select(F.col("doc_id").cast("long").alias("of_id"), digest().alias("of_digest"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    found = texts.join(keyed, F.col("of_id").eqNullSafe(F.col("doc_id")) & (F.col("of_digest") == F.col("digest")))
    found = found.withColumn("other", F.explode("others")).select(
        "row", "root", "copies", "bands", "text", "block", "deal", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    )

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in group.groupby("root"):
            # Equal rows are members once.
            part = part.drop_duplicates("row").sort_values("row")
            low = part.block == part.low
            same = part.low.eq(part.high).all()
            out += verify_blocks(part, None) if same else verify_blocks(part[low], part[~low])
        return pd.DataFrame(out, columns=["row", "links", "root"]).astype("int64")

    return written(found.groupBy("deal", "low", "high").applyInPandas(run, "row long, links long, root long"), "ngram-verified")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, class_id, n_links, kept."""
    return _decided(docs).drop("digest")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs of each class, with all its columns."""
    return marked(docs, _decided(docs))


def _decided(docs: DataFrame) -> DataFrame:
    signed = written(signatures(docs), "ngram-signatures")
    key = ["set_a", "set_b", "n_shingles"]
    some = F.col("n_shingles") > 0
    equal = signed.where(some).groupBy(*key).agg(F.min("row").alias("head"), F.count("*").alias("copies"))
    equal = written(equal, "ngram-classes")
    classes = signed.join(equal.select(F.col("head").alias("row"), "copies"), "row")
    groups = candidate_groups(classes.select("row", "bands"))
    links = verified(docs, classes.join(groups, "row"))
    joined = components(links.select(F.col("row").alias("a"), F.col("root").alias("b"))).withColumnRenamed("row", "head")
    counts = links.groupBy(F.col("row").alias("head")).agg(F.sum("links").alias("links"))
    heads = equal.join(joined, "head", "left").join(counts, "head", "left")
    heads = heads.select(*key, F.coalesce("root", "head").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies")
    small = ["row", "doc_id", "digest"]
    rows = joined_by(signed.where(some).select(*small, *key), written(heads, "ngram-heads"), key, "copies").select(*small, "root", "n_links")
    rows = written(rows.unionByName(signed.where(~some).select(*small, F.col("row").alias("root"), F.lit(0).cast("long").alias("n_links"))), "ngram-rows")
    # The least doc_id of each class, and of its rows with that doc_id the first.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    kept = rows.groupBy("root").agg(first.alias("first"), F.count("*").alias("n")).select("root", F.col("first.doc_id").alias("class_id"), F.col("first.row").alias("kept_row"), "n")
    every = joined_by(rows, written(kept, "ngram-kept"), ["root"], "n")
    return every.select("doc_id", "class_id", "n_links", (F.col("row") == F.col("kept_row")).alias("kept"), "digest")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
