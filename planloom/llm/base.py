"""What the operators share: input tables, tables written to the shared folder, and white space as contracts have it."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom.session import settled as written

__all__ = ["SPACES", "columns_of", "digest", "in_parts", "joined_by", "marked", "table", "unused", "without_spaces", "written"]

#: Space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each behind as many underscores as it takes to be none of the taken ones, in whatever case."""
    known = {c.lower() for c in taken}
    longest = max(map(len, known), default=0)
    return [next(n for k in range(1, longest + 2) if (n := "_" * k + name).lower() not in known) for name in names]


def columns_of(df: DataFrame) -> list[Column]:
    """All columns, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def without_spaces(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def in_parts(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of that column's texts (or one longer text): what Python copies at once."""
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = [0, *(np.flatnonzero(np.diff(upto // most)) + 1).tolist(), len(upto)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                yield batch.slice(a, b - a)


#: Small rows (a few numbers) are broadcast up to this many, and joined by a shuffle beyond it.
BROADCAST_ROWS = 300_000
#: Rows of one key beyond which the key counts as hot. At most one key in this many rows can be.
HOT_ROWS = 10_000


def digest() -> Column:
    """Tells texts of one doc_id apart."""
    return F.xxhash64(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))


def joined_by(rows: DataFrame, facts: DataFrame, key: list[str], n: str) -> DataFrame:
    """rows with the columns of facts (one row for each key, not null; n: how many rows have it) but n; inner join.

    The facts of hot keys are broadcast, of which there is at most one in HOT_ROWS rows: so no key makes a task large.
    """
    hot = facts.where(F.col(n) > HOT_ROWS).drop(n)
    cold = rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(facts.where(F.col(n) <= HOT_ROWS).drop(n), key)
    return cold.unionByName(rows.join(F.broadcast(hot), key))


def marked(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of docs that are kept. decided: doc_id, digest, kept for each row of docs.

    Only keys of rows that go are joined to docs, so that texts stay where they are while these keys are few enough to
    be broadcast. Of rows equal in doc_id and text, as many stay as are kept (one at most). Columns of any name pass.
    """
    id_, digest_, kept = unused(docs.columns, "gone_id", "gone_digest", "gone_kept")
    per = decided.groupBy("doc_id", "digest").agg(F.count("*").alias("rows"), F.count_if("kept").alias("kept"))
    gone = per.where("kept < rows").select(F.col("doc_id").alias(id_), F.col("digest").alias(digest_), F.col("kept").alias(kept))
    gone = written(gone, "gone")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    keyed = docs.join(gone, F.col("doc_id").eqNullSafe(F.col(id_)) & (digest() == F.col(digest_)), "left")
    stay = keyed.where(F.col(kept).isNull()).select(*columns_of(docs))
    one = keyed.where(F.col(kept) > 0).dropDuplicates([id_, digest_]).select(*columns_of(docs))
    return stay.unionByName(one)
