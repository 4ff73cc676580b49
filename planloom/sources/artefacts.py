"""Tables that are kept by the digest of what they were made from: built once, read from then on."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import LARGE_ROWS
from . import files


def digest_of(rows: DataFrame, *columns: str, made_by: str) -> str:
    """Of the rows' columns, in any order of rows, and of the name of what is made of them: 40 hexadecimal digits.

    Two sums of 64-bit hashes over all rows, in one pass without a shuffle of rows.
    """
    wide = "decimal(38,0)"
    one = F.xxhash64(F.lit("a"), *columns).cast(wide)
    two = F.xxhash64(*reversed(columns), F.lit("b")).cast(wide)
    sums = rows.agg(F.count("*"), F.sum(one), F.sum(two)).first()
    return hashlib.sha1(":".join(map(str, (made_by, *columns, *sums))).encode()).hexdigest()


class Artefacts:
    """A folder of tables by kind and digest."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def get(self, kind: str, digest: str, build: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
        """The tables of this kind and digest. Where there are none they are built; of several builders the first to end counts."""
        at = f"{self.path}/{kind}/digest={digest}"
        if not files.exists(self.spark, f"{at}/current"):
            mine = uuid.uuid4().hex
            tables = build()
            for name, df in tables.items():
                df.write.options(**LARGE_ROWS).parquet(f"{at}/{mine}/{name}")
            if not files.claim(self.spark, f"{at}/current", "\n".join([mine, *tables])):
                files.delete(self.spark, f"{at}/{mine}")
        made, *names = files.read(self.spark, f"{at}/current").split("\n")
        return {name: self.spark.read.parquet(f"{at}/{made}/{name}") for name in names}
