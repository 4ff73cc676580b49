"""Tables whose rows are some MB each."""

from __future__ import annotations

import pyarrow.parquet as pq
from planloom import session
from planloom.operators import inverted
from pyspark.sql import functions as F


def test_large_rows_lie_in_small_row_groups(spark, monkeypatch):
    """A writer or reader of an index's blocks holds few of them, whatever the input."""
    rows = spark.range(12, numPartitions=1).select("id", F.transform(F.sequence(F.lit(0), F.lit(400_000)), lambda k: F.xxhash64("id", k)).alias("of"))
    file = session.settled(rows, "large", large_rows=True).inputFiles()[0].removeprefix("file://")
    made = pq.ParquetFile(file).metadata
    assert made.num_row_groups >= 6 and made.num_rows == 12
    seen = {}
    monkeypatch.setattr(inverted, "settled", lambda df, name, large_rows=False: seen.update({name: large_rows}) or session.settled(df, name, large_rows))
    inverted.bm25_index(spark.createDataFrame([(1, "a word or two")], "entry_id long, text string"))
    assert seen["bm25-counts"]
