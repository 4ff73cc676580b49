"""Complaints that arrive as a stream: each micro-batch is answered by the batch flow and written through."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.pipeline import answer
from ..sources.readers import PlanStore


def answer_batch(batch: DataFrame, number: int, catalog: DataFrame, store: PlanStore, out: str, stream: str, **options) -> None:
    """Writes the replies under out/batch=number. A batch that is run again reads the version of the store that it read
    before, gives equal replies, and adds no version."""
    answer(batch, catalog, store, batch=(stream, number), **options).write.mode("overwrite").parquet(f"{out}/batch={number}")


def answer_stream(complaints: DataFrame, catalog: DataFrame, store: PlanStore, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Writes replies under out, by batch; a batch that is run again after a failure overwrites its own folder."""

    def each(batch: DataFrame, number: int) -> None:
        answer_batch(batch, number, catalog, store, out, checkpoint, **options)

    return complaints.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
