"""Scoring a stream of texts with a trained model.

Counting and prediction need one row at a time, so the stream needs no state; each micro-batch goes through the
same plan as a table. Rows are keyed by their own id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from strandloom.plans.model import SegmentModel


def score_stream(stream: DataFrame, model: SegmentModel, out: str, checkpoint: str, *, id_column: str = "sample_id", text_column: str = "text", trigger: dict | None = None) -> StreamingQuery:
    """Writes ``sample_id, prediction`` of every row as Parquet under ``out``, one folder a batch, so that a repeated batch replaces itself."""

    def sink(batch: DataFrame, epoch: int) -> None:
        model.predict_table(batch, id_column, text_column).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
