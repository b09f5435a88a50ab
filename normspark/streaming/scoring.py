"""Scores that arrive as a stream, decided against a static calibration table.

Each micro-batch is an ordinary batch plan (the p-values of its rows against the calibration scores, the
three-way decision), written under its batch id, so a batch that is run again after a failure replaces its own
output. There is no state to keep and no watermark: a decision depends only on its row and the calibration.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from normspark.operators import calibration


def decide_stream(scores: DataFrame, calibration_rows: DataFrame, keys: list[str], alpha: float, review: float, output: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start a query that writes decided rows to ``output/batch_id=N`` (Parquet)."""

    def write(batch: DataFrame, number: int) -> None:
        p = calibration.conformal_p(batch, calibration_rows, keys)
        p.withColumn("decision", calibration.three_way(F.col("conformal_p"), alpha, review)).write.mode("overwrite").parquet(f"{output}/batch_id={number}")

    writer = scores.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
