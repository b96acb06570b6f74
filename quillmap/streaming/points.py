"""A stream of points against static layers. The batch operators are reused as they are, a micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.geometry import membership, nearest


def stream_evidence(points: DataFrame, segments: DataFrame, vertices: DataFrame, attributes: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Nearest feature and polygon of each arriving point (id, px, py); ``sink`` gets each batch's rows and its number.

    Batches are numbered, so a sink that overwrites by number is exactly-once.
    """

    def each(batch: DataFrame, number: int) -> None:
        near = nearest(batch, segments)
        sink(membership(batch, vertices, attributes).join(near.withColumnRenamed("fid", "near_fid"), "id", "left"), number)

    return points.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
