"""Streams of assets: the row operators are stateless and run unchanged on ``readStream``; this maps a stream of raw rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def apply_to_stream(stream: DataFrame, row_operator: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, form: str = "parquet") -> StreamingQuery:
    """Writes ``row_operator`` of every row of the stream to ``sink``, once for all that is there now."""
    return row_operator(stream).writeStream.format(form).option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
