"""Vocabularies of growing corpora: an extension of our own, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.vocab import vocabulary


def stream_vocabulary(corpus: DataFrame, name: str, checkpoint: str, text: str = "text", ignore_case: bool = False) -> StreamingQuery:
    """A running vocabulary of a streaming corpus in the memory table ``name``; the state is counts by word."""
    counts = vocabulary(corpus, text, ignore_case)
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
