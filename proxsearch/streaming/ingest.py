"""Indexing a stream of documents: each micro-batch is a segment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import Index


def index_stream(docs: DataFrame, index: Index, checkpoint: str, id_col: str = "doc_id", text_col: str = "text", compact_every: int = 25, **trigger: object) -> StreamingQuery:
    """Starts indexing the streaming ``docs``. The manifest names a batch's segment and the batch's number in one step, so a
    batch that is tried again after a failure isn't indexed twice; every ``compact_every`` segments the index is compacted."""

    def add(batch: DataFrame, number: int) -> None:
        if number <= index.state.get("stream_done", -1):
            return
        index.append(batch, id_col, text_col, stream_done=number)
        if len(index.state["segments"]) >= compact_every:
            index.compact()

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
