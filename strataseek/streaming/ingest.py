"""Blocks from a stream: each micro-batch is an upsert. An extension; the semantics are the catalog's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from strataseek.sources.catalog import Catalog


def stream_into(blocks: DataFrame, catalog: Catalog, index: str, sub_index: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Upsert every micro-batch of a streaming DataFrame of blocks into a sub-index, and commit it.

    A batch that is run again after a failure replaces its own rows, so the result is the same. checkpoint: a folder on shared storage.
    """

    def one(batch: DataFrame, number: int) -> None:
        opened = catalog.get_index(index)
        if opened is None:
            raise KeyError(f"No index {index}")
        opened.get_binding(sub_index).add_document(batch)
        catalog.flush([index])

    writer = blocks.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
