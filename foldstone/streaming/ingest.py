"""Feeding a store from a stream: each micro-batch is one atomic commit, written once even if it is repeated."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from ..shared import Folder
from ..store import Store


def ingest(stream: DataFrame, store: Store, checkpoint: str, order: str | None = None) -> None:
    """Commit a stream of ``key``, ``value`` and optionally ``op`` until its source is exhausted.

    ``order`` decides between rows of one key in a batch; without it keys must be unique in a batch. The number
    of a batch is published with its rows, in one snapshot, under the id that Spark gave to the stream's checkpoint, so a
    batch that is repeated is left out, and several streams may feed one store. Empty batches publish nothing.
    """

    def commit(df: DataFrame, batch: int) -> None:
        name = json.loads(Folder(df.sparkSession, checkpoint).read("metadata"))["id"]
        store.write_rows(df, order=order, stream=(name, batch))

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(commit).start().awaitTermination()
