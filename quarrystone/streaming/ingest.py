"""Ingest of arriving content as a stream: split, then insert the chunks that aren't there.

An extension: batches of (file_id, data) rows from any streaming source are split by the
chunker and put into a store by ``foreachBatch``.  A batch that is run again after a failure
puts nothing twice, as a put leaves out the keys that are there.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrystone.functions.ids import DEFAULT, Format
from quarrystone.operators import chunking
from quarrystone.scratch import shared_folder
from quarrystone.sources.store import Store


def ingest(stream: DataFrame, store: Store, now: Callable[[], dt.datetime], params: chunking.Params = chunking.ASSETS, form: Format = DEFAULT, name: str = "ingest") -> StreamingQuery:
    """Starts the ingest of what is there, and ends when it is in; the progress is kept in the shared folder."""

    def put(batch: DataFrame, _: int) -> None:
        chunks = chunking.split(batch, params, form=form).persist()
        try:
            store.put(chunks.select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("digest"), "data"), now())
        finally:
            chunks.unpersist()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{shared_folder(store.spark)}/quarrystone/stream-{name}").trigger(availableNow=True).start()
