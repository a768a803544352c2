"""A stream of query reads against a stored index, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import Index
from ..operators.linker import links_for


def stream_links(queries: DataFrame, index: Index, path: str, checkpoint: str, threshold: float = 75, once: bool = False, **options) -> StreamingQuery:
    """Writes the links of each micro-batch of reads (read_set, read_id, seq) as Parquet below path, a folder for each batch.

    A query read is whole in its row, so no state is kept between batches; a batch that is run again overwrites its folder.
    """

    def batch(reads: DataFrame, number: int) -> None:
        links_for(reads, index, threshold, **options).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
