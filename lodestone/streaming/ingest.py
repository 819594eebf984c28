"""Ingestion of an operation stream: each micro-batch is appended to a collection's log and flushed as a segment.

Operations carry their own order; arrival order doesn't count. A batch that is replayed after a failure is
recognised by its number and not applied again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lodestone.sources.collection import Collection
from lodestone.sources.files import Files


def apply_batch(collection: Collection, ops: DataFrame, batch: int, stream: str = "stream") -> None:
    """ops: order, op, user_id, doc_id, vector, attributes."""
    marks = f"{collection.root}/batches/{stream}"
    done = collection.files.names(marks)
    if f"{batch}.json" in done:
        return
    # a batch that was logged, but not marked, before a failure is found by the sequence number it began with
    begun = f"{marks}/begun_{batch}.json"
    if not collection.files.exists(begun):
        collection.files.write_json(begun, {"after": collection.last_seq()})
    if collection.last_seq() == collection.files.read_json(begun)["after"]:
        collection.append(ops)
    collection.flush()
    collection.files.write_json(f"{marks}/{batch}.json", {"sequence": collection.last_seq()})


def operations(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """The Parquet files of a folder, or one file, as a stream."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if Files(spark).is_file(folder):
        folder, _, name = folder.rpartition("/")
        reader = reader.option("pathGlobFilter", name)
    return reader.parquet(folder)


def ingest(collection: Collection, ops: DataFrame, checkpoint: str, stream: str = "stream", available_now: bool = True) -> StreamingQuery:
    """Starts the stream; with `available_now` it ends when what is there has been read."""
    writer = ops.writeStream.foreachBatch(lambda df, n: apply_batch(collection, df, n, stream)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
