"""The index built as a stream: each new document once, counts added up, equal to the batch build."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from peneira.config import Config
from peneira.operators.index import analyzed, document_frequency, postings


def new_documents(stream: DataFrame, hash_column: str, event_time: str | None = None, horizon: str | None = None) -> DataFrame:
    """The stream's rows whose content hash has not come before; rows without hash are left out.

    Without a horizon the state keeps every hash, as the original does; with one, hashes are forgotten so long after their event time.
    """
    stream = stream.where(F.col(hash_column).isNotNull())
    if event_time and horizon:
        return stream.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark([hash_column])
    return stream.dropDuplicates([hash_column])


def index_stream(stream: DataFrame, path: str, checkpoint: str, hash_column: str = "raw_html_hash", text: str = "cleaned_text", config: Config = Config()) -> StreamingQuery:
    """Append postings of new documents to path/postings, a folder a batch.

    A batch that is run again after a failure overwrites its own folder, so each document is indexed once.
    Ends when all that is there is read; start it again for what comes later.
    """
    fresh = new_documents(stream, hash_column)

    def write(batch: DataFrame, number: int) -> None:
        docs = analyzed(batch, text, config)
        postings(docs, hash_column, config).write.mode("overwrite").parquet(f"{path}/postings/batch={number}")

    return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_postings(spark: SparkSession, path: str) -> DataFrame:
    """The postings of all batches so far."""
    return spark.read.option("basePath", f"{path}/postings").parquet(f"{path}/postings").drop("batch")


def snapshot_statistics(posts: DataFrame) -> DataFrame:
    """Document frequencies of the postings so far; as each document is indexed once, they only grow."""
    return document_frequency(posts).select("chunk_size", "term", F.col("doc_frequency"))
