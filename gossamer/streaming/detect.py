"""Detection on a stream: every step is row-local, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import anonymize, extract


def read_stream(spark: SparkSession, path: str, schema: str = "doc_id long, text string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def stream_spans(docs: DataFrame) -> DataFrame:
    """All pattern matches of a stream of (doc_id, text)."""
    return extract.pattern_spans(docs)


def anonymize_stream(docs: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write each micro-batch anonymised; a batch that runs again overwrites its own folder."""

    def put(batch: DataFrame, number: int) -> None:
        done = anonymize.anonymize_text(batch)
        done.select("doc_id", "anonymized_text", "replacement_count").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
