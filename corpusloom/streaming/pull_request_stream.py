"""Pull requests as a stream: micro-batches are upserted, so a batch that is replayed after a failure changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators.changes import pr_cursor, pr_documents
from corpusloom.plans.indexing import embedded
from corpusloom.store import Store


def start(prs: DataFrame, store: Store, provider: Callable, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """PRS: a streaming DataFrame of pull requests, from the data source or files."""
    store.ensure()

    def batch(rows: DataFrame, _: int) -> None:
        docs = pr_documents(rows).withColumn("language", F.lit("md")).withColumn("file_size_bytes", F.octet_length("text").cast("long"))
        store.upsert(embedded(docs, provider))
        old = store.read("pr_state").select("project", "repo", F.col("last_pr_id").alias("old"))
        new = pr_cursor(rows).join(old, ["project", "repo"], "left").select("project", "repo", F.greatest("last_pr_id", "old").alias("last_pr_id"))
        store.record_prs(new)

    writer = prs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
