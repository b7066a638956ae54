"""Counts that follow a stream of documents (an extension): document and pair frequencies add up over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, df) of a batch of (doc_id, terms)."""
    return docs.select(F.explode(F.array_distinct("terms")).alias("term")).filter("term <> ''").groupBy("term").agg(F.count("*").alias("df"))


def count_stream(docs: DataFrame, path: str, checkpoint: str, **trigger):
    """Start a query that appends each micro-batch's counts to a table, partitioned by batch; totals() adds them up.

    A batch that is run again after a failure replaces its own partition, so that nothing counts twice.
    """

    def save(batch: DataFrame, number: int) -> None:
        term_counts(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def totals(spark, path: str) -> DataFrame:
    """(term, df) over all batches so far."""
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*").groupBy("term").agg(F.sum("df").alias("df"))
