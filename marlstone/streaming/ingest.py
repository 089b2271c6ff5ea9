"""Streams of documents: findings as they arrive, and an index kept up to date batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marlstone.operators import audit, chunk
from marlstone.operators.index import Index


def findings(docs: DataFrame) -> DataFrame:
    """audit() on a stream: it is line by line and keeps no state."""
    return audit.audit(docs)


def severity_windows(docs: DataFrame, time_column: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Findings of each severity in windows of event time, with a watermark for late documents."""
    timed = docs.withWatermark(time_column, late)
    found = timed.select(time_column, F.explode(F.flatten(F.transform(audit.lines(F.col("text")), audit.line_findings))).alias("f"))
    return found.groupBy(F.window(time_column, width), F.col("f.severity").alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def keep_indexed(docs: DataFrame, index: Index, checkpoint: str) -> StreamingQuery:
    """Each batch of (path, kind, text, size, modified) is added to the index as a part; later rows of a path win.

    A batch costs what it holds; the index is read and written as a whole only when parts are joined.
    """

    def add(batch: DataFrame, _: int) -> None:
        rows = batch.groupBy("path").agg(F.max_by(F.struct("kind", "text", "size", "modified"), "modified").alias("r")).select("path", "r.*").persist()
        index.append(rows.select("path", "size", "modified", "kind"), chunk.split(rows))
        rows.unpersist()

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
