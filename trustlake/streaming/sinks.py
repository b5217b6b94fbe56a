"""Streams into the lake exactly once, and alerts as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..contracts import TableContract
from ..sources.lake import Writer


def append_stream(stream: DataFrame, writer: Writer, contract: TableContract, name: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Every micro-batch is one append under its own run id: a replayed batch is the same commit."""
    writer.ensure_table(contract)

    def sink(batch: DataFrame, n: int) -> None:
        if not batch.isEmpty():
            writer.append(contract, batch.select(*contract.names), run_id=f"{name}:{n}")

    w = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).queryName(name)
    return (w.trigger(availableNow=True) if available_now else w).start()


def partition_stream(stream: DataFrame, writer: Writer, contract: TableContract, name: str, checkpoint: str) -> StreamingQuery:
    """Late data recompute their day: rows of a batch's days are joined to what the day holds, and the day is committed anew."""
    writer.ensure_table(contract)
    pcol = contract.partition_by

    def sink(batch: DataFrame, n: int) -> None:
        batch.persist()
        try:
            for r in batch.select(pcol).distinct().collect():
                run_id = f"{name}:{n}:{r[pcol]}"
                reader = writer.lake.reader()
                if reader.run_rows(contract.table).where(F.col("run_id") == run_id).limit(1).count():
                    continue
                day = batch.where(F.col(pcol) == r[pcol]).select(*contract.names)
                writer.commit_partition(contract, r[pcol], reader.scan(contract, partition=r[pcol]).unionByName(day), run_id=run_id)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).queryName(name).trigger(availableNow=True).start()


def windowed_failures(spans: DataFrame, by: list[str], ts: str = "ts", window: str = "15 minutes", late: str = "15 minutes") -> DataFrame:
    """Failures per window and group; works on streams (with a watermark) and on tables alike."""
    return spans.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), *by).agg(F.count("*").alias("failures"), F.max(ts).alias("last_seen")).select(F.col("w.start").alias("window_start"), *by, "failures", "last_seen")
