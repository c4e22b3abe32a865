"""Windowed aggregates over events, and ingest of facts as they become usable.

A function given a streaming DataFrame makes a streaming query of it, with a watermark where late data has to end; given a
batch one it computes the same rows at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.asof import latest_revision
from ..sources.library import ensure


def _timed(events: DataFrame, late: str | None) -> DataFrame:
    out = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return out.withWatermark("ts", late) if late and events.isStreaming else out


def tumbling(events: DataFrame, size: str, slide: str | None = None, late: str | None = "1 day") -> DataFrame:
    """window_start, event_type, n, total of events (ts, event_type, value) in fixed or sliding windows."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return _timed(events, late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = "1 day") -> DataFrame:
    """user_id, session_start, n of runs of events with less than the gap between them."""
    return _timed(events, late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")


def merge_revisions(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that appends every version of a cell: late and corrected ones are kept for later cutoffs.

    A batch that is tried again after a failure overwrites its own folder, so versions are appended once.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([*keys, "usable_from", "revision_id"]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return put


def ingest(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Appends a stream of fact versions to a table, as far as there is data."""
    return stream.writeStream.foreachBatch(merge_revisions(path, keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def as_known(versions: DataFrame, keys: list[str], cutoff: str) -> DataFrame:
    """The cells of an ingested table as they were known at a cutoff."""
    seen = versions.filter(F.col("usable_from") <= F.to_timestamp(F.lit(cutoff)))
    return latest_revision(seen.drop("batch"), keys)


def fill_gaps(requests: DataFrame, path: str, checkpoint: str, compute: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Computes the requested feature cells that the library at path hasn't, batch by batch, until no request is left.

    requests: a stream of cells (feature, security_id, session, dependency_ref). A batch that is run again after a failure
    finds its cells there and computes nothing twice.
    """

    def batch(cells: DataFrame, _: int) -> None:
        cells = cells.distinct().persist()
        try:
            ensure(cells.sparkSession, path, cells, compute)
        finally:
            cells.unpersist()

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
