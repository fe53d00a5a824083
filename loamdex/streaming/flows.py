"""Continuous forms: new addresses, states of work items, heartbeats, and indexing as pages arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def new_addresses(stream: DataFrame, time: str = "seen_at", late: str = "1 day") -> DataFrame:
    """Each address of a site once, as long as repeats come within ``late``."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(["site_id", "url"])


def event_windows(stream: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events per type and window of event time. In append and update mode those later than the watermark don't count; complete mode keeps all."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "events", "value")


def active_sessions(stream: DataFrame, gap: str = "2 minutes", late: str = "1 hour") -> DataFrame:
    """Spans in which a sender's heartbeats are less than ``gap`` apart."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("beats")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "beats")


def item_states(stream: DataFrame, max_retries: int = 3) -> DataFrame:
    """The state of each work item (site_id, url) after its events (seq, status), as an aggregate in the JVM.

    The event with the largest seq decides, so events out of order don't go back; each event that failed is a
    retry, given once per seq; an item with retries left is eligible again."""
    last = F.max(F.struct("seq", "status")).alias("last")
    failed = F.size(F.collect_set(F.when(F.col("status") == "failed", F.col("seq")))).alias("retries")  # a few for each item
    got = stream.groupBy("site_id", "url").agg(last, failed).select("site_id", "url", "last.status", "retries", "last.seq")
    return got.withColumn("eligible", (F.col("status") == "pending") | ((F.col("status") == "failed") & (F.col("retries") < max_retries)))


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Runs over what there is now and ends; started again it goes on where it stopped."""
    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(each).start()
    query.awaitTermination()
    return query


class Progress(StreamingQueryListener):
    """Calls ``each`` with batch number and rows of every batch; ``spark.streams.addListener`` takes it."""

    def __init__(self, each: Callable[[int, int], None]):
        self.each = each

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.each(event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
