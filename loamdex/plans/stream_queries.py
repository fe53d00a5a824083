"""Queries of the streaming forms: each runs over what the source holds and ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.plans.scratch import new_path
from loamdex.streaming.flows import event_windows, item_states, run_available
from loamdex.sources.tables import table


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of files; a table that is one file is picked out of its folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    reader = spark.readStream.schema(table(spark, sf_dir, name).schema)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile():
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def _result(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """The rows that a stream gives: in complete mode the last state of all, else every row."""
    root = new_path(spark, "stream")
    out = f"{root}/out"
    run_available(stream, f"{root}/checkpoint", lambda df, _: df.write.mode("overwrite" if mode == "complete" else "append").parquet(out), mode)
    return spark.read.schema(stream.schema).parquet(out)


def stream_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per type and hour."""
    got = _result(spark, event_windows(_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))), "complete")
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "events", F.round("value", 4).alias("value"))


def stream_item_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each queued address after the rows that were delivered for it, as events."""
    q = _stream(spark, sf_dir, "crawl_queue").where("site_id is not null")
    stage = F.when(F.col("status").isin("completed", "failed"), 2).when(F.col("status") == "processing", 1).otherwise(0)
    events = q.select("site_id", "url", "status", (F.col("retry_count") * 10 + stage).cast("long").alias("seq"))
    return _result(spark, item_states(events), "complete")


QUERIES = {"stream_event_windows": stream_event_windows, "stream_item_states": stream_item_states}
ORACLES = {
    "stream_event_windows": "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as events, round(sum(value), 4) as value from events group by all",
    "stream_item_states": "select *, status = 'pending' or (status = 'failed' and retries < 3) as eligible from (select site_id, url, arg_max(status, (seq, status)) as status, cast(count(distinct seq) filter (status = 'failed') as integer) as retries, max(seq) as seq from (select *, retry_count * 10 + case when status in ('completed', 'failed') then 2 when status = 'processing' then 1 else 0 end as seq from crawl_queue where site_id is not null) group by all)",
}
