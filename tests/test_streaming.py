import datetime as dt

from pyspark.sql import functions as F

from loamdex.streaming import flows


def written(spark, path, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_item_states_go_on_after_a_restart(spark, tmp_path):
    src, out, at = (str(tmp_path / n) for n in ("src", "out", "at"))
    schema = "site_id long, url string, seq long, status string"
    batch = lambda df, _: df.write.mode("append").parquet(out)
    stream = written(spark, src, [[(1, "a", 1, "processing"), (1, "a", 2, "failed"), (1, "b", 1, "completed")]], schema)
    flows.run_available(flows.item_states(stream, 2), at, batch, "update")
    stream = written(spark, src, [[(1, "a", 1, "pending"), (1, "a", 3, "failed")]], schema)  # one event comes late
    flows.run_available(flows.item_states(stream, 2), at, batch, "update")
    rows = sorted((r.url, r.seq, r.status, r.retries, r.eligible) for r in spark.read.parquet(out).collect())
    assert rows == [("a", 2, "failed", 1, True), ("a", 3, "failed", 2, False), ("b", 1, "completed", 0, False)]
    spark.createDataFrame([(1, "a", 2, "failed")], schema).coalesce(1).write.mode("append").parquet(src)  # delivered twice: no retry more
    flows.run_available(flows.item_states(stream, 2), at, batch, "update")
    assert {r.retries for r in spark.read.parquet(out).where("seq = 3").collect()} == {2}


def test_addresses_once_and_sessions(spark, tmp_path):
    t = lambda m: dt.datetime(2025, 1, 1, 0, m)
    seen, beats = [], []
    stream = written(spark, str(tmp_path / "u"), [[(1, "a", t(0)), (1, "a", t(1))], [(1, "a", t(2)), (2, "a", t(2))]], "site_id long, url string, seen_at timestamp")
    listener = flows.Progress(lambda batch, rows: None)
    spark.streams.addListener(listener)
    flows.run_available(flows.new_addresses(stream), str(tmp_path / "c1"), lambda df, _: seen.extend(map(tuple, df.select("site_id", "url").collect())))
    spark.streams.removeListener(listener)
    assert sorted(seen) == [(1, "a"), (2, "a")]
    stream = written(spark, str(tmp_path / "e"), [[(7, t(0)), (7, t(1)), (7, t(9))], [(8, t(59))]], "user_id long, ts timestamp")
    flows.run_available(flows.active_sessions(stream, "2 minutes", "1 minute"), str(tmp_path / "c2"), lambda df, _: beats.extend(map(tuple, df.select("user_id", "beats").collect())))
    assert sorted(beats) == [(7, 1), (7, 2)]
    windows = []
    stream = written(spark, str(tmp_path / "w"), [[(t(5), "x", 1.0), (t(6), "x", 2.0)]], "ts timestamp, event_type string, value double")
    flows.run_available(flows.event_windows(stream), str(tmp_path / "c3"), lambda df, _: windows.extend(df.select("events", F.col("value")).collect()), "complete")
    assert [tuple(r) for r in windows] == [(2, 3.0)]
