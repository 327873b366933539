"""Batch and streaming forms of the change operators agree."""

import datetime as dt

from conftest import rows
from pyspark.sql import functions as F

from corpusloom.streaming import events as E

T0 = dt.datetime(2025, 1, 1)


def at(ms):
    return T0 + dt.timedelta(milliseconds=ms)


def events(spark):
    return spark.createDataFrame([("a", at(0)), ("a", at(499)), ("a", at(999)), ("a", at(1500)), ("b", at(10)), (None, at(5))], "path string, ts timestamp")


def test_debounce_edges(spark):
    got = rows(E.debounce(events(spark).filter("path is not null"), ["path"]).select("path", "n"))
    assert got == [("a", 1), ("a", 3), ("b", 1)]


def test_debounce_stream_equals_batch(spark, tmp_path):
    src = events(spark).filter("path is not null")
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    # a last event far ahead moves the watermark past all sessions
    spark.createDataFrame([("z", at(10_000_000))], "path string, ts timestamp").write.mode("append").parquet(str(tmp_path / "in"))
    q = E.debounce_stream(spark.readStream.schema("path string, ts timestamp").parquet(str(tmp_path / "in")), ["path"])
    run = q.writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = rows(spark.table("bursts").filter("path <> 'z'").select("path", "first_ts", "last_ts", "n"))
    assert got == rows(E.debounce(src, ["path"]).select("path", "first_ts", "last_ts", "n"))


def test_filter(spark):
    df = spark.createDataFrame([("modify", "a/x.go"), ("create", "dist/x.js"), ("remove", "a.py"), ("modify", "a.pdf"), (None, "a.go"), ("modify", None)], "k string, p string")
    assert [r[0] for r in df.select(E.is_interesting(F.col("k"), F.col("p"))).collect()] == [True, False, False, False, False, False]


def test_apply(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "path string, v int")
    new = spark.createDataFrame([("a", 2), ("b", 2), ("d", 2)], "path string, v int")
    ev = spark.createDataFrame([(1, "a", "modify", at(1)), (2, "b", "modify", at(1)), (3, "b", "remove", at(1)), (4, "d", "create", at(0)), (5, None, "modify", at(9)), (6, "c", None, at(9))], "event_id long, path string, kind string, ts timestamp")
    assert rows(E.apply_changes(old, ev, new, ["path"])) == [("a", 2), ("c", 1), ("d", 2)]


def test_apply_stream(spark, tmp_path):
    ev = spark.createDataFrame([(1, "a", at(1))], "event_id long, path string, ts timestamp")
    ev.write.parquet(str(tmp_path / "in"))
    seen = []
    q = E.apply_stream(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in")), lambda df, i: seen.extend(r.path for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert seen == ["a"]


def bucket(calls, rate, burst):
    held = {}
    for k, i, t in sorted(calls, key=lambda c: (c[2], c[1])):
        tokens, last = held.get(k, (burst * 10**6, t))
        tokens = min(burst * 10**6, tokens + (t - last) // dt.timedelta(microseconds=1) * rate)
        yield (k, i, tokens >= 10**6)
        held[k] = (tokens - 10**6 * (tokens >= 10**6), t)


def test_token_bucket(spark):
    calls = [("k", i, at(i * 7)) for i in range(200)] + [("j", 500 + i, at(i)) for i in range(3)]
    df = spark.createDataFrame([*calls, (None, 9, at(0))], "u string, i long, ts timestamp").repartition(4)
    assert rows(E.token_bucket(df, "u", "ts", "i", rate=30, burst=10)) == sorted(bucket(calls, 30, 10), key=repr)


def test_token_bucket_stream(spark, tmp_path):
    calls = [("k", at(i)) for i in range(20)]
    spark.createDataFrame(calls, "u string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    q = E.token_bucket_stream(spark.readStream.schema("u string, ts timestamp").parquet(str(tmp_path / "in")), "u", "ts", rate=0.0, burst=5)
    # with a processing-time timeout the stream goes on with empty batches: stopped once its input is done
    run = q.writeStream.format("memory").queryName("bucket").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    for _ in range(60):
        if spark.table("bucket").count():
            break
        run.awaitTermination(1)
    run.stop()
    assert rows(spark.table("bucket")) == [("k", 20, 5)]


def test_micro_batches_and_idle(spark):
    df = spark.createDataFrame([(i, "u", at(i * 100)) for i in range(60)], "i long, u string, ts timestamp")
    got = rows(E.micro_batches(df, "ts", ["i"]).groupBy("batch_start", "batch_no").count().select("batch_no", "count"))
    assert got == sorted([(n, 10) for n in range(5)] + [(0, 10)], key=repr)
    assert rows(E.idle_sessions(df.union(spark.createDataFrame([(99, "u", at(10_000_000))], df.schema)).select("u", "ts"), ["u"]).select("n")) == [(1,), (60,)]


def test_watch_and_progress(spark, tmp_path):
    import time

    root = tmp_path / "src"
    (root / "a").mkdir(parents=True)
    (root / "a" / "x.go").write_text("package a")
    (root / "y.bin").write_text("zz")
    p = E.Progress()
    spark.streams.addListener(p)
    seen = []
    q = E.watch(spark, str(root)).filter(E.is_interesting(F.col("kind"), F.col("path"))).writeStream.foreachBatch(lambda df, i: seen.extend((r.path.rsplit("/", 1)[1], r.size) for r in df.collect()))
    q = q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert seen == [("x.go", 9)]
    for _ in range(50):
        if p.state["status"] == "ready":
            break
        time.sleep(0.1)
    spark.streams.removeListener(p)
    assert p.state["status"] == "ready" and p.state["batches"] >= 1 and p.state["error"] is None
