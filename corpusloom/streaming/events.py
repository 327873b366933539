"""Change events: filter, debounce, application, micro-batches, rate limits and idle sessions.

Each has a batch form, and debounce, rate limit and application have a streaming form with the same results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators.ordered import bursts

# Extensions and directories of interest.
EXTENSIONS = ("go", "rs", "js", "ts", "tsx", "php", "py", "md")
EXCLUDED = ("/node_modules/", "/dist/", "/build/", "/.next/", "/generated/prisma/", "/target/")
QUIET_MS, RATE, BURST = 500, 30.0, 60.0


def watch(spark: SparkSession, root: str) -> DataFrame:
    """A stream of (path, kind, ts, size): files that appear below a root, as Spark's file source sees them.

    A file source tells of new files only; removed ones come from ``sync_diff`` against the store.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    src = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(root)
    return src.select("path", F.lit("create").alias("kind"), F.col("modificationTime").alias("ts"), F.col("length").alias("size"))


class Progress(StreamingQueryListener):
    """Counts batches and rows of the streams of a session: ``spark.streams.addListener(Progress())``."""

    def __init__(self):
        self.state = {"status": "idle", "batches": 0, "rows": 0, "error": None}

    def onQueryStarted(self, event):
        self.state["status"] = "running"

    def onQueryProgress(self, event):
        self.state["batches"] += 1
        self.state["rows"] += event.progress.numInputRows

    def onQueryIdle(self, event):
        self.state["status"] = "idle"

    def onQueryTerminated(self, event):
        self.state["status"], self.state["error"] = "ready", event.exception


def is_interesting(kind: Column, path: Column, kinds: tuple[str, ...] = ("modify", "create")) -> Column:
    ok = kind.isin(*kinds) & F.regexp_extract(path, r"\.([^./]+)$", 1).isin(*EXTENSIONS)
    for d in EXCLUDED:
        ok = ok & ~F.contains(F.concat(F.lit("/"), path), F.lit(d))
    return F.coalesce(ok, F.lit(False))


def debounce(events: DataFrame, key: list[str], ts: str = "ts", quiet_ms: int = QUIET_MS) -> DataFrame:
    """(key, first_ts, last_ts, n): bursts of a key, which end when nothing follows for longer than ``quiet_ms``."""
    return bursts(events, key, ts, quiet_ms * 1000)


def debounce_stream(events: DataFrame, key: list[str], ts: str = "ts", quiet_ms: int = QUIET_MS, late: str = "10 seconds") -> DataFrame:
    """The same on a stream: session windows with a watermark."""
    src = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    # sessions that touch are merged, so a gap of exactly quiet_ms does not end a burst here either
    return src.groupBy(F.session_window(ts, f"{quiet_ms} milliseconds").alias("w"), *key).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n")).drop("w")


def latest_change(events: DataFrame, key: list[str]) -> DataFrame:
    """(key, kind, ts): the last event of every key; of equal times the greatest event_id."""
    top = events.groupBy(*key).agg(F.max(F.struct("ts", "event_id", "kind")).alias("m"))
    return top.select(*key, F.col("m.kind").alias("kind"), F.col("m.ts").alias("ts"))


def apply_changes(rows: DataFrame, events: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """The rows after all events: keys that changed lose their rows, those not removed get the fresh ones."""
    last = latest_change(events.filter(" and ".join(f"{k} is not null" for k in key) + " and kind is not null"), key)
    kept = rows.join(last.select(*key), key, "left_anti")
    new = fresh.join(last.filter("kind <> 'remove'").select(*key), key, "left_semi")
    return kept.unionByName(new.select(*rows.columns))


def apply_stream(events: DataFrame, apply, checkpoint: str):
    """Starts a stream that hands the latest change of each key in every micro-batch to ``apply(df, id)``."""
    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def micro_batches(items: DataFrame, ts: str, order: list[str], seconds: int = 5, most: int = 10, key: list[str] | None = None) -> DataFrame:
    """Adds ``batch_start`` and ``batch_no``: slices of ``seconds``, and within them blocks of ``most`` items by order, for each key."""
    slot = F.timestamp_seconds(F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000 / seconds) * seconds)
    w = Window.partitionBy(*(key or []), "batch_start").orderBy(*order)
    return items.withColumn("batch_start", slot).withColumn("batch_no", F.floor((F.row_number().over(w) - 1) / most).cast("int"))


#: Buckets count in millionths of a token and times in microseconds, so that whole rates stay exact.
TOKEN = 1e6


def _refill(tokens: float, last: int | None, now: int, rate: float, burst: float) -> float:
    return burst * TOKEN if last is None else min(burst * TOKEN, tokens + (now - last) * rate)


def token_bucket(calls: DataFrame, key: str, ts: str, order: str, rate: float = RATE, burst: float = BURST) -> DataFrame:
    """(key, order, ts, allowed): each call takes a token; a key's bucket holds ``burst`` and refills at ``rate`` a second.

    The decision depends on all calls of a key before, so a key's calls pass one task in order, streamed
    through it in batches of sorted rows rather than gathered.
    """
    src = calls.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("call_id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"))
    rows = src.repartition("key").sortWithinPartitions("key", "at", "call_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, tokens, last = None, 0.0, None
        for f in frames:
            ok = []
            for k, now in zip(f["key"], f["at"]):
                if k != held:
                    held, tokens, last = k, 0.0, None
                tokens, last = _refill(tokens, last, now, rate, burst), now
                ok.append(tokens >= TOKEN)
                tokens -= TOKEN * ok[-1]
            yield f.assign(allowed=ok)

    return rows.mapInPandas(run, "key string, call_id long, at long, allowed boolean").select("key", "call_id", "allowed")


def token_bucket_stream(calls: DataFrame, key: str, ts: str, rate: float = RATE, burst: float = BURST) -> DataFrame:
    """(key, calls, allowed) of every micro-batch, the buckets kept as state, which is dropped after ten idle minutes."""

    def step(k, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (0.0, None)
        n = ok = 0
        f = pd.concat(list(frames))
        for now in sorted(map(int, f["at"])):
            tokens, last = _refill(tokens, last, now, rate, burst), now
            n += 1
            if tokens >= TOKEN:
                tokens, ok = tokens - TOKEN, ok + 1
        state.update((tokens, last))
        state.setTimeoutDuration(600_000)
        yield pd.DataFrame({"key": [k[0]], "calls": [n], "allowed": [ok]})

    src = calls.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"))
    return src.groupBy("key").applyInPandasWithState(step, "key string, calls long, allowed long", "tokens double, last long", "update", "ProcessingTimeTimeout")


def idle_sessions(events: DataFrame, key: list[str], ts: str = "ts", idle_s: int = 600) -> DataFrame:
    """(key, session_start, session_end, n): sessions of a key that an idle time longer than ``idle_s`` ends."""
    return debounce(events, key, ts, idle_s * 1000).withColumnsRenamed({"first_ts": "session_start", "last_ts": "session_end"})
