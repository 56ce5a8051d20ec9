"""Structured Streaming: incremental ingest by fingerprint, live progress, values that expire."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from docmill.functions.text import fingerprint
from docmill.operators.resolve import pending
from docmill.sources.files import ResultStore


def stream_table(spark: SparkSession, path: str, schema: T.StructType, glob: str = "*.parquet", files_at_once: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_at_once).parquet(path)


def ingest_stream(docs: DataFrame, extract: Callable[[DataFrame], DataFrame], store: ResultStore, checkpoint: str) -> StreamingQuery:
    """Documents as they arrive: those whose fingerprint the store lacks are extracted, once each, and appended.
    Of the store a batch reads the folders of its own fingerprints.

    extract gives rows with the store's columns, fingerprint among them. A batch that runs again finds its own fingerprints stored."""

    def batch(rows: DataFrame, _: int) -> None:
        rows = rows.withColumn("fingerprint", fingerprint("text"))
        new = pending(rows, store.keys(rows))
        # rows of one fingerprint have one text; of their other columns the least count
        rest = [c for c in new.columns if c != "fingerprint"]
        store.append(extract(new.groupBy("fingerprint").agg(F.min(F.struct(*rest)).alias("r")).select("fingerprint", "r.*")))

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", width: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, kind, n, total): events in tumbling windows by kind; works on a stream and on a table alike."""
    rows = events.withColumn("__ts", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("__ts", late)
    return rows.groupBy(F.window("__ts", width).alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "kind", "n", "total")


def ttl_lookup(observations: DataFrame, key: str, ts: str, now: Column, seconds: int = 86_400) -> DataFrame:
    """The latest observation of each key that is not older than the time to live."""
    alive = observations.where(F.col(ts).cast("timestamp") > now - F.make_dt_interval(secs=F.lit(seconds)))
    rest = [c for c in observations.columns if c != key]
    latest = alive.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(ts, *[c for c in rest if c != ts])).alias("r"))
    return latest.select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def latest_stream(observations: DataFrame, key: str, ts: str, store: ResultStore, checkpoint: str) -> StreamingQuery:
    """T3 on a stream: each batch appends the latest observation of each of its keys to the store, whose reading takes the latest of all; ttl_lookup()
    on what is read says which are alive. The store's schema holds the observations' columns but the key, which is its fingerprint."""

    def batch(rows: DataFrame, _: int) -> None:
        rest = [c for c in rows.columns if c != key]
        latest = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(ts, *[c for c in rest if c != ts])).alias("r"))
        store.append(latest.select(F.col(key).cast("string").alias("fingerprint"), "r.*"), F.col(ts).cast("timestamp"))

    return observations.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def expired_stream(observations: DataFrame, key: str, ts: str, seconds: int = 86_400, late: str = "0 seconds") -> DataFrame:
    """T3 with a time to live in the state: (key, the other columns, expired_at, n), one row for each life of a key's value. A life lasts from an
    observation until none has come for the time to live; its row has the last observation (of one time the largest of the other columns), when it expired, and
    how many there were. Rows come when the watermark passes their end, and with that leave the state, which holds the keys that are alive and nothing else.

    late: how much later than newer ones an observation may come. Works on a table alike, where all lives are told."""
    rest = [c for c in observations.columns if c not in (key, ts)]
    rows = observations.withColumn("__ts", F.col(ts).cast("timestamp"))
    if observations.isStreaming:
        rows = rows.withWatermark("__ts", late)
    last = F.max(F.struct("__ts", *rest)).alias("r")
    lives = rows.groupBy(F.session_window("__ts", f"{seconds} seconds").alias("w"), key).agg(last, F.count("*").alias("n"))
    return lives.select(key, *[F.col(f"r.{c}").alias(c) for c in rest], F.col("w.end").alias("expired_at"), "n")


def distinct_stream(docs: DataFrame, ts: str, late: str = "1 day") -> DataFrame:
    """T1, in the stream: the first document of each fingerprint within the watermark."""
    rows = docs.withColumn("__ts", F.col(ts).cast("timestamp")).withColumn("fingerprint", fingerprint("text"))
    return rows.withWatermark("__ts", late).dropDuplicatesWithinWatermark(["fingerprint"]).drop("__ts")
