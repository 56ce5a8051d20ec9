"""Queries of runs, stores, sources and streams (A3-A6, A14, O3-O5, S and T rows)."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.functions.rules import CORPUS
from docmill.functions.text import fingerprint
from docmill.operators import mentions as M
from docmill.operators import runs as R
from docmill.plans.q_extract import _values
from docmill.plans.registry import query
from docmill.sources import files as S
from docmill.streaming import streams as T


def _shared(df: DataFrame) -> str:
    """A new folder under the shared scratch folder, or a temporary one in local mode."""
    return S.scratch_path(df.sparkSession)


@query("a3_run_stats", "SELECT user_id % 20 AS run, count(*) AS total, count(*) FILTER (event_type <> 'error') AS success, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_id % 7 = 0) AS renamed, (list(event_id ORDER BY event_id) FILTER (event_type <> 'error'))[1:5] AS success_items, (list(event_id ORDER BY event_id) FILTER (event_type = 'error'))[1:5] AS error_items FROM events GROUP BY 1")
def _a3(t):
    rows = t("events").select((F.col("user_id") % 20).alias("run"), F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"), "event_id")
    return R.run_stats(rows, "run", F.col("status"), "event_id", F.col("event_id") % 7 == 0, 5)


_GROUPS = (("credential", ("license", "rights"), "check rights"), ("network", ("http", "www."), "check links"), ("parser", ("###", "!!"), "check marks"), ("file", ("0", "1"), "check numbers"))


@query("a4_error_groups", "WITH g AS (SELECT CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + f" THEN '{n}'" for n, ws, _ in _GROUPS) + " ELSE 'other' END AS grp FROM documents) SELECT grp, count(*) AS n, CASE grp " + " ".join(f"WHEN '{n}' THEN '{a}'" for n, _, a in _GROUPS) + f" ELSE '{R.OTHER_ADVICE}' END AS advice FROM g GROUP BY grp")
def _a4(t):
    return R.error_groups(t("documents"), "text", _GROUPS)


def _feedback(t):
    change = F.array(F.struct(F.col("event_type").alias("field")), F.struct(F.when(F.col("event_id") % 2 == 0, "title").otherwise("journal").alias("field")))
    return t("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("file"), change.alias("changes"))


@query("a5_feedback_by_field", "SELECT field, count(*) AS n FROM (SELECT event_type AS field FROM events UNION ALL SELECT CASE WHEN event_id % 2 = 0 THEN 'title' ELSE 'journal' END FROM events) GROUP BY field")
def _a5(t):
    return R.feedback_stats(_feedback(t), "changes", "ts", "file", F.lit("2024-01-30").cast("timestamp"))[0]


@query("a5_feedback_totals", "SELECT count(*) AS records, count(*) FILTER (ts >= TIMESTAMP '2024-01-23') AS recent, count(DISTINCT user_id) AS files FROM events")
def _a5t(t):
    return R.feedback_stats(_feedback(t), "changes", "ts", "file", F.lit("2024-01-30").cast("timestamp"))[1]


@query("a6_store_stats", "SELECT source, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes, round(sum(strlen(text)) / 1048576.0::DOUBLE, 2) AS mb FROM documents GROUP BY source")
def _a6(t):
    return R.store_stats(t("documents"), "source", F.octet_length("text"))


@query("a14_progress", "SELECT user_id AS run, CAST(max(k) AS INTEGER) AS done, 120 AS total, round(max(k) * 100.0::DOUBLE / 120, 1) AS percent FROM (SELECT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY 1")
def _a14(t):
    return R.progress(t("events").withColumnRenamed("user_id", "run"), "run", F.get_json_object("props", "$.k").cast("int"), F.lit(120))


@query("o3_retain_latest", "SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 100")
def _o3(t):
    return R.retain_latest(t("events"), "ts", 100, "event_id").select("event_id")


@query("o4_list_records", "SELECT event_id, event_type FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id LIMIT 50")
def _o4(t):
    where = (F.col("event_type") == "error") & (F.col("ts") >= F.lit("2024-01-05").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"))
    return R.list_records(t("events"), "ts", 50, where, "event_id").select("event_id", "event_type")


@query("o5_chunk", "SELECT source, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 8) AS BIGINT) AS chunk, doc_id FROM documents")
def _o5(t):
    return R.chunk(t("documents").select("source", "doc_id"), 8, "doc_id", within="source").select("source", "chunk", "doc_id")


@query("s1_scan_corpus", "SELECT lang || '-' || source AS folder, count(*) AS lines, sum(length(text)) AS chars, min(md5(text)) AS low, max(md5(text)) AS high FROM (SELECT lang, source, translate(text, chr(10) || chr(13), '  ') AS text FROM documents WHERE lang <> 'fr') GROUP BY 1")
def _s1(t):
    """Whole texts, a line each, in many files a folder, so that a hot folder is no single task's; what is read is summed up a line at a time."""
    docs = t("documents").select("lang", "source", F.translate("text", "\n\r", "  ").alias("value"), F.pmod(F.xxhash64("doc_id"), F.lit(64)).alias("part"))
    path = _shared(docs)
    docs.repartition("lang", "source", "part").select("value", "lang", "source").write.partitionBy("lang", "source").text(path)
    found = S.scan_corpus(docs.sparkSession, path, "part-*", exclude=["lang=fr"])
    folder = F.concat(F.regexp_extract("path", "lang=([^/]*)/source=([^/]*)/", 1), F.lit("-"), F.regexp_extract("path", "lang=([^/]*)/source=([^/]*)/", 2)).alias("folder")
    lines = found.select(folder, F.explode(F.split(F.regexp_replace("text", "\n$", ""), "\n")).alias("line"))
    return lines.groupBy("folder").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"), F.min(F.md5("line")).alias("low"), F.max(F.md5("line")).alias("high"))


def _store(t):
    return t("documents").select(fingerprint("text").alias("fingerprint"), "doc_id", "source")


@query("s8_result_store", "SELECT md5(text) AS fingerprint, max(doc_id) AS doc_id FROM documents GROUP BY 1")
def _s8(t):
    rows = _store(t)
    store = S.ResultStore(rows.sparkSession, _shared(rows), rows.drop("fingerprint").schema)
    store.append(rows.where("doc_id % 2 = 0"), F.timestamp_seconds("doc_id"))
    store.append(rows.where("doc_id % 2 = 1"), F.timestamp_seconds("doc_id"))
    return store.read().select("fingerprint", "doc_id")


@query("s4_json_round_trip", "SELECT doc_id, source, n_chars FROM documents")
def _s4(t):
    rows = t("documents").select("doc_id", F.struct("source", "n_chars").alias("info"))
    path = _shared(rows)
    S.write_json(rows, path)
    return S.read_json(rows.sparkSession, path, rows.schema).select("doc_id", "info.source", "info.n_chars")


@query("s5_csv_round_trip", "SELECT conv_id, turn, md5(text) AS digest FROM conversations")
def _s5(t):
    rows = t("conversations").select("conv_id", "turn", "text")
    path = _shared(rows)
    S.write_csv(rows, path)
    return S.read_csv(rows.sparkSession, path, rows.schema).select("conv_id", "turn", F.md5("text").alias("digest"))


@query("s3_read_tables_csv", "SELECT p_partkey % 100 AS caption, count(*) AS n, sum(p_retailprice) AS price, min(p_name) AS low, max(p_type) AS high FROM part GROUP BY 1")
def _s3(t):
    rows = t("part").select((F.col("p_partkey") % 100).alias("part"), "p_partkey", "p_name", "p_type", "p_retailprice")
    path = _shared(rows)
    rows.repartition("part").write.partitionBy("part").option("header", True).csv(path)
    cells = S.read_tables_csv(rows.sparkSession, path).select("header", "cells")
    at = lambda name: F.element_at("cells", F.array_position("header", name).cast("int"))
    rows = cells.select((at("p_partkey").cast("long") % 100).alias("caption"), at("p_retailprice").cast("double").alias("price"), at("p_name").alias("name"), at("p_type").alias("kind"))
    return rows.groupBy("caption").agg(F.count("*").alias("n"), F.sum("price").alias("price"), F.min("name").alias("low"), F.max("kind").alias("high"))


def _run_log(t):
    done = F.when(F.col("event_type") == "error", "failed").otherwise("file-complete")
    return t("events").select(done.alias("type"), F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("run"), F.col("user_id") % 5).alias("run"), F.col("event_id").cast("string").alias("file"), F.lit("extract").alias("stage"), F.get_json_object("props", "$.k").cast("int").alias("completed"), F.lit(100).alias("total"), F.col("event_type").alias("message"))


@query("s7_read_run_log", "SELECT 'run' || (user_id % 5) AS run, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'file-complete' END AS type, count(*) AS n, max(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS completed FROM events GROUP BY 1, 2")
def _s7(t):
    rows = _run_log(t)
    path = _shared(rows)
    rows.write.json(path)
    return S.read_run_log(rows.sparkSession, path).groupBy("run", "type").agg(F.count("*").alias("n"), F.max("completed").alias("completed"))


@query("s6_write_errors", "SELECT props AS message, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1")
def _s6(t):
    rows = t("events").where("event_type = 'error'").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("file"), "event_type", "props")
    rows = rows.select("ts", "file", F.col("event_type").alias("type"), F.col("props").alias("message"), F.lit("stream").alias("context"))
    path = _shared(rows)
    for half in (0, 1):
        S.write_errors(rows.where(F.pmod(F.hash("file"), F.lit(2)) == half), path)
    return rows.sparkSession.read.schema(S.ERROR).parquet(path).groupBy("message").agg(F.count("*").alias("n"))


@query("s9_admit_files", "WITH f AS (SELECT 'f' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || CASE WHEN doc_id % 3 = 0 THEN '.txt' WHEN doc_id % 3 = 1 THEN '.PDF' ELSE '.pdf' END AS name, n_chars FROM documents), r AS (SELECT *, CASE WHEN NOT ends_with(lower(name), '.pdf') THEN 'type' WHEN n_chars > 3000 THEN 'size' END AS reason FROM f), s AS (SELECT name, coalesce(reason, CASE WHEN row_number() OVER (PARTITION BY reason ORDER BY name) > 50 THEN 'count' END) AS reject_reason FROM r) SELECT name, reject_reason FROM s")
def _s9(t):
    k = F.col("doc_id")
    name = F.concat(F.lit("f"), F.lpad(k.cast("string"), 9, "0"), F.when(k % 3 == 0, ".txt").when(k % 3 == 1, ".PDF").otherwise(".pdf"))
    fine, bad = S.admit_files(t("documents").select(name.alias("name"), "n_chars"), "name", "n_chars", max_size=3000, max_files=50)
    return fine.withColumn("reject_reason", F.lit(None).cast("string")).unionByName(bad).select("name", "reject_reason")


@query("t1_ingest_stream", f"WITH v AS (SELECT md5(text) AS fingerprint, {_values('text', CORPUS.metrics['number'])} AS vals FROM documents) SELECT fingerprint, CAST(min(len(vals)) AS BIGINT) AS n FROM v GROUP BY 1")
def _t1(t):
    docs = t("documents")
    spark, path = docs.sparkSession, _shared(docs)
    docs.where("doc_id % 2 = 0").write.parquet(f"{path}/in/a.parquet")
    docs.where("doc_id % 2 = 1").write.parquet(f"{path}/in/b.parquet")
    rows = M.extract_mentions(docs.withColumn("doc_id", F.lit("")), CORPUS).select(F.lit(0).cast("long").alias("n"))
    store = S.ResultStore(spark, f"{path}/store", rows.schema)

    def extract(fresh: DataFrame) -> DataFrame:
        return fresh.select("fingerprint", F.size(M.metric_values(F.col("text"), CORPUS.metrics["number"])).cast("long").alias("n"))

    stream = spark.readStream.schema(docs.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 4).parquet(f"{path}/in")
    T.ingest_stream(stream, extract, store, f"{path}/checkpoint").awaitTermination()
    return store.read().select("fingerprint", "n")


@query("t2_progress_table", "SELECT date_trunc('day', ts) AS start, event_type AS kind, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _t2(t):
    rows = T.progress_counts(t("events"))
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "kind", "n", F.round("total", 4).alias("total"))


@query("t2_progress_stream", "SELECT date_trunc('day', ts) AS start, event_type AS kind, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _t2s(t):
    """Only what the stream has written: a late event of no kind moves the watermark past all windows, which closes them."""
    events = t("events")
    spark, path = events.sparkSession, _shared(events)
    late = events.agg(F.max("ts").alias("ts")).select(*[(F.col("ts") + F.expr("INTERVAL 100 DAYS") if c == "ts" else F.lit(None)).cast(events.schema[c].dataType).alias(c) for c in events.columns])
    for rows in (events.repartition(4), late):
        rows.write.mode("append").parquet(f"{path}/in")
        counts = T.progress_counts(T.stream_table(spark, f"{path}/in", events.schema, files_at_once=10_000), late="1 day")
        counts.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    closed = spark.read.schema(counts.schema).parquet(f"{path}/out")
    return closed.select(F.col("start").cast("timestamp_ntz").alias("start"), "kind", "n", F.round("total", 4).alias("total"))


@query("t3_latest_stream", "SELECT CAST(user_id AS VARCHAR) AS user_id, event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-19' AND ts <= TIMESTAMP '2024-01-20' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def _t3s(t):
    rows = t("events").where("ts <= timestamp_ntz'2024-01-20'").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    spark, path = rows.sparkSession, _shared(rows)
    rows.repartition(4).write.parquet(f"{path}/in")
    store = S.ResultStore(spark, f"{path}/store", rows.drop("user_id").schema)
    T.latest_stream(T.stream_table(spark, f"{path}/in", rows.schema, files_at_once=1), "user_id", "ts", store, f"{path}/checkpoint").awaitTermination()
    alive = T.ttl_lookup(store.read().drop("stored_at"), "fingerprint", "ts", F.lit("2024-01-20").cast("timestamp"))
    return alive.select(F.col("fingerprint").alias("user_id"), "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("t3_ttl_lookup", "SELECT user_id, max(event_id) AS event_id, max(ts) AS ts FROM (SELECT * FROM events WHERE ts > TIMESTAMP '2024-01-19' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) GROUP BY 1")
def _t3(t):
    rows = t("events").select("user_id", "ts", "event_id")
    return T.ttl_lookup(rows, "user_id", "ts", F.lit("2024-01-20").cast("timestamp"))


@query("t1_distinct_stream", "SELECT DISTINCT md5(props) AS fingerprint FROM events")
def _t1d(t):
    """Repeats within the watermark, of which all of one batch are; only the stream's output counts."""
    rows = t("events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("props").alias("text"))
    spark, path = rows.sparkSession, _shared(rows)
    rows.repartition(4).write.parquet(f"{path}/in")
    found = T.distinct_stream(T.stream_table(spark, f"{path}/in", rows.schema), "ts").select("fingerprint")
    found.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{path}/out")


_TTL_HOURS = 6


@query(
    "t3_expired_stream",
    f"""WITH e AS (SELECT user_id, event_id, ts, coalesce(ts - lag(ts) OVER w > INTERVAL {_TTL_HOURS} HOURS, true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS life FROM e), l AS (SELECT user_id, life, max(ts) AS ts, max(row(ts, event_id)) AS last, count(*) AS n FROM s GROUP BY ALL)
SELECT user_id, last[2] AS event_id, ts + INTERVAL {_TTL_HOURS} HOURS AS expired_at, n FROM l WHERE ts + INTERVAL {_TTL_HOURS} HOURS <= (SELECT max(ts) FROM events)""",
)
def _t3e(t):
    """The lives of values that had ended when the stream had seen all; what is still alive is in its state alone."""
    rows = t("events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    spark, path = rows.sparkSession, _shared(rows)
    rows.repartition(4).sortWithinPartitions("ts").write.parquet(f"{path}/in")
    ended = T.expired_stream(T.stream_table(spark, f"{path}/in", rows.schema), "user_id", "ts", 3600 * _TTL_HOURS)
    ended.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(ended.schema).parquet(f"{path}/out")
    return out.select("user_id", "event_id", F.col("expired_at").cast("timestamp_ntz").alias("expired_at"), "n")


@query("s2_read_text_store", "SELECT md5(s_name) AS fingerprint, CASE WHEN s_suppkey % 3 = 0 THEN 'old ' ELSE 'new ' END || s_name AS text FROM supplier")
def _s2(t):
    """A text for each supplier under the legacy suffix, and for two of three another under the new one. One supplier of a thousand has a file for each of its
    texts, and one more the new text as a file and the legacy one in a bundle, where all other texts are."""
    rows = t("supplier").select(F.md5("s_name").alias("f"), "s_name", (F.col("s_suppkey") % 1000).alias("i"), (F.col("s_suppkey") % 3).alias("m"))
    old = rows.select(F.concat("f", F.lit(".md")).alias("name"), F.concat(F.lit("old "), "s_name").alias("text"), (F.col("i") == 7).alias("single"))
    new = rows.where("m > 0").select(F.concat("f", F.lit(".text.md")).alias("name"), F.concat(F.lit("new "), "s_name").alias("text"), F.col("i").isin(7, 8).alias("single"))
    path = _shared(rows)
    texts = old.unionByName(new)
    texts.where("single").select("name", F.col("text").alias("value")).write.partitionBy("name").text(f"{path}/files")
    S.write_text_bundles(texts.where("not single"), f"{path}/bundles")
    found = S.read_text_store(rows.sparkSession, f"{path}/files", name=F.regexp_extract("path", "/name=([^/]*)/", 1), bundles=f"{path}/bundles")
    return found.select("fingerprint", F.trim(F.regexp_replace("text", "\n$", "")).alias("text"))


@query("s7_malformed_lines", "SELECT event_type, count(*) AS n FROM events WHERE event_id % 5 < 3 GROUP BY 1")
def _s7m(t):
    """Of five lines of a log one is cut, one is a bare word, one a list; two are events."""
    i, p = F.col("event_id") % 5, F.concat(F.lit('{"type": "'), "event_type", F.lit('", "total": 1}'))
    line = F.when(i == 0, F.concat(F.lit("cut "), F.left(p, F.lit(10)), F.col("event_type"))).when(i == 1, F.concat(F.lit("word "), "event_type")).when(i == 2, F.concat(F.lit('["'), "event_type", F.lit('"]'))).otherwise(p)
    rows = t("events").select(line.alias("value"))
    path = _shared(rows)
    rows.write.text(path)
    return S.malformed_lines(rows.sparkSession, path).groupBy(F.regexp_extract("line", "([a-z]+)[^a-z]*$", 1).alias("event_type")).agg(F.count("*").alias("n"))
