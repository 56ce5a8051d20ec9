"""Sources and sinks: text files, tables, result stores, reports, run logs. Paths may be in any store that Spark reads."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN_EVENT = T.StructType([T.StructField(n, t) for n, t in (("type", T.StringType()), ("ts", T.TimestampType()), ("run", T.StringType()), ("file", T.StringType()), ("stage", T.StringType()), ("completed", T.IntegerType()), ("total", T.IntegerType()), ("message", T.StringType()))])
ERROR = T.StructType([T.StructField(n, t) for n, t in (("ts", T.TimestampType()), ("file", T.StringType()), ("type", T.StringType()), ("message", T.StringType()), ("context", T.StringType()))])


def scratch_path(spark: SparkSession) -> str:
    """A new folder under the shared one that spark.checkpoint.dir names, or a temporary one in local mode, where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root or tempfile.gettempdir()}/docmill-{uuid.uuid4().hex}"


def spread(table: DataFrame) -> DataFrame:
    """A table too small to give every core a full split, dealt out by rows over all cores; any other as it is.

    A file of one row group is one task, however dear its rows. Spark knows the size of the files without reading them, and a table of at least
    a full split for each core never moves; columns and filters are still pushed into the scan."""
    spark = table.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return table.repartition(cores) if size < cores * split else table


def parts_by_size(table: DataFrame, each: int) -> int:
    """How many partitions a table is to be dealt to so that one has about ``each`` bytes of it by Spark's estimate, which is that of its files; at least one a core,
    and as many as any shuffle has where there is no estimate (a table made of rows, or a product of joins)."""
    spark = table.sparkSession
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 46:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(spark.sparkContext.defaultParallelism, -(-size // each))


def scan_corpus(spark: SparkSession, path: str, glob: str = "*.txt", recursive: bool = True, exclude: list[str] = ()) -> DataFrame:
    """(path, name, size, text) of the files under a folder whose names match, less those under excluded folders."""
    reader = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", recursive)
    rows = reader.text(path, wholetext=True).select("_metadata.file_path", "_metadata.file_name", "_metadata.file_size", "value")
    for folder in exclude:
        rows = rows.where(~F.col("file_path").contains(f"/{folder.strip('/')}/"))
    return rows.select(F.col("file_path").alias("path"), F.col("file_name").alias("name"), F.col("file_size").alias("size"), F.col("value").alias("text"))


def write_text_bundles(texts: DataFrame, path: str) -> None:
    """Texts (name, text) for a store, many in a file. A file for each costs a listing, a rename and an opening, which of many small texts are nearly all the work."""
    texts.select("name", "text").write.mode("append").parquet(path)


def read_text_store(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".text.md", ".md"), name: Column | None = None, bundles: str | None = None) -> DataFrame:
    """(fingerprint, text): files named by fingerprint and suffix; of several the one with the earliest suffix counts.

    name: where the name stands, if not in the file's own: an expression of path, such as the folder that a writer puts it in.
    bundles: a folder of write_text_bundles, for the texts of the store that are no files of their own; a text counts by its name, wherever it stands."""
    own = name is None
    rows = scan_corpus(spark, path, "*" + suffixes[-1][suffixes[-1].rindex(".") :] if own else "*").select("path", (F.col("name") if own else name).alias("name"), "text")
    if bundles is not None:
        bundled = spark.read.schema("name string, text string").parquet(bundles)
        rows = rows.unionByName(bundled.select(F.col("name").alias("path"), "name", "text"))
    found = F.coalesce(*[F.when(F.col("name").endswith(s), F.struct(F.lit(i).alias("prio"), F.left("name", F.length("name") - len(s)).alias("fingerprint"))) for i, s in enumerate(suffixes)])
    rows = rows.withColumn("f", found).where("f is not null")
    return rows.groupBy(F.col("f.fingerprint").alias("fingerprint")).agg(F.min(F.struct("f.prio", "path", "text")).alias("first")).select("fingerprint", "first.text")


# a cell is quoted, with quotes doubled, or holds no comma and no line break; quotes within it are its own
_CELL = r'(?:"[^"]*+(?:""[^"]*+)*+"[^,\n]*+|[^,\n]*+)'


def _cells(record: Column) -> Column:
    """The cells of a record; blanks around a plain one go."""
    raw = F.regexp_extract_all(F.concat(F.regexp_replace(record, "\r$", ""), F.lit(",")), F.lit(f"({_CELL}),"), F.lit(1))
    quoted = lambda c: F.concat(F.replace(F.regexp_extract(c, r'^"([^"]*+(?:""[^"]*+)*+)"', 1), F.lit('""'), F.lit('"')), F.regexp_replace(c, r'^"[^"]*+(?:""[^"]*+)*+"', ""))
    return F.transform(raw, lambda c: F.when(c.startswith('"'), quoted(c)).otherwise(F.trim(c)))


def _with_header(rows: DataFrame) -> DataFrame:
    header = rows.where("pos = 0").select("path", F.col("cells").alias("header"))
    return rows.where("pos > 0").join(header.hint("merge"), "path").select("path", "caption", "pos", "header", "cells")


def read_tables_csv(spark: SparkSession, path: str, large: int = 64 << 20) -> DataFrame:
    """S3: (path, caption, pos, header, cells): the rows of CSV tables of any width; the first row of a file is its header, its stem the caption.

    Cells may be quoted, with quotes doubled and line breaks kept. Blank lines are no rows. Files of up to ``large`` bytes are read whole, larger ones by lines in as
    many tasks as they have splits, see read_large_csv."""
    files = spark.read.option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True)
    small = files.text(path, wholetext=True).where(F.col("_metadata.file_size") <= large)
    small = small.select(F.col("_metadata.file_path").alias("path"), _stem("_metadata.file_name"), F.regexp_replace("value", "\r\n", "\n").alias("value"))
    records = F.regexp_extract_all("value", F.lit(rf"(?=[^\n]){_CELL}(?:,{_CELL})*+"), F.lit(0))
    rows = small.select("path", "caption", F.posexplode(records).alias("pos", "record")).select("path", "caption", F.col("pos").cast("long").alias("pos"), _cells(F.col("record")).alias("cells"))
    return _with_header(rows).unionByName(read_large_csv(spark, path, large))


def _stem(name: str) -> Column:
    return F.regexp_replace(name, r"\.csv$", "").alias("caption")


def read_large_csv(spark: SparkSession, path: str, over: int = 0) -> DataFrame:
    """S3 for files of more than ``over`` bytes: lines are read in splits; the quotes of a split, odd or even, say whether the next begins within a cell, and
    so which lines begin a record. A split is ordered and numbered by itself, and the sums of splits run over a few rows for each file; only the lines of one record,
    where it has several, are put together by a shuffle. Quotes have to be balanced, as those around and within quoted cells are."""
    lines = spark.read.option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).text(path).where(F.col("_metadata.file_size") > over)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), _stem("_metadata.file_name"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value")
    lines = lines.withColumn("q", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    own = Window.partitionBy("path", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    quotes = lines.groupBy("path", "split").agg(F.sum("q").alias("q")).select("path", "split", F.coalesce(F.sum("q").over(earlier), F.lit(0)).alias("q0"))
    lines = lines.join(quotes.hint("merge"), ["path", "split"]).withColumn("inside", (F.col("q0") + F.coalesce(F.sum("q").over(own), F.lit(0))) % 2 == 1)
    lines = lines.where(F.col("inside") | (F.trim("value") != "")).withColumn("opens", (~F.col("inside")).cast("long"))
    opened = lines.groupBy("path", "split").agg(F.sum("opens").alias("n")).select("path", "split", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"))
    upto = Window.partitionBy("path", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.join(opened.hint("merge"), ["path", "split"]).withColumn("pos", F.col("n0") + F.sum("opens").over(upto) - 1)
    record = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "at", "value"))), lambda x: x["value"]), "\n")
    rows = lines.groupBy("path", "caption", "pos").agg(record.alias("record"))
    return _with_header(rows.select("path", "caption", "pos", _cells(F.col("record")).alias("cells")))


def write_json(results: DataFrame, path: str, by: str | None = None) -> None:
    """Nested results, one JSON object a line; by a value from the largest on, none last, through the files in the order of their names."""
    ordered = results if by is None else results.orderBy(F.desc_nulls_last(by))
    ordered.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_csv(report: DataFrame, path: str) -> None:
    """A report as CSV with a header; quotes doubled, line breaks kept within quotes."""
    report.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).schema(schema).csv(path)


def write_errors(errors: DataFrame, path: str) -> None:
    """Append error records."""
    errors.select(*ERROR.names).write.mode("append").parquet(path)


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """Run events, one JSON object a line; lines that are none are left out (see malformed_lines)."""
    return spark.read.schema(RUN_EVENT).option("mode", "DROPMALFORMED").json(path)


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line) of a run log that are no JSON objects, as read_run_log leaves out; count them before trusting a log."""
    rows = spark.read.text(path).select(F.col("value").alias("line"))
    return rows.where((F.trim("line") != "") & ~F.coalesce(F.get_json_object("line", "$").startswith("{"), F.lit(False)))


class ResultStore:
    """One result for each content fingerprint; the latest counts. Rows are dealt into folders by the first characters of their fingerprint, so that who
    asks for some fingerprints reads the folders of those only. Appending is one write, reading one aggregation; compacted() gives a store of a file a folder."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, prefix: int = 1):
        self.spark, self.path, self.prefix = spark, path, prefix
        self.schema = T.StructType([T.StructField("fingerprint", T.StringType()), T.StructField("stored_at", T.TimestampType()), *schema.fields])

    def _prefix(self) -> Column:
        return F.left("fingerprint", F.lit(self.prefix))

    def _write(self, rows: DataFrame, path: str) -> None:
        rows.select(*self.schema.names, self._prefix().alias("prefix")).write.mode("append").partitionBy("prefix").parquet(path)

    def append(self, results: DataFrame, at: Column | None = None) -> None:
        self._write(results.withColumn("stored_at", F.current_timestamp() if at is None else at), self.path)

    def rows(self, fingerprints: DataFrame | None = None) -> DataFrame:
        """All that was ever appended, or that of the folders which some fingerprints belong to; there are at most 16 to the power of prefix folders."""
        try:
            rows = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("prefix", T.StringType())])).parquet(self.path)
        except Exception as e:  # nothing stored yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.schema)
        if fingerprints is not None:
            rows = rows.where(F.col("prefix").isin([p for (p,) in fingerprints.select(self._prefix()).distinct().collect()]))
        return rows.select(*self.schema.names)

    def read(self) -> DataFrame:
        return latest_by_key(self.rows(), "fingerprint", "stored_at")

    def keys(self, fingerprints: DataFrame | None = None) -> DataFrame:
        """The fingerprints that are stored, each as often as it is; reads one column and aggregates nothing."""
        return self.rows(fingerprints).select("fingerprint")

    def compacted(self, path: str) -> ResultStore:
        """The latest row of each fingerprint as a store of its own, one file a folder. This one stays as it is, so a failed run loses nothing."""
        other = ResultStore(self.spark, path, T.StructType(self.schema.fields[2:]), self.prefix)
        self._write(self.read().repartition(self._prefix()), path)
        return other


def latest_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key that is last by order; equal ones by the whole row."""
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("r"))
    return best.select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def admit_files(files: DataFrame, name: str, size: str, suffix: str = ".pdf", max_size: int = 100 * 1024 * 1024, max_files: int = 50) -> tuple[DataFrame, DataFrame]:
    """(admitted, rejected with reject_reason): suffix in any case, size, and the first ``max_files`` by name. Names are taken to be distinct."""
    reason = F.when(~F.lower(name).endswith(suffix), "type").when(F.col(size) > max_size, "size")
    rows = files.withColumn("reject_reason", reason)
    fine = rows.where("reject_reason is null").drop("reject_reason")
    first = fine.orderBy(name).limit(max_files)
    # one row: the last name that is admitted
    last = F.broadcast(first.agg(F.max(name).alias("__last")))
    over = fine.join(last, F.col(name) > F.col("__last")).drop("__last").withColumn("reject_reason", F.lit("count"))
    return first, rows.where("reject_reason is not null").unionByName(over)
