"""Run logs, errors, history and feedback."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.sources.files import scratch_path

#: Error group, what its texts contain, and advice of our own; the first that matches counts. Groups and words are fixed values, save that the parser's
#: group goes by the word parser.
ERROR_GROUPS = (
    ("credential", ("token", "api key", "credential", "鉴权", "401", "403"), "check keys and permissions"),
    ("network", ("network", "timeout", "连接", "联网", "dns", "socket"), "check the connection, or run without remote services"),
    ("parser", ("parser",), "check the parser's settings"),
    ("file", ("pdf", "ocr", "page", "文件"), "check that the file opens and has text"),
)
OTHER_ADVICE = "read the log of the failed item"


def run_stats(df: DataFrame, run: str, status: Column, item: str, renamed: Column | None = None, most: int = 100) -> DataFrame:
    """A3: per run: total, success, error, renamed, and the first ``most`` different items of each status, by name; the limit is the feature.

    Items are ranked by a window that keeps only the first of each run and status before it shuffles, so no run is gathered whole."""
    rows = df.withColumn("__status", status)
    counts = rows.groupBy(run).agg(F.count("*").alias("total"), F.count_if(F.col("__status") == "success").alias("success"), F.count_if(F.col("__status") == "error").alias("error"), F.count_if(F.lit(False) if renamed is None else renamed).alias("renamed"))
    ranked = rows.where(F.col("__status").isin("success", "error")).select(run, "__status", item).distinct().withColumn("__n", F.row_number().over(Window.partitionBy(run, "__status").orderBy(item))).where(F.col("__n") <= most)
    def items(s):
        return F.array_sort(F.collect_list(F.when(F.col("__status") == s, F.col(item))))
    lists = ranked.groupBy(run).agg(items("success").alias("success_items"), items("error").alias("error_items"))
    return counts.join(lists.hint("merge"), run, "left")


def classify_error(text: Column, groups=ERROR_GROUPS) -> Column:
    """A4: the first group of which a word stands in the text, else 'other'."""
    low = F.lower(F.coalesce(text, F.lit("")))
    rule = F.lit("other")
    for name, words, _ in reversed(groups):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        rule = F.when(hit, name).otherwise(rule)
    return rule


def error_groups(df: DataFrame, text: str, groups=ERROR_GROUPS) -> DataFrame:
    """A4: (grp, n, advice), largest group first."""
    counts = df.groupBy(classify_error(F.col(text), groups).alias("grp")).agg(F.count("*").alias("n"))
    advice = F.lit(OTHER_ADVICE)
    for name, _, said in groups:
        advice = F.when(F.col("grp") == name, said).otherwise(advice)
    return counts.withColumn("advice", advice).orderBy(F.col("n").desc(), "grp")


def feedback_stats(df: DataFrame, changes: str, ts: str, file: str, now: Column, days: int = 7) -> tuple[DataFrame, DataFrame]:
    """A5: corrections by field; and records, records of the last days, distinct files."""
    by_field = df.select(F.explode(changes).alias("c")).groupBy(F.col("c.field").alias("field")).agg(F.count("*").alias("n"))
    whole = df.agg(F.count("*").alias("records"), F.count_if(F.col(ts) >= now - F.expr(f"INTERVAL {days} DAYS")).alias("recent"), F.count_distinct(file).alias("files"))
    return by_field, whole


def store_stats(df: DataFrame, kind: str, size: Column) -> DataFrame:
    """(kind, files, bytes, mb)."""
    rows = df.groupBy(kind).agg(F.count("*").alias("files"), F.sum(size).cast("long").alias("bytes"))
    return rows.withColumn("mb", F.round(F.col("bytes") / F.lit(1048576.0), 2))


def progress(df: DataFrame, run: str, done: Column, total: Column) -> DataFrame:
    """(run, done, total, percent with one decimal)."""
    rows = df.groupBy(run).agg(F.max(done).alias("done"), F.max(total).alias("total"))
    return rows.withColumn("percent", F.when(F.col("total") > 0, F.round(F.col("done") * 100.0 / F.col("total"), 1)).otherwise(0.0))


def retain_latest(df: DataFrame, ts: str, n: int, *ties: str) -> DataFrame:
    """O3: the newest n records; the limit is the feature."""
    return df.orderBy(F.col(ts).desc(), *ties).limit(n)


def list_records(df: DataFrame, ts: str, n: int, where: Column, *ties: str) -> DataFrame:
    """The newest n records that pass the filter; filtered first, unlike the original."""
    return retain_latest(df.where(where), ts, n, *ties)


def chunk_size(n_files: int) -> int:
    """Files in a batch, by their number. Fixed values."""
    return max(1, n_files) if n_files <= 5 else 5 if n_files <= 20 else 8 if n_files <= 50 else 10


def running_before(df: DataFrame, group: list[str], order: list[str], value: Column, name: str = "before") -> DataFrame:
    """Df with name, the sum of value over the rows of its group that come before it in order; rows equal in all of order come in any order.

    On two levels, so that a group may hold any share of the rows: ranges of (group, order), of a partition's size each, are written out; their sums run
    over the ranges of a group, a few rows; within a range the rows run. Nothing else than a range is ever one task's."""
    keys = [*group, *order]
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.withColumn("__v", value).repartitionByRange(n, *keys).withColumn("__range", F.spark_partition_id())
    # ranges are drawn from a sample: written, so that both uses see the same ones
    path = scratch_path(df.sparkSession)
    ranged.write.parquet(path)
    ranged = df.sparkSession.read.schema(ranged.schema).parquet(path)
    sums = ranged.groupBy(*group, "__range").agg(F.sum("__v").alias("__s"))
    before = F.sum("__s").over(Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__range").alias("__r"), before.alias("__b"))
    same = reduce(and_, [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)], F.col("__range") == F.col("__r"))
    own = F.sum("__v").over(Window.partitionBy(*group, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    rows = ranged.join(sums.hint("merge"), same).withColumn(name, F.coalesce("__b", F.lit(0)) + F.coalesce(own, F.lit(0)))
    return rows.select(*df.columns, name)


def running_budget(df: DataFrame, group: list[str], order: list[str], cost: Column, budget: float) -> DataFrame:
    """The rows of each group, in order, before whose start the budget was not yet used up."""
    return running_before(df, group, order, cost, "__before").where(F.col("__before") < budget).drop("__before")


def chunk(df: DataFrame, n: int, *order: str, within: str | None = None) -> DataFrame:
    """Df with chunk, numbered from 0, n rows each in order, within each value of a column or in the whole table; neither needs to be of bounded size."""
    rows = running_before(df, [within] if within else [], list(order), F.lit(1), "__n")
    return rows.withColumn("chunk", F.floor(F.col("__n") / n).cast("long")).drop("__n")
