"""Arrays of records: merging, filling by position, collapsing, the best one, completeness."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_records(existing: DataFrame, inferred: DataFrame, key: str, pos: str, sig: str, score: str, most: int = 6) -> DataFrame:
    """Per key: no existing record, or a single one with a score of at most 1: the inferred ones; else the existing ones and then those inferred ones whose
    signature is new; at most ``most``. Both have the same columns."""
    weak = existing.groupBy(key).agg((F.count("*") == 1).alias("one"), F.max(score).alias("s")).where("not (one and s <= 1)").select(key)
    kept = existing.join(weak, key, "left_semi")
    # a document whose only record is weak keeps it where nothing was inferred
    alone = existing.join(weak, key, "left_anti").join(inferred.select(key).distinct(), key, "left_anti")
    fresh = inferred.join(kept.select(key, sig).distinct(), [key, sig], "left_anti").withColumn("__first", F.row_number().over(Window.partitionBy(key, sig).orderBy(pos))).where("__first = 1").drop("__first")
    rows = kept.unionByName(alone).withColumn("__new", F.lit(0)).unionByName(fresh.withColumn("__new", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("__new", pos)) - 1
    return rows.withColumn("rank", rank).where(F.col("rank") < most).drop("__new")


def fill_nulls_by_position(a: str, b: str, fields: list[str]) -> Column:
    """Array b where it is longer; else a with null fields filled from b at the same place."""
    filled = F.zip_with(a, b, lambda x, y: F.struct(*[F.coalesce(x[f], y[f]).alias(f) for f in fields]))
    return F.when(F.size(F.coalesce(b, F.array())) > F.size(F.coalesce(a, F.array())), F.col(b)).when(F.col(b).isNull(), F.col(a)).otherwise(filled)


def collapse_records(df: DataFrame, key: str, order: list[str], label: str, values: list[str]) -> DataFrame:
    """One row a key: of each value column the lines '[label] value' in order, joined by line breaks; null ones left out."""
    out = []
    for v in values:
        line = F.when(F.col(v).isNotNull(), F.concat(F.lit("["), F.col(label).cast("string"), F.lit("] "), F.col(v).cast("string")))
        rows = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
        out.append(F.array_join(F.filter(F.transform(rows, lambda x: x["line"]), lambda t: t.isNotNull()), "\n").alias(v))
    return df.groupBy(key).agg(*out)


def best_record(df: DataFrame, key: str, value: Column, *order: str) -> DataFrame:
    """The record with the largest value, the first of equal ones; without any value the first record."""
    w = Window.partitionBy(key).orderBy(value.desc_nulls_last(), *order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def record_completeness(df: DataFrame, critical: dict[str, Column], important: dict[str, Column]) -> DataFrame:
    """Df with missing_critical, missing_important and completeness, the share of the fields that are filled."""

    def missing(fields):
        return F.array_compact(F.array(*[F.when(F.coalesce(F.trim(c.cast("string")), F.lit("")) == "", F.lit(n)) for n, c in fields.items()]))

    total = len(critical) + len(important)
    rows = df.withColumn("missing_critical", missing(critical)).withColumn("missing_important", missing(important))
    return rows.withColumn("completeness", (total - F.size("missing_critical") - F.size("missing_important")) / F.lit(float(total)))


def document_completeness(df: DataFrame, key: str) -> DataFrame:
    """A9 by document: is_complete, needs_follow_up, all missing critical fields, mean completeness."""
    gone = F.array_sort(F.array_distinct(F.flatten(F.collect_set("missing_critical"))))
    rows = df.groupBy(key).agg(F.count("*").alias("records"), gone.alias("missing"), F.avg("completeness").alias("completeness"))
    return rows.withColumn("is_complete", F.size("missing") == 0).withColumn("needs_follow_up", F.size("missing") > 0)


def abnormal_count(columns: list[str]) -> Column:
    """A10: how many of the columns are empty or zero."""
    return reduce(add, [F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")).rlike(r"^(?:0+(?:\.0+)?)?$").cast("int") for c in columns])
