"""Quality figures: completeness, noise, accuracy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases of boilerplate in notes. Fixed values.
NOISE_PHRASES = ("www.", "journal", "figure", "research article", "authors", "corresponding", "components of", "as shown in fig", "ta kinetic traces", "trap state", "as a result, we achieve")


def field_completeness(df: DataFrame, fields: list[str]) -> DataFrame:
    """A1: (field, present, missing): one pass, then one row a field."""
    counts = df.agg(F.count("*").alias("__all"), *[F.count_if(F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) != "").alias(f) for f in fields])
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("present"), (F.col("__all") - F.col(f)).alias("missing")) for f in fields])
    return counts.select(F.inline(cells))


def noisy_ratio(df: DataFrame, notes: str, phrases: tuple[str, ...] = NOISE_PHRASES) -> DataFrame:
    """A2: (records, noisy, percent with one decimal; null without records)."""
    low = F.lower(F.coalesce(notes, F.lit("")))
    hit = F.lit(False)
    for p in phrases:
        hit = hit | low.contains(p)
    rows = df.agg(F.count("*").alias("records"), F.count_if(hit).alias("noisy"))
    return rows.withColumn("percent", F.when(F.col("records") > 0, F.round(F.col("noisy") * 100.0 / F.col("records"), 1)))


def noisy_examples(df: DataFrame, key: str, notes: str, phrases: tuple[str, ...] = NOISE_PHRASES, most: int = 5) -> DataFrame:
    """A2: (key, notes) of the first noisy records by key; the limit is the feature."""
    low = F.lower(F.coalesce(notes, F.lit("")))
    return df.where(reduce(lambda a, b: a | b, [low.contains(p) for p in phrases])).select(key, notes).orderBy(key).limit(most)


def field_accuracy(pred: DataFrame, truth: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(field, compared, percent): how often prediction and truth are equal, nulls equal to each other."""
    other = truth.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    rows = pred.join(other, key)
    rows = rows.agg(F.count("*").alias("__all"), *[F.avg(F.col(f).eqNullSafe(F.col(f"__{f}")).cast("double")).alias(f) for f in fields])
    return rows.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col("__all").alias("compared"), F.round(F.col(f) * 100, 2).alias("percent")) for f in fields])))
