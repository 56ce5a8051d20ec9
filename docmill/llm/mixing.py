"""Mixing sources to target weights by capped water-filling.

Targets: each source gets a level times its weight, at most ``max_epochs`` times its own size; the level is the one at
which the targets sum to the total. Sorted by cap over weight, the sources that are clamped come first, so the level is
the first one that leaves its source below its cap: two running sums over the table of sources, equal to resharing the
excess by weight until no target is above its cap.

Sampling: a target is so many whole repetitions of a source and a fractional one. The fractional one takes documents in
seeded hash order until its words are spent; the document in which they end is taken in part, by its first words. So a
source's taken words are the whole part of its target, and no document exceeds max_epochs times its size.

The order is by the hash of the id, then by hash and size of the text, so rows that share an id or lack one have an order of
their own and reruns agree. The running sum over a source is cut into 4096 ranges of the id's hash, and rows without an id into as
many of their text's, range totals first, then within ranges: a source that holds a third of all rows, or rows without ids, are
thus thousands of small groups. The tables of sources and of ranges have one row a source and 4096 a source; the
targets are windows over the first, which is meant for at most some hundred thousand sources.

Null and empty texts have size 0; a null source is a source of its own, last in order; repeated rows count each. An empty source
has target 0, an empty table gives an empty result. Very long texts are counted where they are read. Other columns may have any names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm.common import named, stored

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (5, 2, 1)


def word_count(text: str | Column) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(t.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """(source, source_size, target): one row a source. sized has source and size."""
    table = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = reduce(lambda w, i: w.when(place % len(weights) == i, F.lit(weights[i])), range(1, len(weights)), F.when(place % len(weights) == 0, F.lit(weights[0])))
    table = table.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs).withColumn("place", place)
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    whole = Window.partitionBy()
    spent = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    table = table.withColumn("level", (F.sum("source_size").over(whole) - spent) / open_weight)
    table = table.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "place", "level"))).over(whole)["level"])
    return table.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def _sized(docs: DataFrame, *more: Column) -> DataFrame:
    th = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("th")
    return docs.select(*more, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count("text").alias("size"), th)


def mix_sources(docs: DataFrame, weights=WEIGHTS, max_epochs: int = 3, seed: int = 42) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken."""
    sized = stored(_sized(docs), "sized")
    return taken_words(sized, sized, weights, max_epochs, seed).select("doc_id", "size", "source_size", "target", "taken")


def taken_words(rows: DataFrame, sized: DataFrame, weights=WEIGHTS, max_epochs: int = 3, seed: int = 42) -> DataFrame:
    """rows (doc_id, source, size, th and more) with source_size, target and taken; sized: the same rows' four columns, written out."""
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    cut = F.concat(F.substring(mark, 1, 3), F.when(F.col("doc_id").isNull(), F.substring(F.hex("th"), -3, 3)).otherwise(""))
    ranges = sized.groupBy("source", cut.alias("__r")).agg(F.sum("size").alias("__n"))
    start = F.coalesce(F.sum("__n").over(Window.partitionBy("source").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(F.col("source").alias("__s"), "__r", start.alias("__start"))
    targets = source_targets(sized, weights, max_epochs)
    starts = ranges.join(targets.hint("merge"), ranges["__s"].eqNullSafe(targets["source"])).drop("source")
    rows = rows.withColumn("__mark", mark).withColumn("__range", cut)
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("source", "__range").orderBy("__mark", "th", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("__inside", inside)
    rows = rows.join(starts.hint("merge"), rows["source"].eqNullSafe(starts["__s"]) & (rows["__range"] == starts["__r"]))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0).cast("long")
    part = F.floor("target").cast("long") - epochs * F.col("source_size") - F.col("__start") - F.col("__inside")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(part, F.col("size")))
    return rows.withColumn("taken", taken.cast("long")).drop("__mark", "__range", "__inside", "__start", "__s", "__r")


def mixed_rows(docs: DataFrame, weights=WEIGHTS, max_epochs: int = 3, seed: int = 42) -> DataFrame:
    """docs, all columns: each row as often as the mix takes it whole, and once more with its first words if in part."""
    sized = stored(_sized(docs), "sized")
    rows = taken_words(_sized(docs, F.struct(*map(named, docs.columns)).alias("__row")), sized, weights, max_epochs, seed).where("taken > 0")
    rest = (F.col("taken") % F.col("size")).cast("int")
    whole = F.floor(F.col("taken") / F.col("size")).cast("int")
    pieces = F.concat(F.array_repeat(F.lit(0), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    rows = rows.select("__row", F.explode(pieces).alias("__words"))
    text = F.col("__row.text")
    head = F.when(F.col("__words") == 0, text).otherwise(F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), 1, F.col("__words")), " "))
    return rows.select(*[head.alias(c) if c == "text" else F.col("__row")[c].alias(c) for c in docs.columns])
