"""Joins that find and fill: pending documents, entities by prioritised keys, lookups, backfill, corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions.text import canonical_title, exact_title, normalize_issn


def pending(new: DataFrame, store: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Rows whose fingerprint the store does not hold."""
    return new.join(store.select(key).distinct(), key, "left_anti")


def cached(new: DataFrame, store: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Rows whose fingerprint the store holds."""
    return new.join(store.select(key), key, "left_semi")


def match_keys(df: DataFrame, id_: str, title: Column, issn: Column | None = None, eissn: Column | None = None) -> DataFrame:
    """(id, prio, kind, value): the keys of an entity, strongest first: issn, eissn, exact title, canonical title."""
    none = F.lit(None).cast("string")
    kinds = [("issn", normalize_issn(issn) if issn is not None else none), ("eissn", normalize_issn(eissn) if eissn is not None else none), ("exact_title", exact_title(title)), ("canonical_title", canonical_title(title))]
    keys = F.array(*[F.struct(F.lit(i).alias("prio"), F.lit(k).alias("kind"), v.alias("value")) for i, (k, v) in enumerate(kinds)])
    return df.select(id_, F.explode(keys).alias("k")).select(id_, "k.prio", "k.kind", "k.value").where("value is not null")


def resolve_entities(keys: DataFrame, dim_keys: DataFrame, ids: DataFrame, id_: str, dim_id: str) -> DataFrame:
    """Ids with status, method, matched: the strongest kind of key with a hit decides; one hit is OK, several MULTI_MATCH, none NO_MATCH.

    One join on (kind, value); per id the least priority with hits and the hits at it. Of several the least dim_id is shown as matched."""
    hits = keys.join(dim_keys.select("kind", "value", dim_id).distinct().hint("merge"), ["kind", "value"]).groupBy(id_, "prio", "kind").agg(F.count_distinct(dim_id).alias("n"), F.min(dim_id).alias("matched"))
    best = hits.groupBy(id_).agg(F.min_by(F.struct("kind", "n", "matched"), "prio").alias("b"))
    rows = ids.select(id_).join(best.hint("merge"), id_, "left")
    status = F.when(F.col("b").isNull(), "NO_MATCH").when(F.col("b.n") == 1, "OK").otherwise("MULTI_MATCH")
    return rows.select(id_, status.alias("status"), F.col("b.kind").alias("method"), F.col("b.matched").alias("matched"), F.coalesce("b.n", F.lit(0)).alias("n_candidates"))


def select_candidate(candidates: DataFrame, id_: str, ours: str, title: str, rank: str) -> DataFrame:
    """Of an entity's candidates the first whose canonical title is ours, else the first by rank; method tells that one was selected."""
    same = canonical_title(title) == canonical_title(ours)
    order = Window.partitionBy(id_).orderBy(F.coalesce(same, F.lit(False)).desc(), rank)
    rows = candidates.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
    return rows.withColumn("method", F.concat(F.col("method"), F.lit("_selected")))


def lookup_curated(df: DataFrame, column: str, dim: DataFrame, key: str = "alias") -> DataFrame:
    """Df with the dimension's columns by canonical title; several aliases may name one entity. Of rows with one title the least counts."""
    rest = [c for c in dim.columns if c != key]
    named = dim.groupBy(canonical_title(key).alias("__k")).agg(F.min(F.struct(*rest)).alias("__r")).select("__k", "__r.*")
    return df.withColumn("__k", canonical_title(column)).join(named, "__k", "left").drop("__k")


#: Texts that share a gram are dealt in parts of about so many.
PART = 5_000


def _grams(text: Column) -> Column:
    """The pieces of three characters of a text, each once; of a shorter one the whole."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda i: F.substring(text, i, F.lit(3))))


def _short_grams(text: Column) -> Column:
    """The pieces of one and of two characters, each once."""
    every = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
    return F.array_distinct(F.concat(every(1), every(2)))


def met_within(short: DataFrame, long: DataFrame) -> DataFrame:
    """Pairs of short (s) and long (l) that are to be tested, as l can only hold s if it holds the rarest gram of s: how often the grams of s stand in
    long texts is counted first. A gram's long texts are dealt in parts of about PART, and its short ones are sent to each of the parts."""
    wanted = short.select("s", F.explode(_grams(F.col("s"))).alias("gram"))
    kinds = wanted.select("gram").distinct()
    tiny = kinds.where(F.length("gram") < 3)
    held = long.select("l", F.explode(_grams(F.col("l"))).alias("gram")).where(F.length("gram") == 3).join(kinds.hint("merge"), "gram", "left_semi")
    held = held.unionByName(long.select("l", F.explode(_short_grams(F.col("l"))).alias("gram")).join(tiny.hint("merge"), "gram", "left_semi"))
    times = held.groupBy("gram").count()
    # a gram that no long text holds rules its short text out
    known = wanted.join(times.hint("merge"), "gram", "left").groupBy("s").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "gram")).alias("g")).where("g.n > 0")
    parts = F.ceil(F.col("g.n") / PART).cast("int")
    rare = known.select("s", F.col("g.gram").alias("gram"), parts.alias("parts"))
    dealt = held.join(rare.select("gram", "parts").distinct().hint("merge"), "gram").select("l", "gram", F.pmod(F.xxhash64("l"), F.col("parts")).cast("int").alias("part"))
    return dealt.join(rare.select("s", "gram", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).hint("merge"), ["gram", "part"]).select("s", "l")


def _within(short: DataFrame, long: DataFrame) -> DataFrame:
    """Pairs of short (s) and long (l) of which the first stands in the second."""
    return met_within(short, long).where(F.col("l").contains(F.col("s")))


def lookup_contains(df: DataFrame, id_: str, column: str, dim: DataFrame) -> DataFrame:
    """(id, column, key, ordinal): the dimension row (key, ordinal) that equals the name, else the first that contains it or stands in it.

    A text that stands in another has its rarest three characters there, so the pairs come from a join on those, and each is then tested; both tables may be
    large, and frequent beginnings meet nothing. Names are looked up once each; empty ones and empty keys meet nothing."""
    words = dim.select("key", "ordinal", F.lower("key").alias("__k")).where("__k <> ''")
    names = df.select(F.col(column).alias("__name")).where(F.trim("__name") != "").distinct().withColumn("__n", F.lower("__name"))
    keys, low = words.select("__k").distinct(), names.select("__n").distinct()
    pairs = _within(keys.withColumnRenamed("__k", "s"), low.withColumnRenamed("__n", "l")).select(F.col("s").alias("__k"), F.col("l").alias("__n"))
    pairs = pairs.unionByName(_within(low.withColumnRenamed("__n", "s"), keys.withColumnRenamed("__k", "l")).select(F.col("l").alias("__k"), F.col("s").alias("__n"))).distinct()
    met = names.join(pairs.hint("merge"), "__n").join(words.hint("merge"), "__k")
    best = met.groupBy(F.col("__name").alias(column)).agg(F.min(F.struct((F.col("__n") != F.col("__k")).alias("loose"), "ordinal", "key")).alias("b"))
    return df.select(id_, column).join(best.hint("merge"), column, "left").select(id_, column, F.col("b.key").alias("key"), F.col("b.ordinal").alias("ordinal"))


def apply_corrections(base: DataFrame, feedback: DataFrame, key: str, order: str, texts: list[str] = (), numbers: list[str] = ()) -> DataFrame:
    """Base with the latest correction of each key: texts where the new one is not blank, numbers where there is one. corrected tells, and for the
    audit: corrected_at (the order of that correction), corrections (how many there were), changed (the columns that it changed)."""
    latest = feedback.groupBy(key).agg(F.max_by(F.struct(*texts, *numbers), order).alias("__new"), F.max(order).alias("corrected_at"), F.count("*").alias("__n"))
    rows = base.join(latest.hint("merge"), key, "left").withColumn("corrected", F.col("__new").isNotNull())
    new = {c: F.coalesce(F.nullif(F.trim(F.col(f"__new.{c}")), F.lit("")), F.col(c)) for c in texts} | {c: F.coalesce(F.col(f"__new.{c}"), F.col(c)) for c in numbers}
    changed = F.array_compact(F.array(*[F.when(~v.eqNullSafe(F.col(c)), F.lit(c)) for c, v in new.items()]))
    return rows.withColumns(new | {"corrections": F.coalesce("__n", F.lit(0)), "changed": changed}).drop("__new", "__n")


def backfill(primary: DataFrame, secondary: DataFrame, key: str, columns: list[str], years: list[str] = ()) -> DataFrame:
    """Primary with blank columns filled from secondary; years only if 1900 to 2100."""
    other = secondary.select(key, *[F.col(c).alias(f"__{c}") for c in (*columns, *years)])
    rows = primary.join(other, key, "left")
    fill = {c: F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.col(f"__{c}").cast("string")) for c in columns}
    fill |= {c: F.coalesce(c, F.when(F.col(f"__{c}").try_cast("int").between(1900, 2100), F.col(f"__{c}").try_cast("int"))) for c in years}
    return rows.withColumns(fill).drop(*[f"__{c}" for c in (*columns, *years)])
