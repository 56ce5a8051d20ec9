"""One value from several sources' observations, by agreement within a tolerance and a priority of sources.

observations: entity, source, value, year, status, url, role ('primary' or 'secondary'). Usable ones have a status that starts with OK and a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.sources.files import parts_by_size

TOLERANCE = 0.6
#: Sources by their whole names, lower is stronger. Fixed values.
PRIORITY = {"WOS_JOURNALS_API": 0, "MJL_PROFILE_API": 1, "CURATED_FALLBACK": 2, "SEARCH_CRAWLER": 3, "LETPUB": 4}
#: A source of any other name, and the last priority that counts as authoritative. Fixed values.
OTHER, AUTHORITATIVE = 9, 2


def source_priority(source: Column, priority: dict[str, int] = PRIORITY) -> Column:
    p = F.lit(OTHER)
    for name, n in priority.items():
        p = F.when(source == name, n).otherwise(p)
    return p


def agreement(observations: DataFrame, tol: float = TOLERANCE, keys: tuple[str, ...] = ("entity",)) -> DataFrame:
    """Observations with agree, the number of the entity's observations within tol, itself among them.

    No pairs are made: equal values are counted first, which combines before the shuffle, and a range frame over each entity's different values sums
    the counts. Values are compared as decimals of six places, so a difference of just tol agrees, unlike in floating point; those from 1e32 on agree where they are equal; infinite ones, NaN and
    null take no part."""
    value = F.col("value")
    exact = F.round(value, 6).try_cast("decimal(38,6)")
    # beyond what a decimal holds a double's steps are wider than any tolerance: only equal values agree
    large = F.when(exact.isNull() & (F.abs(value) < float("inf")), value.cast("double"))
    rows = observations.withColumn("__v", exact).withColumn("__k", F.coalesce(F.col("__v").cast("string"), large.cast("string")))
    counts = rows.where("__k is not null").groupBy(*keys, "__v", "__k").agg(F.count("*").alias("__n"))
    band = f"CAST({tol:.6f} AS DECIMAL(38,6))"
    near = F.expr(f"sum(__n) OVER (PARTITION BY {', '.join(f'`{k}`' for k in keys)} ORDER BY __v RANGE BETWEEN {band} PRECEDING AND {band} FOLLOWING)")
    counts = counts.select(*keys, "__k", F.when(F.col("__v").isNull(), F.col("__n")).otherwise(near).alias("agree"))
    return rows.join(counts.hint("merge"), [*keys, "__k"]).drop("__v", "__k")


def consensus(observations: DataFrame, tol: float = TOLERANCE, *order: str) -> DataFrame:
    """(entity, value, agree): the first observation by order with which another agrees."""
    rows = agreement(observations, tol).where("agree >= 2")
    first = Window.partitionBy("entity").orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def merge_sources(observations: DataFrame, *order: str) -> DataFrame:
    """(entity, sources, url, year): the names of the sources joined by '+' in order, each once; the first url and year there are."""
    names = F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(*[F.col(o).alias(f"__{o}") for o in order], "source"))), lambda x: x["source"])), "+")
    first = {c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))) for c in ("url", "year")}
    return observations.groupBy("entity").agg(names.alias("sources"), *[v.alias(k) for k, v in first.items()])


def decide_value(observations: DataFrame, tol: float = TOLERANCE, priority: dict[str, int] = PRIORITY, authoritative: int = AUTHORITATIVE) -> DataFrame:
    """(entity, rule, value, status, sources, url, year): the decision table.

    1 a secondary agrees with the primary; 2 authoritative secondaries agree among themselves; 3 any do; 4 the primary alone; 5 no primary, secondaries agree;
    6 the strongest usable observation, else the strongest of all with its own status. Of several the strongest counts: by priority, then the latest year,
    then the largest value, then source and url. Those that agree are the one that was chosen and all within tol of it.

    sources, each once and in this order: whose value it is; those that confirm it, by strength; those it was held against (the primary under rules 2 and 3,
    all secondaries under 4, the other ones under 5). url and year are the first there are in that order. Equal observations are counted before the shuffle;
    after it an entity's rows stream through windows of one partitioning, and only its different sources are gathered. The partitions grow in number with the
    input, not in size, as a task sorts its own several times."""
    rows = observations.select("entity", "role", "source", F.col("value").cast("double").alias("value"), "year", "url", "status").withColumn("p", source_priority(F.col("source"), priority))
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("n")).repartition(parts_by_size(observations, 4 << 20), "entity")
    ok = F.col("status").eqNullSafe("OK") & F.col("value").isNotNull()
    second = ok & (F.col("role") == "secondary")
    key = F.struct("p", (-F.coalesce("year", F.lit(0))).alias("y"), (-F.coalesce("value", F.lit(0.0))).alias("v"), "source", "url")
    whole = Window.partitionBy("entity")
    best = lambda which, what=key: F.min(F.when(which, what)).over(whole)
    band = f"CAST({tol:.6f} AS DECIMAL(38,6))"
    agree = lambda flag: F.expr(f"sum(CASE WHEN {flag} THEN n END) OVER (PARTITION BY entity ORDER BY exact RANGE BETWEEN {band} PRECEDING AND {band} FOLLOWING)")
    rows = rows.withColumns({"key": key, "ok": ok, "second": F.coalesce(second, F.lit(False)), "exact": F.when(ok, F.round("value", 6).try_cast("decimal(38,6)"))})
    rows = rows.withColumn("strong", F.col("second") & (F.col("p") <= authoritative))
    rows = rows.withColumns({"n_any": agree("second"), "n_auth": agree("strong")})
    rows = rows.withColumns({
        "pri": best(F.col("ok") & (F.col("role") == "primary")), "any": best(F.col("second") & (F.col("n_any") >= 2)), "auth": best(F.col("strong") & (F.col("n_auth") >= 2)), "lone": best(F.col("second")),
        "last": best(F.lit(True), F.struct(F.col("value").isNull().alias("none"), (~F.col("ok")).alias("bad"), "key", "value", "status", "url", "year")),
    })
    within = lambda chosen: F.coalesce(F.abs(F.col("value") + F.col(f"{chosen}.v")) <= tol, F.lit(False))  # noqa: E731  a key holds the value negated
    rows = rows.withColumn("near", F.max(F.col("second") & within("pri")).over(whole))
    has = F.col("pri").isNotNull()
    rule = F.when(has & F.col("near"), 1).when(has & F.col("auth").isNotNull(), 2).when(has & F.col("any").isNotNull(), 3).when(has, 4).when(F.col("any").isNotNull(), 5).otherwise(6)
    chosen = F.when(F.col("rule").isin(1, 4), F.col("pri")).when(F.col("rule") == 2, F.col("auth")).when(F.col("rule").isin(3, 5), F.col("any")).otherwise(F.col("lone"))
    rows = rows.withColumn("rule", rule).withColumn("chosen", chosen)
    own, primary, r = F.col("key").eqNullSafe(F.col("chosen")) & F.col("ok"), F.col("ok") & (F.col("key") == F.col("pri")), F.col("rule")
    confirms = within("chosen") & F.when(r == 2, F.col("strong")).otherwise(F.col("second"))
    place = F.when(own, 0).when(r.isin(1, 2, 3, 5) & confirms, 1).when(r.isin(2, 3) & primary | r.isin(4, 5) & F.col("second"), 2)
    rows = rows.withColumn("at", F.when(place.isNotNull(), F.struct(place.alias("place"), "key")))
    told = lambda some: [F.first("rule").alias("rule"), F.first("chosen").alias("chosen"), F.first("last").alias("last"), F.max(some).alias("some")]
    first = lambda c, there: F.min_by(F.struct(F.col(c).alias("x")), F.when(there, F.col("at")))
    by_source = rows.groupBy("entity", "source").agg(F.min("at").alias("at"), first("url", F.col("url") != "").alias("u"), F.min(F.when(F.col("url") != "", F.col("at"))).alias("ua"), first("year", F.col("year") != 0).alias("t"), F.min(F.when(F.col("year") != 0, F.col("at"))).alias("ta"), *told("second"))
    names = F.transform(F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "source")))), lambda x: x["source"])
    all_ = by_source.groupBy("entity").agg(F.array_join(names, "+").alias("sources"), F.min_by("u", "ua").alias("u"), F.min_by("t", "ta").alias("t"), *told("some"))
    status = (
        F.when(r == 1, "OK_VALIDATED").when(r.isin(2, 3), "OK_VALIDATED_SECONDARY").when((r == 4) & F.col("some"), "OK_PRIMARY_UNCONFIRMED").when(r == 4, "OK_PRIMARY_ONLY").when(r == 5, "OK_SECONDARY_VALIDATED")
        .when(F.col("chosen").isNotNull(), "OK").otherwise(F.col("last.status"))
    )
    value = F.when(F.col("chosen").isNotNull(), -F.col("chosen.v")).otherwise(F.col("last.value"))
    usable = F.col("chosen").isNotNull()
    return all_.select("entity", "rule", value.alias("value"), status.alias("status"), F.when(usable, F.col("sources")).alias("sources"), F.when(usable, F.col("u.x")).alias("url"), F.when(usable, F.col("t.x")).alias("year"))


def merged_sources(current: Column, new: Column, old_sources: Column, new_sources: Column) -> Column:
    """The sources of a value after a decision: of two values within a millionth those of both, each once in order, else the new one's."""
    both = F.array_join(F.array_distinct(F.filter(F.concat(F.split(old_sources, r"\+"), F.split(new_sources, r"\+")), lambda s: s != "")), "+")
    same = (F.abs(current - new) < 1e-6) & (old_sources != "") & (new_sources != "")
    return F.when(F.coalesce(same, F.lit(False)), both).otherwise(new_sources)


def apply_provenance(current: Column, new: Column, status: Column, old: tuple[Column, Column, Column], found: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """Sources, url and year after a decision; old and found are each (sources, url, year). The url is the new one where there is one; sources and
    year change only with a status that starts with OK and a value."""
    good = F.coalesce(status.startswith("OK"), F.lit(False)) & new.isNotNull()
    sources = F.when(good, merged_sources(current, new, old[0], found[0])).otherwise(old[0])
    return sources, F.coalesce(F.nullif(found[1], F.lit("")), old[1]), F.when(good, found[2]).otherwise(old[2])


def apply_decision(current: Column, new: Column, status: Column, old_status: Column, correct: bool = True) -> tuple[Column, Column]:
    """A12, second part: value and status after a decision: set where there is none, or one out of 0.1 to 200, or, if correction is on, one that is 0.5 or more
    off; an old status that starts with OK_VALIDATED stays as it is."""
    good = F.coalesce(status.startswith("OK"), F.lit(False)) & new.isNotNull()
    bad = current.isNull() | (current <= 0) | ~current.between(0.1, 200)
    off = F.abs(current - new) >= 0.5 if correct else F.lit(False)
    value = F.when(good & (bad | off), new).otherwise(current)
    keep = F.coalesce(old_status.startswith("OK_VALIDATED"), F.lit(False))
    return value, F.when(good & ~keep, status).otherwise(old_status)


def weighted_pick(observations: DataFrame, weights: dict[str, int], base_year: int = 2024) -> DataFrame:
    """(entity, source, value, year, score): 0.7 * the source's weight + 0.3 * year / base_year, the highest; values in 0.1 to 200 first."""
    w = F.lit(0)
    for name, n in weights.items():
        w = F.when(F.col("source") == name, n).otherwise(w)
    score = w * 0.7 + F.coalesce("year", F.lit(0)) / F.lit(float(base_year)) * 0.3
    rows = observations.withColumn("score", score).withColumn("odd", ~F.coalesce(F.col("value").between(0.1, 200), F.lit(False)))
    order = Window.partitionBy("entity").orderBy("odd", F.col("score").desc(), F.col("value").desc(), "source")
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").select("entity", "source", "value", "year", "score")
