"""Windows and sets over rows (W1-W5, W7, W8, U2-U4). A window holds one group; where a group may hold any share of the rows, the operators that can combine
before the shuffle do (keep_first, priority_pick, ordered_distinct, union_distinct, difference), and running sums have running_before in runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(group: list[str], order: list) -> Window:
    return Window.partitionBy(*group).orderBy(*order)


def keep_first(df: DataFrame, key: list[Column], order: list[str]) -> DataFrame:
    """The first row of each key by order, then by all its columns; no window, so copies combine before the shuffle."""
    rest = [c for c in df.columns if c not in order]
    first = df.groupBy(*[k.alias(f"__k{i}") for i, k in enumerate(key)]).agg(F.min_by(F.struct(*df.columns), F.struct(*order, *rest)).alias("__r"))
    return first.select("__r.*")


def top_n(df: DataFrame, group: list[str], n: int, *order) -> DataFrame:
    """The first n rows of each group; Spark drops what cannot be among them before the shuffle."""
    return df.withColumn("__n", F.row_number().over(_order(group, list(order)))).where(F.col("__n") <= n).drop("__n")


def islands(df: DataFrame, group: list[str], order: list, same: str, *, name: str = "island") -> DataFrame:
    """Df with the number, from 1, of the run of rows of one value of ``same`` that a row stands in."""
    w = _order(group, order)
    starts = (F.row_number().over(w) == 1) | ~F.lag(same).over(w).eqNullSafe(F.col(same))
    return df.withColumn("__s", starts).withColumn(name, F.sum(F.col("__s").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__s")


def near(df: DataFrame, group: list[str], order: list, flag: Column, before: int, after: int, *, name: str) -> DataFrame:
    """Df with whether, as 0 or 1, the flag holds for the row or one of so many before and after it."""
    return df.withColumn(name, F.max(F.coalesce(flag, F.lit(False)).cast("int")).over(_order(group, order).rowsBetween(-before, after)))


def carry_forward(df: DataFrame, group: list[str], order: list, value: Column, *, name: str) -> DataFrame:
    """Df with the last value there was up to the row."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(_order(group, order).rowsBetween(Window.unboundedPreceding, 0)))


def priority_pick(df: DataFrame, group: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """The columns of each group's row that is least by order; falling ones are given as -x. Rows combine before the shuffle."""
    keys = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    return df.groupBy(*group).agg(F.min_by(F.struct(*columns), keys).alias("__r")).select(*group, *[F.col(f"__r.{c}").alias(c) for c in columns])


def nearest_of_type(df: DataFrame, group: list[str], order: list, value: Column) -> DataFrame:
    """Df with before and after, the nearest values there are on either side of a row, its own not among them."""
    w = _order(group, order)
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(value, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return df.withColumns({"before": before, "after": after})


def union_distinct(*tables: DataFrame) -> DataFrame:
    """Rows that stand in any of the tables, each once."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.distinct()


def ordered_distinct(df: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """(group, values): a group's different values by where they first come. Only those are gathered."""
    first = df.groupBy(*group, value).agg(F.min(order).alias("__o"))
    values = F.transform(F.array_sort(F.collect_list(F.struct("__o", value))), lambda x: x[value])
    return first.groupBy(*group).agg(values.alias("values"))


def difference(df: DataFrame, other: DataFrame, key: str, other_key: str | None = None) -> DataFrame:
    """U4: rows whose key the other table does not hold."""
    held = other.select(F.col(other_key or key).alias("__k")).distinct()
    return df.join(held, F.col(key) == F.col("__k"), "left_anti")
