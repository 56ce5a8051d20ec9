"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

The ring has 2**cell_bits equal cells. Each shard owns ``vnodes`` virtual nodes; a cell belongs to the first one at or
after it, clockwise. A row falls on the ring by the hash of its text, so equal texts sit together. A shard takes rows up
to its bound, floor or ceiling of rows/shards; what overflows a full shard continues clockwise to the next shards. The
plan of the overflow needs only the number of rows in each cell, a table of fixed size; the rest are joins, sums and
row numbers. The law is ``rows``: shard sizes are at most one apart.

Equal texts are ordered within their group by a salt (the hash of doc_id, or a number drawn for a row without one) and doc_id, and a group is counted in ``salts`` parts, so that a
group which holds a third of all rows is neither one task nor one shard; salts are
written out with the rows, so a task that runs again finds the same. Null texts count as empty. Repeated rows are rows of their own, in
any order: they are the same. Very long texts are hashed where they are read. An empty table gives an empty result. Only doc_id and
text are read, so other columns may have any names.

When a shard is added, rows move for two reasons: cells that the new virtual nodes take over, and the lower bound of all others.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm.common import stored


def ring_owners(spark, shards: int, vnodes: int, cells: int) -> list[int]:
    """The shard of each cell's first virtual node clockwise. Virtual nodes that fall on one cell move on to the next free one."""
    marks = spark.range(shards * vnodes).select(F.col("id"), F.pmod(F.xxhash64(F.lit("ring"), F.col("id") % shards, F.floor(F.col("id") / shards)), F.lit(cells)).alias("cell")).orderBy("id").collect()
    at: dict[int, int] = {}
    for m in marks:
        cell = m.cell
        while cell in at:
            cell = (cell + 1) % cells
        at[cell] = m.id % shards
    places = sorted(at)
    return [at[places[bisect_left(places, c) % len(places)]] for c in range(cells)]


def overflow_plan(counts: dict[int, int], owners: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(cell, low, high, shard, slot): rows low..high-1 of a cell go to a shard, from that slot on.

    Round r offers what is left of each cell to the r-th different shard clockwise from it, cell by cell, until full.
    """
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    left, done = {c: n for c, n in sorted(counts.items()) if n}, {}
    used, plan = [0] * shards, []
    tried: dict[int, tuple[int, set[int]]] = {c: (c, set()) for c in left}
    for _ in range(shards):
        for c in list(left):
            place, seen = tried[c]
            while owners[place % len(owners)] in seen:
                place += 1
            shard = owners[place % len(owners)]
            seen.add(shard)
            tried[c] = place, seen
            if take := min(left[c], room[shard] - used[shard]):
                low = done.get(c, 0)
                plan.append((c, low, low + take, shard, used[shard]))
                used[shard] += take
                done[c] = low + take
                left[c] -= take
            if not left[c]:
                del left[c]
    return plan


def shard_rows(docs: DataFrame, shards: int = 16, vnodes: int = 64, cell_bits: int = 12, salts: int = 64) -> DataFrame:
    """One row a document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    if not 1 <= shards * vnodes <= 1 << cell_bits:
        raise ValueError("the ring needs a cell for each virtual node")
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("bytes"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("point"))
    rows = rows.select("doc_id", (F.col("bytes") + 1).alias("size"), "text_crc32", "point", F.shiftrightunsigned("point", 64 - cell_bits).cast("int").alias("cell"), F.when(F.col("doc_id").isNull(), F.floor(F.rand(9) * salts)).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(salts))).cast("int").alias("salt"))
    rows = stored(rows, "ring")
    parts = rows.groupBy("cell", "point", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("cell").orderBy("point", "salt").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("point", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    counts = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    plan = overflow_plan(counts, ring_owners(spark, shards, vnodes, 1 << cell_bits), shards) or [(-1, 0, 0, 0, 0)]
    table = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, plan)) + " AS plan(p_cell, low, high, shard, base)")
    inside = F.row_number().over(Window.partitionBy("point", "salt").orderBy("doc_id", "size", "text_crc32")) - 1
    placed = rows.withColumn("inside", inside).join(parts.hint("merge"), ["point", "salt"]).withColumn("rank", F.col("before") + F.col("inside"))
    # one row for each cell and shard, at most 2**cell_bits + shards**2 of them: bounded, whatever the input
    placed = placed.join(F.broadcast(table), (F.col("cell") == F.col("p_cell")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("base") + F.col("rank") - F.col("low")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
