"""Approximate nearest neighbours on shifted Hilbert curves.

Each curve projects the vectors on ``dims`` seeded orthonormal directions, shifts and scales the result into a grid, and
orders the cells along a Hilbert curve. Spark range-partitions the rows by curve, key and number; the counts of the partitions
give every row its place in its curve, and places are cut into windows of ``window`` rows. A query meets the rows of its own
window and of ``reach`` neighbours on either side, whatever the keys: ties and dense cells cannot overfill a window. The
reach is measured: the true neighbours of a bounded sample of queries are found by brute force, and of the numbers of curves, 2 at
least, each with the least reach at which ``RECALL`` of these neighbours would be met, that which meets the fewest rows is
taken. Where the windows around any row are the whole table, one curve meets all rows and is enough. Blocks of so many windows as
a query meets (``BLOCK_BYTES`` at most) rerank by exact inner product in double precision and keep each query's k best, so a query goes
to few blocks however far it reaches; blocks and curves merge by one ranked shuffle. The work is rows *
curves * (2 * reach + 1) * window / query_every products: linear in the input where near vectors are near on the curves, and up
to some twice that of brute force where the vectors have no structure.

Every row is indexed; only the grid's bounds come from a bounded sample (``FIT_ROWS``). A vector that is null, all zero or
holds a null or non-finite component takes no part, and nor does a row without an id; missing places of a shorter vector
count as 0. Rows that share an id are rows of their own, each a candidate for all others; queries that share one are told apart
by query_row. Ties go to the smaller id. An empty table gives an empty result. Only vec_id and embedding are read, so other
columns may have any names, and there are no texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm.common import batch, stored
from docmill.llm.maxscore import usable

#: Rows from which the bounds of the grids are taken, and the number of places of a vector.
FIT_ROWS = 4096
#: Queries on which the reach is measured, and the recall it is set for: somewhat over the 0.9 that all queries shall have.
REACH_QUERIES = 128
RECALL = 0.94
#: Bytes of the vectors of a block, in double precision; a block has one window at least.
BLOCK_BYTES = 64 << 20
#: Products that are held at once.
_PRODUCTS = 2 << 20


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of each row of integers below 2**bits (Skilling's transform, all rows at once)."""
    x, n, dims = cells.astype(np.int64), len(cells), cells.shape[1]
    for b in range(bits - 1, 0, -1):
        bit, low = 1 << b, (1 << b) - 1
        for i in range(dims):
            on = (x[:, i] & bit) != 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(on, low, swap)
            x[:, i] ^= swap
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(n, np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[:, -1] & (1 << b), (1 << b) - 1, 0)
    x ^= turn[:, None]
    key = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


class Curves:
    """Projections, shifts and bounds of all curves; a function of the seed and of the sample only."""

    def __init__(self, sample: np.ndarray, curves: int, dims: int, bits: int, seed: int):
        rng = np.random.default_rng(seed)
        self.bits, self.width = bits, sample.shape[1]
        dims = min(dims, self.width)
        self.axes = [np.linalg.qr(rng.normal(size=(self.width, dims)))[0] for _ in range(curves)]
        self.shifts = [rng.random(dims) * 0.5 for _ in range(curves)]
        self.low = [(sample @ a).min(axis=0) for a in self.axes]
        self.span = [np.maximum((sample @ a).max(axis=0) - low, 1e-12) for a, low in zip(self.axes, self.low)]

    def key(self, curve: int, x: np.ndarray) -> np.ndarray:
        u = ((x @ self.axes[curve] - self.low[curve]) / self.span[curve] + self.shifts[curve]) / 1.5
        side = 1 << self.bits
        return hilbert_key(np.clip(u * side, 0, side - 1).astype(np.int64), self.bits)


def dense(lists: list, width: int) -> np.ndarray:
    if all(len(x) == width for x in lists):
        return np.array(lists, np.float64).reshape(len(lists), width)
    out = np.zeros((len(lists), width))
    for i, x in enumerate(lists):
        out[i, : len(x)] = x[:width]
    return out


def curve_windows(rows: DataFrame, fit: Curves, window: int) -> DataFrame:
    """(curve, window, row): every row's window in every curve."""
    n_curves = len(fit.axes)
    schema = pa.schema([("row", pa.int64()), ("curve", pa.int32()), ("key", pa.int64())])

    def keys(batches):
        for b in batches:
            x = dense(b.column(1).to_pylist(), fit.width)
            for c in range(n_curves):
                yield batch(schema, b.column(0), np.full(len(x), c, np.int32), fit.key(c, x))

    spread = stored(rows.select("row", "x").mapInArrow(keys, "row long, curve int, key long"), "keys")
    parts = max(n_curves, rows.sparkSession.sparkContext.defaultParallelism)
    ordered = stored(spread.repartitionByRange(parts, "curve", "key", "row").sortWithinPartitions("curve", "key", "row").select("curve", "key", "row", F.spark_partition_id().alias("part")), "order")
    counts = ordered.groupBy("curve", "part").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("curve", "part", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("curve", "part").orderBy("key", "row")) - 1
    placed = ordered.withColumn("inside", inside).join(starts.hint("merge"), ["curve", "part"])
    place = (F.col("before") + F.col("inside")).cast("long")
    return placed.select("curve", F.floor(place / window).cast("long").alias("window"), "row")


def true_neighbours(rows: DataFrame, queries: list, k: int) -> dict[int, list[int]]:
    """The k nearest rows of each of a few queries (row, x), by brute force in one pass over rows. What a row holds beyond the
    longest query counts as a product with 0, so it may be cut."""
    width = max(len(r.x) for r in queries)
    asked, q = np.array([r.row for r in queries], np.int64), dense([r.x for r in queries], width)
    schema = pa.schema([("query_row", pa.int64()), ("row", pa.int64()), ("score", pa.float64())])

    def best(batches):
        names, scores = np.zeros((len(asked), 0), np.int64), np.zeros((len(asked), 0))
        for b in batches:
            own = b.column(0).to_numpy(zero_copy_only=False)
            score = q @ dense(b.column(1).to_pylist(), width).T
            score[asked[:, None] == own[None, :]] = -np.inf
            names, scores = np.hstack([names, np.broadcast_to(own, score.shape)]), np.hstack([scores, score])
            top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            names, scores = np.take_along_axis(names, top, 1), np.take_along_axis(scores, top, 1)
        real = scores > -np.inf
        yield batch(schema, np.repeat(asked, names.shape[1])[real.ravel()], names[real], scores[real])

    found = rows.select("row", "x").mapInArrow(best, "query_row long, row long, score double")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.col("score").desc(), "row"))
    out: dict[int, list[int]] = {}
    for r in found.withColumn("rank", rank).where(F.col("rank") <= k).collect():
        out.setdefault(r.query_row, []).append(r.row)
    return out


def measured_reach(rows: DataFrame, windows: DataFrame, curves: int, last: int, k: int, query_every: int) -> tuple[int, int]:
    """(curves, reach): so many of the curves, and windows on either side that a query must meet in each, that RECALL of the sample's
    true neighbours are met on some curve and the sample's queries meet the fewest windows in all."""
    asked = rows.where(F.col("vec_id") % query_every == 0)
    queries = asked.orderBy(F.xxhash64("vec_id", F.lit(1)), "x").limit(REACH_QUERIES).select("row", "x").collect()
    near = true_neighbours(rows, queries, k) if queries else {}
    if not near:
        return curves, 1
    names = sorted({v for q, own in near.items() for v in (q, *own)})
    wanted = rows.sparkSession.createDataFrame([(v,) for v in names], "row long")
    at = {v: np.zeros(curves, np.int64) for v in names}
    for r in windows.join(F.broadcast(wanted), "row", "left_semi").collect():
        at[r.row][r.curve] = r.window
    away = np.array([np.abs(at[v] - at[q]) for q, own in near.items() for v in own])
    asked_at = np.array([at[q] for q in near])
    plans = []
    for c in range(min(2, curves), curves + 1):
        needed = np.sort(away[:, :c].min(axis=1))
        reach = max(1, int(needed[int(np.ceil(RECALL * len(needed))) - 1]))
        met = np.minimum(asked_at[:, :c] + reach, last) - np.maximum(asked_at[:, :c] - reach, 0) + 1
        plans.append((int(met.sum()), -c, reach))
    _, c, reach = min(plans)
    return -c, reach


def met_pieces(asked_at: np.ndarray, home_at: np.ndarray, reach: int, queries: np.ndarray, homes: np.ndarray, x: np.ndarray):
    """(queries, homes, vectors of these homes) of each window that asks, in pieces of bounded products; both sides are sorted by window."""
    edges = np.append(np.flatnonzero(np.append(True, asked_at[1:] != asked_at[:-1])), len(asked_at)) if len(asked_at) else [0]
    for i, j in zip(edges[:-1], edges[1:]):
        low, high = np.searchsorted(home_at, asked_at[i] - reach), np.searchsorted(home_at, asked_at[i] + reach, side="right")
        step = max(1, _PRODUCTS // max(1, high - low))
        for p in range(i, j if low < high else i, step):
            yield queries[p : min(p + step, j)], homes[low:high], x[low:high]


def nearest(vectors: DataFrame, k: int = 20, query_every: int = 20, curves: int = 8, dims: int = 6, bits: int = 5, window: int = 1024, seed: int = 11) -> DataFrame:
    """The k nearest found for each query: query_id, rank from 1, vec_id, score, query_row (number of the query's row)."""
    rows = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("x"))
    # written with its number, so that a row keeps it whatever is worked out again
    rows = stored(rows.where(F.exists("x", lambda v: v != 0)).withColumn("row", F.monotonically_increasing_id()), "vectors")
    sample = [r.x for r in rows.orderBy(F.xxhash64("vec_id"), "x").limit(FIT_ROWS).collect()]
    width = max(map(len, sample), default=1)
    fit = Curves(dense(sample, width) if sample else np.zeros((1, 1)), curves, dims, bits, seed)
    windows = stored(curve_windows(rows, fit, window), "windows")
    last = windows.agg(F.coalesce(F.max("window"), F.lit(0))).first()[0]
    used, reach = measured_reach(rows, windows, curves, last, k, query_every) if last > 1 else (1, 1)
    placed = windows.where(F.col("curve") < used).join(rows.hint("merge"), "row")
    is_query = F.col("vec_id") % query_every == 0
    size = max(1, min(2 * reach + 1, BLOCK_BYTES // (8 * window * width)))
    block = lambda w: F.floor(w / size).cast("long")
    # a row goes to the block of its own window; a query also to the others that it reaches, there as a query only
    homes = F.array(F.struct(block(F.col("window")).alias("b"), F.lit(True).alias("home")))
    around = F.sequence(block(F.greatest(F.col("window") - reach, F.lit(0))), block(F.least(F.col("window") + reach, F.lit(last))))
    guests = F.transform(F.filter(around, lambda b: b != block(F.col("window"))), lambda b: F.struct(b.alias("b"), F.lit(False).alias("home")))
    dealt = placed.select("curve", "window", F.explode(F.when(is_query, F.concat(homes, guests)).otherwise(homes)).alias("to"), "vec_id", "row", "x")
    dealt = dealt.select("curve", F.col("to.b").alias("block"), "window", F.col("to.home").alias("home"), "vec_id", "row", "x")
    schema = pa.schema([("query_id", pa.int64()), ("query_row", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64()), ("score", pa.float64())])

    def rerank(table: pa.Table) -> pa.Table:
        ids, names, at, home = (table.column(c).to_numpy() for c in ("vec_id", "row", "window", "home"))
        values = table.column("x").combine_chunks()
        values = values if isinstance(values, pa.Array) else pa.concat_arrays(values.chunks)
        lengths = values.value_lengths().to_numpy()
        wide = int(lengths.max())
        x = values.flatten().to_numpy().reshape(len(ids), wide).astype(np.float64) if (lengths == wide).all() else dense(values.to_pylist(), wide)
        homes, queries = (own[np.argsort(at[own], kind="stable")] for own in (np.flatnonzero(home), np.flatnonzero(ids % query_every == 0)))
        x_homes, out = x[homes], []
        for q, cand, x_cand in met_pieces(at[queries], at[homes], reach, queries, homes, x_homes):
            score = x[q] @ x_cand.T
            score[names[q][:, None] == names[cand][None, :]] = -np.inf
            m = min(k, len(cand))
            edge = np.partition(score, len(cand) - m, axis=1)[:, len(cand) - m]
            i, j = np.nonzero((score >= edge[:, None]) & (score > -np.inf))
            order = np.lexsort((names[cand[j]], ids[cand[j]], -score[i, j], i))
            i, j = i[order], j[order]
            first = np.searchsorted(i, i)
            best = np.arange(len(i)) - first < k
            i, j = i[best], j[best]
            # summed anew, so that a pair's score does not depend on the window in which it was found
            out.append((ids[q[i]], names[q[i]], ids[cand[j]], names[cand[j]], (x[q[i]] * x[cand[j]]).sum(axis=1)))
        return pa.table([np.concatenate([o[c] for o in out]) if out else [] for c in range(5)], schema=schema)

    found = dealt.groupBy("curve", "block").applyInArrow(rerank, "query_id long, query_row long, vec_id long, row long, score double")
    found = found.groupBy("query_id", "query_row", "vec_id", "row").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id", "query_row").orderBy(F.col("score").desc(), "vec_id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "query_row")
