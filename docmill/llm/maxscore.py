"""Exact top-k search with MaxScore over shards of postings.

A vector component, rounded to an integer, is the weight of the term that its place names; the posting list of a term is the column of
its weights in a shard, kept term by term. A term's bound for a query is the most that it can add to a score: query weight times the
largest or the smallest weight of its postings in the shard. Terms are sorted by bound; the longest prefix whose bounds cannot lift a
document over the k-th best score so far is non-essential. Queries whose essential terms are alike form groups; a group traverses
the postings of its essential terms alone, one product over these lists. A document whose partial score and the bounds of the
rest do not fall below the threshold is probed in the remaining lists, a few terms at a time, while it stays competitive, the
largest bounds first. Each shard gives its k best a query; the shards merge by one ranked shuffle.

Queries are a stated set (ids divisible by ``query_every``), met with all rows in blocks. A shard's postings and the query blocks are
dealt to the shard's task, the postings first; the task unpacks them once and streams the query blocks past, so no row ever holds both.
Each query block carries thresholds, from a first search of ``FIRST_ROWS`` rows. Shards grow with the table (``shard_rows`` at least,
``MOST_ROWS`` at most), so that a query block is sent to few.
Scores are exact: weights and products take the smallest number type that holds every sum. A vector that is null, or holds a
null or non-finite component, takes no part, and nor does a row without an id; missing places of a shorter vector count as 0. Rows
that share an id are rows of their own, each a candidate for all others; queries that share one are told apart by query_row. Rows
that share id and weights have equal answers and ask once; as candidates each counts. Ties go to the smaller id. An empty table gives an empty result.
Only vec_id and embedding are read, so other columns may have any names, and there are no texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm.common import batch, stored

#: Rows of a shard at most.
MOST_ROWS = 65_536
#: Rows, at most, whose search gives the first thresholds; they are brought to the driver.
FIRST_ROWS = 2048
#: Queries of a group, ends of the first stretches of a shard's documents, terms probed at once.
_GROUP = 8
_STRETCHES = (512, 2048)
_TERMS_AT_ONCE = 4


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def term_weights(vectors: DataFrame, k: int, query_every: int, scale: int = 256) -> DataFrame:
    """(vec_id, row, asks, weights): components floor(scale * x), a 64-bit name of the row, whether it is a query. Of rows that share id and
    weights k + 1 are enough: no answer can hold more."""
    rows = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("weights"))
    rows = rows.groupBy("vec_id", "weights").agg(F.count("*").alias("n"))
    rows = rows.select("vec_id", "weights", F.explode(F.sequence(F.lit(1).cast("long"), F.least("n", F.lit(k + 1).cast("long")))).alias("copy"))
    asks = (F.col("vec_id") % query_every == 0) & (F.col("copy") == 1)
    return rows.select("vec_id", F.xxhash64("vec_id", "weights", "copy").alias("row"), asks.alias("asks"), "weights")


def _small(x: np.ndarray) -> np.ndarray:
    """x in the smallest integer type that holds it."""
    most = int(np.abs(x).max(initial=0))
    return x.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64)


def _lists(weights: pa.ChunkedArray) -> np.ndarray:
    """The weights of all rows term by term, missing ones 0."""
    values = weights.combine_chunks()
    values = values if isinstance(values, pa.Array) else pa.concat_arrays(values.chunks)
    lengths = values.value_lengths().to_numpy()
    terms = int(lengths.max())
    lists = np.zeros((len(values), terms), np.int64)
    lists[np.arange(terms)[None, :] < lengths[:, None]] = values.flatten().to_numpy()
    return _small(lists.T)


def _block(table: pa.Table) -> pa.Table:
    """The rows of one shard as one row: ids, and the posting lists of all terms one after the other; little-endian."""
    ids, own = (table.column(c).to_numpy() for c in ("vec_id", "row"))
    lists = _lists(table.column("weights"))
    terms = len(lists)
    row = {"shard": [table.column("shard")[0].as_py()], "ids": [ids.astype(np.int64).tobytes()], "rows": [own.tobytes()], "terms": [terms], "bytes": [lists.itemsize], "weights": [lists.tobytes()]}
    return pa.table(row, schema=_BLOCK_ARROW)


_BLOCK_ARROW = pa.schema([("shard", pa.int64()), ("ids", pa.binary()), ("rows", pa.binary()), ("terms", pa.int64()), ("bytes", pa.int64()), ("weights", pa.binary())])
_BLOCK = "shard long, ids binary, rows binary, terms long, bytes long, weights binary"


def blocks(rows: DataFrame, shards: int) -> DataFrame:
    """rows dealt by their names into so many shards, one row a shard."""
    return rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards))).groupBy("shard").applyInArrow(_block, _BLOCK)


def _unpacked(block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, names of the rows, and one line for each term."""
    ids, own = np.frombuffer(block["ids"], np.int64), np.frombuffer(block["rows"], np.int64)
    return ids, own, np.frombuffer(block["weights"], f"i{block['bytes']}").reshape(block["terms"], len(ids))


def _widened(lists: np.ndarray, width: int) -> np.ndarray:
    """lists, with empty ones for terms up to width."""
    return lists if len(lists) >= width else np.concatenate([lists, np.zeros((width - len(lists), lists.shape[1]), lists.dtype)])


class TopK:
    """The k best (score, id) of each query so far; unused places hold the least score. floor: scores that k documents of each query are
    known to reach."""

    def __init__(self, queries: int, k: int, floor: np.ndarray | None = None):
        self.floor = np.full(queries, -(2**63), np.int64) if floor is None else floor
        self.scores = np.full((queries, k), -(2**63), np.int64)
        self.ids = np.full((queries, k), 2**63 - 1, np.int64)

    def threshold(self) -> np.ndarray:
        return np.maximum(self.scores[:, -1], self.floor)

    def offer(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.scores[q], scores]), np.concatenate([self.ids[q], ids])
        best = np.lexsort((i, ~s))[: self.scores.shape[1]]
        self.scores[q], self.ids[q] = s[best], i[best]


class Postings:
    """The posting lists of a shard, term by term, and their bounds."""

    def __init__(self, ids: np.ndarray, lists: np.ndarray, rows: np.ndarray | None = None):
        self.ids, self.lists, self.rows = ids, lists, ids if rows is None else rows
        self.high, self.low = np.maximum(lists.max(axis=1), 0).astype(np.int64), np.minimum(lists.min(axis=1), 0).astype(np.int64)

    def numbers(self, queries: np.ndarray) -> np.ndarray:
        """The lists in the fastest type in which every sum of products with these queries is exact."""
        most = int((np.abs(queries).max(axis=0, initial=0).astype(object) * np.maximum(self.high, -self.low).astype(object)).sum())
        kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
        return self.lists.astype(kind)


def search(postings: Postings, query_rows: np.ndarray, queries: np.ndarray, top: TopK) -> int:
    """Offer a shard's documents, but each query's own row, to the queries' tops. Returns the number of postings that were read."""
    d = postings.numbers(queries)
    kind, ids, read = d.dtype, postings.ids, 0
    bound = np.maximum(queries * postings.high, queries * postings.low)
    # queries that share their heaviest terms share most of their essential ones
    alike = np.lexsort(np.argsort(-bound, axis=1, kind="stable")[:, :6].T[::-1])
    # thresholds rise from one stretch of documents to the next
    stretches = [x for x in _STRETCHES if x < len(ids)] + [len(ids)]
    for first, end in zip([0, *stretches], stretches):
        theta = np.maximum(top.threshold(), -(2**62))  # so that a bound can be taken off
        for at in range(0, len(queries), _GROUP):
            part = alike[at : at + _GROUP]
            essential, others = essential_terms(bound[part], theta[part])
            partial = queries[np.ix_(part, essential)].astype(kind) @ d[essential, first:end]
            read += partial.size * len(essential)
            rest = bound[np.ix_(part, others)].sum(axis=1)
            alive = partial >= (theta[part] - rest)[:, None]
            for j, q in enumerate(part):
                docs = np.flatnonzero(alive[j])
                score, open_bound = partial[j][docs], int(rest[j])
                docs += first
                terms = others[np.argsort(-bound[q, others], kind="stable")]
                for t in range(0, len(terms), _TERMS_AT_ONCE):
                    if not len(docs):
                        break
                    some = terms[t : t + _TERMS_AT_ONCE]
                    score = score + queries[q, some].astype(kind) @ d[some[:, None], docs]
                    read += len(some) * len(docs)
                    open_bound -= int(bound[q, some].sum())
                    stay = score >= theta[q] - open_bound
                    docs, score = docs[stay], score[stay]
                fresh = postings.rows[docs] != query_rows[q]
                if fresh.any():
                    top.offer(q, score[fresh].astype(np.int64), ids[docs[fresh]])
    return read


def essential_terms(bound: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Essential and other terms of a group: the others are those of the least bounds whose sum stays below the threshold of each query."""
    weight = (bound / np.maximum(theta, 1)[:, None]).max(axis=0)
    order = np.argsort(weight, kind="stable")
    n = int((np.cumsum(bound[:, order], axis=1) < theta[:, None]).all(axis=0).sum())
    return np.sort(order[n:]), order[:n]


def _met(postings: Postings, block: dict, k: int, floor: np.ndarray | None = None) -> tuple[Postings, TopK]:
    """The postings, as wide as the query block at least, and the block's best of them."""
    _, own, lists = _unpacked(block)
    if len(postings.lists) < len(lists):
        postings = Postings(postings.ids, _widened(postings.lists, len(lists)), postings.rows)
    top = TopK(len(own), k, floor)
    search(postings, own, _widened(lists, len(postings.lists)).T.astype(np.int64), top)
    return postings, top


def with_thresholds(queries: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """Query blocks and floor: for each query the k-th best score among the rows of first, of which there are few."""
    table = first.toArrow()
    ids, own = (table.column(c).to_numpy() for c in ("vec_id", "row"))
    lists = _lists(table.column("weights")) if len(ids) else None
    schema = pa.schema([*_BLOCK_ARROW, ("floor", pa.binary())])

    def ask(batches):
        for b in batches:
            floors = [_met(Postings(ids, lists, own), block, k)[1].threshold().tobytes() for block in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(floors, pa.binary())], schema=schema)

    return queries.mapInArrow(ask, f"{_BLOCK}, floor binary")


def maxscore_top_k(vectors: DataFrame, k: int = 5, query_every: int = 50, scale: int = 256, shard_rows: int = 8192, query_rows: int = 1024) -> DataFrame:
    """The k best rows for each query: query_id, rank from 1, vec_id, score, query_row (name of the query's row)."""
    rows = stored(term_weights(vectors, k, query_every, scale), "weights")
    asked = rows.where("asks")
    n, m = rows.count(), asked.count()
    shards = max(1, -(-n // max(shard_rows, min(MOST_ROWS, n // 64))))
    first = rows.orderBy(F.xxhash64("row", F.lit(1))).limit(FIRST_ROWS)
    queries = with_thresholds(blocks(asked, max(1, -(-m // query_rows))), first, k)
    queries = stored(queries.withColumnRenamed("shard", "q_shard"), "queries")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard")
    lists = blocks(rows, shards).select(F.lit(-1).cast("long").alias("q_shard"), *_BLOCK_ARROW.names, F.lit(None).cast("binary").alias("floor"))
    dealt = lists.unionByName(queries.select("*", each)).repartition(shards, "shard").sortWithinPartitions("shard", "q_shard")
    schema = pa.schema([("query_id", pa.int64()), ("query_row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def meet(batches):
        postings = None
        for b in batches:
            for i in range(b.num_rows):
                block = b.slice(i, 1).to_pylist()[0]
                ids, own, lists = _unpacked(block)
                if block["q_shard"] < 0:
                    at, postings = block["shard"], Postings(ids, lists, own)
                elif postings is not None and at == block["shard"]:
                    postings, top = _met(postings, block, k, np.frombuffer(block["floor"], np.int64))
                    found = top.scores.ravel() > -(2**63)
                    yield batch(schema, *(np.repeat(c, k)[found] for c in (ids, own)), top.ids.ravel()[found], top.scores.ravel()[found])

    found = dealt.mapInArrow(meet, "query_id long, query_row long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "query_row").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "query_row")
