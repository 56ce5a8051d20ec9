"""Ranked lexical search on K2-treaps: in each shard of documents the grid of terms and documents is a compressed quadtree whose cells hold the largest
impact in them; the paths of an item's terms descend it together, best first over ranges of documents.

Two passes. The first reads the texts: each document's number of terms and its occurrences of the items' terms, written out; from it Spark sums the
documents, their terms and each term's documents. The second makes a quadtree of each shard of at most SHARD documents and asks it every item of the
block: a state is a range of documents with, for each term of the item, its cell there; its bound is the sum of the cells' maxima, so a range is opened
only while its bound reaches the item's 20th score so far, which a task carries from shard to shard. At single documents the impacts are exact. Tasks
send each item's best, which one ranking merges.

Items are a stated query set: those of one block (at most BLOCK_TERMS different terms, one item at least, and at most BLOCK_ITEMS items) are broadcast,
further items make further blocks; documents are never broadcast or collected. Nothing is sampled: the results are those of scoring every document.

Defined results: null and empty texts and items have no terms; they score nothing but leave no trace in N either. Documents that repeat or share an id
are ranked each, those without an id after equal scores with one; rows of items are answered each, also where they share an id. No documents or
no items: no rows. Other columns may have any names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm.common import batch, by_bytes, stored, texts

SHARD = 8192
#: Occurrences of items' terms at which a shard of fewer documents ends.
POSTINGS = 2_000_000
BLOCK_TERMS = 1_000_000
BLOCK_ITEMS = 100_000
#: Ranges of documents opened at once: best first in steps of so many, so that numpy works on them together.
STEP = 256
#: Inner cells hold impacts in units of this, rounded up.
UNIT = 1 << 10

_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Child number within a node, by its mask of children and the child's bit: -1 where there is none.
_NTH = np.array([[bin(m & ((1 << b) - 1)).count("1") if m >> b & 1 else -1 for b in range(4)] for m in range(16)], np.int8)


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of 0-9, A-Z, a-z and what is not ASCII; only A-Z are lower-cased."""
    return text.translate(_TERM_BYTES).split()


class K2Treap:
    """Quadtree over (row, column) with the maxima of its cells. Level l has the cells of side 2**(height - l); each is a mask of its four children, the
    place of the first of them, and how far its maximum lies below its parent's (in UNITs, rounded up). The last level holds exact factors."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, factors: np.ndarray, weights: np.ndarray, n_columns: int):
        self.weights = weights
        self.height = h = max(1, int(max(len(weights), n_columns) - 1).bit_length())
        code = np.zeros(len(rows), np.uint64)
        for bit in range(h):
            code |= ((rows >> bit & 1).astype(np.uint64) << np.uint64(2 * bit + 1)) | ((columns >> bit & 1).astype(np.uint64) << np.uint64(2 * bit))
        order = np.argsort(code)
        code, self.factors = code[order], factors[order].astype(np.uint32)
        impact = -(-(weights[rows[order]] * factors[order]) // UNIT)
        self.masks, self.first, levels = [], [], [impact]
        for _ in range(h):
            above = code >> np.uint64(2)
            starts = np.flatnonzero(np.append(True, above[1:] != above[:-1])) if len(code) else np.zeros(0, np.int64)
            self.masks.append(np.bitwise_or.reduceat(np.uint8(1) << (code & np.uint64(3)).astype(np.uint8), starts) if len(starts) else np.zeros(0, np.uint8))
            self.first.append(starts.astype(np.int32))
            levels.append(np.maximum.reduceat(levels[-1], starts) if len(starts) else np.zeros(0, np.int64))
            code = above[starts]
        self.masks.reverse()
        self.first.reverse()
        levels.reverse()
        self.top = int(levels[0][0]) if len(levels[0]) else 0
        self.below = []  # for levels 1 to height - 1
        for level in range(1, h):
            children = np.diff(np.append(self.first[level - 1], len(levels[level])))
            gap = np.repeat(levels[level - 1], children) - levels[level]
            self.below.append(gap.astype(np.min_scalar_type(int(gap.max()))))

    def best(self, rows: np.ndarray, times: np.ndarray, held: Held, ids: np.ndarray, no_id: np.ndarray) -> None:
        """Puts into held what documents score for these rows (each counted times), best ranges first, until no range can reach its least score."""
        if not self.top:
            return
        tops = np.full((1, len(rows)), self.top, np.int64)
        queue: list = [(-int((tops @ times)[0]) * UNIT, 0, 0)]
        states = {0: (0, np.zeros(1, np.int64), np.zeros((1, len(rows)), np.int32), tops)}  # level, ranges, cells and their maxima
        made = 1
        while queue and -queue[0][0] >= held.least:
            # the best ranges of the best range's level
            _, key, _ = heapq.heappop(queue)
            level, ranges, cells, tops = states.pop(key)
            bits = (rows >> (self.height - 1 - level)) & 1
            opened, scored = [], []
            for side in (0, 1):
                at = np.maximum(cells, 0)
                nth = _NTH[self.masks[level][at], 2 * bits[None, :] + side]
                there = (cells >= 0) & (nth >= 0)
                child = np.where(there, self.first[level][at] + nth, -1)
                opened.append(ranges * 2 + side)
                if level + 1 == self.height:
                    f = np.where(there, self.factors[np.maximum(child, 0)], 0).astype(np.int64)
                    scored.append(f @ (self.weights[rows] * times))
                else:
                    top = np.where(there, tops - self.below[level][np.maximum(child, 0)], 0)
                    scored.append((child, top))
            if level + 1 == self.height:
                held.put(np.concatenate(scored), np.concatenate(opened), ids, no_id)
                continue
            ranges = np.concatenate(opened)
            child = np.concatenate([s[0] for s in scored]).astype(np.int32)
            tops = np.concatenate([s[1] for s in scored])
            bound = (tops @ times) * UNIT
            good = np.flatnonzero((bound > 0) & (bound >= held.least))
            good = good[np.argsort(-bound[good], kind="stable")]
            for i in range(0, len(good), STEP):
                part = good[i : i + STEP]
                states[made] = (level + 1, ranges[part], child[part], tops[part])
                heapq.heappush(queue, (-int(bound[part[0]]), made, level + 1))
                made += 1


class Held:
    """The k best (score, id) of an item so far; equal scores by ascending id, no id last."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.score = np.zeros(0, np.int64)
        self.id = np.zeros(0, np.int64)
        self.none = np.zeros(0, bool)

    def put(self, score: np.ndarray, place: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        good = np.flatnonzero(score >= self.least)
        if not len(good):
            return
        score, at = np.append(self.score, score[good]), place[good]
        id_, none = np.append(self.id, ids[at]), np.append(self.none, no_id[at])
        order = np.lexsort((id_, none, -score))[: self.k]
        self.score, self.id, self.none = score[order], id_[order], none[order]
        if len(order) == self.k:
            self.least = int(self.score[-1])


_COUNTS = "no_id boolean, doc_id long, n long, terms array<int>, counts array<long>"
_COUNTS_ARROW = pa.schema([("no_id", pa.bool_()), ("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])


def _count_terms(vocabulary):
    """Each document's number of terms, and how often it holds each term of the vocabulary."""

    def counts(batches):
        number = vocabulary.value
        for b in (part for whole in batches for part in by_bytes(whole, 1)):
            sizes, found, at = [], [], []
            for i, text in enumerate(texts(b.column(1))):
                words = terms_of(text)
                sizes.append(len(words))
                seen = [x for x in map(number.get, words, repeat(-1)) if x >= 0]
                found.append(np.array(seen, np.int64))
                at.append(len(seen))
            doc = np.repeat(np.arange(len(sizes)), at)
            pair, n = np.unique((doc << 32) | (np.concatenate(found) if found else np.zeros(0, np.int64)), return_counts=True)
            offsets = pa.array(np.searchsorted(pair >> 32, np.arange(len(sizes) + 1)), pa.int32())
            term, times = pa.ListArray.from_arrays(offsets, pa.array((pair & 0xFFFFFFFF).astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.int64)))
            yield batch(_COUNTS_ARROW, b.column(0).is_null(), b.column(0).fill_null(0), sizes, term, times)

    return counts


def _search(shared, k: int):
    """Quadtrees of the shards that this task's rows make, asked every item."""

    def search(batches: Iterator[pa.RecordBatch]):
        items, weights, n_docs, n_terms = shared.value
        held = [Held(k) for _ in items]

        def ask(parts):
            none, ids, n, columns, terms, counts = (np.concatenate(x) for x in zip(*parts))
            m = 75 + (25 * n * n_docs) // n_terms
            factors = (1_000_000_000 * counts) // (1000 * counts + 12 * m[columns])
            tree = K2Treap(terms, columns, factors, weights, len(ids))
            for best, (rows, times) in zip(held, items):
                tree.best(rows, times, best, ids, none)

        parts, size, postings = [], 0, 0
        for b in batches:
            for at in range(0, b.num_rows, SHARD):
                part = b.slice(at, SHARD)
                none, ids, n = (c.to_numpy(zero_copy_only=False) for c in part.columns[:3])
                lengths = np.diff(part.column(3).offsets.to_numpy())
                if size and (size + len(ids) > SHARD or postings > POSTINGS):
                    ask(parts)
                    parts, size, postings = [], 0, 0
                parts.append((none, ids, n, np.repeat(np.arange(len(ids)), lengths) + size, part.column(3).flatten().to_numpy().astype(np.int64), part.column(4).flatten().to_numpy()))
                size += len(ids)
                postings += int(lengths.sum())
        if size:
            ask(parts)
        schema = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
        item = np.repeat(np.arange(len(items)), [len(h.score) for h in held])
        if len(item):
            yield batch(schema, item, pa.array(np.concatenate([h.id for h in held]), mask=np.concatenate([h.none for h in held])), np.concatenate([h.score for h in held]))

    return search


def _blocks(items: DataFrame) -> Iterator[list[tuple[int | None, dict[bytes, int]]]]:
    """Items in blocks of bounded vocabulary: (item_id, its terms and how often it holds each)."""
    block, seen = [], set()
    for row in items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        times: dict[bytes, int] = {}
        for t in terms_of((row[1] or "").encode()):
            times[t] = times.get(t, 0) + 1
        if len(block) >= BLOCK_ITEMS or block and len(seen) + len(times.keys() - seen) > BLOCK_TERMS:
            yield block
            block, seen = [], set()
        if times:
            block.append((row[0], times))
            seen |= times.keys()
    if block:
        yield block


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k best documents with a score above 0."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in _blocks(items):
        number = {t: i for i, t in enumerate(dict.fromkeys(t for _, times in block for t in times))}
        counted = stored(rows.mapInArrow(_count_terms(spark.sparkContext.broadcast(number)), _COUNTS), "term-counts")
        n_docs, n_terms = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            return out
        weights = np.zeros(len(number), np.int64)
        for term, df in counted.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
            weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        asked = [(np.fromiter((number[t] for t in times), np.int64), np.fromiter(times.values(), np.int64)) for _, times in block]
        shared = spark.sparkContext.broadcast((asked, weights, n_docs, n_terms))
        found = counted.where("size(terms) > 0").mapInArrow(_search(shared, k), "item long, doc_id long, score long")
        best = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, id_) for i, (id_, _) in enumerate(block)], "item long, item_id long")
        out = out.unionByName(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out
