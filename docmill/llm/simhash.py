"""SimHash near-dedup over vantage-point trees.

A fingerprint has one bit for each of the 64 bits of XXH64 (seed 42) over the shingles of a text: 1 where over half of the
shingles have it set. Equal fingerprints are one point. A vantage-point tree over a bounded sample of the points cuts the
64-bit space into shards of about ``shard_points``, counted as they arrive (up to some 1e8 points; above, the sample tells no finer
shards and they grow with the table): a point goes to the side of each node that its Hamming distance d to
the vantage point says, d <= r (the node's radius) inwards and d > r outwards. By the triangle inequality a pair within
``radius`` is cut only where its outer point has d <= r + radius, so points of that rim are copied inwards, and nothing is
copied outwards: every pair meets in a shard. Within a shard a local tree prunes the same way before distances are counted.
A shard sends only the edges of a spanning forest of its links, so no pair of different fingerprints is lost and a dense
group of n copies costs n edges, not n squared.

Null and empty texts have no words and fingerprint zero, which links like any other. A very long text is one list of hashes
at a time. Ties need no rule: an edge is an edge. Rows that share a doc_id, and rows that repeat, are rows of their own; rows
without an id get a component but never name it, unless it holds no id at all. An empty table gives an empty result. Only
doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import KEY, batch, bounded, by_bytes, packed, stored, texts, unpacked
from docmill.llm.components import components

#: At most so many fingerprints are brought to the driver to place the vantage points.
TREE_SAMPLE = 65_536
#: Points of the sample in a shard from which on it may be split: fewer say nothing of its size.
LEAST_SAMPLE = 16
#: Vantage points tried for a node; the larger side of a cut may hold this share of the points.
_VANTAGE_TRIES = 4
_WORTH = 0.9
_PAIRS_AT_ONCE = 1 << 21


def shingle_hashes(text: bytes, shingle: int = 3) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words; a shorter text is one run, one without words has none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, "<u8")
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = (ends - sizes)[:n].tolist()
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    return np.fromiter([digest(joined[i:j], 42) for i, j in zip(starts, stops)], dtype="<u8", count=n)


def fingerprint_of(hashes: np.ndarray) -> int:
    n = len(hashes)
    if not n:
        return 0
    total = np.zeros(64, np.int64)
    for i in range(0, n, 4096):
        total += np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(rows: DataFrame, shingle: int = 3) -> DataFrame:
    """(id, fp) of rows of an id (long) and a text; fp is the fingerprint as a signed long."""
    name = rows.columns[0]
    schema = pa.schema([(name, pa.int64()), ("fp", pa.int64())])

    def prints(batches):
        for b in (part for whole in batches for part in by_bytes(whole, 1)):
            yield batch(schema, b.column(0), np.array([fingerprint_of(shingle_hashes(t, shingle)) for t in texts(b.column(1))], np.uint64).view(np.int64))

    return bounded(rows).mapInArrow(prints, f"{name} long, fp long")


def distance(a, b):
    return np.bitwise_count(a ^ b).astype(np.int16)


class VantageTree:
    """Vantage points, radii and children of a binary tree. A node is split while more points of the sample arrive at it than ``most``,
    copies of the rims among them, so shards are even however deep the tree is; of a few vantage points and all radii it takes the one
    whose sides are smallest. Where every cut would leave nearly all points on one side, as in a ball of near copies, it stays whole."""

    def __init__(self, sample: np.ndarray, radius: int, most: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.radius = radius
        points, radii, inner, open_ = [np.uint64(0)], [0], [-1], [(0, sample)]
        while open_:
            node, here = open_.pop()
            if len(here) <= most or (cut := self._cut(here, rng)) is None:
                continue
            center, r = cut
            d = distance(here, center)
            points[node], radii[node], inner[node] = center, r, len(points)
            for side in (here[d <= r + radius], here[d > r]):
                open_.append((len(points), side))
                points.append(np.uint64(0))
                radii.append(0)
                inner.append(-1)
        self.points, self.radii, self.inner = np.array(points, np.uint64), np.array(radii, np.int16), np.array(inner, np.int64)

    def _cut(self, here: np.ndarray, rng) -> tuple[np.uint64, int] | None:
        best = None
        for center in rng.integers(0, 2**64, _VANTAGE_TRIES, dtype=np.uint64):
            upto = np.cumsum(np.bincount(distance(here, center), minlength=65))
            into, out = upto[np.minimum(np.arange(65) + self.radius, 64)], len(here) - upto
            cost = into.astype(np.float64) ** 2 + out.astype(np.float64) ** 2
            r = int(cost.argmin())
            if max(into[r], out[r]) <= _WORTH * len(here) and (best is None or cost[r] < best[0]):
                best = (cost[r], center, r)
        return best and best[1:]

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each point and a shard it has to do with; at least one each."""
        index, node, done = np.arange(len(x)), np.zeros(len(x), np.int64), []
        while len(index):
            child = self.inner[node]
            leaf = child < 0
            done.append((index[leaf], node[leaf]))
            index, node, child = index[~leaf], node[~leaf], child[~leaf]
            d, r = distance(x[index], self.points[node]), self.radii[node]
            within, beyond = d <= r + self.radius, d > r
            index, node = np.concatenate([index[within], index[beyond]]), np.concatenate([child[within], child[beyond] + 1])
        return tuple(np.concatenate(c) for c in zip(*done)) if done else (index, node)


def _forest(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels, each the least index of its component, after adding links u-v to components that have labels already."""
    while True:
        a, b = label[u], label[v]
        open_ = a != b
        if not open_.any():
            return label
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _across(points, left, right, radius, rng):
    """Index arrays of all pairs (left, right) within radius, in pieces, by a local vantage-point tree."""
    if not len(left) or not len(right):
        return
    if min(len(left), len(right)) > 256:
        center = points[left[rng.integers(len(left))]]
        dl, dr = distance(points[left], center), distance(points[right], center)
        r = np.sort(dl)[(len(dl) - 1) // 2]
        if (dl > r).any():
            yield from _across(points, left[dl <= r], right[dr <= r + radius], radius, rng)
            yield from _across(points, left[dl > r], right[dr > r - radius], radius, rng)
            return
    step = max(1, _PAIRS_AT_ONCE // len(left))
    for i in range(0, len(right), step):
        part = right[i : i + step]
        g, h = np.nonzero(distance(points[part][:, None], points[left][None, :]) <= radius)
        yield left[h], part[g]


def _within(points, own, radius, rng):
    """The same of all pairs of own: each half of a node by itself, and the rims of the halves across."""
    if len(own) > 512:
        d = distance(points[own], points[own[rng.integers(len(own))]])
        r = np.sort(d)[(len(d) - 1) // 2]
        if (d > r).any():
            yield from _within(points, own[d <= r], radius, rng)
            yield from _within(points, own[d > r], radius, rng)
            yield from _across(points, own[(d <= r) & (d > r - radius)], own[(d > r) & (d <= r + radius)], radius, rng)
            return
    yield from _across(points, own, own, radius, rng)


def shard_forest(points: np.ndarray, radius: int) -> np.ndarray:
    """For each point the index of its root, over all links of the shard."""
    label = np.arange(len(points))
    for u, v in _within(points, np.arange(len(points)), radius, np.random.default_rng(1)):
        label = _forest(label, u, v)
    return label


def fingerprint_links(points: DataFrame, radius: int = 2, shard_points: int = 32_768) -> DataFrame:
    """Edges (a, b) of a spanning forest of each shard over the distinct fingerprints (fp) of points."""
    n = points.count()
    sample = points.orderBy(F.xxhash64("fp")).limit(TREE_SAMPLE).collect() if n > shard_points else []
    most = max(LEAST_SAMPLE, shard_points * len(sample) // max(1, n))
    tree = VantageTree(np.array([r.fp for r in sample], np.int64).view(np.uint64), radius, most)
    routed_schema = pa.schema([("shard", pa.int64()), ("fp", pa.int64())])
    edge_schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def route(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            index, node = tree.route(fp.view(np.uint64))
            yield batch(routed_schema, node, fp[index])

    def link(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy()
        root = shard_forest(fp.view(np.uint64), radius)
        linked = np.flatnonzero(root != np.arange(len(fp)))
        return pa.table([fp[linked], fp[root[linked]]], schema=edge_schema)

    routed = points.select("fp").mapInArrow(route, "shard long, fp long")
    return routed.groupBy("shard").applyInArrow(link, "a long, b long")


def fingerprint_roots(of: DataFrame, radius: int, shard_points: int) -> DataFrame:
    """(fp, least, root): each fingerprint of (id, fp), its least id, and the least fingerprint of its component."""
    points = stored(of.groupBy("fp").agg(F.min(of.columns[0]).alias("least")), "points")
    roots = components(fingerprint_links(points, radius, shard_points)).withColumnRenamed("node", "fp")
    return points.join(roots.hint("merge"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, shard_points: int = 32_768) -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits), component_id (least doc_id of its component)."""
    of = stored(fingerprints(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), shingle), "fingerprints")
    rooted = fingerprint_roots(of, radius, shard_points)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = stored(rooted.join(named.hint("merge"), "root").select("fp", "component_id"), "classes")
    return of.join(classes.hint("merge"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def row_keyed(docs: DataFrame) -> DataFrame:
    """packed() with a hash of the whole row (__row_hash), so that rows of one id and text stay apart by their other columns, and a second
    hash of the text (__t2), by which unlike texts of one hash are told apart."""
    text = F.coalesce(F.col("__row.text").cast("string"), F.lit(""))
    return packed(docs).withColumn("__row_hash", F.xxhash64("__row")).withColumn("__t2", F.xxhash64(F.lit("second"), text))


def least_rows(keyed: DataFrame, roots: DataFrame) -> DataFrame:
    """Of row_keyed() rows, one for each root of their text (__th), that of the least id (no id last), text hash and row hash; roots has
    (__th, root) of texts that are not their own. Rows that are equal in all columns count once. Where unlike texts share a __th, that of
    the least second hash belongs to the root, and each of the others is a class of its own: a text is lost to none that only shares its hash."""
    keys = [*KEY, "__row_hash"]
    classes = keyed.select(*keys, "__t2").join(roots.hint("merge"), "__th", "left").withColumn("root", F.coalesce("root", "__th"))
    # the join has dealt rows by __th, so the next two aggregations move none
    texts_of = classes.groupBy("__th", "root", "__t2").agg(F.min(F.struct(*keys)).alias("head"))
    texts_of = texts_of.groupBy("__th", "root").agg(F.sort_array(F.collect_list(F.struct("__t2", "head"))).alias("texts"))
    one = texts_of.select("root", F.posexplode("texts").alias("n", "t")).select("root", F.when(F.col("n") > 0, F.col("t.__t2")).alias("own"), "t.head")
    heads = one.groupBy("root", "own").agg(F.min("head").alias("head")).select("head.*")
    return unpacked(keyed.join(heads.hint("merge"), keys, "left_semi").dropDuplicates(keys))


def keep_one_of_each(docs: DataFrame, shingle: int = 3, radius: int = 2, shard_points: int = 32_768) -> DataFrame:
    """docs, all columns, with one row of each component of fingerprints, chosen as in least_rows()."""
    keyed = row_keyed(docs)
    of = stored(fingerprints(keyed.select("__th", F.col("__row.text").cast("string").alias("text")), shingle).dropDuplicates(["__th"]), "fingerprints")
    roots = of.join(fingerprint_roots(of, radius, shard_points).hint("merge"), "fp").select("__th", F.col("root").alias("root"))
    return least_rows(keyed, roots)
