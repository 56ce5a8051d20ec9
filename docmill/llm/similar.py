"""The near-duplicate stage: SimHash over vantage-point trees, made whole for a Jaccard similarity of 0.8 by min-hash bands.

Candidates come from two sides. Texts whose SimHash fingerprints (of ``shingle`` words, see simhash.py) lie within ``radius`` bits
are met by the vantage-point trees. Copies of a similarity of 0.8 differ in some 10 of 64 bits, too near the 32 of unlike texts for a
tree to prune, so these come from bands: a text's signature has the least value of its shingles under each of ``bands * rows``
seeded permutations, and texts that agree in all rows of a band share a bucket. At a similarity of s a pair shares one with
probability 1 - (1 - s**rows)**bands: with 52 bands of 8 rows 0.99993 at 0.8, more above, 0.18 at 0.5, 0.003 at 0.3. Every link is
then checked on the shingles of the whole texts, whichever side it came from.

Equal texts are one point; unlike texts that share the point's hash stay, see least_rows(). The pairs of a bucket are not listed:
every point is compared with the least point of its bucket,
and buckets whose points are then in one component drop out. In the others the points outside the largest component meet all
points in tiles. A tile compares signatures, then sketches (the ``SKETCH`` least shingle hashes: all of them in most texts, and then
the comparison is exact), and lists the pairs that reach the similarity less ``SIGMAS`` standard deviations where it is estimated,
so no pair that shares a bucket is passed over but by a chance of some 3 in 10 million. What is listed is checked like all others.

Null and empty texts are one point without shingles; a text shorter than a shingle is one shingle. Very long texts are hashed in
pieces. Rows are told apart by id, text and whole row; of equal rows one stays. An empty table gives an empty result; other columns
may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import batch, by_bytes, mix64, stored, texts
from docmill.llm.components import components
from docmill.llm.simhash import fingerprint_links, fingerprint_of, least_rows, row_keyed, shingle_hashes

#: How far below the wanted similarity, in standard deviations, the agreement of two signatures may lie.
SIGMAS = 5
#: Points of a side of a tile.
TILE = 2048
#: Least shingle hashes of a text that a tile holds.
SKETCH = 1024
_HELD_SHINGLES = 1_000_000


class Bands:
    """Seeded permutations of 32 bits and the buckets they give."""

    def __init__(self, bands: int, rows: int, seed: int = 5):
        self.bands, self.rows = bands, rows
        rng = np.random.default_rng(seed)
        self.factors = (rng.integers(0, 2**31, bands * rows, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
        self.seeds = rng.integers(0, 2**63, bands, dtype=np.uint64)

    def sign(self, hashes: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Buckets, and the signature: one byte of each least value."""
        least = np.full(self.bands * self.rows, 2**32 - 1, np.uint32)
        short = (hashes >> np.uint64(32)).astype(np.uint32)
        for i in range(0, len(short), 512):
            least = np.minimum(least, (self.factors[:, None] * short[None, i : i + 512]).min(axis=1))
        table, out = least.reshape(self.bands, self.rows), self.seeds
        for column in table.T.astype(np.uint64):
            out = mix64(out * np.uint64(3) ^ column)
        return out, (table >> np.uint32(8)).astype(np.uint8).tobytes()


def is_similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether the Jaccard similarity of two sets is at least so many hundredths; two empty ones are equal."""
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (small + large - both)


def similar_pairs(pairs: DataFrame, whole: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose texts in whole (__th, text) are similar enough."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def checked(batches):
        known: dict[int, np.ndarray] = {}
        held = 0
        for b in batches:
            ends, good = [c.to_pylist() for c in b.columns[:2]], []
            for i, pair in enumerate(zip(*ends)):
                if held > _HELD_SHINGLES:
                    known, held = {}, 0
                for point, column in zip(pair, b.columns[2:]):
                    if point not in known:
                        known[point] = np.unique(shingle_hashes(texts(column.slice(i, 1))[0], shingle))
                        held += len(known[point])
                if is_similar(known[pair[0]], known[pair[1]], percent):
                    good.append(i)
            yield batch(schema, *(np.array(e, np.int64)[good] for e in ends))

    for end in ("a", "b"):
        pairs = pairs.join(whole.select(F.col("__th").alias(end), F.col("text").alias(f"text_{end}")).hint("merge"), end)
    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(checked, "a long, b long")


def signed(text: DataFrame, shingle: int, law: Bands) -> DataFrame:
    """(__th, fp, buckets) of each row of (__th, text)."""
    schema = pa.schema([("__th", pa.int64()), ("fp", pa.int64()), ("buckets", pa.list_(pa.int64()))])

    def sign(batches):
        for b in (part for whole in batches for part in by_bytes(whole, 1, 4 << 20)):
            prints, found = np.zeros(b.num_rows, np.uint64), np.zeros((b.num_rows, law.bands), np.uint64)
            for i, t in enumerate(texts(b.column(1))):
                hashes = shingle_hashes(t, shingle)
                prints[i] = fingerprint_of(hashes)
                found[i], _ = law.sign(hashes)
            offsets = np.arange(b.num_rows + 1, dtype=np.int32) * law.bands
            yield batch(schema, b.column(0), prints.view(np.int64), pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel().view(np.int64))))

    return text.mapInArrow(sign, "__th long, fp long, buckets array<long>")


def sketched(text: DataFrame, shingle: int, law: Bands) -> DataFrame:
    """(__th, sig, sketch, n) of each row of (__th, text): signature, least hashes of different shingles in order, number of these shingles."""
    schema = pa.schema([("__th", pa.int64()), ("sig", pa.binary()), ("sketch", pa.binary()), ("n", pa.int64())])

    def sketch(batches):
        for b in (part for whole in batches for part in by_bytes(whole, 1, 4 << 20)):
            sets = [np.unique(shingle_hashes(t, shingle)) for t in texts(b.column(1))]
            yield batch(schema, b.column(0), [law.sign(h)[1] for h in sets], [h[:SKETCH].tobytes() for h in sets], [len(h) for h in sets])

    return text.mapInArrow(sketch, "__th long, sig binary, sketch binary, n long")


def likely(x: np.ndarray, others: list[np.ndarray], n: int, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which sketches of others, of sets of these sizes, may belong to sets that are similar to that of sketch x, of n elements."""
    flat = np.concatenate(others)
    lengths = np.array(list(map(len, others)))
    if not len(flat) or not len(x):
        return lengths == len(x)
    hit = x[np.minimum(np.searchsorted(x, flat), len(x) - 1)] == flat
    both = np.add.reduceat(np.append(hit, False), np.minimum(np.cumsum(lengths) - lengths, len(flat))) * (lengths > 0)
    ok = 100 * both >= percent * (n + sizes - both)
    # where a sketch is not the whole set: the least elements of the union are a sample of it
    like = percent / 100
    for i in np.flatnonzero((n > SKETCH) | (sizes > SKETCH)):
        least = np.union1d(x, others[i])[:SKETCH]
        shared = np.isin(least, x, assume_unique=True) & np.isin(least, others[i], assume_unique=True)
        ok[i] = shared.mean() >= like - SIGMAS * np.sqrt(like * (1 - like) / len(least))
    return ok


def _tiles(batches):
    """Sorted rows (tile, left, __th, root, sig, sketch, n), the rows of one tile at a time; a tile is small by its making."""
    held: list[list] = []
    for b in batches:
        if not b.num_rows:
            continue
        tile = b.column(0).to_numpy()
        edges = np.append(np.flatnonzero(np.append(True, tile[1:] != tile[:-1])), len(tile))
        for i, j in zip(edges[:-1], edges[1:]):
            if held and held[-1].column(0)[0].as_py() != tile[i]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def open_pairs(rooted: DataFrame, whole: DataFrame, shingle: int, percent: int, law: Bands) -> DataFrame:
    """Pairs (a, b) of rooted (bucket, __th, root) that share a bucket, not a root, and as much of their sketches as similar texts."""
    counts = rooted.groupBy("bucket", "root").count()
    sizes = counts.groupBy("bucket").agg(F.max_by("root", F.struct("count", "root")).alias("most"), F.sum("count").alias("n"), F.max("count").alias("own"))
    # a bucket of two has had its only pair
    sizes = sizes.where("own < n and n > 2").select("bucket", "most", F.ceil(F.col("n") / TILE).alias("rights"), F.ceil((F.col("n") - F.col("own")) / TILE).alias("lefts"))
    open_ = stored(rooted.join(sizes.hint("merge"), "bucket"), "open")
    wanted = open_.select("__th").distinct()
    sketches = stored(sketched(whole.join(wanted.hint("merge"), "__th", "left_semi").select("__th", "text"), shingle, law), "sketches")
    tile = lambda count: F.pmod(F.xxhash64("__th"), F.col(count))
    every = lambda count: F.sequence(F.lit(0).cast("long"), F.col(count) - 1)
    at = lambda left, right: F.xxhash64("bucket", left, right)
    rights = F.transform(every("lefts"), lambda i: F.struct(F.lit(False).alias("left"), at(i, tile("rights")).alias("tile")))
    lefts = F.transform(every("rights"), lambda i: F.struct(F.lit(True).alias("left"), at(tile("lefts"), i).alias("tile")))
    dealt = open_.select("__th", "root", F.explode(F.when(F.col("root") == F.col("most"), rights).otherwise(F.concat(rights, lefts))).alias("to"))
    dealt = dealt.join(sketches.hint("merge"), "__th").select("to.tile", "to.left", "__th", "root", "sig", "sketch", "n")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def close(batches):
        like = percent / 100
        for t in _tiles(batches):
            left, th, root, n = (t.column(c).to_numpy() for c in ("left", "__th", "root", "n"))
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(len(th), -1)
            sketch = [np.frombuffer(x, np.uint64) for x in t.column("sketch").to_pylist()]
            least = sig.shape[1] * (like - SIGMAS * np.sqrt(like * (1 - like) / sig.shape[1]))
            all_, out = np.flatnonzero(~left), []
            for x in np.flatnonzero(left):
                near = all_[(np.count_nonzero(sig[x] == sig[all_], axis=1) >= least) & (root[all_] != root[x])]
                if len(near):
                    near = near[likely(sketch[x], [sketch[y] for y in near], n[x], n[near], percent)]
                    out.append((np.minimum(th[x], th[near]), np.maximum(th[x], th[near])))
            if out:
                yield batch(schema, *map(np.concatenate, zip(*out)))

    return dealt.repartition("tile").sortWithinPartitions("tile").mapInArrow(close, "a long, b long").distinct()


def similar_roots(keyed: DataFrame, shingle: int, percent: int, bands: int, rows: int, radius: int) -> DataFrame:
    """(__th, root) of the texts of keyed that are similar to another one; root is the least __th of the component."""
    text = keyed.select("__th", F.coalesce(F.col("__row.text").cast("string"), F.lit("")).alias("text"))
    law = Bands(bands, rows)
    points = stored(signed(text, shingle, law).dropDuplicates(["__th"]), "points")
    # one side: fingerprints, each standing for its least text; the texts of one fingerprint are a bucket
    prints = stored(points.groupBy("fp").agg(F.min("__th").alias("least")), "prints")
    near = fingerprint_links(prints, radius)
    for end, name in (("a", "x"), ("b", "y")):
        near = near.join(prints.select(F.col("fp").alias(end), F.col("least").alias(name)).hint("merge"), end)
    near = near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    # the other: bands
    dealt = points.select("__th", F.explode(F.concat(F.array("fp"), "buckets")).alias("bucket"))
    ends = dealt.groupBy("bucket").agg(F.min("__th").alias("low"), F.max("__th").alias("high")).where("low < high")
    members = stored(dealt.join(ends.select("bucket", "low").hint("merge"), "bucket").select("bucket", "__th", "low"), "members")
    pairs = stored(members.where("low < __th").select(F.col("low").alias("a"), F.col("__th").alias("b")).unionByName(near).distinct(), "pairs")
    held = members.select("__th").unionByName(pairs.select(F.explode(F.array("a", "b")).alias("__th"))).distinct()
    whole = stored(text.join(held.hint("merge"), "__th", "left_semi").dropDuplicates(["__th"]), "whole")
    roots = components(similar_pairs(pairs, whole, shingle, percent)).withColumnRenamed("node", "__th")
    rooted = members.join(roots.hint("merge"), "__th", "left").select("bucket", "__th", F.coalesce("root", "__th").alias("root"))
    more = stored(open_pairs(stored(rooted, "rooted"), whole, shingle, percent, law), "pairs")
    links = similar_pairs(more, whole, shingle, percent).unionByName(roots.select(F.col("root").alias("a"), F.col("__th").alias("b")))
    return components(links).withColumnRenamed("node", "__th")


def keep_one_of_similar(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 52, rows: int = 8, radius: int = 2) -> DataFrame:
    """docs, all columns, with one row of each component of texts whose ``shingle``-word Jaccard similarity is at least
    ``percent`` hundredths: that of the least doc_id (nulls last), then the least hash of the text, then of the row."""
    keyed = row_keyed(docs)
    return least_rows(keyed, similar_roots(keyed, shingle, percent, bands, rows, radius))
