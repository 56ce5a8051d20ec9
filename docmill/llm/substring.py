"""Substring dedup: suffixes split by prefix into groups that fit in memory, the deep nodes of each group's suffix tree giving the repeats.

A repeat of ``window`` words is an inner node, ``window`` words deep or more, of the suffix tree of the corpus. The tree is sparse: it
has the suffixes that start at anchors. The anchor of a window is the least hashed run of ``SEED`` words in it, the first of equal
ones, so equal windows have their anchors at the same place and need no other suffix to meet. A suffix carries what stands around
its anchor, as far as the windows of that anchor reach. The prefix that deals it out has two lengths:

- ``SEED`` words as a rule. A group is one seed's suffixes, and a task holds a range of the hashed seeds at a time.
- All ``window`` words, one suffix for each window, where a bounded sample of documents (``PREFIX_SAMPLE``) shows that the short prefix is
  frequent. So a run of words that a third of all documents hold is split by what follows it, and what follows alike is combined
  in each batch of documents before it is dealt out. The sample only lays out groups; any sample gives the same result.

First pass: in a group, suffixes with the same surroundings are one leaf; of each leaf only the smallest document stays, the windows
of the others are repeats. A group with one leaf is done. Second pass: the leaves of the other groups come again with the hashes of
their words, sorted into a suffix array with the common-prefix lengths of neighbours; an interval whose lengths reach d is the node
at depth d. A window is its node and as many equal words before the anchor; of each the smallest document stays.

Words are runs of anything but space and \\t..\\r, unchanged. Null and empty texts have none. A document with fewer words than a
window keeps them all. Rows that share a doc_id, or repeat, never remove each other's words (a tie); a null doc_id ranks after all
others. Batches are cut by bytes; a very long text is a batch of its own. An empty table gives an empty result. Only doc_id and
text are read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import KEY, KEY_ARROW, batch, by_bytes, by_range, keyed, mix64, range_bits, sliced, stored, texts, to_ranges

#: Words in a short prefix.
SEED = 5
#: Documents in which frequent short prefixes are looked for, and the share of them that makes one frequent.
PREFIX_SAMPLE = 20_000
FREQUENT = 0.001
_CACHED_WORDS = 500_000
#: Bytes of text that are combined before they are shuffled.
_BYTES_AT_ONCE = 24 << 20
_FOUND = "no boolean, rid long, th long, kind int, value long"
_FOUND_ARROW = pa.schema([*KEY_ARROW, ("kind", pa.int32()), ("value", pa.int64())])
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _dealt_schema(names: list[str]) -> tuple[str, pa.Schema]:
    """Schemas of to_ranges() rows with these columns of longs."""
    arrow = pa.schema([("kind", pa.int32()), ("range", pa.int64()), *((n, pa.list_(pa.int64())) for n in names)])
    return "kind int, `range` long, " + ", ".join(f"{n} array<long>" for n in names), arrow


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _CACHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _hashed(cache: _WordHash, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the documents, one after the other, and the number of words in each."""
    counts, parts = np.zeros(len(data), np.int64), []
    for i, text in enumerate(data):
        words = text.split()
        counts[i] = len(words)
        parts.append(np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), counts


def _grams(hashes: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for j, c in enumerate(mix64(np.arange(1, n + 1, dtype=np.uint64) * _BASE) | np.uint64(1)):
        out += hashes[j : j + len(out)] * c
    return mix64(out)


class Runs:
    """Hash of any run of words: sums of hash * base**place, taken back to place 0."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        self.back = np.multiply.accumulate(np.append(np.uint64(1), np.full(n, inverse)))
        self.sums = np.append(np.uint64(0), np.cumsum(hashes * np.multiply.accumulate(np.append(np.uint64(1), np.full(max(0, n - 1), _BASE)))[:n], dtype=np.uint64))

    def of(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[first]) * self.back[first] + (end - first).astype(np.uint64))


class Anchors:
    """The anchors of a batch: index of the first word, document, seed, and the least and most words by which their windows start before them."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, window: int):
        grams = _grams(hashes, SEED)
        width = window - SEED + 1
        if len(hashes) < window:
            grams = grams[:0]
        least, place, have = grams, np.arange(len(grams)), 1
        while have < width and len(least):
            step = min(have, width - have)
            later = least[step:] < least[:-step]
            place = np.where(later, place[step:], place[:-step])
            least = np.where(later, least[step:], least[:-step])
            have += step
        doc = np.repeat(np.arange(len(counts)), counts)
        start = np.flatnonzero(doc[: len(least)] == doc[window - 1 : window - 1 + len(least)]) if len(least) else np.zeros(0, np.int64)
        at = place[start]
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(at))[: len(first)] - 1
        self.at, self.doc = at[first], doc[start[first]]
        self.seed = grams[self.at]
        self.most, self.least = self.at - start[first], self.at - start[last]
        #: index of each document's first word
        self.base = np.cumsum(counts) - counts


def _after(no: np.ndarray, rid: np.ndarray, head_no: np.ndarray, head_rid: np.ndarray) -> np.ndarray:
    """Whether a document ranks after another one; those without an id are all last and equal."""
    return ~head_no & (no | (rid > head_rid))


def _settled(no: np.ndarray, rid: np.ndarray, *classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by class and document, and whether in this order a row's document ranks after the first of its class."""
    order = np.lexsort((rid, no, *classes))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in classes:
        new[1:] |= c[order][1:] != c[order][:-1]
    head = order[new][np.cumsum(new) - 1]
    return order, _after(no[order], rid[order], no[head], rid[head])


def _spans(no, rid, th, first, last):
    """Found rows of kind 0: runs of windows that are repeats, first * 2**32 + last, neighbours joined."""
    order = np.lexsort((first, th, rid, no))
    no, rid, th, first, last = (x[order] for x in (no, rid, th, first, last))
    new = np.append(True, (no[1:] != no[:-1]) | (rid[1:] != rid[:-1]) | (th[1:] != th[:-1]) | (first[1:] > last[:-1] + 1))[: len(rid)]
    i = np.flatnonzero(new)
    if len(i):
        last = np.maximum.reduceat(last, i)
        yield from sliced(batch(_FOUND_ARROW, no[i], rid[i], th[i], np.zeros(len(i), np.int32), (first[i] << 32) + last))


def _coded(at: np.ndarray, no: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    return (at << 9) | (no.astype(np.int64) << 8) | (most << 4) | least


def _decoded(code: np.ndarray):
    """at, no, most, least."""
    return code >> 9, (code >> 8 & 1).astype(bool), code >> 4 & 15, code & 15


def frequent_seeds(base: DataFrame, window: int) -> np.ndarray:
    """Short prefixes that many documents of a bounded sample hold; at most 1 / FREQUENT times the anchors of a document."""
    n = base.count()
    sample = base.select("text").sample(min(1.0, PREFIX_SAMPLE / max(1, n)), seed=3)
    schema = pa.schema([("seed", pa.int64()), ("n", pa.int64())])

    def seeds(batches):
        cache = _WordHash()
        for b in (part for whole in batches for part in by_bytes(whole, 0, _BYTES_AT_ONCE)):
            found = Anchors(*_hashed(cache, texts(b.column(0))), window)
            order = np.lexsort((found.doc, found.seed))
            seed, doc = found.seed[order], found.doc[order]
            once = np.append(True, (seed[1:] != seed[:-1]) | (doc[1:] != doc[:-1]))[: len(seed)]
            kinds, counts = np.unique(seed[once], return_counts=True)
            yield batch(schema, kinds.view(np.int64), counts)

    counted = sample.mapInArrow(seeds, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
    rows = counted.where(F.col("n") >= max(20, int(FREQUENT * min(n, PREFIX_SAMPLE)))).select("seed").collect()
    return np.sort(np.array([r.seed for r in rows], np.int64).view(np.uint64))


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x if len(known) else np.zeros(len(x), bool)


_LEAVES, _LEAVES_ARROW = _dealt_schema(["seed", "leaf", "rid", "th", "code"])


def _leaf_rows(window: int, bits: int, frequent: np.ndarray):
    """Suffixes dealt by prefix. Of those that are alike in the batch only the smallest document's; kind 1: the others, settled, dealt by document."""

    def rows(batches):
        cache = _WordHash()
        for b in (part for whole in batches for part in by_bytes(whole, 3, _BYTES_AT_ONCE)):
            no, rid, th = (c.to_numpy(zero_copy_only=False) for c in b.columns[:3])
            hashes, counts = _hashed(cache, texts(b.column(3)))
            found, runs = Anchors(hashes, counts, window), Runs(hashes)
            at, doc, most, least = found.at, found.doc, found.most, found.least
            prefix = found.seed
            leaf = mix64(runs.of(at - most, at - least + window) ^ ((most << 4) | least).astype(np.uint64))
            if (hot := _among(prefix, frequent)).any():
                # a suffix for each window, its prefix the whole window
                n = (most - least + 1)[hot]
                start = np.repeat((at - most)[hot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                whole, zero = runs.of(start, start + window), np.zeros(len(start), np.int64)
                # a hash of its own kind tells windows with one prefix hash apart
                other = mix64(_grams(hashes, window)[start])
                at, doc = np.append(at[~hot], start), np.append(doc[~hot], np.repeat(doc[hot], n))
                most, least = np.append(most[~hot], zero), np.append(least[~hot], zero)
                prefix, leaf = np.append(prefix[~hot], whole), np.append(leaf[~hot], other)
            order, gone = _settled(no[doc], rid[doc], leaf, prefix)
            doc = doc[order]
            code = _coded(at[order] - found.base[doc], no[doc], most[order], least[order])
            prefix, leaf = prefix[order], leaf[order]
            by_doc = mix64(rid[doc].view(np.uint64))
            for kind, part, key in ((0, ~gone, prefix), (1, gone, by_doc)):
                blank = np.uint64(kind == 0)
                yield to_ranges(_LEAVES_ARROW, kind, key[part], bits, (prefix[part] * blank).view(np.int64), (leaf[part] * blank).view(np.int64), rid[doc[part]], th[doc[part]], code[part])

    return rows


def _leaves(batches):
    """Found rows: spans of settled suffixes (kind 0), and codes of those whose group has several leaves (kind 1)."""
    for kind, (seed, leaf, rid, th, code) in by_range(batches):
        at, no, most, least = _decoded(code)
        if kind == 1:
            yield from _spans(no, rid, th, at - most, at - least)
            continue
        order, gone = _settled(no, rid, leaf, seed)
        seed, leaf, rid, th, code, at, no, most, least = (x[order] for x in (seed, leaf, rid, th, code, at, no, most, least))
        yield from _spans(no[gone], rid[gone], th[gone], (at - most)[gone], (at - least)[gone])
        new = np.append(True, seed[1:] != seed[:-1])[: len(seed)]
        group = np.cumsum(new) - 1
        leaves = np.append(True, new[1:] | (leaf[1:] != leaf[:-1]))[: len(seed)]
        several = (np.bincount(group, weights=leaves) > 1)[group] & ~gone if len(seed) else gone
        if several.any():
            yield from sliced(batch(_FOUND_ARROW, no[several], rid[several], th[several], np.ones(several.sum(), np.int32), code[several]))


def deep_nodes(seed: np.ndarray, no: np.ndarray, rid: np.ndarray, most: np.ndarray, least: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each suffix and each number of words before its anchor, whether the window that starts there is a repeat of a smaller document's.

    left: hashes of the words before the anchor, nearest first; right: of those after the seed. The suffixes are sorted by seed and right
    words; the common-prefix length of neighbours cuts them into the nodes of each depth.
    """
    n, reach = left.shape if len(left) else (0, left.shape[1])
    out = np.zeros((n, reach + 1), bool)
    if not n:
        return out
    order = np.lexsort((*right.T[::-1], seed))
    same = np.logical_and.accumulate(right[order][1:] == right[order][:-1], axis=1).sum(axis=1)
    common = np.where(seed[order][1:] == seed[order][:-1], same, -1)
    before = np.zeros(n, np.uint64)
    for back in range(reach + 1):
        if back:
            before = mix64(before * np.uint64(3) + left[:, back - 1])
        node = np.empty(n, np.int64)
        node[order] = np.append(0, np.cumsum(common < right.shape[1] - back))
        own = np.flatnonzero((least <= back) & (back <= most))
        at, gone = _settled(no[own], rid[own], before[own], node[own])
        out[own[at[gone]], back] = True
    return out


def _node_spans(no, rid, th, at, gone):
    i, back = np.nonzero(gone)
    yield from _spans(no[i], rid[i], th[i], at[i] - back, at[i] - back)


def _around(reach: int) -> list[str]:
    return [f"l{i}" for i in range(reach)] + [f"r{i}" for i in range(reach)]


def _node_rows(window: int, bits: int):
    """Suffixes of groups with several leaves, with the words around them; kind 1: windows that the batch alone settles, dealt by document."""
    reach = window - SEED
    _, schema = _dealt_schema(["seed", "rid", "th", "code", *_around(reach)])

    def rows(batches):
        cache = _WordHash()
        for b in (part for whole in batches for part in by_bytes(whole, 3, _BYTES_AT_ONCE)):
            no, rid, th = (c.to_numpy(zero_copy_only=False) for c in b.columns[:3])
            hashes, counts = _hashed(cache, texts(b.column(3)))
            codes = b.column(4).combine_chunks() if isinstance(b.column(4), pa.ChunkedArray) else b.column(4)
            doc = np.repeat(np.arange(b.num_rows), codes.value_lengths().to_numpy(zero_copy_only=False))
            code = codes.flatten().to_numpy(zero_copy_only=False)
            at, _, most, least = _decoded(code)
            place = at + (np.cumsum(counts) - counts)[doc]
            padded = np.concatenate([np.zeros(reach, np.uint64), hashes, np.zeros(reach, np.uint64)])
            left = padded[place[:, None] + reach - 1 - np.arange(reach)[None, :]]
            right = padded[place[:, None] + reach + SEED + np.arange(reach)[None, :]]
            seed = _grams(hashes, SEED)[place]
            gone = deep_nodes(seed, no[doc], rid[doc], most, least, left, right)
            i, back = np.nonzero(gone)
            zero = np.zeros(len(i), np.int64)
            own = doc[i]
            yield to_ranges(schema, 1, mix64(rid[own].view(np.uint64)), bits, zero, rid[own], th[own], _coded(at[i] - back, no[own], zero, zero), *[zero] * (2 * reach))
            open_ = gone.sum(axis=1) < most - least + 1
            own = doc[open_]
            yield to_ranges(schema, 0, seed[open_], bits, seed[open_].view(np.int64), rid[own], th[own], code[open_], *left[open_].T.view(np.int64), *right[open_].T.view(np.int64))

    return rows


def _nodes(window: int):
    def found(batches):
        for kind, (seed, rid, th, code, *around) in by_range(batches):
            at, no, most, least = _decoded(code)
            if kind == 1:
                yield from _spans(no, rid, th, at, at)
                continue
            reach = window - SEED
            words = np.stack(around, axis=1).view(np.uint64)
            yield from _node_spans(no, rid, th, at, deep_nodes(seed.view(np.uint64), no, rid, most, least, words[:, :reach], words[:, reach:]))

    return found


def repeated_spans(docs: DataFrame, window: int = 13) -> DataFrame:
    """(__no, __rid, __th, spans): for each document with repeats, the runs of windows that a smaller document holds, each as first * 2**32 + last.

    A run joined with its neighbours is a maximal repeat, from its first window's first word to its last window's last word.
    """
    if not SEED <= window < SEED + 16:
        raise ValueError("window must hold a seed and fewer than 16 words more")
    base, bits = keyed(docs), range_bits(docs.sparkSession)
    one_of = lambda rows: rows.repartition("range").sortWithinPartitions("kind", "range")
    leaves = base.select(*KEY, "text").mapInArrow(_leaf_rows(window, bits, frequent_seeds(base, window)), _LEAVES)
    found = stored(one_of(leaves).mapInArrow(_leaves, _FOUND), "leaves").withColumnsRenamed(dict(zip(("no", "rid", "th"), KEY)))
    open_ = found.where("kind = 1").groupBy(*KEY).agg(F.collect_set("value").alias("codes"))
    again = base.join(open_.hint("merge"), list(KEY)).select(*KEY, "text", "codes").mapInArrow(_node_rows(window, bits), _dealt_schema(["seed", "rid", "th", "code", *_around(window - SEED)])[0])
    nodes = one_of(again).mapInArrow(_nodes(window), _FOUND).withColumnsRenamed(dict(zip(("no", "rid", "th"), KEY)))
    return found.where("kind = 0").unionByName(nodes).groupBy(*KEY).agg(F.collect_set("value").alias("spans"))


def without_spans(text: bytes, spans: list[int] | None, window: int) -> tuple[list[bytes], int]:
    """The words that stay, and how many there were."""
    words = text.split()
    if not spans:
        return words, len(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, [s >> 32 for s in spans], 1)
    np.add.at(edge, [(s & 0xFFFFFFFF) + window for s in spans], -1)
    return [w for w, n in zip(words, np.cumsum(edge).tolist()) if not n], len(words)


def substring_dedup_digest(docs: DataFrame, window: int = 13) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_sha256 of the words that stay, joined by one space."""

    def digest(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
        for b in (part for whole in batches for part in by_bytes(whole, 1)):
            done = [without_spans(t, s, window) for t, s in zip(texts(b.column(1)), b.column(2).to_pylist())]
            yield batch(schema, b.column(0), [n for _, n in done], [n - len(w) for w, n in done], [hashlib.sha256(b" ".join(w)).hexdigest() for w, _ in done])

    joined = keyed(docs).join(repeated_spans(docs, window).hint("merge"), list(KEY), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")
