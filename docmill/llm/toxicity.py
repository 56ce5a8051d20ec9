"""Toxicity by cumulative-link ordinal regression on sparse text features.

Model: P(severity >= k) = sigmoid(w.x - t_k) for k = 1..K-1, one weight vector for all thresholds t_1 < t_2 < ...; the output is
the expected severity, the sum of these probabilities. Features: the words of a document (A-Z lower-cased, runs of ASCII
letters, digits and any non-ASCII characters) and the first 4 and 6 bytes of longer ones, each 1 if present.

The labels say only toxic or not. Grades come from them: 0 for documents that are not toxic; toxic ones get 1..3 by thirds of the number of
different marked words in them, a word being marked where it is ``MARKED`` times as frequent in toxic documents of the sample as in others.

Fitting: at most ``sample`` labelled documents (a documented bound), chosen by the hash of their ids, near copies once. Spark counts their
features; those whose log-likelihood ratio is at least ``SIGNIFICANT`` take part, and only the places of these in the documents come to
the driver. There the likelihood of the grades, log(F(t_(k+1) - s) - F(t_k - s)), less an L1 penalty is maximised by accelerated proximal
gradient steps, the gaps of the thresholds projected to at least ``LEAST_GAP``. At most some hundreds of weights stay; they go to the executors
with the function. Scoring is one pass over all whole texts without a shuffle.

Labels that are null, lack an id or a document take no part; where an id has several labels the largest counts, where it has several texts
the one of the least hash. Without both kinds of labels every document has severity 0 and none is rejected. Null and empty texts have no
features: severity is 0, and they are never rejected. Repeated rows are rated each; a probability of just ``REJECT`` rejects. Very long
texts are read whole, a batch at a time. An empty table gives an empty result. Other columns may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import batch, bounded, by_bytes, mix64, named, pieces_of, stored, texts, unpacked

SAMPLE = 8000
GRADES = 4
MARKED = 8.0
#: Least log-likelihood ratio of a feature that takes part.
SIGNIFICANT = 14.0
#: A document is toxic from this probability of grade 1 or more on.
REJECT = 0.3
#: Least distance of neighbouring thresholds.
LEAST_GAP = 1e-3
#: Words whose features a task keeps, and the longest of them: together a bound in bytes.
_CACHED_WORDS = 100_000
_CACHED_LENGTH = 64
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


def features_of(word: bytes) -> list[bytes]:
    return [word] + [word[:n] + b"*" for n in (4, 6) if len(word) > n]


def minhashes(words: list[bytes], n: int = 4, shingle: int = 5) -> np.ndarray:
    """n least hashes of the five-word shingles under n orders; near copies share one almost surely."""
    shingles = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, shingles), np.uint64, len(shingles))
    return np.array([mix64(h ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)).min() for seed in range(1, n + 1)], "<u8")


def one_of_each(marks: list) -> list:
    """The rows (id, toxic, minhash) without near copies of earlier ones, which would make every one of their words look telling."""
    seen: set[tuple[int, int]] = set()
    out = []
    for r in marks:
        own = set(enumerate(np.frombuffer(bytes(r.minhash), "<u8").tolist()))
        if not own & seen:
            out.append(r)
        seen |= own
    return out


class OrdinalModel:
    """Sparse weights of features and rising thresholds."""

    def __init__(self, weights: dict[bytes, float], thresholds: list[float]):
        self.weights, self.thresholds = weights, thresholds

    def score(self, words: set[bytes], cache: dict[bytes, frozenset]) -> float:
        seen: set[bytes] = set()
        for w in words:
            known = cache.get(w)
            if known is None:
                known = tuple(f for f in features_of(w) if f in self.weights)
                if len(w) <= _CACHED_LENGTH:
                    if len(cache) >= _CACHED_WORDS:
                        cache.clear()
                    cache[w] = known
            if known:
                seen.update(known)
        return sum(self.weights[f] for f in sorted(seen))

    def at_least(self, score: float) -> list[float]:
        """P(severity >= k), k = 1, 2, ..."""
        return [float(1 / (1 + np.exp(-np.clip(score - t, -60, 60)))) for t in self.thresholds]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def ordinal_loss(score: np.ndarray, thresholds: np.ndarray, grades: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of the cumulative-link model, and its gradients by scores and thresholds."""
    n, bounds = len(score), np.concatenate([[-60.0], thresholds, [60.0]])
    low, high = bounds[grades] - score, bounds[grades + 1] - score
    first, last = grades == 0, grades == len(thresholds)
    below = np.where(first, 0.0, _sigmoid(low))
    above = np.where(last, 1.0, _sigmoid(high))
    gap = np.where(first | last, 1.0, -np.expm1(np.minimum(low - high, -1e-12)))
    # F(high) - F(low) = F(high) (1 - F(low)) (1 - exp(low - high))
    loss = -(np.log(np.maximum(above, 1e-300)) + np.log(np.maximum(1 - below, 1e-300)) + np.log(gap)).mean()
    by_score = (1 - above - below) / n
    by_high, by_low = -(1 - above) / ((1 - below) * gap) / n, below / (above * gap) / n
    by_threshold = np.bincount(grades[~last], weights=by_high[~last], minlength=len(thresholds)) + np.bincount(grades[~first] - 1, weights=by_low[~first], minlength=len(thresholds))
    return loss, by_score, by_threshold


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, grades: np.ndarray, n_features: int, n_grades: int, l1: float = 1e-5, steps: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds for documents given as (row, feature) places of ones; accelerated proximal gradient with line search and restarts."""
    n = len(grades)
    share = np.clip((grades[:, None] >= np.arange(1, n_grades)[None, :]).mean(axis=0), 1e-3, 1 - 1e-3)
    start = np.maximum.accumulate(-np.log(share / (1 - share)))
    # features are scaled to one length, so that rare ones learn as fast as common ones
    size = 1 / np.sqrt(np.maximum(np.bincount(cols, minlength=n_features), 1) / n)
    x = size[cols]
    # unknowns: weights, the first threshold, and the gaps to the next ones, for which the constraint is a box
    at = np.concatenate([np.zeros(n_features), start[:1], np.maximum(np.diff(start), LEAST_GAP)])

    def loss(v):
        score = np.bincount(rows, weights=v[cols] * x, minlength=n)
        value, by_score, by_threshold = ordinal_loss(score, np.cumsum(v[n_features:]), grades)
        return value, np.concatenate([np.bincount(cols, weights=by_score[rows] * x, minlength=n_features), np.cumsum(by_threshold[::-1])[::-1]])

    def prox(v, rate):
        w = np.sign(v[:n_features]) * np.maximum(np.abs(v[:n_features]) - rate * l1, 0)
        return np.concatenate([w, v[n_features : n_features + 1], np.maximum(v[n_features + 1 :], LEAST_GAP)])

    ahead, momentum, rate = at, 1.0, 1.0
    for _ in range(steps):
        value, slope = loss(ahead)
        while True:
            new = prox(ahead - rate * slope, rate)
            step = new - ahead
            if loss(new)[0] <= value + slope @ step + step @ step / (2 * rate) + 1e-12 or rate < 1e-9:
                break
            rate /= 2
        restart = (ahead - new) @ (new - at) > 0
        larger = 1.0 if restart else (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        ahead = new + (0.0 if restart else (momentum - 1) / larger) * (new - at)
        ahead[n_features + 1 :] = np.maximum(ahead[n_features + 1 :], LEAST_GAP)
        at, momentum, rate = new, larger, rate * 1.1
    return at[:n_features] * size, np.cumsum(at[n_features:])


def g_squared(in_toxic: np.ndarray, in_clean: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Log-likelihood ratio of each feature's counts against even frequency."""
    all_, n = in_toxic + in_clean, toxic + clean
    total = np.zeros(len(all_))
    for seen, size in ((in_toxic, toxic), (in_clean, clean)):
        for got, expected in ((seen, all_ * size / n), (size - seen, (n - all_) * size / n)):
            total += 2 * got * np.log(np.maximum(got, 1e-9) / np.maximum(expected, 1e-9))
    return total


def _all_features(text: bytes) -> set[bytes]:
    return {f for w in set(words_of(text)) for f in features_of(w)}


def telling_features(chosen: DataFrame, toxic: int, clean: int) -> list:
    """(feature, in_toxic, in_clean) of the features of (toxic, text) that chance would not spread so unevenly; counted in Spark."""
    pairs, counts = pa.schema([("feature", pa.binary()), ("toxic", pa.int64())]), pa.schema([("feature", pa.binary()), ("in_toxic", pa.int64()), ("in_clean", pa.int64())])

    def each(batches):
        for b in batches:
            for is_toxic, text in zip(b.column(0).to_pylist(), texts(b.column(1))):
                own = list(_all_features(text))
                yield batch(pairs, own, np.full(len(own), is_toxic, np.int64))

    def telling(batches):
        for b in batches:
            use = g_squared(b.column(1).to_numpy().astype(float), b.column(2).to_numpy().astype(float), toxic, clean) >= SIGNIFICANT
            yield b.filter(pa.array(use)).cast(counts)

    seen = chosen.select("toxic", "text").mapInArrow(each, "feature binary, toxic long").groupBy("feature").agg(F.sum("toxic").alias("in_toxic"), F.sum(1 - F.col("toxic")).alias("in_clean"))
    return sorted(seen.mapInArrow(telling, "feature binary, in_toxic long, in_clean long").collect(), key=lambda r: bytes(r.feature))


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> OrdinalModel | None:
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = stored(known.orderBy(F.xxhash64("id"), "id").limit(sample).select("id", F.least(F.greatest("toxic", F.lit(0)), F.lit(1)).cast("long").alias("toxic")), "labels")
    # at most sample rows of two numbers
    found = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(known), "id")
    taken = stored(found.groupBy("id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "sample")
    marks = pa.schema([("id", pa.int64()), ("toxic", pa.int64()), ("minhash", pa.binary())])

    def marked(batches):
        for b in batches:
            yield batch(marks, b.column(0), b.column(1), [minhashes(words_of(t)).tobytes() for t in texts(b.column(2))])

    kept = one_of_each(sorted(taken.select("id", "toxic", "text").mapInArrow(marked, "id long, toxic long, minhash binary").collect(), key=lambda r: r.id))
    toxic = np.array([r.toxic > 0 for r in kept], bool)
    if not toxic.any() or toxic.all():
        return None
    ids = frozenset(r.id for r in kept)

    def only_kept(batches):
        for b in batches:
            yield b.filter(pa.array([i in ids for i in b.column(0).to_pylist()], pa.bool_()))

    chosen = taken.select("id", "toxic", "text").mapInArrow(only_kept, "id long, toxic long, text string")
    features = telling_features(chosen, int(toxic.sum()), int((~toxic).sum()))
    place = {bytes(r.feature): i for i, r in enumerate(features)}

    def places(batches):
        schema = pa.schema([("id", pa.int64()), ("places", pa.list_(pa.int32()))])
        for b in batches:
            yield batch(schema, b.column(0), [sorted(place[f] for f in _all_features(t) if f in place) for t in texts(b.column(2))])

    own = {r.id: r.places for r in chosen.mapInArrow(places, "id long, places array<int>").collect()}
    rows = np.repeat(np.arange(len(kept)), [len(own[r.id]) for r in kept])
    cols = np.array([p for r in kept for p in own[r.id]], np.int64)
    in_toxic, in_clean = (np.array([r[name] for r in features], float) for name in ("in_toxic", "in_clean"))
    ratio = ((in_toxic + 0.5) / (toxic.sum() + 1)) / ((in_clean + 0.5) / ((~toxic).sum() + 1))
    is_word = np.array([not bytes(r.feature).endswith(b"*") for r in features], bool)
    share = np.bincount(rows, weights=((ratio >= MARKED) & is_word)[cols], minlength=len(kept)) if len(cols) else np.zeros(len(kept))
    grades = np.zeros(len(kept), np.int64)
    edges = np.quantile(share[toxic], np.arange(1, GRADES - 1) / (GRADES - 1))
    grades[toxic] = 1 + np.searchsorted(edges, share[toxic], side="left")
    w, t = fit_ordinal(rows, cols, grades, max(1, len(features)), GRADES)
    return OrdinalModel({f: float(w[i]) for f, i in place.items() if w[i]}, t.tolist())


def _severity(model: OrdinalModel | None, text: bytes, cache: dict) -> tuple[float, float, int]:
    """Expected severity, P(toxic), most fitting grade."""
    words = set(words_of(text))
    if model is None or not words:
        return 0.0, 0.0, 0
    p = model.at_least(model.score(words, cache))
    return sum(p), p[0], sum(x >= 0.5 for x in p)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row a document: doc_id, severity (expected), p_toxic, grade (0 to 3, the highest that is at least as likely as not), toxic (p_toxic at least ``REJECT``)."""
    model = fit_toxicity(docs, labels, sample)
    schema = pa.schema([("doc_id", pa.int64()), ("severity", pa.float64()), ("p_toxic", pa.float64()), ("grade", pa.int32()), ("toxic", pa.bool_())])

    def rate(batches):
        cache: dict = {}
        for b in (part for whole in batches for part in by_bytes(whole, 1, 4 << 20)):
            done = [_severity(model, t, cache) for t in texts(b.column(1))]
            yield batch(schema, b.column(0), [x[0] for x in done], [x[1] for x in done], [x[2] for x in done], [x[1] >= REJECT for x in done])

    return bounded(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rate, "doc_id long, severity double, p_toxic double, grade int, toxic boolean")


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs, all columns, less the toxic ones."""
    model = fit_toxicity(docs, labels, sample)
    at = docs.columns.index("text")
    rows = bounded(docs).select(F.struct(*map(named, docs.columns)).alias("__row"))

    def keep(batches):
        cache: dict = {}
        for b in batches:
            text = b.column(0).field(at).cast(pa.string())
            for first, n in pieces_of(text, 4 << 20):
                yield b.slice(first, n).filter(pa.array([_severity(model, t, cache)[1] < REJECT for t in texts(text.slice(first, n))], pa.bool_()))

    return unpacked(rows.mapInArrow(keep, rows.schema))
