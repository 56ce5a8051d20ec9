"""Phrase collocations by best-first branch-and-bound growth: the counts of prefixes bound the scores of what grows from them.

1. Texts become rows of word codes, one for each language in a batch, written out; later passes read those.
2. Words are counted exactly, then pairs of frequent words by a hash, whose counts can only be too large: what they leave out cannot be a candidate.
   Pairs that pass are counted exactly.
3. A phrase that starts with the pair (v, w) occurs at most f(v w) = c times, so the cut after v leaves it at most 2000000 c / (f(v) + c): the bound of
   the pair as a prefix. Read from behind it bounds what ends with a pair. Each language's frontier is opened best first: all prefixes and suffixes whose
   bound reaches the level, at first the score of its pair number FRONTIER. Phrases of three words grow where either end is open, of four where both are, and
   around whatever reaches the level by itself, since a longer candidate may drop it.
4. Candidates at the level or above then have their exact scores and all longer candidates around them. Where fewer than ``top`` of them survive, the level
   falls (to the score of eight times as many pairs, in the end to all) and the growth of those languages is done again; else the language is settled, ties included.

The frontier reaches tasks as bitmaps of hashes of a fixed size: a collision opens a phrase too many, never one too few, and every count, score and
drop is computed from exact counts by joins. Nothing is sampled or capped.

Defined results: null texts have no words, a null language is ``und`` (as is the language of that name); repeated rows count each; documents need no id; ties
break by phrase; no documents: no rows. Other columns may have any names.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm.common import batch, by_bytes, by_range, mix64, range_bits, sliced, stored, texts, to_ranges

MIN_COUNT, LONGEST, TOP = 30, 4, 2000
#: Drops a phrase that a longer candidate has in this share of its places, in percent.
COVERED = 80
FRONTIER = 2 * TOP
#: Bits of each bitmap: 8 MB. A hash's place is its upper bits, so that the hashes of a range lie in a few blocks of the bitmap.
PLACE_BITS = 26
BITS = 1 << PLACE_BITS
#: Bytes of text in one row of codes.
PIECE = 8 << 20
#: Rows of codes that are decoded at once.
GROUP_ROWS = 8
#: Parts that a language's best phrases are first sought in.
PARTS = 32

_BREAK = b"\n"
_PLAIN = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")


def pieces(text: bytes) -> list[bytes]:
    """Words, with a line break between pieces: no word holds one."""
    return [w for w in text.lower().translate(_PLAIN).replace(b"\n", b" \n ").split(b" ") if w]


_CODES_ARROW = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("codes", pa.list_(pa.int32())), ("n", pa.int64())])


def _encode(batches):
    """(lang, words, codes, n): code 0 is a break. n counts the words."""
    for b in (part for whole in batches for part in by_bytes(whole, 1, PIECE)):
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in zip(b.column(0).to_pylist(), texts(b.column(1))):
            by_lang.setdefault(lang, [_BREAK]).extend(pieces(text))
            by_lang[lang].append(_BREAK)
        for lang, words in by_lang.items():
            coded = pa.array(words, pa.binary()).dictionary_encode()
            codes = coded.indices
            n = len(codes) - pc.sum(pc.equal(codes, 0)).as_py()
            yield batch(_CODES_ARROW, [lang], [coded.dictionary.cast(pa.string())], pa.ListArray.from_arrays([0, len(codes)], codes), [n])


def encoded(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(_encode, "lang string, words array<string>, codes array<int>, n long"), "word-codes", GROUP_ROWS)


_COUNTS = "lang string, phrase string, c long"
_COUNTS_ARROW = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("c", pa.int64())])


def _rows(batches):
    """(lang, words, codes) of each row; words as a binary array, the first one a break."""
    for b in batches:
        words, codes = b.column(1), b.column(2)
        for i, lang in enumerate(b.column(0).to_pylist()):
            yield lang, words.slice(i, 1).flatten().cast(pa.binary()), codes.slice(i, 1).flatten().to_numpy()


def _count_words(batches):
    for lang, words, codes in _rows(batches):
        n = np.bincount(codes, minlength=len(words))[1:]
        if len(n):
            yield from sliced(batch(_COUNTS_ARROW, pa.repeat(lang, len(n)), words[1:].cast(pa.string()), n))


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


_TURN = np.uint64(0x9E3779B97F4A7C15)


def joined(*hashes: np.ndarray) -> np.ndarray:
    """Hash of the phrase of words of these hashes."""
    out = hashes[0]
    for h in hashes[1:]:
        out = mix64(out * _TURN + h)
    return out


def places(hashes: np.ndarray) -> np.ndarray:
    """Of unsigned hashes, in a bitmap."""
    return (hashes >> np.uint64(64 - PLACE_BITS)).astype(np.int64)


def _has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = places(hashes)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def bitmap(phrases: DataFrame) -> np.ndarray:
    """BITS bits, set at the hashes of (lang, phrase)."""

    def of_phrases(batches):
        for b in batches:
            hashes = [joined(*word_hashes(lang, phrase.encode().split(b" "))[:, None])[0] for lang, phrase in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(places(np.array(hashes, np.uint64)))], names=["at"])

    at = phrases.select("lang", "phrase").mapInArrow(of_phrases, "at long")
    return _bits_of(at)


def _bits_of(at: DataFrame) -> np.ndarray:
    """The bitmap of a column of places: at most BITS / 32768 rows come to the driver, of 4 kB each."""
    blocks = at.select(F.bitmap_bucket_number(F.col("at") + 1).alias("block"), F.bitmap_bit_position(F.col("at") + 1).alias("bit")).groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(BITS // 8, np.uint8)
    for block, bits in blocks.toLocalIterator():
        out[(block - 1) * 4096 : block * 4096] = np.frombuffer(bits, np.uint8)
    return out


def _pair_ranges(frequent, bits: int):
    """Hashes of pairs of frequent words and how often they occur, dealt into ranges."""
    schema = pa.schema([("kind", pa.int32()), ("range", pa.int64()), ("h", pa.list_(pa.int64())), ("c", pa.list_(pa.int64()))])

    def ranges(batches):
        for lang, words, codes in _rows(batches):
            hashes = word_hashes(lang, words.to_pylist())
            good = _has(frequent.value, hashes)
            good[0] = False
            ok = good[codes]
            at = np.flatnonzero(ok[:-1] & ok[1:])
            pair, n = np.unique(codes[at].astype(np.int64) << 32 | codes[at + 1], return_counts=True)
            h = joined(hashes[pair >> 32], hashes[pair & 0xFFFFFFFF])
            yield to_ranges(schema, 0, h, bits, h.view(np.int64), n)

    return ranges


def _frequent_hashes(min_count: int):
    def frequent(batches):
        for _, (h, c) in by_range(batches):
            order = np.argsort(h, kind="stable")
            h, c = h[order], c[order]
            starts = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
            total = np.add.reduceat(c, starts) if len(starts) else np.zeros(0, np.int64)
            at = places(h[starts[total >= min_count]].view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(at)], names=["at"])

    return frequent


def frequent_pairs(codes: DataFrame, frequent: np.ndarray, min_count: int) -> np.ndarray:
    """Bitmap of all pairs that occur min_count times, and of a few more."""
    spark = codes.sparkSession
    bits = range_bits(spark)
    rows = codes.mapInArrow(_pair_ranges(spark.sparkContext.broadcast(frequent), bits), "kind int, range long, h array<long>, c array<long>")
    return _bits_of(rows.repartition("range").sortWithinPartitions("kind", "range").mapInArrow(_frequent_hashes(min_count), "at long"))


def _emit(lang, words, phrases: np.ndarray):
    """Counts of phrases, given by a column of codes for each word."""
    if not phrases.shape[1]:
        return
    order = np.lexsort(phrases[::-1])
    phrases = phrases[:, order]
    starts = np.flatnonzero(np.append(True, (phrases[:, 1:] != phrases[:, :-1]).any(axis=0)))
    counts = np.diff(np.append(starts, phrases.shape[1]))
    text = pc.binary_join_element_wise(*[words.take(pa.array(p[starts])) for p in phrases], pa.scalar(b" ", pa.binary())).cast(pa.string())
    yield from sliced(batch(_COUNTS_ARROW, pa.repeat(lang, len(starts)), text, counts))


def _places(words, codes, hashes, bits):
    """Hashes of the pairs at each place, and which of them may be frequent."""
    h = joined(hashes[codes[:-1]], hashes[codes[1:]]) if len(codes) > 1 else np.zeros(0, np.uint64)
    return h, _has(bits, h) & (codes[:-1] > 0) & (codes[1:] > 0)


def _count_pairs(shared):
    def counts(batches):
        for lang, words, codes in _rows(batches):
            _, ok = _places(words, codes, word_hashes(lang, words.to_pylist()), shared.value)
            at = np.flatnonzero(ok)
            yield from _emit(lang, words, np.stack([codes[at], codes[at + 1]]))

    return counts


def _count_threes(shared):
    def counts(batches):
        pairs, first, last, langs = shared.value
        for lang, words, codes in _rows(batches):
            if lang not in langs:
                continue
            h, ok = _places(words, codes, word_hashes(lang, words.to_pylist()), pairs)
            at = np.flatnonzero(ok[:-1] & ok[1:])
            at = at[_has(first, h[at]) | _has(last, h[at + 1])]
            yield from _emit(lang, words, np.stack([codes[at], codes[at + 1], codes[at + 2]]))

    return counts


def _count_fours(shared):
    def counts(batches):
        pairs, first, last, active, threes, active3, langs = shared.value
        for lang, words, codes in _rows(batches):
            if lang not in langs:
                continue
            hashes = word_hashes(lang, words.to_pylist())
            h, ok = _places(words, codes, hashes, pairs)
            at = np.flatnonzero(ok[:-2] & ok[1:-1] & ok[2:])
            a, b, c = h[at], h[at + 1], h[at + 2]
            left, right = joined(a, hashes[codes[at + 2]]), joined(b, hashes[codes[at + 3]])
            grown_left, grown_right = _has(first, a) | _has(last, b), _has(first, b) | _has(last, c)
            left_3, right_3 = _has(threes, left), _has(threes, right)
            may = (left_3 | ~grown_left) & (right_3 | ~grown_right)
            wanted = (_has(first, a) & _has(last, c)) | _has(active, a) | _has(active, b) | _has(active, c) | _has(active3, left) | _has(active3, right)
            at = at[may & wanted]
            yield from _emit(lang, words, np.stack([codes[at + i] for i in range(4)]))

    return counts


def _share(l: str, r: str):
    """floor(2000000 a / (l + r)) in decimals: products may pass 64 bits."""
    big = lambda x: f"CAST({x} AS DECIMAL(20,0))"
    return F.expr(f"(CAST(2000000 AS DECIMAL(7,0)) * {big('a')}) div ({big(l)} + {big(r)})")


def scored(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score by the cut of the lowest score, the first of them. A candidate one of whose parts has no count is left out."""
    words = F.split("phrase", " ")
    cut = candidates.select("lang", "phrase", F.col("c").alias("a"), words.alias("w")).select("*", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", F.size("w").alias("parts"), F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("rest"))
    known = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("c").alias(n)).hint("merge")
    both = cut.join(known("first", "l"), ["lang", "first"]).join(known("rest", "r"), ["lang", "rest"])
    rows = both.withColumn("score", _share("l", "r"))
    best = rows.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("cut"), F.count("*").alias("cuts"), F.first("parts").alias("parts"))
    return best.where(F.col("cuts") == F.col("parts") - 1).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def _covered(longer: DataFrame) -> DataFrame:
    """lang, phrase, longest: the largest count of a longer candidate around each phrase of two or three words."""
    w = F.split("phrase", " ")
    parts = longer.where(F.size(w) > 2).select("lang", "c", w.alias("w"))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))))
    return parts.select("lang", "c", F.explode(F.array_distinct(spans)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("c").alias("around"))


def scores_at(rows: DataFrame, place: int) -> DataFrame:
    """lang, score: that of the row of this place among a language's rows, best first, where there are so many. What is ranked are the
    different scores, a million for a language at most, not the rows."""
    running = Window.partitionBy("lang").orderBy(F.desc("score"))
    upto = rows.groupBy("lang", "score").agg(F.count("*").alias("rows")).select("lang", "score", F.sum("rows").over(running).alias("upto"))
    return upto.where(F.col("upto") >= place).groupBy("lang").agg(F.max("score").alias("score"))


def ranked(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each language with their rank, of the first of parts of it: no task sorts a whole language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", "part").orderBy(*order)
    first = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top).drop("part", "rank")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, frontier: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of two to four words."""
    spark = docs.sparkSession
    share = lambda *x: spark.sparkContext.broadcast(x if len(x) > 1 else x[0])
    exact = lambda rows: rows.groupBy("lang", "phrase").agg(F.sum("c").alias("c")).where(F.col("c") >= min_count)
    codes = encoded(docs)
    totals = codes.groupBy("lang").agg(F.sum("n").alias("n"))
    one = stored(exact(codes.mapInArrow(_count_words, _COUNTS)), "words")
    pair_bits = frequent_pairs(codes, bitmap(one), min_count)
    two = stored(exact(codes.mapInArrow(_count_pairs(share(pair_bits)), _COUNTS)), "pairs")
    two_scored = stored(scored(two, one.unionByName(two)), "pair-scores")
    pair_bits = bitmap(two)
    open_langs = {lang: None for (lang,) in two.select("lang").distinct().toLocalIterator()}
    wide, done = frontier or FRONTIER * top // TOP, []
    while open_langs:
        mine = two_scored.where(F.col("lang").isin(list(open_langs)))
        level = {lang: 0 for lang in open_langs} | dict(scores_at(mine, wide).collect())
        levels = F.create_map(*[F.lit(x) for pair in level.items() for x in pair])[F.col("lang")]
        pairs = mine.withColumn("level", levels)
        # l and r of a pair are the counts of its words
        first, last, active = (bitmap(pairs.where(x >= F.col("level"))) for x in (_share("l", "a"), _share("a", "r"), F.col("score")))
        langs = frozenset(level)
        three = stored(exact(codes.mapInArrow(_count_threes(share(pair_bits, first, last, langs)), _COUNTS)), "threes")
        three_scored = stored(scored(three, one.unionByName(two).unionByName(three)), "three-scores")
        four = stored(exact(codes.mapInArrow(_count_fours(share(pair_bits, first, last, active, bitmap(three), bitmap(three_scored.where(F.col("score") >= levels)), langs)), _COUNTS)), "fours")
        reached = mine.unionByName(three_scored).unionByName(scored(four, two.unionByName(three).unionByName(four).unionByName(one))).where(F.col("score") >= levels)
        kept = reached.join(_covered(three.unionByName(four)).hint("merge"), ["lang", "phrase"], "left").where("around IS NULL OR CAST(100 AS DECIMAL(3,0)) * CAST(around AS DECIMAL(20,0)) < " + f"CAST({COVERED} AS DECIMAL(3,0)) * CAST(a AS DECIMAL(20,0))")
        kept = stored(kept.drop("around"), "kept")
        alive = dict(kept.groupBy("lang").count().collect())
        settled = [lang for lang, s in level.items() if s == 0 or alive.get(lang, 0) >= top]
        done.append(kept.where(F.col("lang").isin(settled)))
        for lang in settled:
            del open_langs[lang]
        wide *= 8
    if not done:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    best = ranked(functools.reduce(DataFrame.unionByName, done), top)
    return best.join(totals.hint("merge"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
