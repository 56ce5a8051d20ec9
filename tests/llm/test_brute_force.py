"""Each corpus operator against a plain version of its contract, on awkward small tables and on the smallest test tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docmill.llm import hilbert, licenses, toxicity as tox
from docmill.llm.hilbert import hilbert_key, nearest
from docmill.llm.licenses import license_scan
from docmill.llm.lines import drop_lines, line_dedup_digest
from docmill.llm.maxscore import maxscore_top_k
from docmill.llm.mixing import mix_sources, mixed_rows
from docmill.llm.packing import cut_lengths, harmonic_pack
from docmill.llm.ring import overflow_plan, shard_rows
from docmill.llm.simhash import VantageTree, distance, keep_one_of_each, near_duplicates, shard_forest
from docmill.llm.substring import substring_dedup_digest

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 997}x{i}" for i in range(60_000))
PASSAGE = " ".join(f"shared{i}" for i in range(40))


def awkward():
    """Null and empty texts and sources, ties, repeated rows and ids, hot groups, a very long text; extra columns whose names clash."""
    rows = [(1, "", "a"), (2, None, "b"), (3, " \n\t ", None), (None, "no id " + PASSAGE, "a"), (4, LONG, "c"), (5, "É straße ＷＩＤＥ one　two", "b")]
    rows += [(6, "same row", "a")] * 3 + [(7, "one text", "a"), (7, "another text", "b")]
    rows += [(10 + i, "hot line\nHOT LINE \n" + f"own {i} " + (PASSAGE if i % 2 else "") + " tail", "hot") for i in range(30)]
    rows += [(100 + i, "copied " + PASSAGE + " end", "hot") for i in range(20)] + [(200, "Released under CC BY-NC 4.0. All rights reserved, cc by cc by", "z")]
    return [(*r, 1, "x", "y") for r in rows]


@pytest.fixture(scope="module", params=["awkward", "sf0.001", "empty"])
def docs(request, spark):
    if request.param == "sf0.001":
        return spark.read.parquet(f"{SF}/documents.parquet")
    rows = awkward() if request.param == "awkward" else []
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, shard string, rid string").repartition(3).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, (r.text or "").encode(), r.source) for r in docs.collect()]


def counted(df):
    return Counter(map(tuple, df.collect()))


def test_lines(docs, rows):
    holders = defaultdict(set)
    for n, (_, text, _) in enumerate(rows):
        for line in text.split(b"\n"):
            holders[line.strip(b" \t\n\r\x0b\f").lower()].add(n)
    expected = Counter()
    for d, text, _ in rows:
        lines = text.split(b"\n")
        kept = [x for x in lines if not x.strip() or len(holders[x.strip().lower()]) < 10]
        expected[(d, len(lines), len(lines) - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest())] += 1
    assert counted(line_dedup_digest(docs)) == expected


def test_lines_keep_columns(docs):
    out = drop_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.where("lower(text) like '%hot line%'").count() == 0


def without_repeats(rows, min_docs):
    """(id, text less all but the first of each line in min_docs rows or more) of rows (id, text); rows of one id and text are as one."""
    holders, firsts = defaultdict(set), {}
    place = lambda d, t: (d is None, d or 0, stable_hash(t))
    for n, (d, text) in enumerate(rows):
        for pos, line in enumerate(text.split(b"\n")):
            if key := line.strip(b" \t\n\r\x0b\f").lower():
                holders[key].add(n)
                at = (*place(d, text), text, pos)
                firsts[key] = min(firsts.get(key, at), at)
    out = Counter()
    for d, text in rows:
        kept = []
        for pos, line in enumerate(text.split(b"\n")):
            key = line.strip(b" \t\n\r\x0b\f").lower()
            if not key or len(holders[key]) < min_docs or firsts[key] == (*place(d, text), text, pos):
                kept.append(line)
        out[(d, b"\n".join(kept))] += 1
    return out


def stable_hash(text):
    return xxhash.xxh64_intdigest(text, 42) - (1 << 64) * (xxhash.xxh64_intdigest(text, 42) >> 63)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_lines_that_keep_their_first(spark, docs, rows, parts):
    """Whatever the batches: settled in one, met across several, or both."""
    expected = without_repeats([(d, t) for d, t, _ in rows if d is not None], 10)
    out = drop_lines(docs.where("doc_id is not null").repartition(parts), keep_first=True)
    assert Counter((r.doc_id, (r.text or "").encode()) for r in out.collect()) == expected


def test_copies_of_a_text_keep_one(spark):
    rows = [(i, f"alpha {i % 2}\nbeta\nbeta") for i in range(60)] + [(7, "alpha 1\nbeta\nbeta")] * 3 + [(None, "beta")] * 30
    for parts in (1, 7):
        out = drop_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), keep_first=True)
        assert Counter(map(tuple, out.where("text != ''").collect())) == Counter([(0, "alpha 0\nbeta"), (1, "alpha 1")])


def test_substrings(docs, rows):
    big = 2**63 - 1
    first = {}
    words = [(big if d is None else d, WORD.findall(t)) for d, t, _ in rows]
    for d, w in words:
        for i in range(len(w) - 12):
            k = b" ".join(w[i : i + 13])
            first[k] = min(first.get(k, big), d)
    expected = Counter()
    for (d, _, _), (n, w) in zip(rows, words):
        gone = {j for i in range(len(w) - 12) if first[b" ".join(w[i : i + 13])] < n for j in range(i, i + 13)}
        expected[(d, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest())] += 1
    assert counted(substring_dedup_digest(docs)) == expected


def plain_fingerprint(text):
    w = WORD.findall(text.lower())
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates(docs, rows):
    prints = [plain_fingerprint(t) for _, t, _ in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if bin(prints[i] ^ prints[j]).count("1") <= 2 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    least = {}
    for (d, _, _), l in zip(rows, label):
        least[l] = min((x for x in (least.get(l), d) if x is not None), default=None)
    expected = Counter((d, f"{p:016x}", least[l]) for (d, _, _), p, l in zip(rows, prints, label))
    assert counted(near_duplicates(docs)) == expected
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {v for v in least.values()}


def test_one_row_of_each_component(spark):
    words = lambda at: " ".join(f"w{at}x{i}" for i in range(60))
    # two unlike texts without an id, a repeated id with unlike texts of which one is a copy of a smaller id, and a copy without id
    rows = [(None, words(1)), (None, words(2)), (3, words(3)), (7, words(3)), (7, words(4)), (None, words(4)), (8, words(5)), (8, words(5)), (9, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expected = Counter([(None, words(1)), (None, words(2)), (3, words(3)), (7, words(4)), (8, words(5)), (9, None)])
    assert counted(keep_one_of_each(docs)) == expected


def test_vantage_shards_are_even():
    """No shard above twice its bound on points without structure, few copies, and a ball of near copies stays whole without end."""
    x = np.random.default_rng(4).integers(0, 2**64, 400_000, dtype=np.uint64)
    index, shard = VantageTree(x[: 1 << 16], 2, 1600 * (1 << 16) // len(x)).route(x)
    assert np.unique(shard, return_counts=True)[1].max() <= 3200 and len(index) <= 8.5 * len(x)
    ball = x[0] ^ np.unique(np.uint64(1) << np.arange(64, dtype=np.uint64))
    index, shard = VantageTree(ball, 2, 16).route(ball)
    assert set(index) == set(range(64))


@pytest.mark.parametrize("most", [10_000, 40, 6])
def test_vantage_tree_loses_no_pair(most):
    rng = np.random.default_rng(most)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    x = np.unique(np.concatenate([base, base ^ np.uint64(1 << 5), base ^ np.uint64((1 << 60) | 1), base ^ np.uint64(7)]))
    index, shard = VantageTree(x[::7], 2, most).route(x)
    assert most > len(x) or len(np.unique(shard)) > 3
    assert set(index) == set(range(len(x)))
    label = np.arange(len(x))
    for s in np.unique(shard):
        own = index[shard == s]
        root = shard_forest(x[own], 2)
        for a, b in zip(own, own[root]):
            while label[a] != label[b]:
                label[label == max(label[a], label[b])] = min(label[a], label[b])
    i, j = np.nonzero(distance(x[:, None], x[None, :]) <= 2)
    assert (label[i] == label[j]).all()


def test_mixing(docs, rows):
    got = mix_sources(docs).collect()
    again = mix_sources(docs.repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    size = Counter()
    for d, t, s in rows:
        size[s] += len(WORD.findall(t))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target = {s: 0.0 for s in order}
    total, left, open_ = sum(size.values()), sum(size.values()), set(order)
    while open_ and left > 1e-9:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if target[s] + level * weight[s] >= 3 * size[s] - 1e-9}
        for s in full:
            left -= 3 * size[s] - target[s]
            target[s] = 3.0 * size[s]
        if not full:
            for s in open_:
                target[s] += level * weight[s]
            left = 0
        open_ -= full
    by = {(r.doc_id, r["size"]): r for r in got}
    for d, t, s in rows:
        r = by[(d, len(WORD.findall(t)))]
        assert r.source_size in size.values() and abs(sum(target.values()) - total) < 1e-6
        assert r.taken <= 3 * r["size"]
    per = defaultdict(lambda: [0, 0.0])
    for r in got:
        per[(r.source_size, r.target)][0] += r.taken
    for (n, goal), (taken, _) in per.items():
        same = [s for s in order if size[s] == n and abs(target[s] - goal) < 1e-6]
        assert same and abs(taken - goal * len(same)) <= len(same)


def test_mixed_rows(docs):
    out = mixed_rows(docs)
    assert out.columns == docs.columns
    words = lambda df: sum(len(WORD.findall((r.text or "").encode())) for r in df.collect())
    assert words(out) == sum(r.taken for r in mix_sources(docs).collect())


def test_packing(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = harmonic_pack(docs).collect()
    ids = {}
    for d, text, _ in rows:
        x = np.array(t.encode(text.decode(), add_special_tokens=False).ids + [1], "<u4")
        ids.setdefault(d, []).append(x)
    expected = Counter((d, len(x)) for d, xs in ids.items() for x in xs)
    covered = Counter()
    for p in pieces:
        assert any(len(x) == p.doc_tokens and zlib.crc32(x[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for x in ids[p.doc_id])
        covered[(p.doc_id, p.doc_tokens)] += p.length
    assert covered == Counter({k: k[1] * n for k, n in expected.items()})
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    padding = 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 0.02 * sum(len(x) for xs in ids.values() for x in xs) + 2 * 2048


def test_cut_lengths():
    for n in range(1, 5000, 7):
        parts = cut_lengths(n, 2048, 64)
        assert sum(parts) == n and all(p == 2048 // (2048 // p) for p in parts if p >= 64)


def test_ring(docs, rows):
    got = shard_rows(docs).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((d, len(t) + 1, zlib.crc32(t)) for d, t, _ in rows)
    shards = defaultdict(list)
    for r in got:
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < 16
        shards[r.shard].append(r.slot)
    sizes = [len(shards[s]) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in shards.values())


def test_overflow_moves_clockwise():
    owners = [c * 4 // 64 for c in range(64)]
    plan = overflow_plan({3: 90, 40: 10}, owners, 4)
    moved = Counter()
    for cell, low, high, shard, _ in plan:
        moved[(cell, shard)] += high - low
    assert moved == {(3, 0): 25, (3, 1): 25, (3, 2): 15, (3, 3): 25, (40, 2): 10}


def test_licenses(docs, rows):
    got = {}
    for r in license_scan(docs).collect():
        got.setdefault((r.doc_id, r.n_words), []).append(r)
    for d, t, _ in rows:
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
        starts, labels = [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.encode().split()
            hits = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            starts += hits
            labels |= {label} if hits else set()
        r = got[(d, len(w))][0]
        assert (r.n_base, r.first_word, r.last_word, r.base_labels) == (len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1


@pytest.mark.parametrize(
    "said, expected",
    [
        ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
        ("Released under the MIT License.", "mit"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
        ("GNU Lesser General Public License v2.1 or later", "gpl,lgpl-2.1-or-later"),
        ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"),
        ("Copyright 2020. All rights reserved.", "copyright,reserved"),
        ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"),
        ("dedicated to the public domain", "public-domain"),
        ("plain words", ""),
    ],
)
def test_license_rules(said, expected):
    assert licenses.Scanner(licenses.rules()).scan(said.encode())[5] == expected


def test_hundreds_of_rules():
    assert len(licenses.rules()) >= 300


@pytest.fixture(scope="module", params=["awkward", "sf0.001", "empty"])
def vectors(request, spark):
    if request.param == "sf0.001":
        return spark.read.parquet(f"{SF}/embeddings.parquet")
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8).round(2)], 0) for i in range(0, 220)] + [(300 + i, [0.5, -0.25] + [0.0] * 6, 1) for i in range(150)]
    rows += [(1000, None, 0), (1100, [None] * 8, 0), (1200, [float("nan")] * 8, 0), (1300, [float("inf")] + [0.0] * 7, 0), (1400, [0.0] * 8, 0), (None, [1.0] * 8, 0), (1500, [], 0), (1600, [0.25, 0.5], 0), (40, [9.0] * 8, 0), (3, [0.1] * 8, 3)]
    return spark.createDataFrame(rows if request.param == "awkward" else [], "vec_id long, embedding array<float>, rank int").repartition(4)


def usable_rows(vectors):
    """(id, components) of each row that takes part."""
    return [(r.vec_id, r.embedding) for r in vectors.collect() if r.vec_id is not None and r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding)]


def best_rows(rows, k, every):
    """Answers of each query row, by plain products; rows that share id and weights ask once."""
    weights = [(d, [int(np.floor(256.0 * x)) for x in v]) for d, v in rows]
    expected, asked = Counter(), set()
    for i, (q, w) in enumerate(weights):
        if q % every == 0 and (q, *w) not in asked:
            asked.add((q, *w))
            scores = sorted((-sum(a * b for a, b in zip(w, v)), d) for j, (d, v) in enumerate(weights) if j != i)[:k]
            expected.update((q, n + 1, d, -x) for n, (x, d) in enumerate(scores))
    return expected


def test_top_k(vectors):
    expected = best_rows(usable_rows(vectors), 5, 50)
    assert counted(maxscore_top_k(vectors).drop("query_row")) == expected
    assert counted(maxscore_top_k(vectors, shard_rows=40, query_rows=3).drop("query_row")) == expected


def test_top_k_of_rows_that_share_an_id(spark):
    """Every row is a candidate for all but itself, also its equals and other rows of its id; a third of all rows share an id."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(200)] + [(100, rng.normal(size=6).tolist()) for _ in range(100)]
    rows += [(50, [0.9] * 6)] * 12 + [(51, [0.9] * 6)] * 3 + [(150, [0.5] * 4), (150, [0.5] * 9)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    found = maxscore_top_k(vectors, shard_rows=60, query_rows=20)
    assert counted(found.drop("query_row")) == best_rows(rows, 5, 50)
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "SortMergeJoin" not in plan


def nearest_of_rows(rows, k=20, query_every=20):
    """(query_id, scores best first) of every query row, by brute force over rows (vec_id, vector); missing places count as 0."""
    rows = [(i, v) for i, v in rows if any(v)]
    best = [(q, sorted((sum(a * b for a, b in zip(x, y)) for o, (_, y) in enumerate(rows) if o != n), reverse=True)[:k]) for n, (q, x) in enumerate(rows) if q % query_every == 0]
    return sorted(best)


def scores_of_rows(found):
    got = defaultdict(list)
    for r in found.orderBy("query_row", "rank").collect():
        assert r["rank"] == len(got[r.query_id, r.query_row]) + 1
        got[r.query_id, r.query_row].append((r.score, -r.vec_id))
    assert all(own == sorted(own, reverse=True) for own in got.values())
    return sorted((q, [s for s, _ in own]) for (q, _), own in got.items())


def test_nearest(vectors):
    expected, got = nearest_of_rows(usable_rows(vectors)), scores_of_rows(nearest(vectors))
    assert [q for q, _ in got] == [q for q, own in expected if own]
    # the whole table is within one window here, so nothing may be missed
    for (_, own), (_, scores) in zip(got, expected):
        assert np.allclose(own, scores, atol=1e-9)


def test_nearest_of_rows_that_share_an_id(spark):
    """Every row is a candidate for all but itself, also its equals and other rows of its id; a third of all rows share an id."""
    rng = np.random.default_rng(12)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(120)] + [(40, rng.normal(size=6).tolist()) for _ in range(70)]
    rows += [(60, [0.9] * 6)] * 3 + [(61, [0.9] * 6)] * 4 + [(80, [0.5] * 4), (80, [0.5] * 9)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got, expected = scores_of_rows(nearest(vectors)), nearest_of_rows(rows)
    assert [q for q, _ in got] == [q for q, _ in expected] and len(got) == 6 + 70 + 3 + 2
    # equal ids are ordered by their scores on both sides, up to rounding
    for (_, own), (_, scores) in zip(got, expected):
        assert np.allclose(own, scores, atol=1e-9)


def test_no_more_is_met_than_two_curves_hold(spark):
    """On vectors without structure the measured plan meets at most twice the table for each query, as two curves in full would."""
    x = np.random.default_rng(4).normal(size=(3000, 48))
    rows = spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(x)], "vec_id long, row long, x array<double>").repartition(4)
    fit = hilbert.Curves(x[:500], 8, 6, 5, 11)
    windows = hilbert.curve_windows(rows, fit, 64).cache()
    last = windows.agg(F.max("window")).first()[0]
    curves, reach = hilbert.measured_reach(rows, windows, 8, last, 20, 20)
    assert 2 <= curves <= 8 and reach >= 1
    met = {}
    for r in windows.where((F.col("row") % 20 == 0) & (F.col("curve") < curves)).collect():
        met[r.row] = met.get(r.row, 0) + min(r.window + reach, last) - max(r.window - reach, 0) + 1
    assert np.mean(list(met.values())) <= 2 * (last + 1)


def test_nearest_recall_with_small_windows(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    found = {r.vec_id: np.array(r.embedding) for r in vectors.collect()}
    ids = np.array(list(found))
    x = np.array(list(found.values()))
    got = defaultdict(set)
    for r in nearest(vectors, curves=12, window=48).collect():
        got[r.query_id].add(r.vec_id)
    recall = [len(got[q] & set(ids[np.argsort(np.where(ids == q, 9, -(x @ found[q])))[:20]])) / 20 for q in got]
    assert np.mean(recall) > 0.7 and len(got) == 25


def test_nearest_recall_far_above_the_windows(spark):
    x = np.random.default_rng(8).normal(size=(5000, 32)).astype(np.float32)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = defaultdict(set)
    # three windows hold a fiftieth of the table
    for r in nearest(vectors, window=32).collect():
        got[r.query_id].add(r.vec_id)
    score = x[::20].astype(float) @ x.T.astype(float)
    score[np.arange(250), np.arange(250) * 20] = -np.inf
    best = np.argsort(-score, axis=1)[:, :20]
    assert np.mean([len(got[20 * q] & set(own.tolist())) / 20 for q, own in enumerate(best)]) >= 0.9


def test_hilbert_neighbours_touch():
    side = np.array(np.meshgrid(*[np.arange(8)] * 3, indexing="ij")).reshape(3, -1).T
    path = side[np.argsort(hilbert_key(side, 3))]
    assert len(set(hilbert_key(side, 3).tolist())) == 512
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    train, held = labels.where("doc_id % 4 > 0"), labels.where("doc_id % 4 = 0")
    got = tox.toxicity(docs, train).join(held.withColumnRenamed("toxic", "truth"), "doc_id").collect()
    caught = [r.toxic for r in got if r.truth]
    accused = [r.toxic for r in got if not r.truth]
    # the table has some 300 toxic labels to learn from, in four languages
    assert np.mean(caught) > 0.8 and np.mean(accused) < 0.02
    assert np.mean([r.severity for r in got if r.truth]) > np.mean([r.severity for r in got if not r.truth]) + 0.8


def test_toxicity_awkward(docs, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert tox.toxicity(docs, none).where("toxic or severity > 0").count() == 0
    odd = spark.createDataFrame([(1, None), (None, 1), (99999, 1), (7, 1), (7, 0), (10, 0)], "doc_id long, toxic int")
    assert tox.toxicity(docs, odd).count() == docs.count()
    assert tox.without_toxic(docs, none).columns == docs.columns


def test_ordinal_gradient_and_likelihood():
    rng = np.random.default_rng(1)
    grades, score, t = rng.integers(0, 4, 50), rng.normal(size=50), np.array([-0.7, 0.1, 1.4])
    p = lambda s, b: np.diff([0, *(1 / (1 + np.exp(-(b - s)))), 1])
    plain = lambda s, b: -np.mean([np.log(p(x, b)[g]) for x, g in zip(s, grades)])
    loss, by_score, by_threshold = tox.ordinal_loss(score, t, grades)
    assert abs(loss - plain(score, t)) < 1e-9
    for i in range(50):
        e = np.eye(50)[i] * 1e-6
        assert abs((plain(score + e, t) - plain(score - e, t)) / 2e-6 - by_score[i]) < 1e-6
    for k in range(3):
        e = np.eye(3)[k] * 1e-6
        assert abs((plain(score, t + e) - plain(score, t - e)) / 2e-6 - by_threshold[k]) < 1e-6


def test_ordinal_fit_against_plain_descent():
    rng = np.random.default_rng(2)
    x = (rng.random((300, 5)) < 0.4).astype(float)
    truth = np.array([2.0, -1.0, 0.5, 0.0, 1.0])
    grades = (x @ truth + rng.logistic(size=300) > np.array([[0.0], [1.0], [2.5]])).sum(axis=0)
    rows, cols = np.nonzero(x)
    w, t = tox.fit_ordinal(rows, cols, grades, 5, 4, l1=0.0, steps=2000)
    v, b = np.zeros(5), np.array([0.0, 1.0, 2.0])
    for _ in range(20000):
        _, by_score, by_threshold = tox.ordinal_loss(x @ v, b, grades)
        v, b = v - 0.5 * x.T @ by_score, b - 0.5 * by_threshold
    assert np.allclose(w, v, atol=1e-3) and np.allclose(t, b, atol=1e-3)


def test_ordinal_thresholds_rise():
    rng = np.random.default_rng(0)
    grades = rng.integers(0, 4, 400)
    rows = np.repeat(np.arange(400), grades + 1)
    cols = np.concatenate([np.arange(g + 1) for g in grades])
    w, t = tox.fit_ordinal(rows, cols, grades, 4, 4)
    score = np.bincount(rows, weights=w[cols], minlength=400)
    guess = (score[:, None] >= t[None, :]).sum(axis=1)
    assert (np.diff(t) >= 0).all() and np.mean(guess == grades) > 0.95
