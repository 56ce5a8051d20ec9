"""Odd tables for every operator and stage: clashing names, null and shared ids, long texts, hot groups, hash collisions, shuffled input."""

import hashlib
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docmill.llm import common, hilbert, licenses, maxscore, mixing, packing, queries, ring, simhash, substring
from docmill.llm.lines import drop_lines, line_dedup_digest
from docmill.llm.mixing import mixed_rows
from docmill.llm.similar import likely
from docmill.llm.substring import repeated_spans, substring_dedup_digest

SF = "/root/testdata/sf0.001"
CLASHING = ("a.b", "__rid", "__row", "__text", "rid", "kind", "root", "bucket", "size", "th", "n words", "a.b.c")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(name, n=60):
    return " ".join(f"{name}x{i}" for i in range(n))


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(None, words("a")), (None, words("b")), (3, words("c")), (7, words("c")), (7, words("d")), (None, words("d")), (8, None), (9, ""), (9, ""), (10, words("long", 30_000))]
    rows += [(20 + i, f"frequent line\nown {i} " + words(f"o{i}", 20)) for i in range(12)]
    docs = spark.createDataFrame([(*r, "en", ["s", None, "t"][i % 3], 5) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)]).repartition(4)


@pytest.mark.parametrize("label, stage", corpus_pipeline.STAGES, ids=[s[0] for s in corpus_pipeline.STAGES])
def test_stages_keep_clashing_columns(spark, clashing, label, stage):
    out = stage(spark, clashing, SF)
    rows = out.collect()
    assert rows
    if label != "packing":
        assert out.columns == clashing.columns
        assert all(tuple(r)[5:] == tuple(range(len(CLASHING))) for r in rows)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n[:3] not in ("op1", "op6", "pip") or n.startswith("op10")])
def test_operators_meet_clashing_columns(clashing, name, spark, tmp_path):
    clashing.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    rows = queries.QUERIES[name](spark, str(tmp_path)).collect()
    assert len(rows) >= clashing.count()


def test_keys_tell_rows_without_ids_apart_when_a_hash_collides(spark, monkeypatch):
    docs = spark.createDataFrame([(None, words("a", 30) + " " + words("x", 20)), (None, words("b", 30)), (1, words("a", 30))], "doc_id long, text string")
    expected = Counter(map(tuple, substring_dedup_digest(docs).collect()))
    lines = Counter(map(tuple, line_dedup_digest(docs, min_docs=1).collect()))
    honest = common.row_key

    def colliding():
        no, rid, _ = honest()
        return [no, rid, F.lit(5).cast("long").alias("__th")]

    monkeypatch.setattr(common, "row_key", colliding)
    assert Counter(map(tuple, substring_dedup_digest(docs).collect())) == expected
    assert Counter(map(tuple, line_dedup_digest(docs, min_docs=1).collect())) == lines


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_duplicates_keep_texts_in_any_order(spark, seed):
    rows = [(7, words("a")), (7, words("b")), (3, words("b")), (9, words("a")), (None, words("c")), (None, words("a")), (None, words("d")), (5, words("d")), (None, None), (2, "")]
    order = np.random.default_rng(seed).permutation(len(rows))
    docs = spark.createDataFrame([rows[i] for i in order], "doc_id long, text string").repartition(3)
    kept = Counter(map(tuple, corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()))
    assert kept == Counter([(7, words("a")), (3, words("b")), (None, words("c")), (5, words("d")), (2, "")])


def test_near_duplicates_of_a_large_group(spark):
    """Copies at all distances from one text: every link of the bands counts, and unlike ones stay."""
    rng = np.random.default_rng(4)
    base, texts = [f"b{i}" for i in range(150)], []
    for n in range(240):
        copy = list(base)
        for i in rng.choice(150, int(rng.integers(1, 30)), replace=False):
            copy[i] = f"c{n}x{i}"
        texts.append(" ".join(copy))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(146)} for t in texts]
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if label[i] != label[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()) == sorted(set(label))
    assert 1 < len(set(label)) < len(label)


def test_sketches_never_pass_over_similar_sets():
    rng = np.random.default_rng(6)
    for n in (0, 1, 5, 900, 1500, 6000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        near, far = np.unique(np.append(a[: int(0.95 * len(a))], rng.integers(0, 2**63, n // 20, dtype=np.uint64))), np.unique(rng.integers(0, 2**63, n + 3, dtype=np.uint64))
        ok = likely(a[:1024], [x[:1024] for x in (near, far)], len(a), np.array([len(near), len(far)]), 80)
        assert ok[0] == (n not in (1, 5) or len(near) == len(a)) or len(a) <= 5
        assert not ok[1]


def plain_substrings(rows, window=13):
    big, first = 2**63, {}
    split = [(big if d is None else d, WORD.findall((t or "").encode())) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, big), d)
    out = Counter()
    for (d, _), (n, w) in zip(rows, split):
        gone = {j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < n for j in range(i, i + window)}
        out[(d, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest())] += 1
    return out


def tangled(seed, n=160):
    """Texts over few words, so that seeds repeat with other surroundings, and passages of all lengths that many share."""
    rng = np.random.default_rng(seed)
    passages = [[f"p{k}w{i}" for i in range(int(rng.integers(5, 60)))] for k in range(12)]
    rows = []
    for d in range(n):
        w = []
        for _ in range(int(rng.integers(1, 8))):
            kind = rng.integers(0, 3)
            if kind == 0:
                w += [f"v{x}" for x in rng.integers(0, 3, int(rng.integers(1, 30)))]
            else:
                p = passages[int(rng.integers(0, len(passages)))]
                lo = int(rng.integers(0, len(p)))
                w += p[lo : lo + int(rng.integers(1, 60))]
        rows.append((None if d % 37 == 5 else d // 2 if d % 11 == 0 else d, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("batch, frequent", [(24 << 20, 0.001), (2000, 0.001), (2000, 0.9)])
def test_substrings_with_short_and_long_prefixes(spark, monkeypatch, seed, batch, frequent):
    monkeypatch.setattr(substring, "_BYTES_AT_ONCE", batch)
    monkeypatch.setattr(substring, "FREQUENT", frequent)
    rows = tangled(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert Counter(map(tuple, substring_dedup_digest(docs).collect())) == plain_substrings(rows)


def test_spans_joined_are_maximal_repeats(spark):
    one, two = words("a", 50), words("b", 40)
    rows = [(1, f"{one} {two}"), (2, f"start {one} middle {two} end"), (3, " ".join(one.split()[5:30]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in repeated_spans(docs).collect():
        joined = []
        for s in sorted(r.spans):
            first, last = s >> 32, (s & 0xFFFFFFFF) + 13
            if joined and first <= joined[-1][1] - 12:
                joined[-1][1] = max(last, joined[-1][1])
            else:
                joined.append([first, last])
        got[r["__rid"]] = joined
    assert got == {2: [[1, 51], [52, 92]], 3: [[0, 25]]}


def test_prefixes_hold_no_hot_group(spark, monkeypatch):
    """A seed in all documents, each with its own surroundings, is dealt by whole windows."""
    docs = spark.createDataFrame([(i, f"{words(f'l{i}', 20)} the same five words here {words(f'r{i}', 20)}") for i in range(400)], "doc_id long, text string")
    monkeypatch.setattr(substring, "SEED", 5)
    hot = substring.frequent_seeds(common.keyed(docs), 13)
    rows = common.keyed(docs).select(*common.KEY, "text").repartition(2).mapInArrow(substring._leaf_rows(13, 12, hot), substring._LEAVES)
    most = rows.select("kind", "range", F.size("seed").alias("n")).groupBy("kind", "range").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0]
    assert most < 60


def test_maxscore_reads_fewer_postings_than_all():
    rng = np.random.default_rng(1)
    d = np.floor(256 * rng.normal(size=(9000, 64)) / 8).astype(np.int64)
    q = d[:200]
    top, ids = maxscore.TopK(200, 5), np.arange(9000)
    first = maxscore.search(maxscore.Postings(ids[:4500], d[:4500].T), ids[:200], q, top)
    second = maxscore.search(maxscore.Postings(ids[4500:], d[4500:].T), ids[:200], q, top)
    assert second < first and first + second < 0.97 * 200 * 9000 * 64
    score = q @ d.T
    score[np.arange(200), np.arange(200)] = -(2**60)
    assert (np.sort(score, axis=1)[:, ::-1][:, :5] == top.scores).all()


def test_maxscore_on_sparse_weights_skips_most():
    rng = np.random.default_rng(2)
    d = np.where(rng.random((4000, 64)) < 0.05, rng.integers(1, 300, (4000, 64)), 0)
    q = np.zeros((50, 64), np.int64)
    for row in q:
        row[rng.choice(64, 6, replace=False)] = [500, 100, 20, 5, 2, 1]
    top = maxscore.TopK(50, 3)
    read = maxscore.search(maxscore.Postings(np.arange(4000), d.T), np.full(50, -1), q, top)
    assert (np.sort(q @ d.T, axis=1)[:, ::-1][:, :3] == top.scores).all()
    assert read < 0.6 * 50 * 4000 * 64


def test_top_k_of_large_weights_is_exact(spark):
    rows = [(i, [float(2**22 + i * 3 % 7), float(i % 5) - 2.0, 1e4]) for i in range(120)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    w = {i: [int(np.floor(256.0 * x)) for x in v] for i, v in rows}
    expected = set()
    for q in (0, 50, 100):
        best = sorted((-sum(a * b for a, b in zip(w[q], w[d])), d) for d in w if d != q)[:5]
        expected |= {(q, i + 1, d, -s) for i, (s, d) in enumerate(best)}
    assert {tuple(r) for r in maxscore.maxscore_top_k(vectors, shard_rows=50).drop("query_row").collect()} == expected


@pytest.mark.parametrize("short", ["mit 0", "ipl 1.0", "ecl 1.0", "efl 2", "spl 1.0"])
def test_short_license_names_need_a_license_word(short):
    scan = licenses.Scanner(licenses.rules()).scan
    assert scan(f"the final score was {short} in the end".encode())[5:] == ("", 0.0)
    label = short.replace(" ", "-")
    for said in (f"it is licensed under the {short} as a whole", f"see the {short} license for more", f"spdx license identifier {short}"):
        assert label in scan(said.encode())[5].split(","), said


def test_license_scan_of_long_texts_takes_linear_time():
    scanner, one = licenses.Scanner(licenses.rules()), b"this is free and unencumbered software released into the public domain "
    took = []
    for n in (2000, 8000):
        began = time.perf_counter()
        assert scanner.scan(one * n)[5] == "unlicense"
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0] + 0.5


@pytest.mark.parametrize("said", ["It runs on PHP 3.0 and Elastic 2.0.", "We met at a public place; the domain was sold.", "a general idea of public life", "copy right now", "the bar was open to all, rights were not"])
def test_license_rules_leave_plain_sentences_alone(said):
    n_words, n_base, *_, labels, score = licenses.Scanner(licenses.rules()).scan(said.encode())
    assert (n_base, labels, score) == (0, "", 0.0)


def test_suppression_against_all_pairs():
    rng = np.random.default_rng(3)
    pool = ["gnu lesser general public license version 2.1", "general public license", "cc by nc 4.0", "all rights reserved", "apache license version 2.0", "mit license", "filler", "of", "public domain", "in the public domain", "copyright 2020"]
    scanner = licenses.Scanner(licenses.rules())
    for _ in range(60):
        text = " ".join(rng.choice(pool, 12)).encode()
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
        joined = b" " + b" ".join(w) + b" "
        found = []
        for order, (rule, pattern, _) in enumerate(scanner.rules):
            for m in pattern.finditer(joined):
                first = joined[: m.start()].count(b" ") - 1
                found.append((-rule.priority, -(m.end() - m.start()), first, order, first + 1 + m.group().count(b" "), rule.label, rule.confidence))
        kept = []
        for d in sorted(found):
            if not any(a <= d[2] and d[4] <= b for a, b, _, _ in kept):
                kept.append((d[2], d[4], d[5], d[6]))
        base = {label for phrase, label in licenses.BASE.items() if f" {phrase} ".encode() in joined}
        got = scanner.scan(text)
        assert got[5] == ",".join(sorted(base | {k[2] for k in kept}))
        assert got[6] == max([0.5 * bool(base), *(k[3] for k in kept)], default=0.0)


def test_ranks_and_tokenizer_agree_on_every_word(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain, fast = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.tokenizer_words("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
    seen = {w for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").limit(4000).collect() for w in (r.text or "").split(" ")}
    vocabulary = {plain.decode([i]) for i in range(plain.get_vocab_size())}
    texts = sorted({" " + w.strip() for w in seen | vocabulary if w.strip() and len(w) < 62 and max(w) < "ɐ" and "<|" not in w})
    assert len(texts) > 40_000
    for text, e in zip(texts, plain.encode_batch(texts, add_special_tokens=False)):
        assert fast.ranks.encode_ordinary(text) == e.ids, text


def test_few_rows_move_when_a_shard_is_added(spark):
    docs = spark.createDataFrame([(i, words(f"d{i}", 5)) for i in range(4000)], "doc_id long, text string")
    before, after = ({r.doc_id: r.shard for r in ring.shard_rows(docs, shards=n).collect()} for n in (16, 17))
    moved = np.mean([before[d] != after[d] for d in before])
    # a 17th must move; the lower bound of all others pushes some more along the ring, a plain hash would move 16/17
    assert 1 / 17 - 0.01 <= moved < 0.15


def test_ring_spreads_a_text_without_ids(spark):
    docs = spark.createDataFrame([(None, "same")] * 300 + [(i, f"t{i}") for i in range(100)], "doc_id long, text string").repartition(3)
    got = ring.shard_rows(docs).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == 400 and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))


def test_mixing_agrees_between_reruns_on_equal_ids(spark):
    rows = [(None if i % 2 else 5, words(f"w{i}", 1 + i % 3), "a" if i % 3 else "b") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [Counter(map(tuple, mixed_rows(docs.repartition(n)).collect())) for n in (1, 4, 7)]
    assert runs[0] == runs[1] == runs[2]


def test_lines_of_a_text_column_that_is_null_stay_null(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x\ny")], "doc_id long, text string")
    assert Counter(map(tuple, drop_lines(docs, min_docs=1).collect())) == Counter([(1, None), (2, ""), (None, "")])


def test_reach_follows_the_data(spark):
    """On vectors that lie near a plane a query meets few windows, and recall holds."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(6000, 3)) @ rng.normal(size=(3, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = defaultdict(set)
    for r in hilbert.nearest(vectors, window=64).collect():
        got[r.query_id].add(r.vec_id)
    score = x[::20] @ x.T
    score[np.arange(300), np.arange(300) * 20] = -np.inf
    best = np.argsort(-score, axis=1)[:, :20]
    assert np.mean([len(got[20 * q] & set(own.tolist())) / 20 for q, own in enumerate(best)]) >= 0.9


def test_unlike_texts_of_one_hash_stay(spark):
    """Rows whose first hashes are made equal: of each text one row stays, that of the least id; joined to a root only one of the texts is."""
    rows = [(3, "one text"), (1, "one text"), (2, "another text"), (7, "another text"), (5, None), (6, ""), (9, "of its own"), (None, "another text")]
    keyed = simhash.row_keyed(spark.createDataFrame(rows, "doc_id long, text string"))
    shared = keyed.withColumn("__th", F.when(F.col("__row.text") == "of its own", F.lit(2)).otherwise(F.lit(1)).cast("long"))
    none = spark.createDataFrame([], "__th long, root long")
    assert sorted(r.doc_id for r in simhash.least_rows(shared, none).collect()) == [1, 2, 5, 9]
    kept = sorted(r.doc_id for r in simhash.least_rows(shared, spark.createDataFrame([(1, 1), (2, 1)], "__th long, root long")).collect())
    assert len(kept) == 3 and set(kept) < {1, 2, 5, 9}
    assert sorted(r.doc_id for r in simhash.least_rows(keyed, none).collect()) == [1, 2, 5, 9]


def test_targets_of_many_sources_match_the_loop(spark):
    rng = np.random.default_rng(5)
    sizes = {f"s{i:03d}": int(rng.integers(0, 400)) for i in range(200)}
    table = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(table).collect()}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    target, left, open_ = dict.fromkeys(sizes, 0.0), float(sum(sizes.values())), set(sizes)
    while left > 1e-6 and open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if target[s] + level * weight[s] >= 3 * sizes[s]}
        for s in full or open_:
            add = 3 * sizes[s] - target[s] if full else level * weight[s]
            target[s] += add
            left -= add
        open_ -= full
    assert all(abs(got[s] - target[s]) < 1e-3 for s in sizes)
