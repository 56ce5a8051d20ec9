"""The pipeline stage by stage against plain versions of its decisions, and the operators' SQL."""

import numpy as np
import pytest
from compare import check, connect

import corpus_pipeline
from docmill.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    check(queries.QUERIES[name](spark, SF), connect(SF), queries.SQL[name])


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    kept = docs
    for label, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in kept.select("doc_id").collect()}
        kept = stage(spark, kept, SF).cache()
        assert kept.columns == names, label
        assert {r.doc_id for r in kept.select("doc_id").collect()} <= before, label
    # a dozen toxic labels teach nothing that chance could not: the next larger tables have some fifty
    larger = "/root/testdata/sf0.01"
    toxic = {r.doc_id for r in spark.read.parquet(f"{larger}/labels.parquet").where("toxic = 1").collect()}
    clean = {r.doc_id for r in spark.read.parquet(f"{larger}/labels.parquet").where("toxic = 0").collect()}
    first = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{larger}/documents.parquet"), larger).collect()}
    assert len(toxic & first) <= 0.3 * len(toxic) and len(clean - first) <= 0.02 * len(clean) + 1
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in kept.collect()}


def test_run(spark):
    a, b = (sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "start", "length", "ids_crc32").collect())) for _ in range(2))
    assert a == b and a


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)] * 2 + [(2, "", "en", "a", 0)]])
def test_odd_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_groups(texts):
    """Least index of each text's group, over all pairs with a 5-word Jaccard similarity of 0.8 or more."""
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if label[i] != label[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def test_near_duplicate_stage_finds_similar_texts(spark):
    rng = np.random.default_rng(3)
    texts = []
    for group in range(12):
        base = [f"g{group}w{i}" for i in range(400)]
        texts.append(" ".join(base))
        for changed in (4, 8, 12, 16, 30, 60):
            copy = list(base)
            for i in rng.choice(400, changed, replace=False):
                copy[i] = f"c{changed}x{i}"
            texts.append(" ".join(copy))
    # a chain whose ends are unlike, short texts, case and spaces, and texts without words
    texts += [" ".join(f"chain{i}" for i in range(k, k + 200)) for k in range(0, 200, 20)]
    texts += ["a b", "A  b", "a b c", "", None, " \n", "x y z u v w", "x y z u v q"]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect())
    assert kept == sorted(set(plain_groups(texts)))


def test_near_duplicate_stage_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    expected = {rows[i][0] for i in plain_groups([t for _, t in rows])}
    assert {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()} == expected
