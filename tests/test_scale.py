"""What has to hold at any size: lookups that share a prefix, hot groups, deep JSON, stores that grow, state that expires."""

import json
import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docmill.operators import meta, resolve, runs
from docmill.sources import files as S
from docmill.streaming import streams as T


@pytest.fixture
def apart(spark):
    """Partitions as they are dealt: small ones are not put together."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_contains_lookup_of_names_that_share_a_prefix(spark, apart):
    """1e5 names and 1e4 keys that start alike: what is tested is near the number of true pairs, and no gram is one task's."""
    names = spark.range(100_000, numPartitions=8).select(F.concat(F.lit("the journal of "), F.md5(F.col("id").cast("string"))).alias("name"), "id")
    keys = spark.range(10_000).select(F.concat(F.lit("The Journal of "), F.left(F.md5((F.col("id") * 7).cast("string")), F.lit(8))).alias("key"), F.col("id").alias("ordinal"))
    met = resolve.met_within(keys.select(F.lower("key").alias("s")).distinct(), names.select(F.lower("name").alias("l")))
    n = met.count()
    assert n < 40 * 100_000
    most = met.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 0.02 * n
    got = resolve.lookup_contains(names, "id", "name", keys)
    assert got.count() == 100_000 and got.where("key is not null").count() >= 10_000


def test_contains_lookup_against_all_pairs(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abC") for _ in range(n))
    names = [(i, word(rng.randint(0, 9))) for i in range(150)] + [(200, None), (201, "  ")]
    keys = [(word(rng.randint(1, 6)), i) for i in range(40)] + [("", 99)]
    got = {r.id: (r.key, r.ordinal) for r in resolve.lookup_contains(spark.createDataFrame(names, "id long, n string"), "id", "n", spark.createDataFrame(keys, "key string, ordinal long")).collect()}
    for i, n in names:
        low = (n or "").lower()
        met = [(low != k.lower(), o, k) for k, o in keys if low.strip() and k and (k.lower() in low or low in k.lower())]
        assert got[i] == ((min(met)[2], min(met)[1]) if met else (None, None)), n


@pytest.mark.parametrize("hot", [True, False])
def test_running_sums_of_hot_groups(spark, hot):
    rng = random.Random(2)
    rows = [(None if rng.random() < 0.1 else "hot" if hot or rng.random() < 0.4 else f"g{rng.randint(0, 5)}", i, rng.randint(0, 9)) for i in range(4000)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "g string, i long, v long")
    got = {r.i: r.before for r in runs.running_before(df, ["g"], ["i"], F.col("v")).collect()}
    sums = {}
    for g, i, v in rows:
        assert got[i] == sums.get(g, 0)
        sums[g] = sums.get(g, 0) + v
    chunks = {r.i: r.chunk for r in runs.chunk(df, 7, "i").collect()}
    assert chunks == {i: i // 7 for i in range(4000)}
    budget = runs.running_budget(df, ["g"], ["i"], F.col("v"), 100)
    assert {r.i for r in budget.collect()} == {i for i in got if got[i] < 100} and budget.columns == df.columns
    assert runs.running_before(df.limit(0), ["g"], ["i"], F.col("v")).count() == 0


def test_one_source_is_many_tasks(spark, apart):
    df = spark.range(100_000).select(F.lit("one").alias("source"), "id")
    out = runs.chunk(df, 10, "id", within="source")
    per_task = [r[1] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert out.agg(F.max("chunk")).first()[0] == 9_999 and len(per_task) > 100 and max(per_task) < 3_000


def plain_json_best(text):
    try:
        value = json.loads(text)
    except (ValueError, RecursionError, TypeError):
        return None
    names, hits, todo = ("journalimpactfactor", "impactfactor", "jif", "jifvalue"), [], [value]
    while todo:
        x = todo.pop()
        todo += x if isinstance(x, list) else x.values() if isinstance(x, dict) else []
        if not isinstance(x, dict):
            continue
        beside = str(next((x[k] for k in meta.YEAR_KEYS if x.get(k) and not isinstance(x[k], (list, dict))), ""))
        beside = int(beside) if re.fullmatch(r"\s*[0-9]+\s*", beside) and 2000 <= int(beside) <= 2100 else None
        for k, v in x.items():
            k = k.lower()
            if isinstance(v, (dict, list)) or not (k in names or k.startswith("jif") or "impactfactor" in k):
                continue
            number = re.search(r"[0-9]+(?:\.[0-9]+)?", str(v))
            if number and 0.1 <= float(number.group()) <= 200:
                named = None if k in names else re.search("20[0-9]{2}", k)
                hits.append((int(named.group()) if named else beside, float(number.group())))
    return max(hits, key=lambda h: (h[0] or 0, h[1])) if hits else None


def test_json_search_against_a_walk(spark):
    rng = random.Random(3)
    keys = ["jif", "JIF2021", "jif2023", "impactFactor", "myImpactFactorX", "year", "reportYear", "citationReportYear", "a", "b", 'q"{']
    leaf = lambda: rng.choice([1.5, 20, 300, "7.5", "x 9.9 y", "2022", 2021, 2023, None, True, "}{][", 'a"jif":5', "", 0])

    def tree(depth):
        if depth == 0 or rng.random() < 0.2:
            return leaf()
        if rng.random() < 0.3:
            return [tree(depth - 1) for _ in range(rng.randint(0, 3))]
        return {k: tree(depth - 1) for k in rng.sample(keys, rng.randint(0, 4))}

    texts = [json.dumps(tree(5), indent=rng.choice([None, 1])) for _ in range(400)] + ["", "no", None, '{"jif": 5', '{"jif": 5} x', '{"jif": 5}{"jif": 6}', '{"jif": 5}', '[{"jif": 5}]', '{"profile": {"jif2020": "3.5"}}']
    texts += ["[" * 100_000 + '{"jif": 5}' + "]" * 100_000, '{"a":' * 500 + '{"jif": 5}' + "}" * 500, '{"jif": 5, "t": "' + "x" * 1_000_000 + '"}']
    df = spark.createDataFrame(list(enumerate(texts)), "i long, j string").repartition(8)
    found = meta.json_value_search(df, "i", "j")
    assert "MapInArrow" not in plan_of(found) and "Python" not in plan_of(found)
    got = {r.i: (r.year, r.value) for r in found.collect()}
    deep = len(texts) - 3
    assert deep not in got
    for i, t in enumerate(texts):
        if i != deep:
            assert got.get(i) == plain_json_best(t), t[:300] if t else t


def test_a_batch_reads_the_folders_of_its_own_fingerprints(spark, tmp_path):
    """As the store grows a hundredfold, a batch of a few fingerprints reads as many files as before."""
    schema = F.struct(F.lit(1).alias("n"))
    files = []
    for size in (200, 20_000):
        rows = spark.range(size).select(F.md5(F.col("id").cast("string")).alias("fingerprint"), schema["n"].alias("n"))
        store = S.ResultStore(spark, str(tmp_path / f"raw{size}"), rows.select("n").schema, prefix=2)
        for part in rows.randomSplit([0.5, 0.5], 1):
            store.append(part)
        store = store.compacted(str(tmp_path / f"compact{size}"))
        few = spark.range(3).select(F.md5(F.col("id").cast("string")).alias("fingerprint"))
        keys = store.keys(few)
        assert keys.count() < store.keys().count() and keys.join(few, "fingerprint", "left_semi").count() == 3
        keys.collect()
        files.append(len({r[0] for r in store.rows(few).select(F.col("fingerprint"), F.input_file_name().alias("f")).select("f").distinct().collect()}))
        assert store.read().count() == size
    assert files == [3, 3]


def test_expired_values_leave_the_state(spark, tmp_path):
    start = datetime(2024, 1, 1)
    batches = [[("a", start, 1), ("b", start + timedelta(minutes=1), 2)], [("a", start + timedelta(minutes=5), 3)], [("c", start + timedelta(hours=3), 4)], [("c", start + timedelta(hours=3, minutes=1), 5)]]
    schema = "k string, ts timestamp, v int"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ended = T.expired_stream(T.stream_table(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema), "k", "ts", 600)
        query = ended.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination()
        held = [p["stateOperators"][0]["numRowsTotal"] for p in map(lambda p: json.loads(p.json), query.recentProgress) if p["stateOperators"]]
    out = spark.read.schema(ended.schema).parquet(str(tmp_path / "out"))
    assert sorted((r.k, r.v, r.expired_at, r.n) for r in out.collect()) == [("a", 3, start + timedelta(minutes=15), 2), ("b", 2, start + timedelta(minutes=11), 1)]
    assert held[-1] == 1
    table = spark.createDataFrame([r for b in batches for r in b], schema)
    assert sorted(r.k for r in T.expired_stream(table, "k", "ts", 600).collect()) == ["a", "b", "c"]


CSV = 'h1,h2,h3\r\n"a\nb, ""c""",2,x"y\r\n\r\nd,,"say ""hi"" \n\n there"\r\n  e ,"","f"g\n'


@pytest.mark.parametrize("large, odd", [(1 << 20, 'x"y'), (0, "xy")])
def test_csv_cells_keep_their_line_breaks(spark, tmp_path, large, odd):
    """Read by lines, quotes have to be balanced."""
    (tmp_path / "t.csv").write_text(CSV.replace('x"y', odd), newline="")
    got = [(r.pos, r.header, r.cells) for r in S.read_tables_csv(spark, str(tmp_path), large).orderBy("pos").collect()]
    head = ["h1", "h2", "h3"]
    assert got == [(1, head, ['a\nb, "c"', "2", odd]), (2, head, ["d", "", 'say "hi" \n\n there']), (3, head, ["e", "", "fg"])]


def test_a_large_csv_is_read_by_several_tasks(spark, tmp_path):
    rows = [f'{i},"line {i}\n""more"" of it, {"x" * (i % 50)}",{i * i}' for i in range(20_000)]
    (tmp_path / "big.csv").write_text("a,b,c\n" + "\n".join(rows) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
        got = {r.pos: r.cells for r in S.read_tables_csv(spark, str(tmp_path), 0).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 20_000
    assert all(got[i + 1] == [str(i), f'line {i}\n"more" of it, {"x" * (i % 50)}', str(i * i)] for i in range(20_000))


def test_results_are_written_by_value(spark, tmp_path):
    S.write_json(spark.createDataFrame([(1, 2.0), (2, None), (3, 9.0), (4, 5.0)], "i long, v double"), str(tmp_path / "r"), by="v")
    said = "".join(p.read_text() for p in sorted((tmp_path / "r").glob("part-*")))
    assert re.findall(r'"i":(\d)', said) == ["3", "4", "1", "2"]


def test_needed_words_are_needed():
    """Whatever matches a pattern holds one of the words: made from the patterns' own alternatives, in other cases too."""
    from docmill.functions.rules import PACKS, needed_words

    assert needed_words((r"(?i)EQE[^0-9]*?([0-9]+)\s*%", r"(?:ITO|Glass)/x")) == {"eqe", "ito", "glass"}
    assert needed_words((r"[Vv]ersion ([0-9]+)",)) == {"version "} and needed_words(("([0-9]+)", "abc")) is None
    assert needed_words((r"(?:ab)?cd(?:ef|gh)+x",)) in ({"cd"}, {"ef", "gh"}) and needed_words((r"a|bc",)) is None and needed_words(()) is None
    said = ["Max EQE: 12.5 %", "LIMIT OF DETECTION was 3 nM", "FF of 70 %", "ff 70%", "Voc = 1.1 V", "capacity of 900 mAh/g", "12 cd/A", "3.5 LM/W", "Glass/ITO/PEDOT:PSS/Al", "all Rights reserved", "version 3", "CC BY-SA 4.0", "QLED-1", "Sample B", "sensitivity 5 μA/mM", "90 % after 500 cycles", "5 Wh/kg", "coulombic efficiency 99 %", "Jsc 20 mA/cm2", "response time 3 s"]
    hits = 0
    for pack in PACKS.values():
        for patterns in [m.patterns for m in pack.metrics.values()] + [pack.labels]:
            words = needed_words(patterns)
            for text in said + [s.upper() for s in said] + [s.lower() for s in said]:
                if words is not None and any(re.search(p, text) for p in patterns):
                    hits += 1
                    assert any(w in text.lower() for w in words), (patterns, text)
    assert hits > 40


def test_blocks_stay_in_the_row_of_their_document(spark):
    """No exchange in the longest chain, documents that share an id stay apart, and a text of many lines takes no square of time."""
    from docmill.functions.lexicons import DEVICE_LEXICON
    from docmill.operators import blocks as B

    text = "# A\n\none EQE 3%\n\n| a | b |\n| - | - |\n| 1 | 2 |\n\n## B\n\n- x\n- y\n\n"
    df = spark.createDataFrame([(1, text), (1, text), (2, None), (3, ""), (4, text * 2_000)], "doc_id long, text string")
    outline = B.anchor_tables(B.heading_path(B.outlines(df)))[0]
    kept = B.trim_to_budget(B.select_with_neighbours(B.score_blocks(outline, DEVICE_LEXICON), 1, 3.0), 80, 24_000)
    out = B.compose_condensed(kept)
    assert "Exchange" not in plan_of(out)
    rows = {}
    for r in out.collect():
        rows.setdefault(r.doc_id, []).append(r.condensed)
    assert sorted(rows) == [1, 4] and len(rows[1]) == 2 and rows[1][0] == rows[1][1] and "[TABLE_0001]" in rows[1][0] and len(rows[4][0]) <= 24_000
    counts = {r.doc_id: r["count"] for r in B.exploded(outline).groupBy("doc_id").count().collect()}
    assert counts == {1: 10, 4: 10_000}


def test_text_store_in_bundles(spark, tmp_path):
    """Most texts stand in few files; a text counts by its name, whether it is a file or in a bundle."""
    (tmp_path / "files").mkdir()
    for name, said in (("a.text.md", "new"), ("b.md", "old"), ("c.md", "only"), ("d.txt", "other")):
        (tmp_path / "files" / name).write_text(said)
    bundled = [("a.md", "old"), ("b.text.md", "new"), ("e.md", "kept"), ("f.txt", "other")] + [(f"n{i}.md", f"text {i}") for i in range(1000)]
    S.write_text_bundles(spark.createDataFrame(bundled, "name string, text string"), f"{tmp_path}/bundles")
    got = S.read_text_store(spark, f"{tmp_path}/files", bundles=f"{tmp_path}/bundles").rdd.collectAsMap()
    assert got == {"a": "new", "b": "new", "c": "only", "e": "kept"} | {f"n{i}": f"text {i}" for i in range(1000)}


def test_text_store_query_writes_few_files(spark, tmp_path):
    """1,000 suppliers and 1,667 texts are not as many files; none at all make an empty store."""
    from pathlib import Path

    from docmill.plans import catalog

    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(Path(folder).rglob("*"))
    assert catalog.QUERIES["s2_read_text_store"](spark, "/root/testdata/sf0.1").count() == 1000
    assert sum(p.suffix in (".txt", ".parquet") for p in set(Path(folder).rglob("*")) - before) < 100
    spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").limit(0).write.parquet(f"{tmp_path}/supplier.parquet")
    assert catalog.QUERIES["s2_read_text_store"](spark, str(tmp_path)).count() == 0


def test_patterns_are_sought_by_pieces(spark):
    """What is found from a pattern's first word on is what a search of the whole text finds: words across the border of two pieces, what stands before them longer
    than a piece, characters that grow in lower case."""
    from docmill.functions.rules import PACKS
    from docmill.operators import mentions

    bits = ["Max EQE: 12.5 % ", "LOD was 3 nM ", "FF of 70 % ", "900 mAh/g ", "12.5 cd/A ", "Glass/ITO/PEDOT:PSS/Al/Ag ", "CC BY-SA 4.0 ", "\u0130\U0001f600", "mail a.b@c.de ", "90 % after 500 cycles ", "CIE (0.3, 0.4) ", "linear range 0.5 - 7 mM "]
    rng, texts = random.Random(5), ["", "12" + " " * 3000 + "mAh/g", "x" * 1020 + "EQE 5 %", "5" + " " * 2500 + "mAh/g 7 mAh/g", "\u0130" * 1100 + " 12 cd/A", "a" * 1500 + "@b.de"]
    for _ in range(20):
        texts.append("".join(rng.choice(bits) if rng.random() < 0.3 else "y" * rng.randrange(1, 700) + " " for _ in range(rng.randrange(12))))
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(1)
    patterns = sorted({p for pack in PACKS.values() for m in pack.metrics.values() for p in m.patterns})
    plain = [F.regexp_extract_all("text", F.lit(p), F.lit(0)) for p in patterns]
    pieces = mentions.within_pieces(F.col("text"), lambda sought: F.array(*[F.coalesce(F.regexp_extract_all(sought(p), F.lit(p), F.lit(0)), F.array().cast("array<string>")) for p in patterns]))
    rows = df.select(F.array(*plain).alias("a"), pieces.alias("b")).collect()
    assert sum(len(x) for r in rows for x in r.a) > 60
    for r in rows:
        for p, x, y in zip(patterns, r.a, r.b):
            assert x == y, p


def test_a_long_word_is_not_tried_at_each_of_its_characters(spark):
    """300,000 letters without the sign of an address, once as a sentence and once as a whole text."""
    import time

    from docmill.functions.rules import CORPUS
    from docmill.operators import mentions

    docs = spark.createDataFrame([(1, "a number 5. " + "ab" * 150_000)], "doc_id long, text string")
    began = time.time()
    rows = mentions.document_fallback_record(docs, mentions.candidate_records(docs, CORPUS), CORPUS).collect()
    assert [r.number for r in rows] == ["5.00"] and time.time() - began < 30


def test_fallback_records_shuffle_no_text(spark):
    from docmill.functions.rules import CORPUS
    from docmill.operators import mentions

    docs = spark.createDataFrame([(1, "Version 3 of it."), (2, "none"), (3, "mail to a@b.cd, then"), (None, "Version 4")], "doc_id long, text string")
    rows = mentions.document_fallback_record(docs, mentions.candidate_records(docs, CORPUS).where("version is not null"), CORPUS)
    assert "Join" not in plan_of(rows) and sorted((str(r.doc_id), r.version, r.address) for r in rows.collect()) == [("1", "3.0", None), ("3", None, "a@b.cd"), ("None", "4.0", None), ("None", "4.0", None)]
