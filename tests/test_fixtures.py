"""The operators on hand-written tables whose results are known."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions import rules, text
from docmill.functions.lexicons import DEVICE_LEXICON, NOISE_TITLES
from docmill.operators import blocks as B
from docmill.operators import consensus, meta, mentions, quality, records, report, resolve, runs
from docmill.sources import files

PAPER = """# Abstract

The device achieved a maximum EQE of 20.5%.

# Results and Discussion

The champion device uses ITO/PEDOT:PSS/EML/TPBi/LiF/Al.

| Device | EQE |
| --- | --- |
| A | 20.5% |

Figure 1 The device shows stable emission.

# References

1. prior work with EQE 10%."""

RECORDS = """Device A used the structure ITO/PEDOT:PSS/QDs/ZnO/Al and achieved an EQE of 12.5%.

The champion device used ITO/PEDOT:PSS/QDs/ZnMgO/Al with a maximum EQE of 18.9% and CIE (0.63, 0.36).

Control device showed LT50 = 120 h."""


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first().y


def paper_blocks(spark, value=PAPER):
    return B.heading_path(B.split_blocks(spark.createDataFrame([(1, value)], "doc_id long, text string")))


def test_condense(spark):
    b = B.cut_tail_noise(paper_blocks(spark), NOISE_TITLES)
    b, anchors = B.anchor_tables(b)
    assert [a.anchor for a in anchors.collect()] == ["TABLE_0001"]
    kept = B.trim_to_budget(B.select_with_neighbours(B.score_blocks(b, DEVICE_LEXICON), 1, 3.0, NOISE_TITLES), 20, 8000)
    out = B.compose_condensed(kept, 8000).first().condensed
    assert "[TABLE_0001]" in out and "20.5%" in out and "ITO/PEDOT" in out and "References" not in out


def test_block_types_and_paths(spark):
    rows = paper_blocks(spark).orderBy("idx").collect()
    assert [r.type for r in rows] == ["heading", "paragraph", "heading", "paragraph", "table", "figure_caption", "heading", "list"]
    assert rows[4].path == ["Results and Discussion"] and rows[0].path == ["Abstract"]


def test_noise_titles_are_anchored(spark):
    out = B.cut_tail_noise(paper_blocks(spark, "# Preferences\n\na\n\n# Reference device\n\nb"), ("references",))
    assert out.count() == 4


@pytest.mark.parametrize("seed", range(3))
def test_budget_equals_greedy_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(d, i, "x" * rng.randint(1, 40), rng.randint(0, 4) / 2, rng.random() < 0.3) for d in range(40) for i in range(rng.randint(1, 15))]
    df = spark.createDataFrame(rows, "doc_id int, idx int, text string, score double, mandatory boolean")
    got = {(r.doc_id, r.idx) for r in B.trim_to_budget(df, 6, 120).collect()}
    expected = set()
    for d in range(40):
        own = [r for r in rows if r[0] == d]
        for r in sorted((r for r in own if not r[4]), key=lambda r: (r[3], len(r[2]), r[1])):
            if len(own) > 6 or sum(len(x[2]) + 2 for x in own) > 120:
                own.remove(r)
            else:
                break
        expected |= {(r[0], r[1]) for r in own}
    assert got == expected


def test_records(spark):
    docs = spark.createDataFrame([(1, RECORDS), (2, "nothing"), (3, None)], "doc_id long, text string")
    clean = mentions.sanitize_records(mentions.candidate_records(docs, rules.OLED), rules.OLED).cache()
    found = clean.orderBy("rank").collect()
    assert len(found) >= 2 and {r.doc_id for r in found} == {1}
    assert {"12.50%", "18.90%"} <= {r.eqe for r in found} and "(0.6300, 0.3600)" in {r.cie for r in found}
    best = records.best_record(clean, "doc_id", text.first_number("eqe"), "rank").first()
    assert best.eqe == "18.90%"


def test_evidence(spark):
    docs = spark.createDataFrame([(1, "impact factor: 12.3. The EQE was 20.5 % here. CIE (0.21, 0.32) and T50 150 h were seen.")], "doc_id long, text string")
    assert {r.metric for r in mentions.evidence_sentences(docs, rules.OLED).collect()} == {"eqe", "cie", "lifetime"}
    assert docs.select(meta.value_from_head(F.col("text")).alias("v")).first().v == 12.3


def test_pack_schema():
    rules.register_pack("tiny", rules.RulePack({"n": rules.Metric((r"([0-9]+)",))}, {"n": 1}))
    assert rules.pack_schema("tiny").names == ["label", "n", "notes"]
    assert "eqe" in rules.pack_schema("oled").names


@pytest.mark.parametrize("raw, expected", [("14764660", "1476-4660"), ("2041-172X", "2041-172X"), ("1476-466", None), ("abcd-efgh", None), (None, None)])
def test_issn(spark, raw, expected):
    assert one(spark, raw, text.normalize_issn) == expected


def test_titles(spark):
    assert one(spark, "Research & Development Letters", text.canonical_title) == one(spark, "Research and Development Letters", text.canonical_title)
    assert one(spark, "Nature-Materials", text.canonical_title) == "nature materials"


def test_issn_candidates(spark):
    c = one(spark, "Print ISSN 2041-1723 and Online ISSN 2041-1731", meta.issn_candidates)
    assert (c.issn, c.eissn) == ("2041-1723", "2041-1731")


@pytest.mark.parametrize("raw, expected", [("Advanced Materials 2024.36:2404480", "Advanced Materials"), ("Chem. Mater. 2023.35:822-836", "Chemistry of Materials"), ("no such name", None)])
def test_names(spark, raw, expected):
    aliases = spark.createDataFrame([("advanced materials", "Advanced Materials"), ("chem mater", "Chemistry of Materials")], "alias string, name string")
    assert meta.normalize_name(spark.createDataFrame([(raw,)], "x string"), "x", aliases).first()["name"] == expected


def test_resolution(spark):
    dim = spark.createDataFrame([(1, "Journal A", "11111111", None), (2, "Twin", None, None), (3, "Twin", None, None), (4, "Other", None, "22222222")], "j long, title string, issn string, eissn string")
    ours = spark.createDataFrame([(1, "zzz", None, "2222-2222"), (2, "Journal A", "9999-9999", None), (3, "Twin", None, None), (4, "none", None, None)], "id long, title string, issn string, eissn string")
    keys = [resolve.match_keys(d, k, F.col("title"), F.col("issn"), F.col("eissn")) for d, k in ((ours, "id"), (dim, "j"))]
    got = {r.id: (r.status, r.method, r.n_candidates) for r in resolve.resolve_entities(*keys, ours, "id", "j").collect()}
    assert got == {1: ("OK", "eissn", 1), 2: ("OK", "exact_title", 1), 3: ("MULTI_MATCH", "exact_title", 2), 4: ("NO_MATCH", None, 0)}


def test_decisions(spark):
    obs = "entity string, source string, value double, year int, status string, url string, role string"
    rows = [
        ("1", "LETPUB", 10.0, 2023, "OK", None, "primary"), ("1", "MJL", 10.6, 2023, "OK", None, "secondary"),
        ("2", "LETPUB", 10.0, 2023, "OK", None, "primary"), ("2", "WOS", 5.0, 2023, "OK", None, "secondary"), ("2", "MJL", 5.1, 2023, "OK", None, "secondary"),
        ("3", "LETPUB", 10.0, 2023, "OK", None, "primary"), ("3", "CRAWLER", 5.0, 2023, "OK", None, "secondary"), ("3", "BLOG", 5.1, 2023, "OK", None, "secondary"),
        ("4", "LETPUB", 10.0, 2023, "OK", None, "primary"), ("4b", "LETPUB", 10.0, 2023, "OK", None, "primary"), ("4b", "MJL", 1.0, 2023, "OK", None, "secondary"),
        ("5", "WOS", 7.0, 2023, "OK", None, "secondary"), ("5", "BLOG", 7.1, 2023, "OK", None, "secondary"),
        ("6", "MJL", 18.9, 2023, "OK", None, "secondary"), ("6b", "MJL", None, None, "NO_ACCESS", None, "secondary"),
    ]
    strength = {"WOS": 0, "MJL": 1, "CURATED": 2, "CRAWLER": 3, "LETPUB": 4}
    got = {r.entity: (r.rule, r.value, r.status) for r in consensus.decide_value(spark.createDataFrame(rows, obs), priority=strength).collect()}
    assert got == {
        "1": (1, 10.0, "OK_VALIDATED"), "2": (2, 5.0, "OK_VALIDATED_SECONDARY"), "3": (3, 5.0, "OK_VALIDATED_SECONDARY"), "4": (4, 10.0, "OK_PRIMARY_ONLY"), "4b": (4, 10.0, "OK_PRIMARY_UNCONFIRMED"),
        "5": (5, 7.0, "OK_SECONDARY_VALIDATED"), "6": (6, 18.9, "OK"), "6b": (6, None, "NO_ACCESS"),
    }


ITEMS = [("OLED efficiency study", 2024, 15.0), ("Perovskite solar cells", 2023, 20.0), ("Battery materials", 2022, 50.0), ("OLED device optimization", 2024, 30.0)]


@pytest.mark.parametrize("words, numbers, n", [({"title": "OLED"}, {}, 2), ({}, {"year": "2023-2024"}, 3), ({}, {"impact": ">20"}, 2), ({}, {"impact": ">=20"}, 3), ({"title": "OLED"}, {"year": "2024"}, 2), ({"title": " "}, {"year": "soon"}, 4)])
def test_facets(spark, words, numbers, n):
    items = spark.createDataFrame(ITEMS, "title string, year int, impact double")
    assert items.where(text.facet_filter(words, numbers)).count() == n


def test_json_values(spark):
    rows = [(1, '{"journalProfile":{"metrics":{"jcr":{"citationReportYear":2024,"jif":50.5}}}}'), (2, '{"journalProfile":{"indicators":{"jif2024":"49.9","jif2023":"47.1"}}}'), (3, '{"a": 1}')]
    got = {r.id: (r.year, r.value) for r in meta.json_value_search(spark.createDataFrame(rows, "id long, j string"), "id", "j").collect()}
    assert got == {1: (2024, 50.5), 2: (2024, 49.9)}


@pytest.mark.parametrize("raw, expected", [('{"k": 1}', '{"k":1}'), ('a\n```json\n{"k": 2}\n```', '{"k":2}'), ('so {"k": 3} it is', '{"k":3}'), ("none", None)])
def test_responses(spark, raw, expected):
    assert one(spark, raw, report.parse_json_responses) == expected


@pytest.mark.parametrize("raw, expected", [("plain text, quite fine. " * 9, False), ("�" * 100, True), ("��", False), ("", True), (None, True)])
def test_garbled(spark, raw, expected):
    assert one(spark, raw, text.is_garbled) == expected


def test_files(spark):
    rows = [(f"f{i:03}.pdf", 10) for i in range(60)] + [("x.txt", 1), ("big.pdf", 200 * 1024 * 1024), ("A.PDF", 5)]
    fine, bad = files.admit_files(spark.createDataFrame(rows, "name string, size long"), "name", "size")
    assert fine.count() == 50 and fine.where("name = 'A.PDF'").count() == 1
    assert bad.groupBy("reject_reason").count().rdd.collectAsMap() == {"type": 1, "size": 1, "count": 11}


def test_feedback(spark):
    schema = T.StructType.fromDDL("id string, ts timestamp, file string, changes array<struct<field:string,original:string,modified:string>>")
    from datetime import datetime

    rows = [("1", datetime(2024, 5, 1), "a", [("title", "", "x"), ("journal", "", "y")]), ("2", datetime(2024, 5, 2), "b", [("title", "", "z")])]
    by_field, whole = runs.feedback_stats(spark.createDataFrame(rows, schema), "changes", "ts", "file", F.lit("2024-05-03").cast("timestamp"))
    assert by_field.rdd.collectAsMap() == {"title": 2, "journal": 1}
    assert tuple(whole.first()) == (2, 2, 2)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert B.compose_condensed(B.split_blocks(none)).count() == 0
    assert mentions.candidate_records(none, rules.OLED).count() == 0
    assert quality.noisy_ratio(none, "text").first().records == 0
    assert consensus.decide_value(spark.createDataFrame([], "entity string, source string, value double, year int, status string, url string, role string")).count() == 0


def test_text_store(spark, tmp_path):
    for name, said in (("a.text.md", "new"), ("a.md", "old"), ("b.md", "only")):
        (tmp_path / name).write_text(said)
    assert files.read_text_store(spark, str(tmp_path)).rdd.collectAsMap() == {"a": "new", "b": "only"}


def test_csv_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text('h1,h2\n"a,""b""",2\nc,\n')
    got = files.read_tables_csv(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.caption, r.header, r.cells) for r in got] == [("t", ["h1", "h2"], ['a,"b"', "2"]), ("t", ["h1", "h2"], ["c", ""])]
