"""Decisions of values, answers as JSON, agreement of large values: cases with a known answer."""

import re

import pytest
from pyspark.sql import functions as F

from docmill.operators import consensus as C
from docmill.operators import report as R

OBS = "entity string, source string, value double, year int, status string, url string, role string"
P, S = "primary", "secondary"
WOS, MJL, CURATED, CRAWLER, LETPUB = C.PRIORITY


def decide(spark, rows):
    return {r.entity: tuple(r)[1:] for r in C.decide_value(spark.createDataFrame(rows, OBS)).collect()}


def test_rules(spark):
    rows = [
        # 1: the primary first, then who confirms it, by strength
        ("r1", LETPUB, 10.0, 2023, "OK", None, P), ("r1", CRAWLER, 10.4, 2022, "OK", "c", S), ("r1", WOS, 9.9, 2021, "OK", "w", S), ("r1", MJL, 20.0, 2024, "OK", "m", S),
        # 2: authoritative ones agree against the primary
        ("r2", LETPUB, 1.0, 2023, "OK", "l", P), ("r2", MJL, 5.0, 0, "OK", "", S), ("r2", CURATED, 5.5, 2020, "OK", "k", S), ("r2", CRAWLER, 5.0, 2024, "OK", "c", S),
        # 3: only others agree
        ("r3", LETPUB, 1.0, 2023, "OK", "l", P), ("r3", CRAWLER, 5.0, 2024, "OK", "c", S), ("r3", "X", 5.1, 2024, "OK", "x", S), ("r3", WOS, 9.0, 2024, "OK", "w", S),
        # 4: nobody agrees with anybody, or nobody else is there
        ("r4", LETPUB, 1.0, None, "OK", None, P), ("r4", WOS, 5.0, 2024, "OK", "w", S), ("r4b", LETPUB, 1.0, 2022, "OK", "l", P), ("r4b", WOS, 1.0, 2024, "ERROR", "w", S),
        # 5: no primary; the rest comes last
        ("r5", CRAWLER, 3.0, 2020, "OK", "c", S), ("r5", "X", 3.5, 2021, "OK", "x", S), ("r5", WOS, 9.0, 2024, "OK", "w", S),
        # 6: the strongest, or what there is
        ("r6", MJL, 18.9, 2023, "OK", "m", S), ("r6", CRAWLER, 5.0, 2024, "OK", "c", S), ("r6b", MJL, None, None, "NO_ACCESS", None, S), ("r6c", "X", 7.0, 2020, "ERROR", "x", S),
    ]
    assert decide(spark, rows) == {
        "r1": (1, 10.0, "OK_VALIDATED", f"{LETPUB}+{WOS}+{CRAWLER}", "w", 2023),
        "r2": (2, 5.0, "OK_VALIDATED_SECONDARY", f"{MJL}+{CURATED}+{LETPUB}", "k", 2020),
        "r3": (3, 5.0, "OK_VALIDATED_SECONDARY", f"{CRAWLER}+X+{LETPUB}", "c", 2024),
        "r4": (4, 1.0, "OK_PRIMARY_UNCONFIRMED", f"{LETPUB}+{WOS}", "w", 2024),
        "r4b": (4, 1.0, "OK_PRIMARY_ONLY", LETPUB, "l", 2022),
        "r5": (5, 3.0, "OK_SECONDARY_VALIDATED", f"{CRAWLER}+X+{WOS}", "c", 2020),
        "r6": (6, 18.9, "OK", MJL, "m", 2023),
        "r6b": (6, None, "NO_ACCESS", None, None, None),
        "r6c": (6, 7.0, "ERROR", None, None, None),
    }


def test_of_equal_strength_the_latest_year_then_the_largest_value(spark):
    rows = [("a", "AAA", 2.0, 2020, "OK", "", S), ("a", "BBB", 2.3, 2024, "OK", "", S), ("b", "AAA", 2.0, 2024, "OK", "", S), ("b", "BBB", 2.3, 2024, "OK", "", S)]
    got = decide(spark, rows)
    assert got["a"][1] == 2.3 and got["b"][1] == 2.3


def test_sources_count_by_their_whole_names(spark):
    names = [*C.PRIORITY, "WOS", "WOS_JOURNALS_API_2", "letpub", None]
    df = spark.createDataFrame([(n,) for n in names], "s string")
    assert [r.p for r in df.select(C.source_priority(F.col("s")).alias("p")).collect()] == [0, 1, 2, 3, 4, 9, 9, 9, 9]


def test_a_validated_status_stays(spark):
    df = spark.createDataFrame([("OK_VALIDATED", "OK_VALIDATED_SECONDARY"), ("OK_VALIDATED_SECONDARY", "OK_VALIDATED"), ("NO_MATCH", "OK_PRIMARY_ONLY"), ("OK_PRIMARY_ONLY", "ERROR")], "old string, new string")
    status = C.apply_decision(F.lit(1.0), F.lit(2.0), F.col("new"), F.col("old"))[1]
    assert [r[0] for r in df.select(status).collect()] == ["OK_VALIDATED", "OK_VALIDATED_SECONDARY", "OK_PRIMARY_ONLY", "OK_PRIMARY_ONLY"]


def test_agreement_of_large_values(spark):
    df = spark.createDataFrame([("a", 1e40), ("a", 1e40), ("a", 2e40), ("a", 1.0), ("a", 1.6), ("a", float("nan")), ("a", None), ("a", float("inf"))], "entity string, value double")
    assert sorted((r.value, r.agree) for r in C.agreement(df).collect()) == [(1.0, 2), (1.6, 2), (1e40, 2), (1e40, 2), (2e40, 1)]


@pytest.mark.parametrize(
    "answer, expected",
    [
        ('{"k":1}', '{"k":1}'), (' {"k": 1}\n', '{"k":1}'), ('{"k":1} and {"z":2}', None), ('{"k":1} }', None), ('{"k":1}x', '{"k":1}'), ("none", None), ("[1]", None), ("7", None), ("", None), (None, None),
        ('so: {"k":{"a":[1,2]}} .', '{"k":{"a":[1,2]}}'), ('```json\n{bad}\n```\n```\n{"k":2}\n```', '{"k":2}'), ('```json\n{"k":"a } b"}\n```', '{"k":"a } b"}'), ('```\n{"k":1} more\n```', '{"k":1}'), ('```\n{"k":1} {"z":1}\n```', None),
    ],
)
def test_answers_parse_to_their_end(spark, answer, expected):
    df = spark.createDataFrame([(answer,)], "a string")
    assert df.select(R.parse_json_responses("a")).first()[0] == expected
    parsed, refused = R.split_responses(df, "a")
    assert (parsed.count(), refused.count()) == ((1, 0) if expected else (0, 1))


def test_partitions_of_decisions_grow_with_the_input(spark, tmp_path):
    """The partitions that an entity's rows are sorted in are as many as the size of the input asks for, and are not put together again."""
    rows = spark.range(600_000).selectExpr("id AS entity", "md5(string(id)) AS source", "double(id % 50) AS value", "2020 AS year", "'OK' AS status", "sha2(string(id), 256) AS url", "'secondary' AS role")
    rows.write.parquet(str(tmp_path / "o"))
    plan = C.decide_value(spark.read.parquet(str(tmp_path / "o")))._jdf.queryExecution().executedPlan().toString()
    parts = re.search(r"hashpartitioning\(entity#\w+, (\d+)\), REPARTITION_BY_NUM", plan)
    assert parts and int(parts[1]) > 8
