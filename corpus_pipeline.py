"""A corpus pipeline: drop toxic documents, drop frequent lines, keep one of each near-duplicate group, mix the sources, pack.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the columns of
documents; a stage that changes a text sets n_chars to its new length.

What holds for all stages: null and empty texts are texts without words or lines of their own; rows without an id, rows that share an
id and rows that repeat are rows of their own, told apart by their texts; whole texts count, however long; other columns may be null
and have any names; an empty table gives an empty result. What a stage does with them is in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.common import stored
from docmill.llm.lines import drop_lines
from docmill.llm.mixing import mixed_rows
from docmill.llm.packing import harmonic_pack
from docmill.llm.similar import keep_one_of_similar
from docmill.llm.toxicity import without_toxic


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose probability of being toxic is below the operator's REJECT. Null and empty texts stay; each row is judged by its own text."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more hold stay once: in the document of the least id (no id last, then by a hash of the text), at their
    first place. All others go; rows stay, if need be with an empty text. So of a group of ten equal documents or more one stays whole."""
    return _counted(drop_lines(docs, keep_first=True))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of texts whose 5-word shingles have a Jaccard similarity of 0.8 or more: the row of the least id (no id last), then
    of the least hash of its text and of the row. Texts without words are one group; equal rows count once."""
    return keep_one_of_similar(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it whole, and its first words if in part. Rows without words have nothing to take and go; a null
    source is a source of its own."""
    return _counted(mixed_rows(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows; repeated rows are packed each. A text without words is its end id."""
    return harmonic_pack(docs)


STAGES = [("toxicity", toxicity_stage), ("line dedup", line_stage), ("near-duplicates", near_duplicate_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: Tokenizing, hashing and the classifier have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written out and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
