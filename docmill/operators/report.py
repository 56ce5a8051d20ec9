"""Reports: one shape for results and errors, sorting, prompts out and answers in, validation, status texts."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.text import blank_to_null, col, squeeze


def union_results_errors(results: DataFrame, errors: DataFrame) -> DataFrame:
    """Success and error rows in one shape, missing columns null."""
    return results.unionByName(errors, allowMissingColumns=True)


def sort_report(df: DataFrame, value: str, *ties: str) -> DataFrame:
    """O1: largest value first, missing counts as 0."""
    return df.orderBy(F.coalesce(F.col(value), F.lit(0.0)).desc(), *ties)


def sort_table(df: DataFrame, column: str, descending: bool = False, *ties: str) -> DataFrame:
    """O2: numbers ascending with nulls last or descending with nulls first; texts by lower case, null as ''."""
    if isinstance(df.schema[column].dataType, T.StringType):
        key = F.lower(F.coalesce(F.col(column), F.lit("")))
        return df.orderBy(key.desc() if descending else key.asc(), *ties)
    return df.orderBy(F.col(column).desc_nulls_first() if descending else F.col(column).asc_nulls_last(), *ties)


def missing_fields(fields: dict[str, Column]) -> Column:
    """P10: names of the fields that are empty: null, blank, or zero."""
    empty = {name: F.coalesce(c.cast("string"), F.lit("")).rlike(r"^\s*(?:0+(?:\.0+)?)?\s*$") for name, c in fields.items()}
    return F.array_compact(F.array(*[F.when(e, F.lit(name)) for name, e in empty.items()]))


def processing_status(missing: Column) -> Column:
    """A line on what is missing; four and more make an extraction partial, of which at most five are named."""
    names = F.array_join(missing, ", ")
    return F.when(F.size(missing) == 0, "Completed: core fields are available").when(F.size(missing) >= 4, F.concat(F.lit("Partial extraction: missing "), F.array_join(F.slice(missing, 1, 5), ", "))).otherwise(F.concat(F.lit("Completed with gaps: "), names))


def error_status(context: Column, message: Column, most: int = 70) -> Column:
    text = F.trim(F.coalesce(message, F.lit("Unknown error")))
    cut = F.when(F.length(text) > most, F.concat(F.rtrim(F.left(text, F.lit(most - 3))), F.lit("..."))).otherwise(text)
    return F.concat(F.lit("Failed: "), F.coalesce(context, F.lit("Pipeline")), F.lit(" - "), cut)


def validate_rows(df: DataFrame, json: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good, quarantine). Texts are squeezed; a row is refused if it is no JSON object, has unknown keys, or a field of the wrong type."""
    raw = F.from_json(json, "map<string,string>")
    rows = df.withColumn("__raw", raw)
    unknown = F.array_except(F.map_keys("__raw"), F.array(*[F.lit(f.name) for f in schema]))
    cells = {f.name: F.try_element_at(F.col("__raw"), F.lit(f.name)) for f in schema}
    typed = {f.name: squeeze(cells[f.name]) if isinstance(f.dataType, T.StringType) else cells[f.name].try_cast(f.dataType) for f in schema}
    wrong = F.array_compact(F.array(*[F.when(cells[n].isNotNull() & typed[n].isNull(), F.lit(n)) for n in typed]))
    reason = F.when(F.col("__raw").isNull(), "not an object").when(F.size(unknown) > 0, F.concat(F.lit("unknown: "), F.array_join(F.array_sort(unknown), ","))).when(F.size(wrong) > 0, F.concat(F.lit("type: "), F.array_join(wrong, ",")))
    rows = rows.withColumn("reason", reason).withColumns(typed)
    return rows.where("reason is null").drop("__raw", "reason", json), rows.where("reason is not null").select(*df.columns, "reason")


def prompt_table(df: DataFrame, template: str, fields: dict[str, Column], examples: list[str] = (), max_examples: int = 2) -> DataFrame:
    """A prompt for each row: {name} replaced by the field, {examples} by the first examples."""
    prompt = F.replace(F.lit(template), F.lit("{examples}"), F.lit("\n\n".join(list(examples)[:max_examples])))
    for name, value in fields.items():
        prompt = F.replace(prompt, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return df.withColumn("prompt", prompt)


def parse_json_responses(c: str | Column) -> Column:
    """The JSON object in an answer, in one form: all of it, else the first fenced block that is one, else from the first to the last brace; null if none is.

    Each has to parse to its end: an object with anything but white space after it is refused, as are other values than objects."""
    c = F.trim(col(c))
    fenced = F.regexp_extract_all(c, F.lit(r"(?s)```(?:json)?\s*(.*?)```"), F.lit(1))
    tries = F.concat(F.array(c), fenced, F.array(F.regexp_extract(c, r"(?s)\{.*\}", 0)))
    # Spark's readers stop after the first value. What follows it would have to go on an array here and an object there, which nothing does
    whole = lambda x: (F.json_array_length(F.concat(F.lit("["), x, F.lit("]"))) == 1) & F.try_parse_json(F.concat(F.lit('{"a":'), x, F.lit("}"))).isNotNull()
    objects = F.transform(F.filter(tries, lambda x: x.rlike(r"(?s)^\s*\{.*\}\s*$") & whole(x)), lambda x: F.to_json(F.try_parse_json(x)))
    return F.try_element_at(F.filter(objects, lambda x: x.isNotNull()), F.lit(1))


def split_responses(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(parsed, quarantine): rows with their JSON object in place of the answer, and the rows without one as they are."""
    rows = df.withColumn("__json", parse_json_responses(column))
    return rows.where("__json is not null").withColumn(column, F.col("__json")).drop("__json"), rows.where("__json is null").drop("__json")


def relevance_score(rules: list[tuple[Column, int]]) -> Column:
    """The weights of the conditions that hold."""
    return reduce(add, [F.when(c, w).otherwise(0) for c, w in rules])


def duplicate_suffix(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Repeats of a name get _1, _2, ..."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(*order)) - 1
    return df.withColumn("__n", n).withColumn(name, F.when(F.col("__n") > 0, F.concat(name, F.lit("_"), F.col("__n").cast("string"))).otherwise(F.col(name))).drop("__n")


def flat_report(df: DataFrame, columns: dict[str, list[str]]) -> DataFrame:
    """A report column is the first of its source columns that is not blank."""
    return df.select(*[F.coalesce(*[blank_to_null(c) for c in sources]).alias(name) for name, sources in columns.items()])


def csv_cell(c: str | Column) -> Column:
    """A cell as CSV writes it: quoted where it holds a comma, quote or line break, quotes doubled."""
    text = F.coalesce(col(c).cast("string"), F.lit(""))
    return F.when(text.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)
