"""Metadata from texts: titles, authors, identifiers, names, years, values. Patterns and word lists are fixed values where results must equal theirs."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.text import let, squeeze

#: Starts of lines that are no titles. Fixed values.
TITLE_STOPS = (
    r"^(?:abstract|a\s*b\s*s\s*t\s*r\s*a\s*c\s*t)\b",
    r"^(?:keywords?|key words?)\b",
    r"^(?:article info|a\s*r\s*t\s*i\s*c\s*l\s*e\s*i\s*n\s*f\s*o)\b",
    r"^(?:introduction|results(?: and discussion)?|experimental(?: section)?|materials?(?: and methods?)?)\b",
    r"^(?:received|accepted|published|available online|copyright)\b",
    r"^(?:doi|https?://|www\.)\b",
    r"^(?:corresponding author|e-?mail)\b",
)

#: Lines that name a journal. Fixed values.
NAME_LINES = (
    r"Nature\s+(?:Communications|Photonics|Materials|Nanotechnology|Energy)",
    r"Advanced\s+(?:Materials|Functional\s+Materials|Optical\s+Materials|Energy\s+Materials)",
    r"Laser\s*(?:&|and)?\s*Photonics\s+Reviews",
    r"ACS\s+(?:Nano|Applied\s+Materials|Energy\s+Letters|Photonics)",
    r"Nano\s+(?:Letters|Today|Research|Energy)",
    r"Journal\s+of\s+the\s+American\s+Chemical\s+Society",
    r"Science\s+Advances",
    r"Cell(?:\s+Reports)?",
    r"Angewandte\s+Chemie",
    r"Chemical\s+Science",
    r"Physical\s+Review\s+(?:Letters|Applied)",
)


def normalize_title(line: Column) -> Column:
    out = F.regexp_replace(F.trim(line), r"^[#*\-\s]+", "")
    out = F.regexp_replace(squeeze(out), "^[ \"'`|]+|[ \"'`|]+$", "")
    out = F.regexp_replace(out, r"(?i)^(?:article )?title\s*[:-]\s*", "")
    out = F.regexp_replace(out, r"\s*\[[^\]]+\]\s*$", "")
    out = F.regexp_replace(out, r"(?i)\s*\(\s*(?:article|review|communication)\s*\)\s*$", "")
    return F.regexp_replace(F.regexp_replace(out, r"(?i)\s*doi\s*:\s*10\.[^\s]+$", ""), r"^[ ,.;]+|[ ,;]+$", "")


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def bad_title(t: Column) -> Column:
    low = F.lower(t)
    words = F.size(F.filter(F.split(t, " +"), lambda w: w != ""))
    names = r"^(?:[A-Z][a-zA-Z'`-]+(?:\s+[A-Z][a-zA-Z'`-]+){0,2}\s*[,*]?\s*){3,}$"
    return reduce(
        or_,
        [
            ~F.length(t).between(15, 300),
            low.rlike("|".join(f"(?:{p})" for p in TITLE_STOPS)),
            low.rlike(r"@|http|www\.|\.pdf$"),
            low.rlike(r"^[a-z]\s*(?:[a-z]\s+){4,}$"),
            low.rlike(r"\b(?:university|college|institute|school|laboratory|department)\b"),
            t.rlike(names),
            (_count(t, ",") >= 3) & ~t.rlike("[:;]"),
            low.rlike(r"\b(?:figure|table)\s+[0-9]+\b|\b(?:orcid|supporting information)\b"),
            low.rlike(r"\b(?:j\.\s*[a-z]|adv\.|nano lett\.|chem\.)") & (words <= 6),
            _count(t, "[0-9]") > F.greatest(F.lit(4), F.floor(F.length(t) / 8)),
        ],
    )


def title_score(t: Column, place: Column, heading: Column) -> Column:
    words = F.size(F.filter(F.split(t, " +"), lambda w: w != ""))
    alpha, upper = _count(t, r"\p{L}"), _count(t, r"\p{Lu}")
    parts = [
        F.when(heading, 5).otherwise(0),
        F.when(place == 0, 4).when(place <= 2, 2).otherwise(0),
        F.when(words.between(6, 28), 4).otherwise(0),
        F.when(F.length(t).between(40, 180), 4).otherwise(0),
        F.when((alpha >= 20) & (alpha * 100 >= F.length(t) * 45), 3).otherwise(0),
        F.when(upper * 100 < F.greatest(alpha, F.lit(1)) * 45, 2).otherwise(0),
        F.when(t.contains(":"), 1).otherwise(0),
        F.when(t.endswith("."), -2).otherwise(0),
    ]
    return reduce(add, parts)


def title_lines(docs: DataFrame, most: int = 40) -> DataFrame:
    """(doc_id, lines): the first 20 that are not blank of the first lines, cleaned, as an array of (title, heading, bad). All of a document stays in its row; the
    array is exploded out of an array of one, so that what uses it several times does not work it out several times."""
    cleaned = F.transform(F.slice(F.split("text", "\n"), 1, most), lambda line: F.struct(normalize_title(line).alias("title"), F.ltrim(line).startswith("#").alias("heading")))
    rows = docs.select("doc_id", F.slice(F.filter(cleaned, lambda x: x["title"] != ""), 1, 20).alias("lines"))
    judged = F.transform("lines", lambda x: F.struct(x["title"], x["heading"], bad_title(x["title"]).alias("bad")))
    return rows.select("doc_id", F.explode(F.array(judged)).alias("lines"))


def _scored(title: Column, score: Column, place: Column) -> Column:
    return F.struct(title.alias("title"), score.alias("score"), place.cast("int").alias("place"))


def _blocks(lines: Column) -> Column:
    """The first one, two and three good lines in a row, of the first eight lines, joined and scored."""
    head = F.slice(lines, 1, 8)
    begin = F.array_position(F.transform(head, lambda x: x["bad"]), False)
    rest = F.when(begin > 0, F.slice(head, F.greatest(begin, F.lit(1)).cast("int"), 8)).otherwise(F.slice(head, 1, 0))
    end = F.array_position(F.transform(rest, lambda x: x["bad"]), True)
    good = F.slice(F.when(end > 0, F.slice(rest, F.lit(1), F.greatest(end - 1, F.lit(0)).cast("int"))).otherwise(rest), 1, 3)
    counts = F.when(F.size(good) > 0, F.sequence(F.lit(1), F.size(good))).otherwise(F.array().cast("array<int>"))
    joined = F.transform(counts, lambda n: F.array_join(F.transform(F.slice(good, F.lit(1), n), lambda x: x["title"]), " "))
    fine = F.filter(joined, lambda t: F.length(t).between(20, 260) & ~bad_title(t))
    return F.transform(fine, lambda t: _scored(t, title_score(t, F.lit(0), F.lit(True)) + 2, F.lit(-1)))


def title_blocks(lines: DataFrame) -> DataFrame:
    """X11: (doc_id, title, score): the first one, two and three good lines in a row joined, 20 to 260 characters long, scored as headings and 2 more."""
    return lines.select("doc_id", F.inline(_blocks(F.col("lines"))))


def rank_titles(docs: DataFrame, with_blocks: bool = True) -> DataFrame:
    """(doc_id, title, score): the best title of each document; ties go to the earlier, then to the shorter and then to the larger text."""
    numbered = F.transform("lines", lambda x, i: F.struct(x["title"], x["heading"], x["bad"], i.alias("place")))
    single = F.transform(F.filter(F.slice(numbered, 1, 20), lambda x: ~x["bad"]), lambda x: _scored(x["title"], title_score(x["title"], x["place"], x["heading"]), x["place"]))
    every = F.concat(single, _blocks(F.col("lines"))) if with_blocks else single
    order = F.transform(F.filter(every, lambda x: x["score"] > 0), lambda x: F.struct(x["score"], (-x["place"]).alias("early"), (-F.length(x["title"])).alias("short"), x["title"]))
    # at most one element; a filter on it would work the arrays out a second time
    return title_lines(docs).select("doc_id", F.inline(F.array_compact(F.array(F.array_max(order))))).select("doc_id", "title", "score")


def author_candidates(text: Column, known: Column | None = None, most: int = 10) -> Column:
    """Known authors split at [;,\\n], else pairs of capitalised words in the first 5,000 characters; each once, at most ten."""
    pairs = F.array_distinct(F.regexp_extract_all(F.left(text, F.lit(5000)), F.lit("(?:^|[^A-Za-z])([A-Z][a-z]+ [A-Z][a-z]+)(?:$|[^A-Za-z])"), F.lit(1)))
    if known is not None:
        split = F.filter(F.transform(F.split(known, "[;,\n]+"), lambda p: F.trim(p)), lambda p: p != "")
        pairs = F.when(F.size(split) > 0, split).otherwise(pairs)
    return F.slice(pairs, 1, most)


def issn_candidates(text: Column) -> Column:
    """struct(issn, eissn) from the first 5,000 characters: labelled ones, else the first and the first other one that stand there."""
    head, body = F.left(text, F.lit(5000)), r"([0-9]{4}-?[0-9]{3}[0-9Xx])"
    labelled_e = F.nullif(F.regexp_extract(head, r"(?i)\b(?:e-?issn|electronic\s+issn|online\s+issn)\b[^0-9A-Za-z]{0,10}" + body, 1), F.lit(""))
    labelled_p = F.nullif(F.regexp_extract(head, r"(?i)(?:^|[^-A-Za-z])(?:p-?issn|print\s+issn|issn\s*\(print\)|issn)\b[^0-9A-Za-z]{0,10}" + body, 1), F.lit(""))
    plain = F.regexp_extract_all(head, F.lit(r"\b([0-9]{4}-?[0-9]{3}[0-9Xx])\b"), F.lit(1))
    issn = F.coalesce(labelled_p, F.try_element_at(plain, F.lit(1)))
    other = F.try_element_at(F.filter(plain, lambda p: p != issn), F.lit(1))
    return F.struct(issn.alias("issn"), F.coalesce(labelled_e, F.when(F.size(plain) > 1, other)).alias("eissn"))


def clean_name(c: Column) -> Column:
    out = squeeze(c)
    for p in (r"^(?:cite this|available online)[: -]*", r"^(?:review|research article|article)[: -]+", r"doi\s*:\s*10\.[^ ]+$", r"www\.[^ ]+"):
        out = F.regexp_replace(out, "(?i)" + p, "")
    for p in (r"\([0-9]+\)$", r"(?:19|20)[0-9]{2}([^0-9].*)?$", r" *\([^)]*\)$"):
        out = F.regexp_replace(F.trim(out), p, "")
    return F.regexp_replace(out, r"^[ |,;.-]+|[ |,;-]+$", "")


def normalize_name(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """Df with name: by alias (alias, name) of the cleaned text, then of its letters and digits, else the text where it is a known name.

    aliases is a dimension of short texts; the join is on the alias, so its size does not matter."""
    cleaned = clean_name(F.col(column))
    rows = df.withColumn("__c", F.lower(cleaned)).withColumn("__s", F.trim(F.regexp_replace("__c", "[^a-z0-9]+", " ")))
    one = aliases.select(F.col("alias").alias("__c"), F.col("name").alias("__n1"))
    two = aliases.select(F.col("alias").alias("__s"), F.col("name").alias("__n2"))
    known = F.when(cleaned.rlike("(?i)^(?:" + "|".join(NAME_LINES) + ")$"), cleaned)
    rows = rows.join(one, "__c", "left").join(two, "__s", "left")
    return rows.withColumn("name", F.coalesce("__n1", "__n2", known)).drop("__c", "__s", "__n1", "__n2")


def name_from_hints(df: DataFrame, text: str, hints: dict[str, str], then: Column | None = None) -> DataFrame:
    """Df with name: of the first hint that stands in the head of the text, else then, else the first known name in it. Hints are part of the plan."""
    head = F.left(F.lower(text), F.lit(5000))
    by_hint = F.coalesce(*[F.when(head.contains(h), F.lit(n)) for h, n in hints.items()])
    line = F.nullif(squeeze(F.regexp_extract(F.left(text, F.lit(5000)), r"(?i)(?:^|[^A-Za-z])(" + "|".join(NAME_LINES) + r")(?:$|[^A-Za-z])", 1)), F.lit(""))
    return df.withColumn("name", F.coalesce(by_hint, *([then] if then is not None else []), line))


def value_from_head(text: Column, label: str = r"impact\s+factor", low: float = 0.1, high: float = 200.0) -> Column:
    """A number after its label in the first 3,000 characters, in range."""
    value = F.regexp_extract(F.left(text, F.lit(3000)), rf"(?i){label}[^0-9]{{0,20}}([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    return F.when((value > low) & (value < high), value)


#: What may stand around a year. Fixed values.
YEARS = (
    r"(?i)(?:published|accepted|received|online|available)[^0-9]{0,20}(20[1-2][0-9])",
    r"(20[1-2][0-9])\s+(?:The\s+Author|Elsevier|Nature|Science|Wiley|Springer|ACS|Taylor\s+&\s+Francis)",
    r"\b(20[1-2][0-9])\b",
    r"(?i)\b(?:vol|volume|issue|no)\.?\s*[0-9]+[^0-9]{0,10}(20[1-2][0-9])",
    r"(?i)\b(20[1-2][0-9])\b[^0-9]{0,20}(?:doi|pmid|arxiv)",
)


def modal(rows: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """(key, value, n): the value that a key has most often; ties go to the one at the least place."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("n"), F.min(at).alias("__at"))
    return counts.groupBy(key).agg(F.max_by(F.struct(value, "n"), F.struct("n", -F.col("__at"))).alias("b")).select(key, F.col("b")[value].alias(value), F.col("b.n").alias("n"))


def modal_year(docs: DataFrame, first: int = 2010, last: int = 2026) -> DataFrame:
    """(doc_id, year, times): the year found most often in the first and, of texts over 6,000 characters, the last 3,000; ties go to the one seen first."""
    ends = F.array(F.left("text", F.lit(3000)), F.when(F.length("text") > 6000, F.right("text", F.lit(3000))).otherwise(""))
    found = F.flatten(F.transform(ends, lambda s: F.concat(*[F.regexp_extract_all(s, F.lit(p), F.lit(1)) for p in YEARS])))
    rows = docs.select("doc_id", F.posexplode(found).alias("at", "y")).withColumn("y", F.col("y").cast("int")).where(F.col("y").between(first, last))
    return modal(rows, "doc_id", "y", "at").select("doc_id", F.col("y").alias("year"), F.col("n").alias("times"))


def value_year_from_text(text: Column, label: str = r"(?:journal\s+)?impact\s+factor", low: float = 0.1, high: float = 200.0) -> Column:
    """struct(year, value) by three patterns in order: year before, year after, none; the first whose value is in range."""
    number = r"([0-9]+(?:\.[0-9]+)?)"
    shapes = [(rf"(?i)(20[0-9]{{2}})[^0-9]{{0,20}}{label}[^0-9]{{0,20}}{number}", 1, 2), (rf"(?i){label}[^0-9]{{0,20}}{number}[^0-9]{{1,20}}(20[0-9]{{2}})", 2, 1), (rf"(?i){label}[^0-9]{{0,20}}{number}", 0, 1)]
    tries = []
    for pattern, year, value in shapes:
        v = F.regexp_extract(text, pattern, value).try_cast("double")
        y = F.regexp_extract(text, pattern, year).try_cast("int") if year else F.lit(None).cast("int")
        tries.append(F.when(v.between(low, high), F.struct(y.alias("year"), v.alias("value"))))
    return F.coalesce(*tries)


#: Keys of an object that tell the year of its values, in order. Fixed values.
YEAR_KEYS = ("citationReportYear", "reportYear", "year", "jifYear")


_TEXT = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
#: A key with a plain value, a text or key that stands alone, the start or end of an object.
_JSON_TOKEN = rf'{_TEXT}:(?:{_TEXT}|[^,{{}}\[\]"]++)|{_TEXT}|[{{}}]'


def _json_best(text: Column, names: tuple[str, ...], stem: str, inside: str, low: float, high: float) -> Column:
    """struct(year, value) of the best hit, year 0 where it has none: a fold over the tokens of one JSON text, with a stack of the objects that are open."""
    hit, open_ = "struct<year:int,value:double>", f"struct<years:array<string>,named:struct<year:int,value:double>,plain:double>"
    none = F.lit(None).cast(hit)
    fresh = F.struct(F.array_repeat(F.lit(None).cast("string"), len(YEAR_KEYS)).alias("years"), none.alias("named"), F.lit(None).cast("double").alias("plain"))
    start = F.struct(F.array().cast(f"array<{open_}>").alias("stack"), none.alias("best"))
    largest = lambda *x: F.greatest(*x)  # noqa: E731  nulls are passed over
    below = lambda s: F.slice(s["stack"], F.lit(1), F.size(s["stack"]) - 1)

    def closed(s: Column) -> Column:
        year = lambda t: F.when(t.rlike(r"^\s*[0-9]{1,9}\s*$") & F.trim(t).try_cast("int").between(2000, 2100), F.trim(t).try_cast("int"))

        def end(o: Column) -> Column:
            first = let(F.get(F.filter(o["years"], lambda y: y.isNotNull() & ~y.isin("", "0", "false", "null")), F.lit(0)), year)
            plain = F.when(o["plain"].isNotNull(), F.struct(F.coalesce(first, F.lit(0)).alias("year"), o["plain"].alias("value")))
            return F.struct(below(s).alias("stack"), largest(s["best"], o["named"], plain).alias("best"))

        return let(F.element_at(s["stack"], -1), end)

    def pair(s: Column, t: Column) -> Column:
        key = F.regexp_extract(t, rf"^({_TEXT}):", 1)
        bare = F.substring(key, F.lit(2), F.length(key) - 2)
        value = F.substring(t, F.length(key) + 2, F.length(t))
        said = F.when(value.startswith('"'), F.regexp_replace(F.substring(value, F.lit(2), F.length(value) - 2), r"\\u[0-9a-fA-F]{4}|\\.", " ")).otherwise(value)

        def put(x: Column) -> Column:
            low_ = F.lower(x["key"])
            is_name = low_.isin(*names)
            number = F.regexp_extract(x["said"], r"[0-9]+(?:\.[0-9]+)?", 0).try_cast("double")
            good = (is_name | low_.startswith(stem) | low_.contains(inside)) & number.between(low, high)
            year = F.when(~is_name, F.regexp_extract(low_, "20[0-9]{2}", 0).try_cast("int"))
            o = F.element_at(s["stack"], -1)
            years = F.array(*[F.when(x["key"] == k, x["said"]).otherwise(F.get(o["years"], F.lit(i))) for i, k in enumerate(YEAR_KEYS)])
            named = largest(o["named"], F.when(good & year.isNotNull(), F.struct(year.alias("year"), number.alias("value"))))
            plain = largest(o["plain"], F.when(good & year.isNull(), number))
            return F.struct(F.concat(below(s), F.array(F.struct(years.alias("years"), named.alias("named"), plain.alias("plain")))).alias("stack"), s["best"].alias("best"))

        matters = bare.isin(*YEAR_KEYS) | F.lower(bare).isin(*names) | F.lower(bare).startswith(stem) | F.lower(bare).contains(inside)
        return F.when(matters, let(F.struct(bare.alias("key"), said.alias("said")), put)).otherwise(s)

    def step(s: Column, t: Column) -> Column:
        opened = F.struct(F.concat(s["stack"], F.array(fresh)).alias("stack"), s["best"].alias("best"))
        return F.when(t == "{", opened).when(t == "}", closed(s)).when(t.endswith('"') & ~t.rlike(rf"^{_TEXT}:"), s).otherwise(pair(s, t))

    return F.aggregate(F.regexp_extract_all(text, F.lit(_JSON_TOKEN), F.lit(0)), start, step, lambda s: s["best"])


def json_value_search(df: DataFrame, key: str, json: str, names: tuple[str, ...] = ("journalimpactfactor", "impactfactor", "jif", "jifvalue"), stem: str = "jif", inside: str = "impactfactor", low: float = 0.1, high: float = 200.0) -> DataFrame:
    """P25: (key, year, value): of all values, in objects and arrays of any depth, whose key is one of the names, starts with the stem or holds ``inside``, the one
    of the latest year and then the largest. The year stands in the key or beside it.

    A text is read as a variant, brought to one form and walked within its row, in the JVM. Texts that are no JSON to their end, that repeat a key in an object, or
    that Spark's reader refuses as too deep (1,000 levels) have no values."""
    text = F.col(json).cast("string")
    may = F.lower(text).contains(stem) | F.lower(text).contains(inside) | reduce(or_, [F.lower(text).contains(n) for n in names])
    whole = (F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1) & F.try_parse_json(F.concat(F.lit('{"a":'), text, F.lit("}"))).isNotNull()
    best = F.when(may & whole, let(F.to_json(F.try_parse_json(text)), lambda x: _json_best(x, names, stem, inside, low, high)))
    # as a generated row, so that the filter is not worked out apart from the value
    found = df.select(key, F.explode_outer(F.array(best)).alias("__b")).where("__b is not null")
    return found.select(key, F.when(F.col("__b.year") > 0, F.col("__b.year")).alias("year"), F.col("__b.value").alias("value"))
