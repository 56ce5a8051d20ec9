"""Queries of mentions, records and metadata (X rows, P24, P25)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.functions.rules import CORPUS, OLED, PACKS, Metric, RulePack, pack_schema, register_pack
from docmill.operators import mentions as M
from docmill.operators import meta as D
from docmill.plans.registry import query
from docmill.sources.files import spread


_SQ = "trim(regexp_replace({}, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_shown(v: str, m) -> str:
    return f"CAST(CAST(round(TRY_CAST({v} AS DECIMAL(20,6)), {m.decimals}) AS DECIMAL(20,{m.decimals})) AS VARCHAR) || '{m.unit}'"


def _sql_in_range(v: str, m) -> str:
    number = f"TRY_CAST({v} AS DOUBLE)"
    return " AND ".join([f"{number} IS NOT NULL"] + ([f"{number} > {m.low}"] if m.low is not None else []) + ([f"{number} < {m.high}"] if m.high is not None else []))


def _values(text: str, m) -> str:
    """SQL for one metric's values."""
    parts = []
    for p in m.patterns:
        raw = f"regexp_extract_all({text}, {_q(p)}, 1)"
        if m.pair:
            both = f"list_zip({raw}, regexp_extract_all({text}, {_q(p)}, 2))"
            parts.append(f"list_transform({both}, lambda v: CASE WHEN {_sql_in_range('v[1]', m)} AND {_sql_in_range('v[2]', m)} THEN '(' || {_sql_shown('v[1]', m)} || ', ' || {_sql_shown('v[2]', m)} || ')' END)")
        elif m.decimals is None:
            bare = r"regexp_replace(trim(regexp_replace(v, '[ \t\n\r]+', ' ', 'g')), '^[ .;,)(]+|[ .;,)(]+$', '', 'g')"
            parts.append(f"list_filter(list_transform({raw}, lambda v: {bare}), lambda v: length(v) > {m.longer_than})")
        else:
            parts.append(f"list_transform({raw}, lambda v: CASE WHEN {_sql_in_range('v', m)} THEN {_sql_shown('v', m)} END)")
    every = f"list_concat({', '.join(parts)})" if len(parts) > 1 else parts[0]
    # the first of equal values stays, in order
    return f"(list_filter(list_filter({every}, lambda v: v IS NOT NULL), lambda v, i: list_position(list_filter({every}, lambda u: u IS NOT NULL), v) = i))[1:{m.cap}]"


_MENTIONS = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS metric, {_values('text', m)} AS vals FROM documents" for n, m in CORPUS.metrics.items())


@query("x1_extract_mentions", f"WITH m AS ({_MENTIONS}) SELECT doc_id, metric, CAST(generate_subscripts(vals, 1) - 1 AS INTEGER) AS pos, unnest(vals) AS value FROM m")
def _x1(t):
    return M.extract_mentions(t("documents"), CORPUS)


@query(
    "entry_mention_report",
    f"""WITH d AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY md5(text)), u AS (SELECT documents.* FROM documents JOIN d USING (doc_id)),
m AS ({_MENTIONS.replace('FROM documents', 'FROM u')}), e AS (SELECT doc_id, metric, unnest(vals) AS value FROM m)
SELECT source, metric, count(*) AS mentions, count(DISTINCT e.doc_id) AS docs FROM e JOIN u USING (doc_id) GROUP BY source, metric""",
)
def entry(t):
    """Distinct documents by fingerprint, their mentions, counted by source and metric, most mentions first.

    Mentions are counted where a text is read; only fingerprints and counts are shuffled, and of each fingerprint the least document stays."""
    text = F.coalesce("text", F.lit(""))
    sizes = F.struct(*[F.size(M.metric_values(text, m)).alias(n) for n, m in CORPUS.metrics.items()])
    rows = t("documents").select(F.md5(F.encode("text", "UTF-8")).alias("fp"), "doc_id", F.struct("source", sizes.alias("sizes")).alias("d"))
    first = rows.groupBy("fp").agg(F.min_by("d", "doc_id").alias("d"))
    cells = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"d.sizes.{n}").alias("n")) for n in CORPUS.metrics])
    found = first.select("d.source", F.inline(cells)).where("n > 0")
    counts = found.groupBy("source", "metric").agg(F.sum("n").alias("mentions"), F.count("*").alias("docs"))
    return counts.orderBy(F.col("mentions").desc(), "source", "metric")


#: A measured sentence: texts, and numbers made of the document's id as (divisor, added), so that the packs of all domains have something to find.
_MEASURED = (
    " The device reached an EQE of ", (70, 1), ".5 % and PCE of ", (30, 1), " % with capacity of ", (900, 1), " mAh/g, 90.5 % after ", (500, 2), " cycles. Linear range 0.5 - ", (40, 1), " mM. Response time was ", (60, 1), " s.",
    " Its structure was ITO/PEDOT:PSS/Layer", (9, 1), "/TPBi/LiF/Al, CIE (0.", (60, 20), ", 0.", (50, 30), "), LT50 = ", (400, 3), " h, luminance of ", (9000, 100), " cd/m2, current efficiency of ", (80, 2), ".5 cd/A, power efficiency of ", (70, 2), ".25 lm/W.",
    " Jsc of ", (25, 2), ".1 mA/cm2, Voc of 1.", (10, 0), " V, FF of ", (70, 10), ".5 %. Energy density of ", (400, 9), " Wh/kg, coulombic efficiency of ", (99, 1), ".2 %. Sensitivity of ", (700, 5), ".4, detection limit of 0.", (90, 10), " nM.",
)


def _packed(docs):
    n = F.col("doc_id")
    said = [F.lit(x) if isinstance(x, str) else (n % x[0] + x[1]).cast("string") for x in _MEASURED]
    return docs.select("doc_id", F.concat("text", *said).alias("text"))


_PACKED = "p AS (SELECT doc_id, text || " + " || ".join(f"'{x}'" if isinstance(x, str) else f"(doc_id % {x[0]} + {x[1]})" for x in _MEASURED) + " AS text FROM documents)"
_DOMAIN = [(pk, n) for pk in ("oled", "solar_cell", "battery", "sensor") for n in PACKS[pk].metrics]


@query("x2_rule_packs", f"WITH {_PACKED}, m AS (" + " UNION ALL ".join(f"SELECT doc_id, '{pk}' AS pack, '{n}' AS metric, {_values('text', PACKS[pk].metrics[n])} AS vals FROM p" for pk, n in _DOMAIN) + ") SELECT doc_id, pack, metric, vals[1] AS value FROM m WHERE len(vals) > 0")
def _x2(t):
    docs = _packed(t("documents"))
    cells = lambda sought: F.array(*[F.struct(F.lit(pk).alias("pack"), F.lit(n).alias("metric"), M.first_value(sought, PACKS[pk].metrics[n]).alias("value")) for pk, n in _DOMAIN])
    return docs.select("doc_id", F.inline(M.within_pieces(F.col("text"), cells))).where("value is not null")


_CODES = RulePack(metrics={"code": Metric((r"\b([A-Za-z]+[0-9]+)\b",), cap=3), "share": Metric((r"([0-9]+) ?%",), 0, 101, 1, "%")}, signals={"code": 1})


@query("e1_register_pack", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS metric, CAST(generate_subscripts({_values('text', m)}, 1) - 1 AS INTEGER) AS pos, unnest({_values('text', m)}) AS value FROM documents" for n, m in _CODES.metrics.items()) + ")")
def _e1(t):
    register_pack("codes", _CODES)
    return M.extract_mentions(t("documents"), PACKS["codes"])


@query("e3_pack_schema", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS year, value AS impact_factor, event_type AS label FROM events")
def _e3(t):
    """Records of the corpus pack with document fields, read back from JSON by the pack's schema: years and factors are numbers."""
    schema = pack_schema("corpus", ("year", "impact_factor"))
    json = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("int").alias("year"), F.col("value").alias("impact_factor"), F.col("event_type").alias("label")))
    return t("events").select("event_id", F.from_json(json, schema).alias("r")).select("event_id", "r.year", "r.impact_factor", "r.label")


def _first(text, name):
    return f"({_values(text, CORPUS.metrics[name])})[1]"


_LABEL = "coalesce(" + ", ".join(f"nullif({_SQ.format(f'regexp_extract(s, {_q(p)}, 1)')}, '')" for p in CORPUS.labels) + ")"
_SIGNAL = " + ".join(f"CASE WHEN len({_values('s', CORPUS.metrics[n])}) > 0 THEN {w} ELSE 0 END" for n, w in CORPUS.signals.items()) + f" + CASE WHEN {_LABEL} IS NOT NULL THEN 1 ELSE 0 END"
_SEGMENTS = f"""
g0 AS (SELECT doc_id, string_split_regex(text, '\\n[ \\t]*\\n') AS parts FROM documents),
g1 AS (SELECT doc_id, generate_subscripts(parts, 1) - 1 AS pl, trim(unnest(parts)) AS s FROM g0),
g2 AS (SELECT doc_id, 0 AS kind, pl, s FROM g1 WHERE s <> '' AND {_SIGNAL} >= 2),
h0 AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])[ \\n\\t]+', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM documents),
h1 AS (SELECT doc_id, generate_subscripts(parts, 1) - 1 AS pl, trim(unnest(parts)) AS s FROM h0),
h2 AS (SELECT *, {_SIGNAL} > 0 AS hit FROM h1 WHERE s <> ''),
h3 AS (SELECT *, sum(CAST(NOT hit AS INT)) OVER (PARTITION BY doc_id ORDER BY pl) AS run FROM h2),
h4 AS (SELECT doc_id, 1 AS kind, min(pl) AS pl, string_agg(s, ' ' ORDER BY pl) AS s FROM h3 WHERE hit GROUP BY doc_id, run),
i0 AS (SELECT * FROM g2 UNION ALL SELECT * FROM h4),
i1 AS (SELECT doc_id, kind, pl, s FROM i0 QUALIFY row_number() OVER (PARTITION BY doc_id, {_SQ.format('s')} ORDER BY kind, pl) = 1),
seg AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY kind, pl) - 1 AS INTEGER) AS pos, s FROM i1 QUALIFY pos < 20)"""
_NOTES = "s"
for _p in ("Research Article", "RESEARCH ARTICLE", r"www\.afm-journal\.de", r"www\.small-journal\.com", r"www\.advancedsciencenews\.com", r"Fig(?:ure|\.) [0-9]+\.[^ \t\n]*", r"\[[0-9]+(?:-[0-9]+)?\]"):
    _NOTES = f"regexp_replace({_NOTES}, {_q(_p)}, '', 'g')"
_NOTES = _SQ.format(_NOTES)
_NOTES = f"nullif(CASE WHEN length({_NOTES}) > 220 THEN rtrim(left({_NOTES}, 217)) || '...' ELSE {_NOTES} END, '')"
_RECORDS = f"""
r0 AS (SELECT doc_id, pos AS pl, {_LABEL} AS label, {', '.join(f'{_first("s", n)} AS {n}' for n in CORPUS.metrics)}, {_NOTES} AS notes FROM seg),
r1 AS (SELECT *, lower(concat_ws(chr(2), coalesce(label, ''), {', '.join(f"coalesce({n}, '')" for n in CORPUS.signals)})) AS sig FROM r0 WHERE coalesce({', '.join(CORPUS.metrics)}) IS NOT NULL),
r2 AS (SELECT * FROM r1 QUALIFY row_number() OVER (PARTITION BY doc_id, sig ORDER BY pl) = 1),
rec AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pl) - 1 AS INTEGER) AS pos, label, {', '.join(CORPUS.metrics)}, notes FROM r2 QUALIFY pos < 6)"""


@query("x3_segments", f"WITH {_SEGMENTS} SELECT doc_id, pos, s AS text FROM seg")
def _x3(t):
    return M.segments(t("documents"), CORPUS)


@query("x4_candidate_records", f"WITH {_SEGMENTS}, {_RECORDS} SELECT * FROM rec")
def _x4(t):
    return M.candidate_records(t("documents"), CORPUS)


@query("x5_document_fallback_record", f"WITH {_SEGMENTS}, {_RECORDS}, few AS (SELECT * FROM rec WHERE version IS NOT NULL), f AS (SELECT doc_id, text AS s FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM few)), o AS (SELECT doc_id, 0 AS pos, {_LABEL} AS label, {', '.join(f'{_first("s", n)} AS {n}' for n in CORPUS.metrics)}, NULL AS notes FROM f) SELECT * FROM few UNION ALL SELECT * FROM o WHERE coalesce({', '.join(CORPUS.metrics)}) IS NOT NULL")
def _x5(t):
    docs = t("documents")
    return M.document_fallback_record(docs, M.candidate_records(docs, CORPUS).where("version is not null"), CORPUS)


@query("x6_record_label", f"SELECT doc_id, {_LABEL.replace('(s,', '(text,')} AS label FROM documents WHERE {_LABEL.replace('(s,', '(text,')} IS NOT NULL")
def _x6(t):
    return t("documents").select("doc_id", M.record_label(F.col("text"), CORPUS.labels).alias("label")).where("label is not null")


@query("x7_clean_notes", f"WITH d AS (SELECT doc_id, text || ' [1-2] Figure 3.abc' AS s FROM documents) SELECT doc_id, {_NOTES} AS notes FROM d")
def _x7(t):
    return t("documents").select("doc_id", M.clean_notes(F.concat("text", F.lit(" [1-2] Figure 3.abc"))).alias("notes"))


_SCORE = " + ".join(f"CAST({n} IS NOT NULL AS INT)" for n in ("label", *CORPUS.signals))
_CAP_NOTES = "CASE WHEN length(notes) > 280 THEN rtrim(left(notes, 277)) || '...' ELSE notes END"


@query(
    "x8_sanitize_records",
    f"""WITH {_SEGMENTS}, {_RECORDS}, a AS (SELECT * REPLACE ({_CAP_NOTES} AS notes), {_SCORE} AS score, lower(concat_ws(chr(2), coalesce(label, ''), {', '.join(f"coalesce({n}, '')" for n in CORPUS.signals)})) AS sig FROM rec),
b AS (SELECT * FROM a WHERE score > 1 OR (score = 1 AND coalesce({', '.join(CORPUS.signals)}) IS NOT NULL)), c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY doc_id, sig ORDER BY pos) = 1)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, {', '.join(f'({n} IS NOT NULL) DESC' for n in CORPUS.signals)}, pos) - 1 AS INTEGER) AS rank, label, {', '.join(CORPUS.metrics)}, notes, score FROM c QUALIFY rank < 6""",
)
def _x8(t):
    return M.sanitize_records(M.candidate_records(t("documents"), CORPUS), CORPUS)


_SENTENCES = "list_transform(string_split(regexp_replace(regexp_replace(text, '([0-9])[.]([0-9])', '\\1' || chr(2) || '\\2', 'g'), '([.!?\n])', '\\1' || chr(1), 'g'), chr(1)), lambda v: replace(v, chr(2), '.'))"


@query("x9_evidence_sentences", f"WITH z AS (SELECT doc_id, {_SENTENCES} AS v FROM documents) SELECT * FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS metric, nullif({_SQ.format(f'(list_filter(v, lambda x: regexp_matches(x, {_q(p)})))[1]')}, '') AS sentence FROM z" for n, p in CORPUS.evidence.items()) + ") WHERE sentence IS NOT NULL")
def _x9(t):
    return M.evidence_sentences(t("documents"), CORPUS)


def _sql_count(t: str, pattern: str) -> str:
    return f"(length({t}) - length(regexp_replace({t}, {_q(pattern)}, '', 'g')))"


def _sql_title(line: str) -> str:
    out = _SQ.format(f"regexp_replace(trim({line}), {_q(chr(94) + r'[#*\-' + chr(92) + 's]+')}, '', 'g')")
    for pattern in ("^[ \"'`|]+|[ \"'`|]+$", r"(?i)^(?:article )?title\s*[:-]\s*", r"\s*\[[^\]]+\]\s*$", r"(?i)\s*\(\s*(?:article|review|communication)\s*\)\s*$", r"(?i)\s*doi\s*:\s*10\.[^\s]+$", "^[ ,.;]+|[ ,;]+$"):
        out = f"regexp_replace({out}, {_q(pattern)}, '', 'g')"
    return out


_N_WORDS = "len(list_filter(string_split_regex(title, ' +'), lambda w: w <> ''))"
_NAMES = r"^(?:[A-Z][a-zA-Z'`-]+(?:\s+[A-Z][a-zA-Z'`-]+){0,2}\s*[,*]?\s*){3,}$"
_LOW_STOPS = (*D.TITLE_STOPS, r"@|http|www\.|\.pdf$", r"^[a-z]\s*(?:[a-z]\s+){4,}$", r"\b(?:university|college|institute|school|laboratory|department)\b", r"\b(?:figure|table)\s+[0-9]+\b|\b(?:orcid|supporting information)\b")
_BAD = f"(NOT length(title) BETWEEN 15 AND 300 OR {' OR '.join(f'regexp_matches(lower(title), {_q(p)})' for p in _LOW_STOPS)} OR regexp_matches(title, {_q(_NAMES)}) OR ({_sql_count('title', ',')} >= 3 AND NOT regexp_matches(title, '[:;]')) OR (regexp_matches(lower(title), {_q(chr(92) + r'b(?:j[.]' + chr(92) + 's*[a-z]|adv[.]|nano lett[.]|chem[.])')}) AND {_N_WORDS} <= 6) OR {_sql_count('title', '[0-9]')} > greatest(4, length(title) // 8))"
_ALPHA, _UPPER = _sql_count("title", r"\p{L}"), _sql_count("title", r"\p{Lu}")
_TITLE_SCORE = f"(CASE WHEN heading THEN 5 ELSE 0 END + CASE WHEN place = 0 THEN 4 WHEN place <= 2 THEN 2 ELSE 0 END + CASE WHEN {_N_WORDS} BETWEEN 6 AND 28 THEN 4 ELSE 0 END + CASE WHEN length(title) BETWEEN 40 AND 180 THEN 4 ELSE 0 END + CASE WHEN {_ALPHA} >= 20 AND {_ALPHA} * 100 >= length(title) * 45 THEN 3 ELSE 0 END + CASE WHEN {_UPPER} * 100 < greatest({_ALPHA}, 1) * 45 THEN 2 ELSE 0 END + CASE WHEN contains(title, ':') THEN 1 ELSE 0 END + CASE WHEN ends_with(title, '.') THEN -2 ELSE 0 END)"
_TITLES = f"""l0 AS (SELECT doc_id, string_split(text, chr(10))[1:40] AS v FROM documents), l1 AS (SELECT doc_id, generate_subscripts(v, 1) AS pl, unnest(v) AS line FROM l0),
l2 AS (SELECT doc_id, pl, starts_with(ltrim(line), '#') AS heading, {_sql_title('line')} AS title FROM l1), l3 AS (SELECT doc_id, heading, title, row_number() OVER (PARTITION BY doc_id ORDER BY pl) - 1 AS place, {_BAD} AS bad FROM l2 WHERE title <> ''),
b0 AS (SELECT *, sum(CAST(NOT bad AS INT)) OVER (PARTITION BY doc_id ORDER BY place) AS begun FROM l3 WHERE place < 8), b1 AS (SELECT *, max(CAST(bad AND begun > 0 AS INT)) OVER (PARTITION BY doc_id ORDER BY place) AS stop FROM b0),
b2 AS (SELECT doc_id, row_number() OVER w AS n, string_agg(title, ' ') OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS title, 0 AS place, true AS heading FROM b1 WHERE NOT bad AND stop = 0 WINDOW w AS (PARTITION BY doc_id ORDER BY place)),
blk AS (SELECT doc_id, title, CAST({_TITLE_SCORE} + 2 AS INTEGER) AS score FROM b2 WHERE n <= 3 AND length(title) BETWEEN 20 AND 260 AND NOT {_BAD})"""


@query("x10_rank_titles", f"WITH {_TITLES}, s AS (SELECT doc_id, title, CAST({_TITLE_SCORE} AS INTEGER) AS score, place FROM l3 WHERE place < 20 AND NOT bad UNION ALL SELECT doc_id, title, score, -1 FROM blk) SELECT doc_id, title, score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place, length(title), title DESC) = 1")
def _x10(t):
    return D.rank_titles(t("documents").select("doc_id", "text"))


@query("x11_title_blocks", f"WITH {_TITLES} SELECT * FROM blk")
def _x11(t):
    return D.title_blocks(D.title_lines(t("documents").select("doc_id", "text"))).select("doc_id", "title", "score")


_PAGE_TEXT = r"pg AS (SELECT page_id AS doc_id, regexp_replace(regexp_replace(regexp_replace(html, '<(?:style|script|title)[^>]*>[^<]*', '', 'g'), '</?(?:p|h1|div|li|br)[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS text FROM pages)"


@query("x10_page_titles", f"WITH {_PAGE_TEXT}, {_TITLES.replace('FROM documents', 'FROM pg')}, s AS (SELECT doc_id, title, CAST({_TITLE_SCORE} AS INTEGER) AS score, place FROM l3 WHERE place < 20 AND NOT bad) SELECT doc_id AS page_id, title, score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place, title) = 1")
def _x10p(t):
    """Titles of pages, of whose blocks each is a line."""
    bare = F.regexp_replace("html", "<(?:style|script|title)[^>]*>[^<]*", "")
    text = F.regexp_replace(F.regexp_replace(bare, "</?(?:p|h1|div|li|br)[^>]*>", "\n"), "<[^>]*>", "")
    return D.rank_titles(t("pages").select(F.col("page_id").alias("doc_id"), text.alias("text")), with_blocks=False).withColumnRenamed("doc_id", "page_id")


_PAIR = "(?:^|[^A-Za-z])([A-Z][a-z]+ [A-Z][a-z]+)(?:$|[^A-Za-z])"


@query("x12_author_candidates", f"WITH a AS (SELECT doc_id, regexp_extract_all(left(text, 5000), '{_PAIR}', 1) AS v FROM documents) SELECT doc_id, array_to_string((list_filter(v, lambda x, i: list_position(v, x) = i))[1:10], ', ') AS authors FROM a WHERE len(v) > 0")
def _x12(t):
    return t("documents").select("doc_id", F.array_join(D.author_candidates(F.col("text")), ", ").alias("authors")).where("authors <> ''")


def _numbered(docs):
    """Documents with a sentence of numbers in them, at places from their start to past what the operators look at; the SQL twins read the same texts."""
    n = F.col("doc_id")
    body = F.concat(F.lpad(n.cast("string"), 4, "1"), F.lit("-"), F.lpad((n % 997).cast("string"), 4, "2"))
    tail = F.concat(F.lpad((n + 7).cast("string"), 4, "3"), F.lit("-"), F.lpad((n % 991).cast("string"), 4, "4"))
    said = F.when(n % 3 == 0, F.concat(F.lit(" Print ISSN "), body, F.lit(" Online ISSN "), tail)).when(n % 3 == 1, F.concat(F.lit(" "), body, F.lit(" and "), tail)).otherwise("")
    said = F.concat(said, F.lit(" (impact factor: "), (n % 40 + 1).cast("string"), F.lit(".5) "), F.when(n % 2 == 0, F.concat(F.lit("in "), (n % 20 + 2005).cast("string"), F.lit(". published "), (n % 20 + 2005).cast("string"))).otherwise(""), F.lit(" end. "))
    at = (n * 37 % 6000).cast("int")
    return docs.select("doc_id", F.concat(F.left("text", at), said, F.substring("text", at + 1, F.length("text"))).alias("text"))


_NUMBERED = """n AS (SELECT doc_id, text, CAST(doc_id * 37 % 6000 AS INT) AS place, lpad(CAST(doc_id AS VARCHAR), 4, '1') || '-' || lpad(CAST(doc_id % 997 AS VARCHAR), 4, '2') AS body, lpad(CAST(doc_id + 7 AS VARCHAR), 4, '3') || '-' || lpad(CAST(doc_id % 991 AS VARCHAR), 4, '4') AS tail FROM documents),
t AS (SELECT doc_id, left(text, place) || CASE doc_id % 3 WHEN 0 THEN ' Print ISSN ' || body || ' Online ISSN ' || tail WHEN 1 THEN ' ' || body || ' and ' || tail ELSE '' END || ' (impact factor: ' || (doc_id % 40 + 1) || '.5) '
 || CASE WHEN doc_id % 2 = 0 THEN 'in ' || (doc_id % 20 + 2005) || '. published ' || (doc_id % 20 + 2005) ELSE '' END || ' end. ' || substr(text, place + 1) AS text FROM n)"""
_ISSN = "([0-9]{4}-?[0-9]{3}[0-9Xx])"
_ISSNS = rf"""i AS (SELECT doc_id, nullif(regexp_extract(left(text, 5000), '(?i)\b(?:e-?issn|electronic\s+issn|online\s+issn)\b[^0-9A-Za-z]{{0,10}}{_ISSN}', 1), '') AS e,
 nullif(regexp_extract(left(text, 5000), '(?i)(?:^|[^-A-Za-z])(?:p-?issn|print\s+issn|issn\s*\(print\)|issn)\b[^0-9A-Za-z]{{0,10}}{_ISSN}', 1), '') AS p, regexp_extract_all(left(text, 5000), '\b{_ISSN}\b', 1) AS plain FROM t)"""


@query("x13_issn_candidates", f"WITH {_NUMBERED}, {_ISSNS} SELECT doc_id, coalesce(p, plain[1]) AS issn, coalesce(e, CASE WHEN len(plain) > 1 THEN (list_filter(plain, lambda x: x <> coalesce(p, plain[1])))[1] END) AS eissn FROM i")
def _x13(t):
    return _numbered(t("documents")).select("doc_id", D.issn_candidates(F.col("text")).alias("c")).select("doc_id", "c.issn", "c.eissn")


@query("x14_normalize_name", "WITH p AS (SELECT p_partkey, lower(trim(p_name)) AS c FROM part) SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(c) ELSE upper(trim(regexp_replace(c, '[^a-z0-9]+', ' ', 'g'))) END AS name FROM p")
def _x14(t):
    part = t("part")
    shown = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Cite this: "), "p_name", F.lit(" 2024, 3 (1)"))).otherwise(F.concat("p_name", F.lit(" (12)")))
    aliases = part.select(F.lower(F.trim("p_name")).alias("alias")).distinct().withColumn("name", F.upper("alias"))
    return D.normalize_name(part.select("p_partkey", shown.alias("raw")), "raw", aliases).select("p_partkey", "name")


@query("x15_name_from_hints", "SELECT page_id, CASE WHEN contains(left(lower(url || ' ' || html), 5000), '.org/') THEN 'Organisation' WHEN contains(left(lower(url || ' ' || html), 5000), '.com/') THEN 'Company' WHEN page_id % 2 = 0 THEN 'fallback' END AS name FROM pages")
def _x15(t):
    rows = t("pages").withColumn("t", F.concat_ws(" ", "url", "html"))
    return D.name_from_hints(rows, "t", {".org/": "Organisation", ".com/": "Company"}, F.when(F.col("page_id") % 2 == 0, F.lit("fallback"))).select("page_id", "name")


@query("x16_value_from_head", f"WITH {_NUMBERED}, v AS (SELECT doc_id, TRY_CAST(regexp_extract(left(text, 3000), '(?i)impact\\s+factor[^0-9]{{0,20}}([0-9]+(?:\\.[0-9]+)?)', 1) AS DOUBLE) AS v FROM t) SELECT doc_id, CASE WHEN v > 0.1 AND v < 200 THEN v END AS value FROM v")
def _x16(t):
    return _numbered(t("documents")).select("doc_id", D.value_from_head(F.col("text")).alias("value"))


_YEARS = "list_concat(" * (len(D.YEARS) - 1) + f"regexp_extract_all(h, {_q(D.YEARS[0])}, 1)" + "".join(f", regexp_extract_all(h, {_q(p)}, 1))" for p in D.YEARS[1:])


@query(
    "x17_modal_year",
    f"""WITH t AS (SELECT o_custkey AS doc_id, string_agg('published ' || (year(o_orderdate) + 18), '; ' ORDER BY o_orderkey) AS text FROM orders GROUP BY 1),
e AS (SELECT doc_id, 0 AS side, left(text, 3000) AS h FROM t UNION ALL SELECT doc_id, 1, right(text, 3000) FROM t WHERE length(text) > 6000), f AS (SELECT doc_id, side, {_YEARS} AS ys FROM e),
g AS (SELECT doc_id, side, generate_subscripts(ys, 1) AS i, CAST(unnest(ys) AS INTEGER) AS y FROM f), c AS (SELECT doc_id, y, count(*) AS n, min(side * 100000 + i) AS pl FROM g WHERE y BETWEEN 2010 AND 2026 GROUP BY 1, 2)
SELECT doc_id, y AS year, n AS times FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pl) = 1""",
)
def _x17(t):
    orders = t("orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", F.year("o_orderdate").alias("y")))), lambda x: F.concat(F.lit("published "), (x["y"] + 18).cast("string"))), "; ").alias("text"))
    return D.modal_year(orders)


@query("x17_modal_order_year", "WITH c AS (SELECT o_custkey, year(o_orderdate) AS y, count(*) AS n, min(o_orderkey) AS pl FROM orders GROUP BY ALL) SELECT o_custkey, y AS year, n AS times FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, pl) = 1")
def _x17o(t):
    rows = t("orders").select("o_custkey", F.year("o_orderdate").alias("y"), F.col("o_orderkey").alias("at"))
    return D.modal(rows, "o_custkey", "y", "at").select("o_custkey", F.col("y").alias("year"), F.col("n").alias("times"))


@query("x18_first_class", "SELECT doc_id, CASE " + " ".join("WHEN " + " OR ".join(f"regexp_matches(text, {_q(p)})" for p in ps) + f" THEN '{n}'" for n, ps in CORPUS.classes.items()) + " END AS class FROM documents")
def _x18(t):
    return t("documents").select("doc_id", M.first_class(F.col("text"), CORPUS.classes).alias("class"))


_TAGS = "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(text), {_q(w)})" for w in ws) + f" THEN '{n}' END" for n, ws in CORPUS.tags.items()) + "], lambda x: x IS NOT NULL)"


@query("x19_multi_tags", f"SELECT doc_id, array_to_string({_TAGS}, ',') AS tags, CASE WHEN len({_TAGS}) > 0 THEN 'Uses ' || array_to_string({_TAGS}, ', ') || '.' END AS summary FROM documents")
def _x19(t):
    tags = M.multi_tags(F.col("text"), CORPUS.tags)
    return t("documents").select("doc_id", F.array_join(tags, ",").alias("tags"), M.tag_summary(tags).alias("summary"))


_LABEL, _NUMBER = r"(?:journal\s+)?impact\s+factor", r"([0-9]+(?:\.[0-9]+)?)"
_SHAPES = ((rf"(?i)(20[0-9]{{2}})[^0-9]{{0,20}}{_LABEL}[^0-9]{{0,20}}{_NUMBER}", 1, 2), (rf"(?i){_LABEL}[^0-9]{{0,20}}{_NUMBER}[^0-9]{{1,20}}(20[0-9]{{2}})", 2, 1), (rf"(?i){_LABEL}[^0-9]{{0,20}}{_NUMBER}", 0, 1))
_TRIES = ", ".join(f"TRY_CAST(regexp_extract(text, {_q(p)}, {v}) AS DOUBLE) AS v{i}, " + (f"TRY_CAST(regexp_extract(text, {_q(p)}, {y}) AS INTEGER)" if y else "CAST(NULL AS INTEGER)") + f" AS y{i}" for i, (p, y, v) in enumerate(_SHAPES))


@query("p24_value_year_from_text", f"WITH {_NUMBERED}, v AS (SELECT doc_id, {_TRIES} FROM t) SELECT doc_id, CASE WHEN v0 BETWEEN 0.1 AND 200 THEN y0 WHEN v1 BETWEEN 0.1 AND 200 THEN y1 END AS year, CASE WHEN v0 BETWEEN 0.1 AND 200 THEN v0 WHEN v1 BETWEEN 0.1 AND 200 THEN v1 WHEN v2 BETWEEN 0.1 AND 200 THEN v2 END AS value FROM v")
def _p24(t):
    return _numbered(t("documents")).select("doc_id", D.value_year_from_text(F.col("text")).alias("x")).select("doc_id", "x.year", "x.value")


@query(
    "p25_json_value_search",
    "WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events), c AS (SELECT event_id, 2020 + k % 5 AS year, k % 100 + 1.5 AS value FROM e UNION ALL SELECT event_id, 2022, k % 50 + 0.5 FROM e UNION ALL SELECT event_id, 2019, k % 90 + 1.0 FROM e)"
    " SELECT event_id, CAST(year AS INTEGER) AS year, CAST(value AS DOUBLE) AS value FROM c QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY year DESC, value DESC) = 1",
)
def _p25(t):
    k = F.get_json_object("props", "$.k").cast("int")
    deep = F.concat(F.lit('{"profile": {"metrics": {"jcr": {"citationReportYear": '), (2020 + k % 5).cast("string"), F.lit(', "jif": '), (k % 100 + 1).cast("string"), F.lit('.5}}}, "indicators": [{"x": [{"jif2022": "'), (k % 50).cast("string"), F.lit('.5", "jif2019": '), (k % 90 + 1).cast("string"), F.lit("}]}]}"))
    return D.json_value_search(spread(t("events")).select("event_id", deep.alias("j")), "event_id", "j")
