"""Queries of the block operators. Documents are single lines of prose, so an outline with headings, lists, captions, tables and blank lines is derived
from every document's own lines first; the SQL twins derive the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.functions import outline as O  # noqa: E741
from docmill.functions.lexicons import CORPUS_LEXICON, FIGURE_CAPTION, LIST_MARK, TABLE_RULE
from docmill.operators import blocks as B
from docmill.plans.registry import Tables, query

NOISE = ("the", "die", "la", "references")
LEX = CORPUS_LEXICON


def outline(docs: DataFrame) -> DataFrame:
    """Documents as Markdown: by a line's place it becomes a heading, a list item, a caption, a table, or a paragraph of its own."""

    def mark(line, i):
        bare = F.replace(F.trim(line), F.lit("|"), F.lit(" "))
        table = F.concat(F.lit("| a | b |\n| --- | --- |\n| "), F.left(bare, F.lit(20)), F.lit(" | 1 |"))
        return (
            F.when(i % 21 == 14, F.concat(F.lit("# References "), F.left(bare, F.lit(10))))
            .when(i % 7 == 0, F.concat(F.repeat(F.lit("#"), (1 + F.length(line) % 3).cast("int")), F.lit(" "), F.left(bare, F.lit(30))))
            .when(i % 7 == 3, F.concat(F.lit("- "), bare))
            .when(i % 7 == 5, F.concat(F.lit("Figure "), i.cast("string"), F.lit(" "), bare))
            .when(i % 13 == 8, table)
            .when(i % 5 == 2, F.concat(bare, F.lit("\n")))
            .otherwise(bare)
        )

    return docs.select("doc_id", F.array_join(F.transform(F.split("text", "\n"), mark), "\n").alias("text"))


_OUTLINE = r"""
docs AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l, j: CASE
   WHEN (j-1) % 21 = 14 THEN '# References ' || left(replace(trim(l), '|', ' '), 10)
   WHEN (j-1) % 7 = 0 THEN repeat('#', 1 + length(l) % 3) || ' ' || left(replace(trim(l), '|', ' '), 30)
   WHEN (j-1) % 7 = 3 THEN '- ' || replace(trim(l), '|', ' ')
   WHEN (j-1) % 7 = 5 THEN 'Figure ' || CAST(j-1 AS VARCHAR) || ' ' || replace(trim(l), '|', ' ')
   WHEN (j-1) % 13 = 8 THEN '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || left(replace(trim(l), '|', ' '), 20) || ' | 1 |'
   WHEN (j-1) % 5 = 2 THEN replace(trim(l), '|', ' ') || chr(10)
   ELSE replace(trim(l), '|', ' ') END), chr(10)) AS text FROM documents)"""

_BLOCKS = rf"""
l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM docs),
l1 AS (SELECT *, trim(line) AS bare, lead(trim(line)) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM l0),
l2 AS (SELECT *, bare = '' AS blank, regexp_matches(line, '^#{{1,6}}[ \t]+[^ \t]') AS head, starts_with(bare, '|') AND coalesce(regexp_matches(nxt, '{TABLE_RULE}'), false) AS opens,
   bare <> '' AND contains(bare, '|') AND NOT starts_with(bare, '#') AS pipe, regexp_matches(bare, '{FIGURE_CAPTION}') AS cap, regexp_matches(bare, '{LIST_MARK}') AS item FROM l1),
l3 AS (SELECT *, sum(CAST(NOT pipe AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM l2),
l4 AS (SELECT *, coalesce(pipe AND pos >= min(CASE WHEN opens THEN pos END) OVER (PARTITION BY doc_id, island), false) AS tab FROM l3),
l5 AS (SELECT *, sum(CAST(blank OR head OR tab AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS chunk FROM l4),
l6 AS (SELECT *, CASE WHEN blank THEN NULL WHEN head THEN 'heading' WHEN tab THEN 'table' WHEN pos >= min(CASE WHEN cap AND NOT blank AND NOT head AND NOT tab THEN pos END) OVER (PARTITION BY doc_id, chunk) THEN 'figure_caption'
   WHEN item THEN 'list' ELSE 'paragraph' END AS type FROM l5),
l7 AS (SELECT *, type IS NOT NULL AND (type = 'heading' OR NOT coalesce(lag(type) OVER (PARTITION BY doc_id ORDER BY pos) = type, false)) AS starts FROM l6),
l8 AS (SELECT *, sum(CAST(starts AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM l7),
b0 AS (SELECT doc_id, CAST(block - 1 AS INTEGER) AS idx, min(type) AS type, string_agg(CASE WHEN type = 'table' THEN line ELSE bare END, chr(10) ORDER BY pos) AS text FROM l8 WHERE type IS NOT NULL GROUP BY doc_id, block),
b1 AS (SELECT *, CASE WHEN type = 'heading' THEN length(regexp_extract(text, '^#+')) END AS level, CASE WHEN type = 'heading' THEN trim(regexp_replace(text, '^#+[ \t]*', '')) END AS title FROM b0)"""

_UP = "OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_PATH = (
    "p0 AS (SELECT *, "
    + ", ".join(f"last_value(CASE WHEN level = {n} THEN idx END IGNORE NULLS) {_UP} AS i{n}, last_value(CASE WHEN level = {n} THEN title END IGNORE NULLS) {_UP} AS t{n}, last_value(CASE WHEN level < {n} THEN idx END IGNORE NULLS) {_UP} AS a{n}" for n in B.LEVELS)
    + " FROM b1),\np1 AS (SELECT doc_id, idx, type, text, level, title, list_filter(["
    + ", ".join(f"CASE WHEN i{n} > coalesce(a{n}, -1) THEN t{n} END" for n in B.LEVELS)
    + "], lambda x: x IS NOT NULL) AS path FROM p0)"
)


def _noise(title: str) -> str:
    return f"coalesce(regexp_matches({title}, '(?i)^[0-9. ]*(?:{'|'.join(NOISE)})'), false)"


_CUT = f"""
c0 AS (SELECT *, max(CASE WHEN type = 'heading' AND {_noise('title')} THEN idx END) OVER (PARTITION BY doc_id) AS ln FROM p1),
c1 AS (SELECT *, max(CASE WHEN type = 'heading' AND NOT {_noise('title')} AND idx < ln THEN idx END) OVER (PARTITION BY doc_id) AS lb FROM c0),
c2 AS (SELECT *, min(CASE WHEN type = 'heading' AND {_noise('title')} AND idx > coalesce(lb, -1) THEN idx END) OVER (PARTITION BY doc_id) AS cut FROM c1),
c3 AS (SELECT doc_id, idx, type, text, level, title, path FROM c2 WHERE cut IS NULL OR idx < cut)"""

_KINDS = "type IN ('paragraph', 'figure_caption', 'list') AND trim(text) <> ''"
_ANCHOR = f"""
n0 AS (SELECT *, last_value(CASE WHEN {_KINDS} THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
   first_value(CASE WHEN {_KINDS} THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after,
   CASE WHEN type = 'table' THEN printf('TABLE_%04d', row_number() OVER (PARTITION BY doc_id, type ORDER BY idx)) END AS anchor FROM p1),
a1 AS (SELECT doc_id, idx, CASE WHEN anchor IS NULL THEN type ELSE 'table_anchor' END AS type, CASE WHEN anchor IS NULL THEN text ELSE '[' || anchor || ']' END AS text, level, title, path FROM n0)"""


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sum(words, text: str) -> str:
    return " + ".join(f"CAST(contains({text}, {_q(w)}) AS INT)" for w in words)


def _or(words, text: str) -> str:
    return "(" + " OR ".join(f"contains({text}, {_q(w)})" for w in words) + ")"


_SCORE = f"""
s0 AS (SELECT *, lower(text) AS low, lower(array_to_string(path, ' ')) AS context, path[len(path)] AS own FROM a1),
s1 AS (SELECT *, {_sum(LEX.parameters, 'low')} AS np, {_sum(LEX.structures, 'low')} AS ns, {' + '.join(f"CAST(regexp_matches(text, {_q(p)}) AS INT)" for p in LEX.metrics)} AS nm FROM s0),
s2 AS (SELECT doc_id, idx, type, text, level, title, path, CASE WHEN type = 'table_anchor' THEN 1000 ELSE np * 25 + ns * 20 + nm * 30 + CASE WHEN {_or(LEX.priority_titles, 'context')} THEN 18 ELSE 0 END
   + CASE WHEN type = 'heading' AND {_or(LEX.priority_titles, 'lower(coalesce(own, low))')} THEN 12 ELSE 0 END + CASE WHEN type = 'figure_caption' THEN 20 ELSE 0 END + CASE WHEN type = 'list' THEN 4 ELSE 0 END
   + CASE WHEN regexp_matches(text, '[0-9]') AND np + ns > 0 THEN 15 ELSE 0 END - CASE WHEN {_or(LEX.noisy_titles, 'context')} THEN 10 ELSE 0 END
   - CASE WHEN coalesce(regexp_matches(coalesce(own, text), '(?i)^[0-9. ]*(?:{'|'.join(LEX.noise)})'), false) THEN 60 ELSE 0 END END / 10 AS score FROM s1)"""

_NEAR = "OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"
_KEPT = f"""
k0 AS (SELECT *, {_noise('path[len(path)]')} AS noisy FROM s2),
k1 AS (SELECT *, type = 'table_anchor' AND NOT noisy AS anchor, NOT noisy AND (score >= 3.0 OR type = 'table_anchor') AS seed FROM k0),
k2 AS (SELECT *, max(CAST(seed AS INT)) {_NEAR} = 1 AS keep, max(CAST(anchor AS INT)) {_NEAR} = 1 OR score >= 5.0 AS mandatory FROM k1),
k3 AS (SELECT doc_id, idx, type, text, level, title, path, score, mandatory FROM k2 WHERE keep AND NOT noisy)"""

MAX_BLOCKS, MAX_CHARS = 12, 1500
_TRIM = f"""
t0 AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, sum(length(text) + 2) OVER (PARTITION BY doc_id) AS t,
   count(*) OVER (PARTITION BY doc_id, mandatory ORDER BY score, length(text), idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gone,
   coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id, mandatory ORDER BY score, length(text), idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chars FROM k3),
t1 AS (SELECT doc_id, idx, type, text, level, title, path, score, mandatory FROM t0 WHERE mandatory OR NOT (n - gone > {MAX_BLOCKS} OR t - chars > {MAX_CHARS}))"""
_COMPOSE = f"""
m0 AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY type <> 'table_anchor', idx) AS whole FROM t1 GROUP BY doc_id),
m1 AS (SELECT *, left(whole, {MAX_CHARS}) AS head, length(left(whole, {MAX_CHARS})) - instr(reverse(left(whole, {MAX_CHARS})), chr(10) || chr(10)) - 1 AS cut, instr(reverse(left(whole, {MAX_CHARS})), chr(10) || chr(10)) AS back FROM m0),
m2 AS (SELECT doc_id, CASE WHEN length(whole) <= {MAX_CHARS} THEN whole WHEN back > 0 AND cut > 0 THEN left(head, cut) ELSE head END AS condensed FROM m1)"""


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts)


def _paths(t: Tables) -> DataFrame:
    return B.heading_path(B.outlines(outline(t("documents"))))


def _scored(t: Tables) -> DataFrame:
    return B.score_blocks(B.anchor_tables(_paths(t))[0], LEX)


def _kept(t: Tables) -> DataFrame:
    return B.select_with_neighbours(_scored(t), 1, 3.0, NOISE)


def _trimmed(t: Tables) -> DataFrame:
    return B.trim_to_budget(_kept(t), MAX_BLOCKS, MAX_CHARS)


@query("b1_split_blocks", _with(_OUTLINE, _BLOCKS) + " SELECT doc_id, idx, type, text FROM b1")
def _b1(t):
    return B.split_blocks(outline(t("documents"))).select("doc_id", "idx", "type", "text")


@query("b1_split_turns", _with("docs AS (SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations)", _BLOCKS) + " SELECT type, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM b1 GROUP BY type")
def _b1c(t):
    turns = t("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return B.split_blocks(turns).groupBy("type").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))


@query("b2_heading_path", _with(_OUTLINE, _BLOCKS, _PATH) + " SELECT doc_id, idx, array_to_string(path, ' > ') AS path FROM p1")
def _b2(t):
    return B.exploded(_paths(t)).select("doc_id", "idx", F.array_join("path", " > ").alias("path"))


@query("b3_cut_tail_noise", _with(_OUTLINE, _BLOCKS, _PATH, _CUT) + " SELECT doc_id, count(*) AS blocks, max(idx) AS last FROM c3 GROUP BY doc_id")
def _b3(t):
    left = B.cut_tail_noise(_paths(t), NOISE)
    ends = left.select("doc_id", F.size("blocks").cast("long").alias("blocks"), F.explode_outer(F.slice("blocks", -1, 1)).alias("end"))
    return ends.where("end is not null").select("doc_id", "blocks", F.col("end")["idx"].alias("last"))


@query("b4_anchor_tables", _with(_OUTLINE, _BLOCKS, _PATH, _ANCHOR) + " SELECT doc_id, anchor, idx, array_to_string(path, ' > ') AS path, text, before, after FROM n0 WHERE anchor IS NOT NULL")
def _b4(t):
    return B.anchor_tables(_paths(t))[1].withColumn("path", F.array_join("path", " > "))


@query("b5_neighbor_text", _with(_OUTLINE, _BLOCKS, _PATH, _ANCHOR) + " SELECT doc_id, idx, before, after FROM n0 WHERE type = 'heading'")
def _b5(t):
    return B.exploded(B.neighbor_text(_paths(t))).where("type = 'heading'").select("doc_id", "idx", "before", "after")


@query("b6_score_blocks", _with(_OUTLINE, _BLOCKS, _PATH, _ANCHOR, _SCORE) + " SELECT doc_id, idx, type, CAST(score AS DOUBLE) AS score FROM s2")
def _b6(t):
    return B.exploded(_scored(t)).select("doc_id", "idx", "type", "score")


@query("b7_select_with_neighbours", _with(_OUTLINE, _BLOCKS, _PATH, _ANCHOR, _SCORE, _KEPT) + " SELECT doc_id, idx, mandatory FROM k3")
def _b7(t):
    return B.exploded(_kept(t)).select("doc_id", "idx", "mandatory")


@query(
    "b8_heading_context",
    _with(_OUTLINE, _BLOCKS, _PATH, _ANCHOR, _SCORE, _KEPT, "w AS (SELECT doc_id, idx AS at, unnest(path) AS title FROM k3)")
    + " SELECT DISTINCT doc_id, idx FROM (SELECT w.doc_id, w.title, w.at, max(h.idx) AS idx FROM w JOIN b1 h ON h.type = 'heading' AND h.doc_id = w.doc_id AND h.title = w.title AND h.idx < w.at GROUP BY ALL)",
)
def _b8(t):
    scored = _scored(t)
    return B.heading_context(scored.withColumn("kept", O.selected(F.col("blocks"), 1, 3.0, NOISE)))


@query("b9_trim_to_budget", _with(_OUTLINE, _BLOCKS, _PATH, _ANCHOR, _SCORE, _KEPT, _TRIM) + " SELECT doc_id, idx, CAST(score AS DOUBLE) AS score FROM t1")
def _b9(t):
    return B.exploded(_trimmed(t)).select("doc_id", "idx", "score")


@query("b10_compose_condensed", _with(_OUTLINE, _BLOCKS, _PATH, _ANCHOR, _SCORE, _KEPT, _TRIM, _COMPOSE) + " SELECT doc_id, condensed FROM m2")
def _b10(t):
    return B.compose_condensed(_trimmed(t), MAX_CHARS)


_TOPICS = {"abstract": ("the", "der"), "introduction": ("la", "in"), "results": ("on", "en")}


@query(
    "b11_section_rollup",
    _with(_OUTLINE, _BLOCKS, _PATH, "r AS (SELECT *, CASE " + " ".join(f"WHEN regexp_matches(path[1], '(?i)^[0-9. ]*(?:{'|'.join(v)})') THEN '{k}'" for k, v in _TOPICS.items()) + " ELSE 'other' END AS section FROM p1)")
    + " SELECT doc_id, section, count(*) AS n_blocks, string_agg(text, chr(10) || chr(10) ORDER BY idx) AS text FROM r GROUP BY doc_id, section",
)
def _b11(t):
    return B.section_rollup(_paths(t), _TOPICS)


_FLAT = "f0 AS (SELECT *, sum(CAST(type = 'heading' AS INT)) OVER (PARTITION BY doc_id ORDER BY idx) AS pos FROM b1), f1 AS (SELECT doc_id, CAST(pos AS BIGINT) AS pos, coalesce(max(title), 'Document') AS title, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY idx) FILTER (type <> 'heading'), '') AS content FROM f0 GROUP BY doc_id, pos)"


@query("b12_flat_sections", _with(_OUTLINE, _BLOCKS, _FLAT) + " SELECT * FROM f1")
def _b12(t):
    return B.flat_sections(B.outlines(outline(t("documents"))))


@query(
    "b13_extract_pipe_tables",
    _with(_OUTLINE, r"x AS (SELECT doc_id, regexp_extract_all(text, '(?m)(^\|[^\n]*\|[ \t]*\n\|[-:| \t]+\|[ \t]*(?:\n\|[^\n]*\|[ \t]*)*)', 1) AS found FROM docs), y AS (SELECT doc_id, CAST(generate_subscripts(found, 1) - 1 AS INTEGER) AS pos, unnest(found) AS tab FROM x)")
    + " SELECT doc_id, pos, CAST(len(string_split(tab, chr(10))) - 2 AS INTEGER) AS n_rows, array_to_string(list_transform(list_filter(string_split(string_split(tab, chr(10))[1], '|'), lambda c: trim(c) <> ''), lambda c: trim(c)), '|') AS header FROM y",
)
def _b13(t):
    return B.extract_pipe_tables(outline(t("documents")))


@query(
    "b14_reduction_stats",
    _with(_OUTLINE, _BLOCKS, _PATH, _ANCHOR, _SCORE, _KEPT, _TRIM, _COMPOSE)
    + " SELECT d.doc_id, length(d.text) AS original, coalesce(length(condensed), 0) AS cleaned, CASE WHEN length(d.text) > 0 THEN 1 - coalesce(length(condensed), 0) / length(d.text) END AS reduction FROM docs d LEFT JOIN m2 USING (doc_id)",
)
def _b14(t):
    return B.reduction_stats(_trimmed(t).withColumn("condensed", O.condensed(F.col("blocks"), MAX_CHARS)))


@query("b15_find_section", _with(_OUTLINE, _BLOCKS, _FLAT) + " SELECT doc_id, arg_min(title, pos) AS title, arg_min(content, pos) AS content FROM f1 WHERE regexp_matches(title, '(?i)ref|on') GROUP BY doc_id")
def _b15(t):
    return B.find_section(B.outlines(outline(t("documents"))), "(?i)ref|on")


@query(
    "b14_removed_titles",
    _with(_OUTLINE, _BLOCKS, _PATH, _ANCHOR, _SCORE, _KEPT)
    + """, g0 AS (SELECT doc_id, path[len(path)] AS title, min(idx) AS idx FROM s2 WHERE len(path) > 0 GROUP BY ALL), g1 AS (SELECT DISTINCT doc_id, path[len(path)] AS title FROM k3 WHERE len(path) > 0)
 SELECT doc_id, string_agg(title, ' > ' ORDER BY idx) AS titles FROM g0 ANTI JOIN g1 USING (doc_id, title) GROUP BY doc_id""",
)
def _b14r(t):
    gone = B.removed_titles(_scored(t).withColumn("kept", O.selected(F.col("blocks"), 1, 3.0, NOISE)))
    return gone.select("doc_id", F.array_join("titles", " > ").alias("titles"))


@query(
    "b13_pipe_table",
    """SELECT r_name, '| name | key | note |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || n_name || ' | ' || n_nationkey || ' |' || CASE WHEN n_nationkey % 2 = 0 THEN ' even |' ELSE '  |' END, chr(10) ORDER BY n_nationkey) AS text
FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
)
def _b13i(t):
    cells = F.array_compact(F.array("n_name", F.col("n_nationkey").cast("string"), F.when(F.col("n_nationkey") % 2 == 0, "even")))
    rows = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", cells.alias("cells")))).alias("rows"))
    return rows.select("r_name", B.pipe_table(F.array(F.lit("name"), F.lit("key"), F.lit("note")), F.transform("rows", lambda r: r["cells"])).alias("text"))
