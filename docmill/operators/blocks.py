"""Structure of documents: blocks, heading paths, tables, scores, selection within a budget.

A document and its blocks are one row, (doc_id, text, blocks), from outlines() on: a chain of operators works on the array in that row and exchanges
nothing, however many documents there are, and documents may share an id. exploded() gives a row for each block. Tables that already are rows of blocks
(doc_id, idx, ...) are taken as well: they are gathered by doc_id first, and answered as rows.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions import outline as O  # noqa: E741
from docmill.functions.lexicons import SECTION_TITLES, BlockLexicon

LEVELS = range(1, 7)


def outlines(docs: DataFrame) -> DataFrame:
    """B1: (doc_id, text, blocks). A blank line ends a block, and so does a change of type; a heading is a block of its own.

    Types: heading, table (pipe lines from a header line with a rule below it), figure_caption, list, paragraph. A null text has no blocks."""
    return docs.select("doc_id", "text", O.blocks_of(F.col("text")).alias("blocks"))


def _each(outline: DataFrame, array: Column, *names: str) -> DataFrame:
    """A row for each struct of an array. The outer generator with a filter behind it, as Spark would put a filter on the array below the plain one and there work out
    the whole chain of the array again, twice for each operator in it."""
    rows = outline.select("doc_id", F.explode_outer(array).alias("__x")).where("__x is not null")
    return rows.select("doc_id", *([f"__x.{n}" for n in names] or ["__x.*"]))


def _one(outline: DataFrame, value: Column, name: str) -> DataFrame:
    """(doc_id, value) of documents whose value is not null; a filter on the value itself would be worked out apart, as above."""
    return outline.select("doc_id", F.explode_outer(F.array(value)).alias(name)).where(F.col(name).isNotNull())


def exploded(outline: DataFrame) -> DataFrame:
    """A row for each block."""
    return _each(outline, F.col("blocks"))


def gathered(rows: DataFrame) -> DataFrame:
    """Rows of blocks as (doc_id, blocks), in the order of idx."""
    rest = [c for c in rows.columns if c not in ("doc_id", "idx")]
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", *rest))).alias("blocks"))


def _on_either(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator on outlines that also takes and gives rows of blocks."""

    @functools.wraps(operator)
    def apply(blocks: DataFrame, *more, **named) -> DataFrame:
        if "blocks" in blocks.columns:
            return operator(blocks, *more, **named)
        return exploded(operator(gathered(blocks), *more, **named))

    return apply


def _outline(blocks: DataFrame) -> DataFrame:
    return blocks if "blocks" in blocks.columns else gathered(blocks)


def split_blocks(docs: DataFrame) -> DataFrame:
    """B1 as rows: (doc_id, idx, type, text, level, title, section)."""
    return exploded(outlines(docs))


@_on_either
def heading_path(blocks: DataFrame) -> DataFrame:
    """B2: blocks with path, the open headings above each block and its own. Of each level the last heading counts, if no higher one came after it."""
    return blocks.withColumn("blocks", O.with_path(F.col("blocks")))


@_on_either
def cut_tail_noise(blocks: DataFrame, noise: tuple[str, ...]) -> DataFrame:
    """Blocks before the first heading of the last run of noise headings."""
    return blocks.withColumn("blocks", O.before_tail_noise(F.col("blocks"), noise))


def anchor_tables(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks (with path) with tables replaced by [TABLE_nnnn], and the anchors (doc_id, anchor, idx, path, text, before, after)."""
    rows = _outline(blocks)
    found = rows.withColumn("blocks", O.with_anchors(O.with_neighbours(F.col("blocks"))))
    anchors = _each(found, F.filter("blocks", lambda b: b["anchor"].isNotNull()), "anchor", "idx", "path", "text", "before", "after")
    replaced = rows.withColumn("blocks", O.anchored(F.col("blocks")))
    return replaced if "blocks" in blocks.columns else exploded(replaced), anchors


@_on_either
def neighbor_text(blocks: DataFrame, kinds: tuple[str, ...] = O.SAID) -> DataFrame:
    """Blocks with before and after, the nearest texts of the given kinds."""
    return blocks.withColumn("blocks", O.with_neighbours(F.col("blocks"), kinds))


@_on_either
def score_blocks(blocks: DataFrame, lexicon: BlockLexicon) -> DataFrame:
    """Blocks (with path) with score: words, measured values, titles, captions and lists add, noisy titles take away. Table anchors have 100."""
    return blocks.withColumn("blocks", O.with_score(F.col("blocks"), lexicon))


@_on_either
def select_with_neighbours(blocks: DataFrame, k: int = 1, least: float = 3.0, noise: tuple[str, ...] = ("\\A(?!)",)) -> DataFrame:
    """Kept blocks with mandatory. Seeds score at least ``least``; they and k neighbours on either side stay, noise sections aside. Mandatory: table
    anchors with their neighbours, and scores of least + 2 and more."""
    return blocks.withColumn("blocks", O.selected(F.col("blocks"), k, least, noise))


def heading_context(kept: DataFrame, headings: DataFrame | None = None) -> DataFrame:
    """The nearest earlier heading for each title on the path of a kept block: (doc_id, idx).

    kept: an outline with all its blocks in ``blocks`` and the kept ones in ``kept``; or rows of kept blocks, and the headings (doc_id, idx, title) as rows."""
    if headings is None:
        return kept.select("doc_id", F.explode_outer(O.context_of(F.col("kept"), F.col("blocks"))).alias("idx")).where("idx is not null")
    wanted = kept.select("doc_id", F.col("idx").alias("__at"), F.explode("path").alias("title"))
    named = headings.select("doc_id", F.col("idx").alias("__h"), "title")
    met = wanted.join(named.hint("merge"), ["doc_id", "title"]).where("__h < __at")
    return met.groupBy("doc_id", "title", "__at").agg(F.max("__h").alias("idx")).select("doc_id", "idx").distinct()


@_on_either
def trim_to_budget(kept: DataFrame, max_blocks: int = 80, max_chars: int = 24_000) -> DataFrame:
    """Optional blocks go, lowest (score, length, idx) first, until both budgets hold; a block costs its length and 2."""
    return kept.withColumn("blocks", O.trimmed(F.col("blocks"), max_blocks, max_chars))


def compose_condensed(kept: DataFrame, max_chars: int = 24_000) -> DataFrame:
    """(doc_id, condensed): one text a document, table anchors first, then the blocks in order, cut at max_chars on a blank line."""
    return _one(_outline(kept), O.condensed(F.col("blocks"), max_chars), "condensed")


def section_rollup(blocks: DataFrame, titles: dict[str, tuple[str, ...]] = SECTION_TITLES) -> DataFrame:
    """(doc_id, section, n_blocks, text): blocks (with path) by the kind of their top heading, joined in order."""
    return _each(_outline(blocks), O.rolled_up(F.col("blocks"), titles))


def flat_sections(blocks: DataFrame) -> DataFrame:
    """(doc_id, pos, title, content): each heading with what follows it; what comes before the first, or all, is "Document"."""
    return _each(_outline(blocks), O.sections_of(F.col("blocks")))


def find_section(sections: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, title, content) of the first section whose title matches. Takes outlines, or the rows of flat_sections."""
    if "blocks" in sections.columns:
        hit = F.get(F.filter(O.sections_of(F.col("blocks")), lambda s: s["title"].rlike(pattern)), F.lit(0))
        return _one(sections, hit, "s").select("doc_id", "s.title", "s.content")
    hit = sections.where(F.col("title").rlike(pattern)).groupBy("doc_id").agg(F.min_by(F.struct("title", "content"), "pos").alias("s"))
    return hit.select("doc_id", "s.title", "s.content")


PIPE_TABLE = r"(?m)(^\|[^\n]*\|[ \t]*\n\|[-:| \t]+\|[ \t]*(?:\n\|[^\n]*\|[ \t]*)*)"


def extract_pipe_tables(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, n_rows, header) of every pipe table in a text."""
    found = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(PIPE_TABLE), F.lit(1))).alias("pos", "table"))
    rows = F.split("table", "\n")
    cells = F.transform(F.filter(F.split(rows[0], r"\|"), lambda c: F.trim(c) != ""), lambda c: F.trim(c))
    return found.select("doc_id", "pos", (F.size(rows) - 2).alias("n_rows"), F.concat_ws("|", cells).alias("header"))


def pipe_table(header: Column, rows: Column) -> Column:
    """B13, the inverse: a Markdown table of a header and an array of rows; short rows are filled up, long ones cut, a null cell is empty, no header gives an empty text."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | ", ""), F.lit(" |"))
    fit = lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), F.greatest(F.size(header) - F.size(r), F.lit(0)))), F.lit(1), F.size(header))
    whole = F.concat(F.array(line(header), line(F.array_repeat(F.lit("---"), F.size(header)))), F.transform(rows, lambda r: line(fit(r))))
    return F.when(F.size(header) > 0, F.array_join(whole, "\n")).otherwise("")


def reduction_stats(docs: DataFrame, condensed: DataFrame | None = None) -> DataFrame:
    """(doc_id, original, cleaned, reduction): the share of characters that condensing took away.

    docs: with text and condensed in one row, or with text alone and the condensed texts in a table of their own."""
    if condensed is not None:
        docs = docs.select("doc_id", "text").join(condensed.select("doc_id", "condensed").hint("merge"), "doc_id", "left")
    rows = docs.select("doc_id", F.length("text").alias("original"), F.coalesce(F.length("condensed"), F.lit(0)).alias("cleaned"))
    return rows.withColumn("reduction", F.when(F.col("original") > 0, 1 - F.col("cleaned") / F.col("original")))


def removed_titles(blocks: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """(doc_id, titles): the titles of the sections, that is the last headings on the paths, of which no block was kept, in order. Documents that
    lost none are left out.

    blocks: an outline with all its blocks in ``blocks`` and the kept ones in ``kept``; or rows of all blocks, and rows of the kept ones."""
    if kept is None:
        return _one(blocks, O.let(O.removed_of(F.col("blocks"), F.col("kept")), lambda x: F.when(F.size(x) > 0, x)), "titles")
    title = F.try_element_at(F.col("path"), F.lit(-1))
    first = blocks.where(F.size("path") > 0).groupBy("doc_id", title.alias("title")).agg(F.min("idx").alias("idx"))
    left = kept.where(F.size("path") > 0).select("doc_id", title.alias("title")).distinct()
    gone = first.join(left.hint("merge"), ["doc_id", "title"], "left_anti")
    return gone.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "title"))), lambda x: x["title"]).alias("titles"))
