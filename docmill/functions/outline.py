"""The blocks of one text as an array of structs: every function takes and gives columns, so that a chain of them stays in the row of its document.

Nothing is exchanged and no array grows element by element: states that run along a text (tables, captions, sections) are runs of a regular expression over
lines marked by their class, positions are found in a string with one character a block, sums that run are folds to numbers. The work is linear in the blocks,
but for heading paths, which copy pointers with the square of a document's headings.
"""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmill.functions.lexicons import FIGURE_CAPTION, LIST_MARK, SECTION_TITLES, TABLE_RULE, BlockLexicon
from docmill.functions.text import _last_place, let

SAID = ("paragraph", "figure_caption", "list")


# Classes of lines: blank b, heading h, opening line of a table o; caption c, list item i, other text t, and C, I, P for the same with a pipe in them.
# A table runs from its opening line over all lines with pipes, a caption to the next blank line, heading or table.
_BLOCK = r"h[^\n]*+|o[^\n]*+(?:\n[oCIP][^\n]*+)*+|[cC][^\n]*+(?:\n[cCiItP][^\n]*+)*+|[iI][^\n]*+(?:\n[iI][^\n]*+)*+|[tP][^\n]*+(?:\n[tP][^\n]*+)*+"
_SECTION = r"h[^\n]*+(?:\n[^h][^\n]*+)*+|[^h\n][^\n]*+(?:\n[^h][^\n]*+)*+"


def lines_of(text: Column) -> Column:
    """The lines of a text, with every line break as \\n."""
    return F.split(F.regexp_replace(text, "\r\n|[\r\x0B\f\u0085\u2028]", "\n"), "\n")


def _marked(line: Column, following: Column) -> Column:
    bare = F.trim(line)
    pipe = bare.contains("|") & ~bare.startswith("#")
    opens = bare.startswith("|") & F.coalesce(F.trim(following).rlike(TABLE_RULE), F.lit(False))
    kind = F.when(bare.rlike(FIGURE_CAPTION), F.when(pipe, "C").otherwise("c")).when(bare.rlike(LIST_MARK), F.when(pipe, "I").otherwise("i")).otherwise(F.when(pipe, "P").otherwise("t"))
    mark = F.when(bare == "", "b").when(line.startswith("#") & line.rlike(r"^#{1,6}[ \t]+[^ \t]"), "h").when(opens, "o").otherwise(kind)
    return F.concat(mark, line)


def _block(run: Column, section: Column) -> Column:
    kind = F.left(run, F.lit(1))
    type_ = F.when(kind == "h", "heading").when(kind == "o", "table").when(F.lower(kind) == "c", "figure_caption").when(F.lower(kind) == "i", "list").otherwise("paragraph")
    text = F.when(kind == "o", F.regexp_replace(run, r"(?dm)^.", "")).otherwise(F.regexp_replace(run, r"(?dm)^. *+| ++$", ""))
    return let(
        F.struct(type_.alias("type"), text.alias("text")),
        lambda b: F.struct(
            F.lit(0).alias("idx"), b["type"].alias("type"), b["text"].alias("text"),
            F.when(b["type"] == "heading", F.length(F.regexp_extract(b["text"], "^#+", 0))).alias("level"),
            F.when(b["type"] == "heading", F.trim(F.regexp_replace(b["text"], r"^#+[ \t]*", ""))).alias("title"),
            section.cast("int").alias("section"),
        ),
    )


def blocks_of(text: Column) -> Column:
    """B1: array of (idx, type, text, level, title, section); section counts the headings up to the block."""
    lines = lines_of(text)
    marked = let(lines, lambda x: F.array_join(F.zip_with(x, F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0))), _marked), "\n"))

    def parts(m: Column) -> Column:
        first = m.startswith("h").cast("int")
        return F.flatten(F.transform(F.regexp_extract_all(m, F.lit(_SECTION), F.lit(0)), lambda s, i: F.transform(F.regexp_extract_all(s, F.lit(_BLOCK), F.lit(0)), lambda run: _block(run, i + first))))

    blocks = F.transform(let(marked, parts), lambda b, i: b.withField("idx", i))
    return F.when(text.isNotNull(), blocks).otherwise(F.filter(blocks, lambda b: F.lit(False)))


def headings_of(blocks: Column) -> Column:
    return F.filter(blocks, lambda b: b["type"] == "heading")


def with_path(blocks: Column) -> Column:
    """B2: blocks with path, the open headings above each block and its own: a heading closes those of its level and of lower ones."""
    one = "struct<level:int,title:string>"
    start = F.struct(F.array().cast(f"array<{one}>").alias("open"), F.array().cast("array<array<string>>").alias("paths"))

    def meet(state: Column, h: Column) -> Column:
        mine = F.array(F.struct(h["level"].cast("int").alias("level"), h["title"].alias("title")))
        return let(
            F.concat(F.filter(state["open"], lambda o: o["level"] < h["level"]), mine),
            lambda now: F.struct(now.alias("open"), F.concat(state["paths"], F.array(F.transform(now, lambda o: o["title"]))).alias("paths")),
        )

    paths = F.aggregate(headings_of(blocks), start, meet, lambda s: s["paths"])
    return let(paths, lambda p: F.transform(blocks, lambda b: b.withField("path", F.coalesce(F.get(p, b["section"] - 1), F.array().cast("array<string>")))))


def is_noise_title(title: Column, noise: tuple[str, ...]) -> Column:
    return F.coalesce(title.rlike(rf"(?i)^[0-9. ]*(?:{'|'.join(noise)})"), F.lit(False))


def before_tail_noise(blocks: Column, noise: tuple[str, ...]) -> Column:
    """Blocks before the first heading of the last run of noise headings."""
    places = lambda h, keep: F.transform(F.filter(h, keep), lambda x: x["idx"])
    heads = F.transform(headings_of(blocks), lambda h: F.struct(h["idx"].alias("idx"), is_noise_title(h["title"], noise).alias("bad")))
    last = lambda h: F.struct(h.alias("h"), F.array_max(places(h, lambda x: x["bad"])).alias("last"))
    good = lambda s: F.struct(s["h"].alias("h"), F.coalesce(F.array_max(places(s["h"], lambda x: ~x["bad"] & (x["idx"] < s["last"]))), F.lit(-1)).alias("good"))
    cut = let(let(let(heads, last), good), lambda s: F.array_min(places(s["h"], lambda x: x["bad"] & (x["idx"] > s["good"]))))
    return let(F.struct(cut.alias("cut")), lambda c: F.filter(blocks, lambda b: c["cut"].isNull() | (b["idx"] < c["cut"])))


def with_neighbours(blocks: Column, kinds: tuple[str, ...] = SAID) -> Column:
    """Blocks with before and after, the nearest texts of the given kinds."""
    said = F.array_join(F.transform(blocks, lambda b: F.when(b["type"].isin(*kinds) & (F.trim(b["text"]) != ""), "s").otherwise("-")), "")

    def near(at: Column) -> Column:
        back = lambda i: F.call_function("locate", F.lit("s"), at["back"], F.size(blocks) - i + 1)
        on = lambda i: F.call_function("locate", F.lit("s"), at["on"], i + 2)
        return F.transform(
            blocks,
            lambda b, i: b.withField("before", let(back(i), lambda p: F.when(p > 0, F.get(blocks, F.size(blocks) - p)["text"]))).withField("after", let(on(i), lambda p: F.when(p > 0, F.get(blocks, p - 1)["text"]))),
        )

    return let(said, lambda s: let(F.struct(s.alias("on"), F.reverse(s).alias("back")), near))


def with_anchors(blocks: Column) -> Column:
    """Blocks with anchor, the number of a table as TABLE_nnnn."""
    tables = F.transform(F.filter(blocks, lambda b: b["type"] == "table"), lambda b: b["idx"])
    return let(tables, lambda t: F.transform(blocks, lambda b: b.withField("anchor", F.when(b["type"] == "table", F.format_string("TABLE_%04d", F.array_position(t, b["idx"]))))))


def anchored(blocks: Column) -> Column:
    """Blocks with tables replaced by [TABLE_nnnn], of type table_anchor."""

    def put(b: Column) -> Column:
        is_table = b["anchor"].isNotNull()
        return b.withField("text", F.when(is_table, F.concat(F.lit("["), b["anchor"], F.lit("]"))).otherwise(b["text"])).withField("type", F.when(is_table, "table_anchor").otherwise(b["type"]))

    return F.transform(with_anchors(blocks), put)


def _hits(words: tuple[str, ...], text: Column) -> Column:
    return reduce(add, [text.contains(w).cast("int") for w in words], F.lit(0))


def _any(words: tuple[str, ...], text: Column) -> Column:
    return reduce(or_, [text.contains(w) for w in words], F.lit(False))


def score_of(type_: Column, text: Column, path: Column, lexicon: BlockLexicon) -> Column:
    """The score of a block: words, measured values, titles, captions and lists add, noisy titles take away. Table anchors have 100. Counted in
    tenths, so that the sum is exact."""

    def tenths(x: Column) -> Column:
        words = _hits(lexicon.parameters, x["low"]) * 25 + _hits(lexicon.structures, x["low"]) * 20
        metrics = reduce(add, [text.rlike(p).cast("int") for p in lexicon.metrics], F.lit(0))
        heading = type_ == "heading"
        return let(
            words,
            lambda y: y
            + metrics * 30
            + F.when(_any(lexicon.priority_titles, x["context"]), 18).otherwise(0)
            + F.when(heading & _any(lexicon.priority_titles, F.lower(F.coalesce(x["own"], x["low"]))), 12).otherwise(0)
            + F.when(type_ == "figure_caption", 20).when(type_ == "list", 4).otherwise(0)
            + F.when((y > 0) & text.rlike("[0-9]"), 15).otherwise(0)
            - F.when(_any(lexicon.noisy_titles, x["context"]), 10).otherwise(0)
            - F.when(is_noise_title(F.coalesce(x["own"], text), lexicon.noise), 60).otherwise(0),
        )

    seen = F.struct(F.lower(text).alias("low"), F.lower(F.array_join(path, " ")).alias("context"), F.try_element_at(path, F.lit(-1)).alias("own"))
    return F.when(type_ == "table_anchor", F.lit(1000) / 10).otherwise(let(seen, tenths) / 10)


def with_score(blocks: Column, lexicon: BlockLexicon) -> Column:
    return F.transform(blocks, lambda b: b.withField("score", score_of(b["type"], b["text"], b["path"], lexicon)))


def selected(blocks: Column, k: int = 1, least: float = 3.0, noise: tuple[str, ...] = ("\\A(?!)",)) -> Column:
    """Kept blocks with mandatory. Seeds score at least ``least``; they and k neighbours on either side stay, noise sections aside. Mandatory: table
    anchors with their neighbours, and scores of least + 2 and more."""

    def flags(b: Column) -> Column:
        noisy = is_noise_title(F.try_element_at(b["path"], F.lit(-1)), noise)
        anchor = b["type"] == "table_anchor"
        return let(noisy, lambda n: F.when(n, "x").when(anchor, "a").when(b["score"] >= least, "s").otherwise("-"))

    def keep(f: Column) -> Column:
        near = lambda i: F.slice(f, F.greatest(i - k + 1, F.lit(1)), F.least(i, F.lit(k)) + k + 1)
        rows = F.transform(
            blocks,
            lambda b, i: let(
                near(i),
                lambda x: F.struct(
                    ((F.get(f, i) != "x") & (F.array_contains(x, "a") | F.array_contains(x, "s"))).alias("keep"),
                    b.withField("mandatory", F.array_contains(x, "a") | (b["score"] >= least + 2)).alias("b"),
                ),
            ),
        )
        return F.transform(F.filter(rows, lambda r: r["keep"]), lambda r: r["b"])

    return let(F.transform(blocks, flags), keep)


def trimmed(blocks: Column, max_blocks: int = 80, max_chars: int = 24_000) -> Column:
    """Optional blocks go, lowest (score, length, idx) first, until both budgets hold; a block costs its length and 2."""
    cost = lambda b: F.length(b["text"]).cast("long") + 2
    rank = lambda b: F.struct(b["score"].alias("score"), F.length(b["text"]).alias("chars"), b["idx"].alias("idx"))
    optional = F.array_sort(F.transform(F.filter(blocks, lambda b: ~b["mandatory"]), rank))
    chars = F.aggregate(blocks, F.lit(0).cast("long"), lambda t, b: t + cost(b))
    start = F.struct(F.size(blocks).cast("long").alias("n"), chars.alias("t"), F.lit(0).alias("gone"))
    over = lambda s: (s["n"] > max_blocks) | (s["t"] > max_chars)
    gone = lambda o: F.aggregate(o, start, lambda s, x: F.when(over(s), F.struct((s["n"] - 1).alias("n"), (s["t"] - x["chars"] - 2).alias("t"), (s["gone"] + 1).alias("gone"))).otherwise(s), lambda s: s["gone"])
    last = let(optional, lambda o: F.get(o, gone(o) - 1))
    return let(F.struct(last.alias("last")), lambda s: F.filter(blocks, lambda b: b["mandatory"] | s["last"].isNull() | (rank(b) > s["last"])))


def condensed(blocks: Column, max_chars: int = 24_000) -> Column:
    """One text, table anchors first, then the blocks in order, cut at max_chars on a blank line; null without blocks."""
    anchor = lambda b: b["type"] == "table_anchor"
    parts = F.concat(F.filter(blocks, anchor), F.filter(blocks, lambda b: ~anchor(b)))
    whole = F.array_join(F.transform(parts, lambda b: b["text"]), "\n\n")

    def cut(w: Column) -> Column:
        head = F.left(w, F.lit(max_chars))
        return F.when(F.length(w) <= max_chars, w).otherwise(let(_last_place(head, "\n\n"), lambda at: F.when(at > 0, F.left(head, at)).otherwise(head)))

    return F.when(F.size(blocks) > 0, let(whole, cut))


def section_kind(title: Column, titles: dict[str, tuple[str, ...]] = SECTION_TITLES) -> Column:
    rule = reduce(lambda w, kv: w.when(title.rlike(rf"(?i)^[0-9. ]*(?:{'|'.join(kv[1])})"), kv[0]), titles.items(), F.when(title.isNull(), "other"))
    return rule.otherwise("other")


def rolled_up(blocks: Column, titles: dict[str, tuple[str, ...]] = SECTION_TITLES) -> Column:
    """Array of (section, n_blocks, text): blocks (with path) by the kind of their top heading, joined in order."""
    kinds = F.transform(blocks, lambda b: F.struct(section_kind(F.try_element_at(b["path"], F.lit(1)), titles).alias("kind"), b["text"].alias("text")))

    def group(k: Column) -> Column:
        names = F.array_distinct(F.transform(k, lambda x: x["kind"]))
        return F.transform(names, lambda n: let(F.filter(k, lambda x: x["kind"] == n), lambda mine: F.struct(n.alias("section"), F.size(mine).cast("long").alias("n_blocks"), F.array_join(F.transform(mine, lambda x: x["text"]), "\n\n").alias("text"))))

    return let(kinds, group)


def sections_of(blocks: Column) -> Column:
    """Array of (pos, title, content): each heading with what follows it; what comes before the first, or all, is "Document"."""
    starts = F.transform(F.filter(blocks, lambda b: (b["type"] == "heading") | (b["idx"] == 0)), lambda b: b["idx"])

    def cut(at: Column) -> Column:
        def one(i: Column, j: Column) -> Column:
            mine = F.slice(blocks, i + 1, F.coalesce(F.get(at, j + 1), F.size(blocks)) - i)
            head = F.get(blocks, i)
            said = F.transform(F.filter(mine, lambda b: b["type"] != "heading"), lambda b: b["text"])
            return F.struct(head["section"].cast("long").alias("pos"), F.coalesce(head["title"], F.lit("Document")).alias("title"), F.array_join(said, "\n\n").alias("content"))

        return F.transform(at, one)

    return let(starts, cut)


def context_of(kept: Column, blocks: Column) -> Column:
    """The nearest earlier heading for each title on the path of a kept block, as an array of idx, each once."""
    heads = F.transform(headings_of(blocks), lambda h: F.struct(h["idx"].alias("idx"), h["title"].alias("title")))
    # all blocks of a section ask the same, but for its heading
    asked = F.array_distinct(F.transform(kept, lambda b: F.struct(F.when(b["type"] == "heading", b["idx"]).otherwise(F.lit(None)).alias("own"), b["section"].alias("section"), b["path"].alias("path"))))

    def near(h: Column) -> Column:
        before = lambda a, x: F.when(a["own"].isNull(), True).otherwise(x["idx"] < a["own"])
        upto = lambda a: F.slice(h, F.lit(1), a["section"])
        return F.array_distinct(F.array_compact(F.flatten(F.transform(asked, lambda a: F.transform(a["path"], lambda t: F.array_max(F.transform(F.filter(upto(a), lambda x: (x["title"] == t) & before(a, x)), lambda x: x["idx"])))))))

    return let(heads, near)


def removed_of(blocks: Column, kept: Column) -> Column:
    """Titles of the sections, that is the last headings on the paths, of which no block was kept, in order."""
    own = lambda b: F.try_element_at(b["path"], F.lit(-1))
    titles = lambda x: F.array_compact(F.array_distinct(F.transform(x, own)))
    return F.array_except(titles(blocks), titles(kept))
