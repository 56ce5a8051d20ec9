"""Mentions and records from rule packs: every pattern is a literal of the plan, so a text is matched inside the JVM and never shuffled to be read."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions.rules import Metric, RulePack, led_words, needed_words
from docmill.functions.text import let, squeeze

_MARK = "\x01"
#: Pieces in which words are looked for, and how much longer than any word what a piece shares with the next one is.
_PIECE, _SHARED = 1024, 64
#: For a pattern the part of a text in which it is to be sought, null where it cannot match.
Sought = Callable[[str], Column]


def _shown(value: Column, metric: Metric) -> Column:
    scaled = F.round(value, metric.decimals).cast(f"decimal(20,{metric.decimals})").cast("string")
    return F.concat(scaled, F.lit(metric.unit)) if metric.unit else scaled


def _in_range(value: Column, metric: Metric) -> Column:
    ok = value.isNotNull()
    if metric.low is not None:
        ok = ok & (value > metric.low)
    if metric.high is not None:
        ok = ok & (value < metric.high)
    return ok


def _may_match(low: Column, patterns: tuple[str, ...]) -> Column:
    words = needed_words(patterns)
    return F.lit(True) if words is None else reduce(or_, [low.contains(w) for w in sorted(words)])


def gates(text: Column, pack: RulePack) -> Column:
    """struct of whether a text can match a metric's patterns, and those of labels (column labels), at all: whether it holds one of the words that they need.
    Worked out once for a text, it spares each of its sentences the patterns."""
    groups = {n: m.patterns for n, m in pack.metrics.items()} | {"labels": pack.labels}
    return let(F.lower(text), lambda low: F.struct(*[(_may_match(low, p) if p else F.lit(False)).alias(n) for n, p in groups.items()]))


def within_pieces(text: Column, body: Callable[[Sought], Column]) -> Column:
    """body of where to seek each pattern in a long text: from the piece on that holds the first of the pattern's words, or from the one before it.

    Matches and groups are those of the whole text, as such a pattern does not look behind. Most texts hold no word of most patterns, or a late one, and to look
    for a word is far cheaper than to try a pattern at each character."""
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))
    lower = lambda c: F.transform(c, lambda x, i: F.lower(F.concat(x, F.coalesce(F.left(F.get(c, i + 1), F.lit(_SHARED)), F.lit("")))))

    def sought(c: Column, low: Column, pattern: str) -> Column:
        holds = lambda words: F.array_position(F.transform(low, lambda x: reduce(or_, [x.contains(w) for w in sorted(words)])), True)
        words, led = needed_words((pattern,)), led_words(pattern)
        if words is None:
            return F.array_join(c, "")
        if led is None:
            return F.when(holds(words) > 0, F.array_join(c, ""))
        rest = lambda n: F.array_join(F.slice(c, n, F.size(c)), "")
        # what stands before the word in a match ends within the piece before, unless all of that could be part of it
        start = (lambda n: F.when((n > 1) & F.get(c, n - 2).rlike(f"^[{led[1]}]*$"), 1).otherwise(F.greatest(n - 1, F.lit(1)))) if led[1] else (lambda n: n)
        found = let(holds(led[0]).cast("int"), lambda n: F.when(n > 0, rest(start(n))))
        return found if led[0] == words else F.when(holds(words) > 0, found)

    return let(cut, lambda c: let(lower(c), lambda low: body(lambda p: sought(c, low, p))))


def in_sentence(text: Column) -> Sought:
    """Where to seek a pattern in a short text: all of it, if it holds a sign that the pattern needs. Words are left to gates(), which need the lower case."""

    def sought(pattern: str) -> Column:
        words = needed_words((pattern,))
        signs = words is not None and all(w.lower() == w.upper() for w in words)
        return F.when(_may_match(text, (pattern,)), text) if signs else text

    return sought


def _found(text: Column, p: str, metric: Metric) -> Column:
    """All of one pattern's matches in the metric's form; null where one is out of range."""
    if metric.pair:
        pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(p), F.lit(1)).alias("x"), F.regexp_extract_all(text, F.lit(p), F.lit(2)).alias("y"))
        return F.transform(pairs, lambda v: F.when(_in_range(v["x"].try_cast("double"), metric) & _in_range(v["y"].try_cast("double"), metric), F.concat(F.lit("("), _shown(v["x"].try_cast("decimal(20,6)"), metric), F.lit(", "), _shown(v["y"].try_cast("decimal(20,6)"), metric), F.lit(")"))))
    raw = F.regexp_extract_all(text, F.lit(p), F.lit(1))
    if metric.decimals is None:
        cleaned = F.transform(raw, lambda v: F.regexp_replace(squeeze(v), r"^[ .;,)(]+|[ .;,)(]+$", ""))
        return F.filter(cleaned, lambda v: F.length(v) > metric.longer_than)
    return F.transform(raw, lambda v: F.when(_in_range(v.try_cast("double"), metric), _shown(v.try_cast("decimal(20,6)"), metric)))


def _of_pattern(sought: Sought, p: str, metric: Metric) -> Column:
    # most texts match no pattern: the cheap test spares them the arrays
    return let(sought(p), lambda s: F.when(s.rlike(p), F.array_compact(_found(s, p, metric))).otherwise(F.array().cast("array<string>")))


def metric_values(text: Column, metric: Metric, sought: Sought | None = None) -> Column:
    """X1 for one metric: all values in the order of patterns, in range, in one form, each once, at most cap. sought: where patterns are to be sought, if that is
    known from more than this metric."""
    if sought is None:
        return within_pieces(text, lambda found: metric_values(text, metric, found))
    return F.slice(F.array_distinct(F.concat(*[_of_pattern(sought, p, metric) for p in metric.patterns])), 1, metric.cap)


def first_value(sought: Sought, metric: Metric) -> Column:
    """The first of metric_values, null without any; a pattern is tried only where those before it have none."""
    return F.coalesce(*[F.get(_of_pattern(sought, p, metric), F.lit(0)) for p in metric.patterns])


def extract_mentions(docs: DataFrame, pack: RulePack) -> DataFrame:
    """Mentions (doc_id, metric, pos, value)."""
    text = F.coalesce("text", F.lit(""))
    all_ = within_pieces(text, lambda sought: F.array(*[F.struct(F.lit(name).alias("metric"), metric_values(text, m, sought).alias("values")) for name, m in pack.metrics.items()]))
    rows = docs.select("doc_id", F.explode(all_).alias("m"))
    return rows.select("doc_id", F.col("m.metric").alias("metric"), F.posexplode("m.values").alias("pos", "value"))


def record_label(text: Column, patterns: tuple[str, ...], sought: Sought | None = None) -> Column:
    """The first label pattern that matches, squeezed."""
    tries = [F.nullif(squeeze(F.regexp_extract(sought(p) if sought else text, p, 1)), F.lit("")) for p in patterns]
    return F.coalesce(*tries) if tries else F.lit(None).cast("string")


def has_value(text: Column, metric: Metric) -> Column:
    """Whether a short text has a value of the metric; of single numbers none has to be brought to its form for that."""
    if metric.pair or metric.decimals is None:
        return first_value(in_sentence(text), metric).isNotNull()
    return reduce(or_, [text.rlike(p) & F.exists(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda v: _in_range(v.try_cast("double"), metric)) for p in metric.patterns])


def signal_score(text: Column, pack: RulePack, may: Column) -> Column:
    """The weights of the signal metrics that the text has a value of, and 1 for a label. may: the gates of the text or of one that it is a part of."""
    parts = [F.when(may[n] & has_value(text, pack.metrics[n]), w).otherwise(0) for n, w in pack.signals.items()]
    return reduce(add, parts) + F.when(may["labels"] & record_label(text, pack.labels).isNotNull(), 1).otherwise(0)


def segments(docs: DataFrame, pack: RulePack, most: int = 20) -> DataFrame:
    """(doc_id, pos, text): paragraphs with a signal of 2 and more, then maximal runs of sentences with any; each text once, the first ``most``.

    All within the row of the document: nothing is shuffled, and only hits are exploded. Sentences end at [.!?] before white space; a mark is
    put there first, so that no look-behind is needed."""
    parts = F.filter(F.transform(F.split("text", "\n[ \t]*\n"), lambda s: F.trim(s)), lambda s: s != "")
    paragraphs = lambda g: F.filter(parts, lambda s: signal_score(s, pack, g) >= 2)
    marked = F.regexp_replace("text", "([.!?])[ \n\t]+", "$1" + _MARK)
    cut = F.filter(F.transform(F.split(marked, _MARK), lambda s: F.trim(s)), lambda s: s != "")
    # runs: sentences without a signal become the mark, the rest is joined and cut at marks again
    kept = lambda g: F.transform(cut, lambda s: F.when(signal_score(s, pack, g) > 0, s).otherwise(_MARK))
    runs = lambda g: F.filter(F.transform(F.split(F.array_join(kept(g), " "), f" ?{_MARK} ?"), lambda s: F.trim(s)), lambda s: s != "")
    # a text without any of the words that signals need has no segment and is not cut up
    some = lambda g: reduce(or_, [g[n] for n in (*pack.signals, "labels")])
    found = let(gates(F.col("text"), pack), lambda g: F.when(some(g), F.concat(paragraphs(g), runs(g))).otherwise(F.array().cast("array<string>")))
    every = docs.select("doc_id", found.alias("s"))
    every = every.select("doc_id", "s", F.transform("s", lambda s: squeeze(s)).alias("same"))
    first = F.filter("s", lambda _, i: F.array_position("same", F.col("same")[i]) == i + 1)
    return every.select("doc_id", F.posexplode(F.slice(first, 1, most)).alias("pos", "text"))


def _records(docs: DataFrame, pack: RulePack, text: Column, *rest: Column) -> DataFrame:
    """The rows with rest, label and the first value of each metric of a text; those without any value go. A generator makes the records, as a filter on
    plain columns would be pushed below them and match each text twice."""
    of = lambda sought: F.struct(*rest, record_label(text, pack.labels, sought).alias("label"), *[first_value(sought, m).alias(n) for n, m in pack.metrics.items()])
    each = F.filter(F.array(within_pieces(text, of)), lambda r: F.coalesce(*[r[n] for n in pack.metrics]).isNotNull())
    return docs.select("doc_id", F.inline(each))


def signature(pack: RulePack) -> Column:
    """What makes a record the same as another: its label and signal metrics, in lower case."""
    return F.lower(F.concat_ws("\x02", *[F.coalesce(n, F.lit("")) for n in ("label", *pack.signals)]))


def clean_notes(text: Column, most: int = 220) -> Column:
    """A note without boilerplate, figure references and citations, cut at ``most``. Phrases are fixed values."""
    out = text
    for p in ("Research Article", "RESEARCH ARTICLE", r"www\.afm-journal\.de", r"www\.small-journal\.com", r"www\.advancedsciencenews\.com"):
        out = F.regexp_replace(out, p, "")
    out = F.regexp_replace(out, r"Fig(?:ure|\.) [0-9]+\.[^ \t\n]*", "")
    out = squeeze(F.regexp_replace(out, r"\[[0-9]+(?:-[0-9]+)?\]", ""))
    return F.nullif(F.when(F.length(out) > most, F.concat(F.rtrim(F.left(out, F.lit(most - 3))), F.lit("..."))).otherwise(out), F.lit(""))


def candidate_records(docs: DataFrame, pack: RulePack, most: int = 6) -> DataFrame:
    """(doc_id, pos, label, metrics, notes): the first value of each metric in each segment; empty ones go, each signature once, the first ``most``."""
    rows = _records(segments(docs, pack), pack, F.col("text"), F.col("pos").alias("at"), clean_notes(F.col("text")).alias("notes")).withColumn("sig", signature(pack))
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "sig").orderBy("at"))).where("n = 1")
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("at")) - 1
    return first.withColumn("pos", pos).where(F.col("pos") < most).select("doc_id", "pos", "label", *pack.metrics, "notes")


def document_fallback_record(docs: DataFrame, records: DataFrame, pack: RulePack) -> DataFrame:
    """The records, and for documents without any one record of the whole text's first values.

    Whole texts are matched where they are read, and the records of each document are told from its own fallback by one window: no text is shuffled, and
    the records are worked out once."""
    one = _records(docs, pack, F.coalesce("text", F.lit("")), F.lit(0).alias("pos"), F.lit(None).cast("string").alias("notes"))
    both = records.withColumn("__k", F.lit(0)).unionByName(one.withColumn("__k", F.lit(1)))
    both = both.withColumn("__least", F.min("__k").over(Window.partitionBy("doc_id")))
    return both.where((F.col("__k") == 0) | (F.col("__least") == 1) | F.col("doc_id").isNull()).select(*records.columns)


def sanitize_records(records: DataFrame, pack: RulePack, most: int = 6) -> DataFrame:
    """Squeezed, weak ones dropped (no signal, or one that is not a key metric), each signature once, best first, at most ``most``."""
    keys = [n for n in pack.signals if n != "structure"]
    rows = records
    if "structure" in pack.metrics:
        rows = rows.withColumn("structure", F.nullif(F.regexp_replace(squeeze("structure"), r"^[ .;]+|[ .;]+$", ""), F.lit("")))
    notes = squeeze("notes")
    rows = rows.withColumn("notes", F.when(F.length(notes) > 280, F.concat(F.rtrim(F.left(notes, F.lit(277))), F.lit("..."))).otherwise(notes))
    score = reduce(add, [F.col(n).isNotNull().cast("int") for n in ("label", *pack.signals)])
    rows = rows.withColumn("score", score).where((F.col("score") > 1) | ((F.col("score") == 1) & F.coalesce(*keys).isNotNull()))
    rows = rows.withColumn("sig", signature(pack)).withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "sig").orderBy("pos"))).where("n = 1")
    best = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), *[F.col(n).isNotNull().desc() for n in pack.signals], "pos")
    return rows.withColumn("rank", F.row_number().over(best) - 1).where(F.col("rank") < most).select("doc_id", "rank", "label", *pack.metrics, "notes", "score")


def sentences(text: Column) -> Column:
    """A text cut after each [.!?] and line break; the point within a number ends nothing."""
    held = F.regexp_replace(F.coalesce(text, F.lit("")), "([0-9])[.]([0-9])", "$1\x02$2")
    return F.transform(F.split(F.regexp_replace(held, "([.!?\n])", "$1" + _MARK), _MARK), lambda s: F.replace(s, F.lit("\x02"), F.lit(".")))


def evidence_sentences(docs: DataFrame, pack: RulePack) -> DataFrame:
    """(doc_id, metric, sentence): the first sentence that names a metric and a value. Sentences are cut first, so that no pattern runs over a whole text."""
    rows = docs.select("doc_id", sentences(F.col("text")).alias("s"))

    def first(pattern: str) -> Column:
        return F.nullif(squeeze(F.try_element_at(F.filter("s", lambda x: x.rlike(pattern)), F.lit(1))), F.lit(""))

    hits = [F.struct(F.lit(n).alias("metric"), first(p).alias("sentence")) for n, p in pack.evidence.items()]
    return rows.select("doc_id", F.inline(F.array(*hits))).where("sentence is not null")


def first_class(text: Column, classes: dict[str, tuple[str, ...]]) -> Column:
    """The first class of which a pattern matches."""
    return F.coalesce(*[F.when(reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns]), F.lit(name)) for name, patterns in classes.items()])


def multi_tags(text: Column, tags: dict[str, tuple[str, ...]]) -> Column:
    """All tags of which a phrase stands in the text, in the order of the list."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), F.lit(name)) for name, words in tags.items()]))


def tag_summary(tags: Column) -> Column:
    return F.when(F.size(tags) > 0, F.concat(F.lit("Uses "), F.array_join(tags, ", "), F.lit(".")))
