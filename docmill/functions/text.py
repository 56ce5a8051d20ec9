"""Column functions on text: filters, quality gates, cleaning, keys. All stay in the JVM; patterns are ASCII classes."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that garbled text lacks, besides letters and digits. Fixed values.
PLAIN_MARKS = ".,;:!?()[]/%+-_=<>"
SPACE = r"[ \t\n\r\f\x0B]"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is worked out once, also where body is used for every element of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank_to_null(c: str | Column) -> Column:
    """Trimmed text; null where nothing is left."""
    return F.nullif(F.trim(col(c).cast("string")), F.lit(""))


def squeeze(c: str | Column) -> Column:
    return F.trim(F.regexp_replace(col(c), f"{SPACE}+", " "))


def search_any(columns: list[str], q: str) -> Column:
    """Trimmed, case-insensitive substring in any column; a blank query passes all."""
    q = q.strip().lower()
    if not q:
        return F.lit(True)
    return reduce(or_, [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(q) for c in columns])


def cell_number(c: str | Column) -> Column:
    """The number that a table cell shows: signs, digits and dots kept, the leading number read."""
    digits = F.regexp_replace(col(c).cast("string"), "[^0-9.-]", "")
    return F.regexp_extract(digits, r"^-?[0-9]*\.?[0-9]+", 0).try_cast("double")


_NUMBER = r"-?\d+(?:\.\d+)?"


def numeric_filter(c: str | Column, text: str) -> Column:
    """P2: '>x', '>=x', '<x', '<=x', 'a-b' or 'x'. An unreadable filter passes all; a cell without a number fails.

    Unlike the original, '>=', '<=' and negative numbers work."""
    text, value = text.strip(), cell_number(c)
    if m := re.fullmatch(rf"(>=|<=|>|<)\s*({_NUMBER})", text):
        x = float(m[2])
        test = {">": value > x, ">=": value >= x, "<": value < x, "<=": value <= x}[m[1]]
    elif m := re.fullmatch(rf"({_NUMBER})\s*-\s*({_NUMBER})", text):
        test = value.between(float(m[1]), float(m[2]))
    elif re.fullmatch(_NUMBER, text):
        test = value == float(text)
    else:
        return F.lit(True)
    return F.coalesce(test, F.lit(False))


def facet_filter(text_facets: dict[str, str], number_facets: dict[str, str]) -> Column:
    """All facets hold."""
    return reduce(and_, [search_any([c], q) for c, q in text_facets.items()] + [numeric_filter(c, q) for c, q in number_facets.items()], F.lit(True))


def is_garbled(c: str | Column, least_chars: int = 80, least_share: float = 0.6) -> Column:
    """Null or empty, or of ``least_chars`` or more with a replacement character or too few letters, digits and plain marks."""
    c = col(c)
    solid = F.regexp_replace(c, f"{SPACE}", "")
    marks = re.escape(PLAIN_MARKS)
    valid = F.length(solid) - F.length(F.regexp_replace(solid, rf"[\p{{L}}\p{{N}}{marks}]", ""))
    rule = F.when(F.length(solid) < least_chars, False).when(c.contains("�"), True).otherwise(valid / F.length(solid) < least_share)
    return F.when(c.isNull() | (c == ""), True).otherwise(rule)


def density_gate(c: str | Column, area: float, least: float) -> Column:
    """P5: True where the text has fewer than ``least`` characters for each 100 units of area: a scan without text."""
    return F.length(F.coalesce(col(c), F.lit(""))) / F.lit(area / 100.0) < least


def clean_ws(c: str | Column) -> Column:
    """White space squeezed, ends trimmed, control characters dropped."""
    return F.regexp_replace(squeeze(c), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", "")


def markdown_to_text(c: str | Column) -> Column:
    """Fences and images dropped, links unwrapped, heading and emphasis marks removed, blank lines squeezed."""
    out = F.regexp_replace(col(c), r"```[^`]*```", "")
    out = F.regexp_replace(out, r"!\[[^\]]*\]\([^)]*\)", "")
    out = F.regexp_replace(out, r"\[([^\]]*)\]\([^)]*\)", "$1")
    out = F.regexp_replace(out, r"(?m)^#{1,6}[ \t]+", "")
    out = F.regexp_replace(out, r"[*_`]+", "")
    return F.trim(F.regexp_replace(out, r"\n{3,}", "\n\n"))


#: Entities and what they stand for. Fixed values.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def html_to_text(c: str | Column) -> Column:
    """Tags to spaces, common entities read, white space squeezed."""
    out = F.regexp_replace(col(c), "<[^>]+>", " ")
    for entity, char in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    return squeeze(out)


def word_count(c: str | Column) -> Column:
    """Words, markdown marks aside."""
    return F.size(F.filter(F.split(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"[#*_`>|\[\]()-]", " "), f"{SPACE}+"), lambda w: w != ""))


def first_number(c: str | Column) -> Column:
    """The first number in a text, or null."""
    return F.regexp_extract(col(c).cast("string"), r"[0-9]+(?:\.[0-9]+)?", 0).try_cast("double")


def coerce_number(c: str | Column, least: float | None = None, most: float | None = None, default: float | None = 0.0) -> Column:
    """The first number, if in range; else the default."""
    n = first_number(c)
    if least is not None:
        n = F.when(n.between(least, most), n)
    return n if default is None else F.coalesce(n, F.lit(default))


def truncate_at_boundary(c: str | Column, n: int, share: float, separators: tuple[str, ...] = ("\n", ". ")) -> Column:
    """At most n characters, cut back to the last separator (kept in part: a full stop stays) if it lies past share * n."""
    c = col(c)
    head = F.left(c, F.lit(n))
    last = F.greatest(*[_last_place(head, s) for s in separators], F.lit(-1))
    return F.when(F.length(c) <= n, c).when(last > int(n * share), F.left(head, last + 1)).otherwise(head)


def _last_place(c: Column, sep: str) -> Column:
    """0-based place of the last sep, -1 where there is none."""
    back = F.instr(F.reverse(c), F.lit(sep[::-1]))
    return F.when(back == 0, F.lit(-1)).otherwise(F.length(c) - back + 1 - len(sep))


def normalize_issn(c: str | Column) -> Column:
    """Dddd-dddX, or null."""
    compact = F.upper(F.regexp_replace(col(c).cast("string"), "[^0-9Xx]", ""))
    return F.when(compact.rlike("^[0-9]{7}[0-9X]$"), F.concat(F.left(compact, F.lit(4)), F.lit("-"), F.substring(compact, 5, 4)))


def exact_title(c: str | Column) -> Column:
    return F.nullif(squeeze(c), F.lit(""))


def canonical_title(c: str | Column) -> Column:
    out = F.regexp_replace(F.replace(exact_title(c), F.lit("&"), F.lit(" and ")), "[^0-9A-Za-z]+", " ")
    return F.nullif(F.lower(F.trim(out)), F.lit(""))


def fingerprint(c: str | Column) -> Column:
    """P20: md5 of the UTF-8 text."""
    return F.md5(F.encode(col(c), "UTF-8"))


def stable_id(c: str | Column, most: int = 128) -> Column:
    """A slug of the text and 12 hex digits of its md5, together at most ``most`` characters."""
    slug = F.regexp_replace(F.regexp_replace(col(c), "[^0-9A-Za-z._-]+", "-"), "^-+|-+$", "")
    slug = F.when(slug == "", "document").otherwise(slug)
    return F.concat(F.left(slug, F.lit(most - 13)), F.lit("-"), F.left(fingerprint(c), F.lit(12)))


def host_in_suffix_list(url: str | Column, suffixes: list[str]) -> Column:
    """The host is one of the domains or below one."""
    host = F.lower(F.regexp_extract(col(url), "^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))
    return reduce(or_, [(host == s) | host.endswith(f".{s}") for s in suffixes])


def coalesce_aliases(*columns: str) -> Column:
    """The first column that is not blank."""
    return F.coalesce(*[blank_to_null(c) for c in columns])


#: Full name and short form. Fixed values.
SHORT_NAMES = {
    "Nature Communications": "NatCommun",
    "Nature Materials": "NatMater",
    "Nature Photonics": "NatPhoton",
    "Nature Nanotechnology": "NatNano",
    "Advanced Materials": "AdvMater",
    "Advanced Functional Materials": "AdvFunctMater",
    "Journal of the American Chemical Society": "JACS",
    "ACS Nano": "ACSNano",
    "Nano Letters": "NanoLett",
}


def short_name(c: str | Column) -> Column:
    """Known short form; else the initials of over three words, or up to three words joined, 20 characters at most."""
    c = col(c)
    known = F.create_map(*[F.lit(x) for pair in SHORT_NAMES.items() for x in pair])
    plain = reduce(lambda t, w: F.replace(t, F.lit(w), F.lit(" ")), ["The ", "Journal of ", " and ", " International"], c)
    words = F.filter(F.split(plain, " +"), lambda w: w != "")
    initials = F.upper(F.array_join(F.transform(F.slice(words, 1, 4), lambda w: F.left(w, F.lit(1))), ""))
    joined = F.left(F.array_join(F.slice(words, 1, 3), ""), F.lit(20))
    return F.when(c.isNull() | (F.trim(c) == ""), "Unknown").otherwise(F.coalesce(F.try_element_at(known, c), F.when(F.size(words) > 3, initials).otherwise(joined)))


def make_label(year: Column, value: Column, name: Column, title: Column) -> Column:
    """[{year}_IF{value}_{name}]_{title}, free of characters that file names cannot hold."""
    bad = r'[<>:"/\\|?*]'
    clean = F.regexp_replace(F.regexp_replace(title, bad, ""), f"{SPACE}+", "_")
    clean = F.coalesce(F.nullif(F.regexp_replace(clean, "^_+|_+$", ""), F.lit("")), F.lit("Untitled"))
    amount = F.when(F.coalesce(value, F.lit(0.0)) == 0, "IF?").otherwise(F.concat(F.lit("IF"), F.round(value, 1).cast("decimal(20,1)").cast("string")))
    out = F.concat(F.lit("["), year.cast("string"), F.lit("_"), amount, F.lit("_"), short_name(name), F.lit("]_"), F.left(clean, F.lit(100)))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(out, bad, ""), "_+", "_"), "^[ _]+|[ _]+$", "")
