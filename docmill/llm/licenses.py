"""License scans: ordered signature rules, gated by a keyword prefilter, overlaps resolved by priority and containment.

A text is lower-cased in A-Z and cut into words (``WORDS``); rules are regular expressions over the words joined by one space, and
match whole words only. Each rule names the words of which one must stand in a text that it matches; a document without any of
these is not scanned, and a rule only where one of its own stands. Detections are then resolved: sorted by priority, length and place, a detection is suppressed
if a stronger one of the same or a higher priority contains its words, so "gnu lesser general public license version 2.1"
does not also count as the GPL. Base phrases are counted at every place where their words stand in a row; their labels are
never suppressed.

Score: 0 without a detection; else the largest of the kept detections' confidences (a base phrase alone has 0.5, an exact
name with a version 0.9, a full sentence or identifier 1.0).

Null and empty texts have no words and no labels (an empty string). One pass, one row a document, no shuffle; repeated rows count
each. Ties of priority go to the longer detection, then the earlier one, then the rule that stands first. The time for a very long
text is in proportion to its words times the rules that its words let through, and n log n in its detections. An empty table gives
an empty result. Only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import batch, bounded, by_bytes, texts

#: Bytes that belong to a word once A-Z are lower-cased.
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))

#: Fixed values of the query's contract: phrase and label.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


#: The least common word of each.
BASE_KEYWORDS = {"cc by": "cc", "general public license": "general", "all rights reserved": "rights"}


class Rule(NamedTuple):
    label: str
    pattern: str
    #: Words, one of which every match holds.
    keyword: str
    priority: int
    confidence: float


def _creative_commons() -> list[Rule]:
    names = {"by": "attribution", "by sa": "attribution share ?alike", "by nd": "attribution no ?deriv(?:ative)?s", "by nc": "attribution non ?commercial", "by nc sa": "attribution non ?commercial share ?alike", "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s"}
    out = []
    for short, name in names.items():
        label = "cc-" + short.replace(" ", "-")
        more = 3 * short.count(" ")
        for version in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            full = f"{label}-{version.replace(' ', '.')}"
            out.append(Rule(full, f"cc {short} {version}", "cc", 60 + more, 0.9))
            out.append(Rule(full, f"creative commons {name} {version}(?: (?:international|unported|generic))?(?: (?:public )?licen[sc]e)?", "creative", 62 + more, 1.0))
            out.append(Rule(full, f"creativecommons org licenses {short} {version}", "creativecommons", 64 + more, 1.0))
        out.append(Rule(label, f"creative commons {name}(?: (?:public )?licen[sc]e)?", "creative", 50 + more, 0.8))
        if short != "by":
            out.append(Rule(label, f"cc {short}", "cc", 48 + more, 0.8))
    out.append(Rule("cc0-1.0", "cc0(?: 1 0)?(?: universal)?|creative commons zero(?: 1 0)?|creativecommons org publicdomain zero 1 0", "cc0 creative creativecommons", 70, 0.9))
    out.append(Rule("cc-pdm-1.0", "creativecommons org publicdomain mark 1 0|public domain mark(?: 1 0)?", "mark", 66, 0.9))
    return out


def _gnu() -> list[Rule]:
    out = []
    kinds = {"gpl": ("general public licen[sc]e", "gpl", ("1", "2", "3")), "lgpl": ("(?:lesser|library) general public licen[sc]e", "lgpl", ("2", "2 1", "3")), "agpl": ("affero general public licen[sc]e", "agpl", ("1", "3")), "gfdl": ("free documentation licen[sc]e", "gfdl", ("1 1", "1 2", "1 3"))}
    for kind, (name, short, versions) in kinds.items():
        more = 0 if kind == "gpl" else 10
        word = {"gpl": "public", "lgpl": "public", "agpl": "affero", "gfdl": "documentation"}[kind]
        for v in versions:
            label = f"{kind}-{v.replace(' ', '.')}" + ("" if " " in v else ".0")
            tail = v if " " in v else f"{v}(?: 0)?"
            out.append(Rule(label, f"(?:gnu )?{name},? (?:version |v ?){tail}", word, 80 + more, 0.9))
            joined = " ".join([short, f"{short}v", f"{short}{v[0]}", f"{short}v{v[0]}"])
            out.append(Rule(label, f"{short} ?v?{tail}", joined, 76 + more, 0.9))
            for suffix, words in (("only", "only"), ("or-later", "(?:of the licen[sc]e )?(?:or (?:at your option )?(?:any )?later(?: version)?|or newer)")):
                out.append(Rule(f"{label}-{suffix}", f"(?:gnu )?{name},? (?:version |v ?){tail} {words}", word, 82 + more, 1.0))
                out.append(Rule(f"{label}-{suffix}", f"{short} ?v?{tail} {words}", joined, 78 + more, 1.0))
        out.append(Rule(kind, f"gnu {name}", "gnu", 60 + more, 0.8))
        out.append(Rule(kind, f"{name}" if kind != "gpl" else "licensed under (?:the )?gpl", word if kind != "gpl" else "gpl", 58 + more, 0.7))
    return out


#: Label, name as words, versions; a version may be missing in a text, then the label has none.
_NAMED = (
    ("apache", "apache(?: software)?", ("1 0", "1 1", "2 0"), "apache"),
    ("mpl", "mozilla public", ("1 0", "1 1", "2 0"), "mozilla"),
    ("epl", "eclipse public", ("1 0", "2 0"), "eclipse"),
    ("cddl", "common development and distribution", ("1 0", "1 1"), "development"),
    ("cpl", "common public", ("0 5", "1 0"), "common"),
    ("eupl", "european union public", ("1 0", "1 1", "1 2"), "european"),
    ("osl", "open software", ("1 0", "1 1", "2 0", "2 1", "3 0"), "software"),
    ("afl", "academic free", ("1 1", "1 2", "2 0", "2 1", "3 0"), "academic"),
    ("artistic", "(?:clarified )?artistic", ("1 0", "2 0"), "artistic"),
    ("bsl", "boost software", ("1 0",), "boost"),
    ("busl", "business source", ("1 0", "1 1"), "business"),
    ("sspl", "server side public", ("1",), "server"),
    ("ofl", "(?:sil )?open font", ("1 0", "1 1"), "font"),
    ("odbl", "open database", ("1 0",), "database"),
    ("odc-by", "open data commons attribution", ("1 0",), "commons"),
    ("pddl", "public domain dedication and", ("1 0",), "dedication"),
    ("ms-pl", "microsoft public", (), "microsoft"),
    ("ms-rl", "microsoft reciprocal", (), "microsoft"),
    ("zpl", "zope public", ("1 1", "2 0", "2 1"), "zope"),
    ("psf", "python software foundation", ("2",), "python"),
    ("php", "php", ("3 0", "3 01"), "php"),
    ("qpl", "q public", ("1 0",), "q"),
    ("apsl", "apple public source", ("1 0", "1 1", "1 2", "2 0"), "apple"),
    ("ipl", "ibm public", ("1 0",), "ibm"),
    ("lppl", "latex project public", ("1 0", "1 1", "1 2", "1 3"), "latex"),
    ("npl", "netscape public", ("1 0", "1 1"), "netscape"),
    ("spl", "sun public", ("1 0",), "sun"),
    ("upl", "universal permissive", ("1 0",), "universal"),
    ("wtfpl", "do what the f u?c?k you want to public", ("2",), "want"),
    ("elastic", "elastic", ("2 0",), "elastic"),
    ("cecill", "cecill", ("1 0", "1 1", "2 0", "2 1"), "cecill"),
    ("ecl", "educational community", ("1 0", "2 0"), "educational"),
    ("efl", "eiffel forum", ("1", "2"), "eiffel"),
    ("openrail", "(?:bigscience )?(?:open ?)?rail(?: m)?", ("1 0",), "rail openrail"),
    ("ncsa", "university of illinois ncsa open source", (), "ncsa"),
    ("vsl", "vovida software", ("1 0",), "vovida"),
    ("w3c", "w3c software(?: notice and)?", (), "w3c"),
    ("mulan-psl", "mulan permissive software", ("1", "2"), "mulan"),
    ("unicode", "unicode(?: data files)?", (), "unicode"),
    ("blueoak", "blue oak model", ("1 0 0",), "oak"),
)

#: Labels that with a version are names of products, too; they count only with the word license.
_PRODUCTS = {"php", "elastic", "unicode", "w3c"}
#: Short names that stand for many other things; with a version they count only beside the word license, or as what something is licensed under.
_SHORT = {"ipl", "spl", "ecl", "efl"}

#: Signatures of their own wording: label, pattern, keyword, priority, confidence.
_SENTENCES = (
    ("mit", "(?:the )?mit licen[sc]e", "mit", 60, 0.9),
    ("mit", "(?:released|licensed|distributed|available) under (?:the |an )?mit(?: licen[sc]e)?", "mit", 64, 1.0),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby", 90, 1.0),
    ("mit-0", "mit no attribution(?: licen[sc]e)?|mit 0 licen[sc]e|(?:licen[sc]e|(?:licensed|released|distributed|available) under(?: the)?) mit 0", "mit", 66, 0.9),
    ("isc", "(?:the )?isc licen[sc]e", "isc", 60, 0.9),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee", "modify", 90, 1.0),
    ("bsd", "(?:the )?(?:new |modified |simplified |original )?bsd licen[sc]e", "bsd 0bsd", 50, 0.8),
    ("bsd-2-clause", "(?:the )?(?:2 clause|simplified|freebsd) bsd(?: licen[sc]e)?|bsd 2 clause(?: licen[sc]e)?", "bsd 0bsd", 62, 0.9),
    ("bsd-3-clause", "(?:the )?(?:3 clause|new|modified|revised) bsd(?: licen[sc]e)?|bsd 3 clause(?: licen[sc]e)?", "bsd 0bsd", 62, 0.9),
    ("bsd-4-clause", "(?:the )?(?:4 clause|original|old) bsd(?: licen[sc]e)?|bsd 4 clause(?: licen[sc]e)?", "bsd 0bsd", 62, 0.9),
    ("bsd-0-clause", "(?:0 clause|zero clause) bsd(?: licen[sc]e)?|0bsd", "bsd 0bsd", 62, 0.9),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution", 88, 1.0),
    ("bsd-3-clause", "neither the name of .{1,80} nor the names of its contributors may be used to endorse or promote", "endorse", 89, 1.0),
    ("zlib", "(?:the )?zlib(?: libpng)? licen[sc]e", "zlib", 60, 0.9),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "warranty", 88, 1.0),
    ("unlicense", "(?:the )?unlicense", "unlicense", 60, 0.8),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered", 92, 1.0),
    ("public-domain", "(?:in|into|to) the public domain", "domain", 40, 0.7),
    ("public-domain", "(?:dedicated|released|placed|committed) (?:in|into|to) the public domain", "domain", 52, 0.9),
    ("proprietary", "proprietary and confidential", "proprietary", 50, 0.8),
    ("proprietary", "unauthorized (?:copying|use|reproduction|distribution)(?: of this (?:file|document|work|material))?(?: via any medium)? is (?:strictly )?prohibited", "unauthorized", 70, 1.0),
    ("proprietary", "(?:no part of this|this) (?:publication|document|work|book) may (?:not )?be reproduced", "reproduced", 70, 0.9),
    ("proprietary", "not for (?:redistribution|resale|commercial use)", "not", 45, 0.7),
    ("copyright", "copyright (?:c )?(?:19|20)\\d\\d(?: (?:19|20)\\d\\d)?", "copyright", 30, 0.6),
    ("copyright", "copyright notice", "copyright", 20, 0.5),
    ("reserved", "all rights reserved", "rights", 35, 0.6),
    ("some-reserved", "some rights reserved", "rights", 36, 0.6),
    ("used-with-permission", "(?:used|reprinted|reproduced) (?:with|by) permission", "permission", 40, 0.7),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e", "redistribute", 95, 1.0),
    ("apache-2.0", "you may not use this file except in compliance with the licen[sc]e you may obtain a copy of the licen[sc]e at", "compliance", 92, 1.0),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0", "mozilla", 94, 1.0),
    ("beerware", "beer ?ware licen[sc]e", "beer beerware", 60, 0.9),
    ("json", "the software shall be used for good not evil", "evil", 90, 1.0),
    ("non-commercial", "(?:for )?non ?commercial (?:use|purposes)(?: only)?", "commercial noncommercial", 42, 0.7),
    ("educational-use", "for (?:educational|research|academic) (?:use|purposes) only", "only", 44, 0.7),
    ("fair-use", "fair use (?:of|under|doctrine|policy)", "fair", 40, 0.6),
    ("terms-of-use", "subject to (?:the |our )?terms (?:of (?:use|service)|and conditions)", "terms", 32, 0.5),
    ("ogl-3.0", "open government licen[sc]e(?: v ?3 0)?", "government", 60, 0.9),
    ("llama", "llama(?: \\d)? community licen[sc]e(?: agreement)?", "llama", 66, 0.9),
    ("free-art", "free art licen[sc]e(?: 1 3)?|licence art libre", "art", 60, 0.9),
    ("postgresql", "postgresql licen[sc]e", "postgresql", 60, 0.9),
    ("openssl", "openssl licen[sc]e", "openssl", 60, 0.9),
    ("curl", "curl licen[sc]e", "curl", 60, 0.9),
    ("ruby", "ruby licen[sc]e", "ruby", 60, 0.9),
    ("perl", "same terms as perl(?: itself)?", "perl", 60, 0.9),
    ("de-reserved", "alle rechte vorbehalten", "rechte", 35, 0.6),
    ("fr-reserved", "tous droits réservés", "droits", 35, 0.6),
    ("es-reserved", "todos los derechos reservados", "derechos", 35, 0.6),
)

#: SPDX identifiers, as words.
_SPDX = (
    "mit", "mit 0", "ipl 1 0", "spl 1 0", "ecl 1 0", "ecl 2 0", "efl 1", "efl 2", "isc", "apache 2 0", "bsd 2 clause", "bsd 3 clause", "gpl 2 0 only", "gpl 2 0 or later", "gpl 3 0 only", "gpl 3 0 or later", "lgpl 2 1 only", "lgpl 2 1 or later", "lgpl 3 0 only",
    "lgpl 3 0 or later", "agpl 3 0 only", "agpl 3 0 or later", "mpl 2 0", "epl 2 0", "unlicense", "0bsd", "cc0 1 0", "cc by 4 0", "cc by sa 4 0", "bsl 1 0", "zlib", "wtfpl", "artistic 2 0", "ofl 1 1", "eupl 1 2", "ms pl", "cddl 1 0",
)


def _dotted(words: str) -> str:
    return re.sub(r"(?<=\d)-(?=\d)", ".", words.replace(" ", "-"))


def rules() -> list[Rule]:
    """All rules, strongest first; the order breaks ties of priority."""
    out = _creative_commons() + _gnu() + [Rule(*s) for s in _SENTENCES]
    for label, name, versions, keyword in _NAMED:
        for v in versions:
            full = f"{label}-{v.replace(' ', '.')}"
            out.append(Rule(full, f"{name} licen[sc]e,? (?:version |v ?)?{v}", keyword, 72, 0.9))
            if label in _SHORT:
                short = f"{label} (?:version |v ?)?{v}"
                out.append(Rule(full, f"{short} licen[sc]e|(?:licen[sc]e|(?:licensed|released|distributed|available) under(?: the)?) {short}", label, 68, 0.9))
            elif label not in _PRODUCTS:
                out.append(Rule(full, f"{label.replace('-', ' ')} (?:version |v ?)?{v}", label.split("-")[0], 68, 0.9))
            out.append(Rule(full, f"(?:licensed|released|distributed) under (?:the )?(?:terms of the )?{name} licen[sc]e,? (?:version |v ?)?{v}", keyword, 74, 1.0))
        out.append(Rule(label, f"{name} licen[sc]e", keyword, 55, 0.8))
    out += [Rule(_dotted(s), f"spdx license identifier {s}", "spdx", 98, 1.0) for s in _SPDX]
    out += [Rule(label, phrase, BASE_KEYWORDS[phrase], 10, 0.5) for phrase, label in BASE.items()]
    return sorted(out, key=lambda r: -r.priority)


class Farthest:
    """The farthest end of the intervals so far that start at or before a place: a tree of running maxima."""

    def __init__(self, places: int):
        self.ends = [0] * (places + 1)

    def add(self, start: int, end: int) -> None:
        at = start + 1
        while at < len(self.ends):
            self.ends[at] = max(self.ends[at], end)
            at += at & -at

    def until(self, start: int) -> int:
        at, most = start + 1, 0
        while at:
            most = max(most, self.ends[at])
            at &= at - 1
        return most


class Scanner:
    def __init__(self, all_rules: list[Rule]):
        self.rules = [(r, re.compile(b"(?<= )(?:" + r.pattern.encode() + b")(?= )"), frozenset(r.keyword.encode().split())) for r in all_rules]
        self.base = [(b" " + p.encode() + b" ", label) for p, label in BASE.items()]
        self.keywords = frozenset().union(*(k for _, _, k in self.rules))

    def detections(self, joined: bytes, spaces: np.ndarray, present: set[bytes]) -> list[tuple[Rule, int, int]]:
        """Kept detections over b' w1 w2 ... ', whose spaces are given: rule, first word, end word."""
        found = []
        for order, (rule, pattern, keywords) in enumerate(self.rules):
            if not keywords.isdisjoint(present):
                spans = np.array([m.span() for m in pattern.finditer(joined)], np.int64).reshape(-1, 2)
                # a detection starts after a space and ends before one
                first, end = np.searchsorted(spaces, spans[:, 0]) - 1, np.searchsorted(spaces, spans[:, 1])
                found += [(-rule.priority, a - b, f, order, e) for (a, b), f, e in zip(spans.tolist(), first.tolist(), end.tolist())]
        found.sort()
        starts = {f: i for i, f in enumerate(sorted({d[2] for d in found}))}
        taken = Farthest(len(starts))
        kept: list[tuple[Rule, int, int]] = []
        for _, _, first, order, end in found:
            if taken.until(starts[first]) < end:
                taken.add(starts[first], end)
                kept.append((self.rules[order][0], first, end))
        return kept

    def scan(self, text: bytes) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score."""
        words = text.translate(_TO_WORDS).split()
        present = self.keywords.intersection(words)
        if not present:
            return len(words), 0, None, None, "", "", 0.0
        joined = b" " + b" ".join(words) + b" "
        spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        places, base = [], set()
        for phrase, label in self.base:
            at = joined.find(phrase)
            while at >= 0:
                places.append(at)
                base.add(label)
                at = joined.find(phrase, at + 1)
        starts = np.searchsorted(spaces, places).tolist()
        kept = self.detections(joined, spaces, present)
        labels = base | {r.label for r, _, _ in kept}
        score = max([0.5 * bool(base), *(r.confidence for r, _, _ in kept)])
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def license_scan(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])

    def scan(batches):
        scanner = Scanner(rules())
        for b in (part for whole in batches for part in by_bytes(whole, 1)):
            done = [scanner.scan(t) for t in texts(b.column(1))]
            yield batch(schema, b.column(0), *map(list, zip(*done))) if done else batch(schema, *[[] for _ in schema])

    return bounded(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
