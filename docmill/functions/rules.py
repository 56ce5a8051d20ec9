"""Rule packs: what to extract, as plain data that compiles to Column expressions.

A metric has ordered patterns with one group (two for pairs), a value range, decimals to show, a unit, and a cap. Packs are registered by name; own ones can
be added. Patterns are Java and RE2 alike: no look-around.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cache
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import types as T


@dataclass(frozen=True)
class Metric:
    patterns: tuple[str, ...]
    low: float | None = None
    high: float | None = None
    decimals: int | None = None
    unit: str = ""
    cap: int = 5
    pair: bool = False
    #: A text value must be longer than this.
    longer_than: int = 0


@dataclass(frozen=True)
class RulePack:
    metrics: dict[str, Metric]
    #: Weight of each metric in a segment's signal; of evidence, what a sentence must match: a term and, after it, a value.
    signals: dict[str, int]
    labels: tuple[str, ...] = ()
    evidence: dict[str, str] = field(default_factory=dict)
    classes: dict[str, tuple[str, ...]] = field(default_factory=dict)
    tags: dict[str, tuple[str, ...]] = field(default_factory=dict)
    critical: tuple[str, ...] = ()
    important: tuple[str, ...] = ()


def _class(arg) -> list[str] | None:
    """What a character class or literal matches, in any case, as the inside of a class of Java's; None where that has no short form."""
    found = []
    for kind, x in arg:
        if kind is sre.LITERAL:
            found += [re.escape(c) for c in {chr(x), chr(x).lower(), chr(x).upper()} if len(c) == 1]
        elif kind is sre.RANGE and x[1] < 128:
            found.append(f"{re.escape(chr(x[0]))}-{re.escape(chr(x[1]))}" + ("a-zA-Z" if x[1] >= ord("A") else ""))
        elif kind is sre.CATEGORY and x is sre.CATEGORY_SPACE:
            found.append(r"\s")
        else:
            return None
    return found


def _chars(parts) -> frozenset[str] | None:
    """All that a pattern's parts may match, as pieces of a class; None where that is unknown."""
    found: frozenset[str] = frozenset()
    for op, arg in parts:
        if op in (sre.LITERAL, sre.IN):
            own = _class([(op, arg)] if op is sre.LITERAL else arg)
            each = [own if own is None else frozenset(own)]
        elif op is sre.SUBPATTERN:
            each = [_chars(arg[3])]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            each = [_chars(arg[2])]
        elif op is sre.BRANCH:
            each = [_chars(b) for b in arg[1]]
        else:
            return None
        if any(e is None for e in each):
            return None
        found = found.union(*each)
    return found


#: Texts, one of which stands in a match, and what may stand before it there: pieces of a class, or None where that is unknown.
Words = tuple[frozenset[str], frozenset[str] | None]


def _tells(word: str) -> bool:
    return len(word) > 1 or len(word) == 1 and not (word.isascii() and word.isalnum()) and word not in ". \n\t"


def _words(parts) -> list[Words]:
    """Lower-case texts, of two characters and more or of one that is rare, one of which stands in whatever the parts of a pattern match: all such sets."""
    found: list[Words] = []
    runs, before, lead = [""], frozenset(), frozenset()

    def end() -> None:
        nonlocal runs
        if all(map(_tells, runs)):
            found.append((frozenset(runs), before))
        runs = [""]

    plus = lambda x, y: None if x is None or y is None else x | y
    for op, arg in parts:
        one = {chr(arg).lower()} if op is sre.LITERAL else {chr(x).lower() for kind, x in arg if kind is sre.LITERAL} if op is sre.IN and all(kind is sre.LITERAL for kind, _ in arg) else set()
        if one and len(one) * len(runs) <= 4:
            if runs == [""]:
                before = lead
            runs = [r + c for r in runs for c in sorted(one)]
        elif op is not sre.AT:
            end()
            inner: list[Words] = []
            if op is sre.SUBPATTERN:
                inner = _words(arg[3])
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
                inner = _words(arg[2])  # those of the first round
            elif op is sre.BRANCH:
                each = [_best(_words(b)) for b in arg[1]]
                if all(each):
                    led = [e[1] for e in each]
                    inner = [(frozenset().union(*[e[0] for e in each]), None if None in led else frozenset().union(*led))]
            found += [(w, plus(lead, b)) for w, b in inner]
        lead = plus(lead, _chars([(op, arg)]))
    end()
    return found


def _best(found: list[Words]) -> Words | None:
    return max(found, key=lambda f: min(map(len, f[0])), default=None)


@cache
def needed_words(patterns: tuple[str, ...]) -> frozenset[str] | None:
    """Lower-case texts without any of which none of the patterns can match, whatever their case; None where a pattern needs no word. Of several such sets of a
    pattern the one whose shortest text is longest."""
    each = [_best(_words(sre_parser.parse(p, re.NOFLAG))) for p in patterns]
    return frozenset().union(*[e[0] for e in each]) if each and all(each) else None


@cache
def led_words(pattern: str) -> tuple[frozenset[str], str] | None:
    """Lower-case texts, one of which stands in every match, and the inside of a class of all that may stand before it in the match (empty: nothing may). None
    where there are none, and for patterns that look at what is around a match."""
    parts = sre_parser.parse(pattern, re.NOFLAG)
    found = _best([w for w in _words(parts) if w[1] is not None])
    return None if found is None or _looks_around(parts) else (found[0], "".join(sorted(found[1])))


def _looks_around(parts) -> bool:
    for op, arg in parts:
        if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            return True
        inner = [arg[3]] if op is sre.SUBPATTERN else [arg[2]] if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) else arg[1] if op is sre.BRANCH else []
        if any(map(_looks_around, inner)):
            return True
    return False


# The patterns, ranges, labels and word lists below are fixed values: results must equal those of the rules that they state.

_PERCENT = r"([0-9]+\.?[0-9]*)\s*%"
_HOURS = r"([0-9]+\.?[0-9]*)\s*(?:h|hr|hrs|hour|hours)"
_PAIR = r"\(([0-9]?\.[0-9]+)\s*[,，]\s*([0-9]?\.[0-9]+)\)"
_LABELS = (r"(?i)\b(champion device|best device|optimized device|control device|reference device)\b", r"(?i)\b(device\s*[A-Z0-9])\b", r"(?i)\b(sample\s*[A-Z0-9])\b", r"(?i)\b(QLED[-\s]*[A-Z0-9]+)\b")

OLED = RulePack(
    metrics={
        "structure": Metric((r"((?:ITO|Glass)\s*/\s*[A-Za-z0-9:+()._\-\s]{1,40}(?:\s*/\s*[A-Za-z0-9:+()._\-\s]{1,40}){2,8})",), cap=3, longer_than=10),
        "eqe": Metric((r"(?i)EQE[^0-9<≥>]*?" + _PERCENT, r"(?i)external quantum efficiency[^0-9<≥>]*?" + _PERCENT, r"(?i)max(?:imum)?\s+EQE[^0-9]*?" + _PERCENT), 0.1, 80, 2, "%"),
        "cie": Metric((r"(?i)CIE[^0-9]*?" + _PAIR, r"(?i)" + _PAIR + r"[^)]*CIE", r"(?i)色度坐标[^0-9]*?" + _PAIR, r"(?i)color\s*coordinates?[^0-9]*?" + _PAIR, r"(?i)\b(?:x|y)\s*=\s*([0-9]?\.[0-9]+)\s*,?\s*(?:x|y)\s*=\s*([0-9]?\.[0-9]+)"), 0, 1, 4, pair=True),
        "lifetime": Metric((r"(?i)T[⑤5]0[^0-9]*?" + _HOURS, r"(?i)LT[⑤5]0[^0-9]*?" + _HOURS, r"(?i)lifetime[^0-9]*?([0-9]+\.?[0-9]*)\s*(?:h|hour|hours)"), 1, 50_000, 1, " h"),
        "luminance": Metric((r"(?i)(?:luminance|brightness)\s*[:=]?\s*([0-9]+(?:\.[0-9]+)?(?:\s*×\s*10\^[0-9]+)?\s*(?:cd/m²|cd/m2|cd\s*/\s*m\s*²|nits))", r"(?i)([0-9]+(?:\.[0-9]+)?(?:\s*×\s*10\^[0-9]+)?\s*(?:cd/m²|cd/m2|cd\s*/\s*m\s*²|nits))")),
        "current_efficiency": Metric((r"(?i)(?:current\s*efficiency|CE)\s*[:=]?\s*([0-9]+(?:\.[0-9]+)?\s*cd/A)", r"(?i)([0-9]+(?:\.[0-9]+)?\s*cd/A)")),
        "power_efficiency": Metric((r"(?i)(?:power\s*efficiency|PE)\s*[:=]?\s*([0-9]+(?:\.[0-9]+)?\s*lm/W)", r"(?i)([0-9]+(?:\.[0-9]+)?\s*lm/W)")),
    },
    signals={"structure": 2, "eqe": 2, "cie": 1, "lifetime": 1},
    labels=_LABELS,
    evidence={
        "eqe": r"(?i)(?:EQE|external quantum efficiency).*?[0-9]+(?:\.[0-9]+)?\s*%",
        "cie": r"(?i)CIE.*?\([0-9]\.[0-9]+\s*[,，]\s*[0-9]\.[0-9]+\)",
        "lifetime": r"(?i)(?:T[⑤5]0|lifetime).*?[0-9]+(?:\.[0-9]+)?\s*(?:h|hr|hrs|hour|hours)",
        "structure": r"(?i)(?:device\s+structure|architecture).*?ITO",
    },
    classes={"OLED": (r"(?i)\bOLED\b", r"(?i)organic\s+light.emitting\s+diode"), "PLED": (r"(?i)\bPLED\b", r"(?i)polymer\s+light.emitting\s+diode"), "QLED": (r"(?i)\bQLED\b", r"(?i)quantum\s+dot\s+LED"), "PeLED": (r"(?i)\bPeLED\b", r"(?i)perovskite\s+LED"), "LED": (r"(?i)\bLED\b", r"(?i)light.emitting\s+diode")},
    tags={
        "材料合成": ("synthesis", "material design", "precursor"),
        "核壳结构": ("core-shell", "core/shell", "shell growth"),
        "表面处理": ("surface treatment", "surface modification", "passivation"),
        "配体工程": ("ligand engineering", "ligand exchange"),
        "器件结构": ("device architecture", "device structure"),
        "工艺优化": ("annealing", "thermal treatment"),
    },
    critical=("eqe", "structure", "cie"),
    important=("lifetime", "luminance", "current_efficiency"),
)

SOLAR_CELL = RulePack(
    metrics={
        "pce": Metric((r"(?i)PCE[^0-9<≥>]*?" + _PERCENT, r"(?i)power conversion efficiency[^0-9<≥>]*?" + _PERCENT, r"(?i)efficiency[^0-9<≥>]*?" + _PERCENT, r"(?i)η[^0-9<≥>]*?" + _PERCENT), 0.1, 80, 2, "%"),
        "jsc": Metric((r"(?i)Jsc[^0-9]*?([0-9]+\.?[0-9]*)\s*(?:mA/cm²|mA cm⁻²|mA·cm⁻²)", r"(?i)short.circuit current[^0-9]*?([0-9]+\.?[0-9]*)\s*(?:mA/cm²|mA cm⁻²)"), 0, 100, 2, " mA/cm²"),
        "voc": Metric((r"(?i)Voc[^0-9]*?([0-9]+\.?[0-9]*)\s*V", r"(?i)open.circuit voltage[^0-9]*?([0-9]+\.?[0-9]*)\s*V"), 0, 10, 2, " V"),
        "ff": Metric((r"(?i)FF[^0-9]*?([0-9]+\.?[0-9]*)\s*%?", r"(?i)fill factor[^0-9]*?([0-9]+\.?[0-9]*)\s*%?"), 0, 100, 2, "%"),
        "structure": Metric((r"((?:FTO|ITO|Glass)\s*/\s*[A-Za-z0-9:+()._\-\s]{1,50}(?:\s*/\s*[A-Za-z0-9:+()._\-\s]{1,50}){2,10})",), cap=3, longer_than=10),
    },
    signals={"pce": 2, "structure": 2, "jsc": 1, "voc": 1, "ff": 1},
    labels=_LABELS,
    classes={"Perovskite SC": (r"(?i)perovskite\s+solar\s+cell", r"PSC", r"(?i)perovskite\s+photovoltaic"), "Organic SC": (r"(?i)organic\s+solar\s+cell", r"OSC", r"(?i)organic\s+photovoltaic", r"OPV"), "DSSC": (r"(?i)dye.sensitized\s+solar\s+cell", r"DSSC", r"(?i)dye.sensitized"), "CIGS": (r"CIGS", r"Cu\(In,Ga\)Se2")},
    tags={
        "界面工程": ("interface engineering", "interface modification", "interfacial layer"),
        "钝化层": ("passivation", "passivating", "defect passivation"),
        "组分调控": ("composition engineering", "composition tuning", "mixed cation"),
        "溶剂工程": ("solvent engineering", "antisolvent", "solvent treatment"),
        "退火处理": ("annealing", "thermal annealing", "post-treatment"),
        "添加剂工程": ("additive engineering", "additive"),
    },
    critical=("pce", "jsc", "voc", "ff"),
    important=("stability", "hysteresis"),
)

_MAH, _WH, _MOLAR = r"(?:mAh/g|mAh\s*g⁻¹)", r"(?:Wh/kg|Wh\s*kg⁻¹)", r"(?:nM|μM|mM|ppb|ppm)"
_NUMBER = r"([0-9]+\.?[0-9]*)"

BATTERY = RulePack(
    metrics={
        "capacity": Metric((r"(?i)" + _NUMBER + r"\s*(?:mAh/g|mAh\s*g⁻¹|mAh·g⁻¹)", r"(?i)capacity[^0-9]*?" + _NUMBER + r"\s*" + _MAH, r"(?i)specific capacity[^0-9]*?" + _NUMBER + r"\s*" + _MAH), 0, 10_000, 1, " mAh/g"),
        "cycling_stability": Metric((r"(?i)([0-9]+\.?[0-9]*\s*%\s*(?:after|for)\s*[0-9]+\s*cycles?)", r"(?i)([0-9]+\s*cycles?[^0-9]*?[0-9]+\.?[0-9]*\s*%)", r"(?i)(capacity retention[^0-9]*?[0-9]+\.?[0-9]*\s*%)")),
        "energy_density": Metric((r"(?i)" + _NUMBER + r"\s*(?:Wh/kg|Wh\s*kg⁻¹|Wh·kg⁻¹)", r"(?i)energy density[^0-9]*?" + _NUMBER + r"\s*" + _WH), 0, 5000, 1, " Wh/kg"),
        "coulombic_efficiency": Metric((r"(?i)Coulombic efficiency[^0-9]*?" + _NUMBER + r"\s*%", r"(?i)CE[^0-9]*?" + _NUMBER + r"\s*%"), 0, 100.5, 2, "%"),
    },
    signals={"capacity": 2, "cycling_stability": 1, "energy_density": 1},
    labels=_LABELS,
    classes={"Li-ion": (r"(?i)Li.ion\s+battery", r"(?i)lithium.ion\s+battery", r"LIB"), "Solid-state": (r"(?i)solid.state\s+battery", r"(?i)solid\s+electrolyte", r"(?i)all.solid.state"), "Li-S": (r"(?i)lithium.sulfur", r"(?i)Li.S\s+battery"), "Na-ion": (r"(?i)sodium.ion", r"(?i)Na.ion\s+battery")},
    tags={
        "材料改性": ("material modification", "doping", "coating", "surface modification"),
        "界面工程": ("interface engineering", "sei", "interphase", "interface layer"),
        "电解质优化": ("electrolyte optimization", "electrolyte additive", "solid electrolyte"),
        "结构设计": ("structure design", "nanostructure", "hierarchical structure"),
        "粘结剂优化": ("binder optimization", "binder design"),
    },
    critical=("capacity", "cycling_stability"),
    important=("energy_density", "coulombic_efficiency"),
)

SENSOR = RulePack(
    metrics={
        "sensitivity": Metric((r"(?i)sensitivity[^0-9]*?" + _NUMBER + r"\s*(?:μA/mM|μA\s*mM⁻¹|mA/mM|V/pH)", r"(?i)" + _NUMBER + r"\s*(?:μA/mM|μA\s*mM⁻¹|mA/mM|V/pH)\s*(?:cm⁻²|cm²)?"), 0, 1e9, 2),
        "detection_limit": Metric((r"(?i)LOD[^0-9]*?([0-9]+\.?[0-9]*\s*" + _MOLAR + ")", r"(?i)limit of detection[^0-9]*?([0-9]+\.?[0-9]*\s*" + _MOLAR + ")", r"(?i)detection limit[^0-9]*?([0-9]+\.?[0-9]*\s*" + _MOLAR + ")")),
        "linear_range": Metric((r"(?i)linear range[^0-9]*?" + _NUMBER + r"\s*[-–]\s*" + _NUMBER + r"\s*(?:nM|μM|mM|M)", r"(?i)" + _NUMBER + r"\s*[-–]\s*" + _NUMBER + r"\s*(?:nM|μM|mM|M)"), decimals=2, pair=True),
        "response_time": Metric((r"(?i)response time[^0-9]*?" + _NUMBER + r"\s*s", r"(?i)" + _NUMBER + r"\s*s\s*response"), 0, 100_000, 1, " s"),
    },
    signals={"sensitivity": 2, "detection_limit": 2, "response_time": 1},
    labels=_LABELS,
    classes={"Electrochemical": (r"(?i)electrochemical\s+sensor", r"(?i)amperometric", r"(?i)potentiometric", r"(?i)voltammetric"), "Optical": (r"(?i)optical\s+sensor", r"(?i)fluorescence", r"(?i)colorimetric", r"(?i)surface plasmon"), "Biosensor": (r"(?i)biosensor", r"(?i)biological\s+sensor", r"(?i)enzyme\s+sensor"), "Gas sensor": (r"(?i)gas\s+sensor", r"(?i)chemiresistor", r"(?i)MOX\s+sensor")},
    tags={
        "材料选择": ("material selection", "sensing material", "recognition element"),
        "表面修饰": ("surface modification", "surface functionalization", "coating"),
        "信号放大": ("signal amplification", "amplification strategy", "enhancement"),
        "纳米材料": ("nanomaterial", "nanoparticle", "nanocomposite"),
        "生物识别": ("biorecognition", "enzyme", "antibody", "aptamer"),
    },
    critical=("sensitivity", "detection_limit", "target_analyte"),
    important=("selectivity", "response_time", "linear_range"),
)

#: Types of the document's own fields that are not text. Fixed values.
DOCUMENT_TYPES = {"impact_factor": T.DoubleType(), "impact_factor_year": T.IntegerType(), "year": T.IntegerType()}

# What follows is our own: a pack for general documents such as the test tables.

CORPUS = RulePack(
    metrics={
        "license": Metric((r"(Apache License|MIT License|General Public License|CC BY[A-Z-]*|[Aa]ll [Rr]ights [Rr]eserved)",), cap=3),
        "version": Metric((r"[Vv]ersion ([0-9]+(?:\.[0-9]+)?)", r"CC BY[A-Z-]* ([0-9]+\.[0-9]+)"), 0, 100, 1),
        "address": Metric((r"([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)", r"([A-Za-z0-9._-]+@[A-Za-z0-9.-]+[A-Za-z])")),
        "number": Metric((r"([0-9]+(?:\.[0-9]+)?)",), 0, 1e12, 2),
    },
    signals={"license": 2, "version": 1, "address": 2, "number": 1},
    labels=(r"(Copyright [0-9]+)", r"([Ll]icensed under)", r"([Rr]eleased under)"),
    evidence={"license": r"[Ll]icen|[Rr]ights", "number": r"[0-9]"},
    classes={"licensed": (r"[Ll]icense",), "reserved": (r"[Rr]ights [Rr]eserved",), "contact": (r"@",), "numeric": (r"[0-9]",)},
    tags={"permissive": ("mit license", "apache license"), "copyleft": ("general public license",), "creative": ("cc by",), "numbered": ("version",)},
    critical=("license", "version"),
    important=("address", "number"),
)

PACKS: dict[str, RulePack] = {"oled": OLED, "solar_cell": SOLAR_CELL, "battery": BATTERY, "sensor": SENSOR, "corpus": CORPUS}


def register_pack(name: str, pack: RulePack) -> None:
    """Make a pack known by name."""
    PACKS[name] = pack


def pack_schema(name: str, document: tuple[str, ...] = ()) -> T.StructType:
    """The record of a pack: fields of the document, typed, then a label, its metrics and notes, which are texts."""
    fields = [T.StructField(n, DOCUMENT_TYPES.get(n, T.StringType())) for n in document]
    return T.StructType(fields + [T.StructField(n, T.StringType()) for n in ("label", *PACKS[name].metrics, "notes")])
