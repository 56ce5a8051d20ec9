"""Word lists and patterns of the block operators. Fixed values where a comment says so; all are arguments."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Titles of sections without content of their own. Fixed values; matched at the start of a title, after its number, so that "Reference device" stays.
NOISE_TITLES = (
    r"references?", r"bibliography", r"文献", r"acknowledg?ments?", r"致谢", r"资金资助", r"author\s*contributions?", r"作者贡献", r"supplementary\s*(?:material|information|data)", r"补充材料", r"支持信息",
    r"conflict\s*of\s*interest", r"利益冲突", r"data\s*availability", r"数据可用性", r"author\s*information", r"corresponding\s*author", r"通讯作者", r"appendix", r"appendices", r"附录",
)

#: Section kinds and their titles, first match wins. Fixed values.
SECTION_TITLES = {
    "abstract": (r"abstract", r"摘要"),
    "introduction": (r"introduction", r"引言", r"background", r"背景"),
    "experimental": (r"experimental", r"materials?\s*and\s*methods?", r"实验", r"材料与方法", r"methodology"),
    "results": (r"results?", r"结果"),
    "discussion": (r"discussion", r"讨论"),
    "conclusion": (r"conclusions?", r"结论", r"summary", r"总结"),
}

FIGURE_CAPTION = r"(?i)^(?:figure|fig\.?|scheme|图|表)[ \t]*[0-9]+"
LIST_MARK = r"^(?:[-*+][ \t]+|[0-9]+[.)][ \t]+)"
TABLE_RULE = r"^\|?[ \t]*[:-]+(?:[ \t]*\|[ \t]*[:-]+)+[ \t]*\|?$"


@dataclass(frozen=True)
class BlockLexicon:
    """What makes a block relevant: words for values, words for things, patterns of measured values, titles."""

    parameters: tuple[str, ...]
    structures: tuple[str, ...]
    metrics: tuple[str, ...]
    priority_titles: tuple[str, ...]
    noisy_titles: tuple[str, ...]
    noise: tuple[str, ...] = field(default=NOISE_TITLES)


#: Optoelectronic papers. Fixed values.
DEVICE_LEXICON = BlockLexicon(
    parameters=("eqe", "external quantum efficiency", "cie", "luminance", "current efficiency", "power efficiency", "efficiency", "lifetime", "lt50", "t50", "t90", "turn-on voltage", "cd/a", "lm/w", "cd/m2", "cd/m²", "ma/cm2", "ma/cm²"),
    structures=("device", "devices", "structure", "architecture", "ito", "fto", "pedot", "pedot:pss", "htl", "etl", "eml", "host", "dopant", "layer", "spin-coating", "spin coating", "vacuum deposition"),
    metrics=(
        r"(?i)[0-9]+(?:\.[0-9]+)?[ \t]?%",
        r"(?i)[0-9]+(?:\.[0-9]+)?[ \t]?cd/A",
        r"(?i)[0-9]+(?:\.[0-9]+)?[ \t]?lm/W",
        r"(?i)[0-9]+(?:\.[0-9]+)?[ \t]?cd/m(?:²|2)",
        r"(?i)[0-9]+(?:\.[0-9]+)?[ \t]?mA/cm(?:²|2)",
        r"(?i)[0-9]+(?:\.[0-9]+)?[ \t]?V(?:[^A-Za-z]|$)",
        r"\([ \t]*0?\.[0-9]+[ \t]*,[ \t]*0?\.[0-9]+[ \t]*\)",
        r"(?i)(?:LT|T)[ \t]?(?:50|90)[ \t]*=[ \t]*[0-9]+(?:\.[0-9]+)?[ \t]?h",
    ),
    priority_titles=("abstract", "experimental", "method", "results", "discussion", "device", "performance", "characterization", "figure", "table"),
    noisy_titles=("introduction", "background", "related work", "literature review"),
)

#: General web and prose documents, such as the test tables.
CORPUS_LEXICON = BlockLexicon(
    parameters=("licen", "version", "public", "rights", "e-mail", "price"),
    structures=("tion", "ement", "keit", "ción", "http"),
    metrics=(r"[0-9]+(?:\.[0-9]+)?[ \t]?%", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+", r"[0-9]{4,}"),
    priority_titles=("the", "der", "la "),
    noisy_titles=("ing", "en "),
)
