"""Text functions on columns: splitting, cleaning, years, citation counts, comparison keys, equivalence rules."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Dashes that become a hyphen, and the characters stripped from both ends of a term. Fixed values.
DASHES = "‐‑‒–—−"
EDGES = " \t\r\n\"'.,;:!?，。；：！？、"

#: Equivalence rules, applied in this order, case-insensitively: pattern, replacement. Fixed values.
EQUIVALENTS = [
    (r"\bmodelling\b", "modeling"),
    (r"\bbehaviour\b", "behavior"),
    (r"\bprogramme\b", "program"),
    (r"\boptimisation\b", "optimization"),
    (r"\borganisation\b", "organization"),
    (r"\banalyse\b", "analyze"),
    (r"\bthe elderly\b", "older adult"),
    (r"\belderly people\b", "older adult"),
    (r"\belderly\b", "older adult"),
    (r"\bsenior citizen\b", "older adult"),
    (r"\baged people\b", "older adult"),
    (r"\bliving alone\b", "solitary living"),
    (r"\bsolo living\b", "solitary living"),
    (r"\blive alone\b", "solitary living"),
    (r"\bhome automation\b", "smart home"),
    (r"\bsmart homes\b", "smart home"),
    (r"\baal\b", "ambient assisted living"),
    (r"\bambient assistive living\b", "ambient assisted living"),
    (r"\bhealthcare monitoring\b", "health monitoring"),
    (r"\bhealth care monitoring\b", "health monitoring"),
    (r"\btelemonitoring\b", "remote monitoring"),
    (r"\bremote health monitoring\b", "remote monitoring"),
    (r"\biot\b", "internet of things"),
    (r"\bict\b", "information and communication technology"),
    (r"\bwelfare technology\b", "assistive technology"),
    (r"\bassistive technologies\b", "assistive technology"),
    (r"\bhuman computer interaction\b", "human-computer interaction"),
    (r"\bhci\b", "human-computer interaction"),
    (r"\buser experience\b", "user experience"),
    (r"\bux\b", "user experience"),
    (r"^et al\.?$", ""),
    (r"^review$", ""),
]

#: Terms that name a discipline, a method or nothing in particular. Fixed values.
GENERIC_EN = (
    "computer science", "medicine", "engineering", "psychology", "business", "gerontology", "sociology", "mathematics",
    "physics", "chemistry", "biology", "materials science", "nursing", "political science", "economics", "geography",
    "environmental science", "education", "law", "history", "philosophy", "statistics", "archaeology", "geology", "art",
    "literature", "linguistics", "anthropology", "neuroscience", "biochemistry", "genetics", "ecology", "astronomy", "optics",
    "acoustics", "thermodynamics", "quantum mechanics", "electromagnetism", "electrical engineering", "mechanical engineering",
    "civil engineering", "aerospace engineering", "systems engineering", "control engineering", "control theory",
    "manufacturing engineering", "structural engineering", "computer network", "operating system", "embedded system",
    "real-time computing", "data science", "world wide web", "telecommunications", "internet privacy", "computer security",
    "distributed computing", "parallel computing", "cloud computing", "software engineering", "programming language",
    "database", "computer graphics", "image processing", "signal processing", "information technology", "information science",
    "library science", "knowledge management", "simulation", "visualization", "algorithm", "wireless", "software", "hardware",
    "computing", "population", "architecture", "context", "value (mathematics", "phase (matter", "bridging (networking",
    "set (mathematics", "quality (philosophy", "structure (mathematical", "questionnaire", "interview", "case study",
    "empirical research", "quantitative research", "qualitative research", "literature review", "systematic review",
    "meta-analysis", "survey", "quality of life", "well-being", "satisfaction", "usability", "performance", "efficiency",
    "effectiveness", "implementation", "framework", "model", "system", "method", "approach", "analysis", "evaluation",
    "assessment", "design", "development", "management",
)
GENERIC_ZH = (
    "计算机科学", "医学", "工程", "心理学", "管理学", "经济学", "社会学", "数学", "物理学", "化学", "生物学", "材料科学", "护理学", "政治学", "地理学", "环境科学", "教育学", "法学",
    "历史学", "哲学", "统计学", "情报学", "图书馆学", "影响因素", "研究进展", "研究综述", "文献综述", "研究现状", "对策建议", "启示", "综述", "述评", "研究展望", "应用现状", "研究热点",
    "可视化分析", "文献计量分析", "知识图谱", "研究趋势", "案例分析", "实证研究", "问卷调查", "深度访谈", "生活质量", "满意度", "可用性", "绩效", "效率", "框架", "模型", "系统", "方法",
    "分析", "评价", "设计", "开发", "管理", "应用", "技术",
)


def split_multi(col: Column) -> Column:
    """array<string> of the parts between semicolons, also full-width ones; trimmed, empty ones left out; null gives no parts."""
    parts = F.split(F.coalesce(col, F.lit("")), r"(?U)\s*[;；]\s*")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")


def _count(col: Column, char: str) -> Column:
    return F.length(col) - F.length(F.replace(col, F.lit(char), F.lit("")))


def balance_parens(col: Column) -> Column:
    """Without closing brackets that nothing opens, then without the last opening ones that nothing closes."""
    chars = F.filter(F.split(col, ""), lambda c: c != "")
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("text"))

    def forward(state: Column, c: Column) -> Column:
        stray = (c == ")") & (state["depth"] == 0)
        step = F.when(c == "(", 1).when((c == ")") & ~stray, -1).otherwise(0)
        return F.struct((state["depth"] + step).alias("depth"), F.when(stray, state["text"]).otherwise(F.concat(state["text"], c)).alias("text"))

    first = F.aggregate(chars, start, forward)

    def backward(state: Column, c: Column) -> Column:
        drop = (c == "(") & (state["depth"] > 0)
        return F.struct((state["depth"] - F.when(drop, 1).otherwise(0)).alias("depth"), F.when(drop, state["text"]).otherwise(F.concat(c, state["text"])).alias("text"))

    second = F.aggregate(F.reverse(F.filter(F.split(first["text"], ""), lambda c: c != "")), F.struct(first["depth"].alias("depth"), F.lit("").alias("text")), backward)
    return second["text"]


def clean_term(col: Column) -> Column:
    """A term without surrounding punctuation, with plain hyphens, balanced brackets and single spaces; null and blank give ''.

    A term wholly in brackets is unwrapped; a qualifier that is opened and never closed is cut off.
    """
    t = F.translate(F.regexp_replace(F.coalesce(col, F.lit("")), r"(?U)^\s+|\s+$", ""), DASHES, "-" * len(DASHES))
    t = F.btrim(t, F.lit(EDGES))
    inner = F.regexp_replace(F.substring(t, F.lit(2), F.length(t) - 2), r"(?U)^\s+|\s+$", "")
    t = F.when((F.length(t) > 2) & t.startswith("(") & t.endswith(")") & (_count(inner, "(") == _count(inner, ")")), inner).otherwise(t)
    cut = F.regexp_replace(F.regexp_replace(t, r"(?U)\s*\([^)]*$", ""), r"(?U)^\s+|\s+$", "")
    t = F.when(_count(t, "(") == _count(t, ")"), t).when((cut != "") & (_count(cut, "(") == _count(cut, ")")), cut).otherwise(balance_parens(t))
    return F.trim(F.regexp_replace(F.btrim(t, F.lit(EDGES)), r"(?U)\s+", " "))


def clean_terms(col: Column) -> Column:
    """Cleaned terms of an array, without those that nothing is left of."""
    return F.filter(F.transform(col, clean_term), lambda t: t != "")


def year(col: Column) -> Column:
    """First year from 1900 to 2099 that stands as a word of its own, '' if there is none."""
    return F.regexp_extract(F.coalesce(col, F.lit("")), r"(?U)\b((?:19|20)\d{2})\b", 1)


def citations(col: Column) -> Column:
    """All digits as one number, null if there are none."""
    return F.nullif(F.regexp_replace(col, r"\D", ""), F.lit("")).try_cast("bigint")


def comparison_form(term: str | None) -> str | None:
    """Lower case, NFKC, hyphens, underscores and white space one space."""
    if term is None:
        return None
    t = unicodedata.normalize("NFKC", term.strip().lower())
    return re.sub(r"[\s\-_]+", " ", re.sub("[‐–—]", "-", t)).strip()


@F.arrow_udf(T.StringType())
def _comparison(values: pa.Array) -> pa.Array:
    coded = values.dictionary_encode()
    return pa.array([comparison_form(x) for x in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)


def normalize(col: Column) -> Column:
    """comparison_form of a column; Spark has no function for NFKC, so batches go through Arrow, each distinct value once."""
    return _comparison(col)


def singularize(word: Column) -> Column:
    """Plain singular of an English plural."""
    n = F.length(word)
    return (
        F.when(n <= 3, word)
        .when(word.endswith("ies") & (n > 4), F.concat(F.substring(word, F.lit(1), n - 3), F.lit("y")))
        .when(word.rlike("(?:sses|shes|ches|xes|zes)$"), F.substring(word, F.lit(1), n - 2))
        .when(word.endswith("s") & ~word.rlike("(?:ss|us|is)$"), F.substring(word, F.lit(1), n - 1))
        .otherwise(word)
    )


def key_form_of(normal: Column) -> Column:
    """Comparison key of a normalised term: words without punctuation, each in the singular."""
    words = F.filter(F.split(F.regexp_replace(normal, r"(?U)[^\w\s]", " "), r"(?U)\s+"), lambda w: w != "")
    return F.concat_ws(" ", F.transform(words, singularize))


def key_form(term: Column) -> Column:
    """Comparison key of a term."""
    return key_form_of(normalize(term))


def equivalents(term: Column) -> Column:
    """A term after the equivalence rules; the term itself where they leave nothing."""
    t = term
    for pattern, replacement in EQUIVALENTS:
        t = F.regexp_replace(t, "(?iU)" + pattern, replacement)
    t = F.regexp_replace(F.regexp_replace(t, r"(?U)\s+", " "), r"^ | $", "")
    return F.when(t == "", term).otherwise(t)


def text_from_positions(index: Column) -> Column:
    """Text of an inverted index map<word, array<position>>: words by position, then by name; null for a null index."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.when(index.isNotNull(), F.concat_ws(" ", F.transform(F.array_sort(placed), lambda x: x["w"])))
