"""Content density: marker counts per paragraph and labels. Pure column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, paragraphs, word_count
from .structure import section_list

# Marker families. (?i) is ASCII-only in Java.
DISPLAY_MATH = r"(?s)\$\$.+?\$\$"
INLINE_MATH = r"(?<!\$)\$[^$\n]+?\$(?!\$)"
CODE = r"(?md)```[\s\S]*?```|(?:^    .+$\n?)++"
EXAMPLE = r"(?i)(?:for\s+example|e\.g\.,?|for\s+instance|consider\s+(?:the|a|an)|(?:imagine|suppose|say)\s+(?:that|we|you)|(?:real-world|practical)\s+example|case\s+study|(?:Figure|Table|Listing)\s+\d)"
COMPARISON = r"(?i)(?:unlike|compared\s+to|in\s+contrast|on\s+the\s+other\s+hand|whereas|while|however|alternatively|instead|advantage|disadvantage|trade-?off|pros?\s+and\s+cons?|vs\.?|versus)"
ALGORITHM = r"(?i)(?:algorithm|step\s+\d|procedure|(?:first|second|third|finally),?\s+(?:we|the|it)|pseudo\s*code|implementation|function\s+\w+|class\s+\w+|def\s+\w+|import\s+)"
PROOF = r"(?i)(?:Q\.E\.D\.|∎|■|\bproof\b|\btherefore\b|\bhence\b|\bit\s+follows|\bwe\s+conclude|\bwe\s+have\s+shown|\bsufficiency|\bnecessity|\bby\s+(?:induction|contradiction|contrapositive))"
PROBLEM = r"(?i)(?:\bexercise\b|\bproblem\b|\bquestion\b|\bfind\s+(?:the|a|an)\b|\bshow\s+that\b|\bprove\s+that\b|\bcalculate\b|\bcompute\b|\bdetermine\b|\bverify\s+that\b|\bhomework|\bassignment)"
DEFINITION = r"(?i)(?:is\s+defined\s+as|refers?\s+to|means?|is\s+(?:a|an|the)\s+\w+\s+(?:that|which|where)|we\s+call|known\s+as|termed)"
BOLD = r"\*\*[^*]+\*\*"
LIST = r"(?md)^\s*[-*•]\s+|^\s*\d+\.\s+"

#: What the alternatives of a family begin with, beside single characters; a blank is any white space.
HEADS = {
    EXAMPLE: ("for", "e.g", "con", "ima", "sup", "say", "rea", "pra", "cas", "fig", "tab", "lis"),
    COMPARISON: ("un", "co", "in", "on", "wh", "ho", "al", "ad", "di", "tr", "pr", "vs", "ve"),
    ALGORITHM: ("alg", "ste", "pro", "fir", "sec", "thi", "fin", "pse", "imp", "fun", "cla", "def"),
    PROOF: ("q.e", "pro", "the", "hen", "it ", "we ", "suf", "nec", "by "),
    PROBLEM: ("exe", "pro", "que", "fin", "sho", "cal", "com", "det", "ver", "hom", "ass"),
    DEFINITION: ("is ", "ref", "mea", "we ", "kno", "ter"),
}

COUNTS = (("display_math", DISPLAY_MATH), ("inline_math", INLINE_MATH), ("code", CODE), ("example", EXAMPLE), ("comparison", COMPARISON), ("algorithm", ALGORITHM), ("definition", DEFINITION), ("bold", BOLD), ("list", LIST), ("proof", PROOF), ("problem", PROBLEM))
NAMES = ("word_count", "para_count", "math_per_para", "display_math_count", "inline_math_count", "code_per_para", "code_count", "example_ratio", "example_count", "comparison_ratio", "comparison_count", "algorithm_ratio", "definition_ratio", "definition_count", "bold_ratio", "bold_count", "list_ratio", "list_count", "proof_ratio", "proof_count", "problem_ratio", "problem_count")
#: Labels in their order of declaration, which breaks ties.
LABELS = ("concept-dense", "math-heavy", "example-rich", "implementation-focused", "comparison", "proof-heavy", "problem-set", "introductory")


def quick(pattern: str) -> str:
    """A pattern of the same matches that turns most places away by two or three characters, before its alternatives are tried."""
    if pattern not in HEADS:
        return pattern
    classes = ("[" + "".join(sorted({r"\s" if c == " " else c for c in place})) + "]" for place in zip(*HEADS[pattern], strict=True))
    rest = f"(?={''.join(classes)}){pattern.removeprefix('(?i)')}"
    return f"(?i)(?:[∎■]|{rest})" if pattern == PROOF else f"(?i){rest}"


def counts(t: Column) -> Column:
    """struct<words, paras, count of each family>, each counted once; all 0 for a text without words."""

    def of(words):
        some = lambda c: F.when(words > 0, c).otherwise(0)
        paras = F.greatest(F.lit(1), F.size(F.filter(paragraphs(t), lambda p: p.rlike(r"\S"))))
        return F.struct(words.alias("words"), some(paras).alias("paras"), *(some(F.regexp_count(t, F.lit(quick(p)))).alias(k) for k, p in COUNTS))

    return let(word_count(t), of)


def stats(n: Column) -> dict[str, Column]:
    """The 22 statistics of a text from its counts()."""
    paras = n["paras"]
    per = lambda c: F.coalesce(F.try_divide(c.cast("double"), paras), F.lit(0.0))
    out = {"word_count": n["words"], "para_count": paras, "math_per_para": per(n["display_math"] + n["inline_math"]), "display_math_count": n["display_math"], "inline_math_count": n["inline_math"], "code_per_para": per(n["code"]), "code_count": n["code"]}
    for k in ("example", "comparison", "algorithm", "definition", "bold", "list", "proof", "problem"):
        out[f"{k}_ratio"] = per(n[k])
        if k != "algorithm":
            out[f"{k}_count"] = n[k]
    return out


def _steps(*rules: tuple[Column, float]) -> Column:
    """The first rule that holds."""
    out = F.lit(0.0)
    for cond, v in reversed(rules):
        out = F.when(cond, F.lit(v)).otherwise(out)
    return out


def labels(c: Callable[[str], Column] = F.col) -> Column:
    """Ranked labels from the statistics, which c gives by name: columns of the row, or fields of a struct."""
    ratios = [c(f"{k}_ratio") for k in ("example", "comparison", "algorithm", "definition", "bold", "list", "proof", "problem")]
    score = {
        "concept-dense": _steps((c("definition_ratio") >= 0.3, 2.0)) + _steps((c("bold_ratio") >= 0.5, 2.0), (c("bold_ratio") >= 0.2, 1.0)),
        "math-heavy": _steps((c("math_per_para") >= 1.0, 3.0), (c("math_per_para") >= 0.3, 1.5)) + _steps((c("display_math_count") >= 3, 2.0)),
        "example-rich": _steps((c("example_ratio") >= 0.3, 2.0), (c("example_ratio") >= 0.15, 1.0)),
        "implementation-focused": _steps((c("code_per_para") >= 0.3, 3.0), (c("code_count") >= 2, 1.5)) + _steps((c("algorithm_ratio") >= 0.2, 1.5)),
        "comparison": _steps((c("comparison_ratio") >= 0.3, 2.5), (c("comparison_ratio") >= 0.15, 1.0)),
        "proof-heavy": _steps((c("proof_ratio") >= 0.3, 3.0), (c("proof_ratio") >= 0.15, 1.5)) + _steps((c("proof_count") >= 5, 1.0)),
        "problem-set": _steps((c("problem_ratio") >= 0.3, 3.0), (c("problem_ratio") >= 0.15, 1.5)) + _steps((c("problem_count") >= 5, 1.5)),
        "introductory": _steps((c("word_count") < 300, 1.0)) + F.when(F.greatest(*ratios) < 0.1, 2.0).otherwise(0.0),
    }
    ranked = F.array_sort(F.array(*(F.struct((-score[k]).alias("s"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(LABELS))))
    own = F.transform(F.filter(ranked, lambda x: x.s <= -1.0), lambda x: x.k)
    return F.when(F.size(own) > 0, own).otherwise(F.array(F.lit("general")))


def analyze(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, 22 statistics, types) of whole texts."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), counts(t).alias("n")).select("id", *(v.alias(k) for k, v in stats(F.col("n")).items()))
    return rows.withColumn("types", labels())


def section_stats(t: Column, sections: Column) -> Column:
    """array<struct<ord, title, statistics, types>> of top sections and their children, 20 words or more; a short parent hides its children."""
    parent = lambda x: F.get(sections, x.parent_ord)
    long = lambda x: x.word_count >= 20
    shown = lambda x: long(x) & (x.parent_ord.isNull() | (F.when(x.parent_ord.isNotNull(), parent(x).parent_ord.isNull() & long(parent(x)))))

    def one(x):
        piece = F.substring(t, x.start + 1, x.end - x.start)
        numbers = let(let(piece, counts), lambda n: F.struct(*(v.alias(k) for k, v in stats(n).items())))
        return let(numbers, lambda n: F.struct(x.ord.alias("ord"), x.title.alias("title"), *(n[k].alias(k) for k in NAMES), labels(lambda k: n[k]).alias("types")))

    return F.transform(F.filter(sections, shown), one)


def by_section(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, ord, title, statistics, types), see section_stats(); sections are cut in the row, texts are never shuffled."""
    found = let(F.coalesce(F.col(text_col), F.lit("")), lambda t: let(section_list(t), lambda s: section_stats(t, s)))
    rows = docs.select(F.col(id_col).alias("id"), F.explode(found).alias("x"))
    return rows.select("id", *(F.col(f"x.{k}").alias(k) for k in ("ord", "title", *NAMES, "types")))
