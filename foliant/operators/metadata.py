"""Bibliographic metadata from a title, the first pages and the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import occurrences, strip

# Keyword lists by subject, in order (the first of equal scores wins). The upper-case keyword never hits lower-cased text.
SUBJECTS = {
    "mathematics": ("theorem", "proof", "lemma", "algebra", "calculus", "topology", "geometry", "equation", "matrix", "integral", "manifold", "eigenvalue"),
    "computer science": ("algorithm", "data structure", "complexity", "programming", "software", "database", "compiler", "operating system", "machine learning", "distributed system", "concurrency", "hash table", "binary tree", "linked list", "API"),
    "physics": ("mechanics", "quantum", "thermodynamics", "electromagnetism", "relativity", "particle physics", "wave function", "kinetic energy", "potential energy", "newton"),
    "statistics": ("probability", "distribution", "hypothesis", "regression", "variance", "bayesian", "sampling", "confidence interval", "p-value", "random variable"),
    "engineering": ("circuit design", "signal processing", "control theory", "structural analysis", "fluid dynamics", "mechanical engineering", "electrical engineering", "civil engineering"),
    "biology": ("cell", "protein", "gene", "organism", "evolution", "ecology", "molecular", "dna", "rna", "metabolism"),
    "chemistry": ("reaction", "compound", "molecule", "organic chemistry", "inorganic", "periodic table", "chemical bond", "solution", "acid"),
    "economics": ("market", "supply and demand", "equilibrium", "fiscal", "monetary", "inflation", "gdp", "utility", "microeconomics", "macroeconomics"),
}
# Patterns.
EDITION = r"(?i)(\d+)(?:st|nd|rd|th)\s+edition"
YEAR = r"\b(19[5-9]\d|20[0-3]\d)\b"
BY_AUTHOR = r"(?md)\bby\s+([A-Z][a-z]+(?:\s+[A-Z]\.?\s*)?(?:\s+[A-Z][a-z]+){1,3})"
NAME_LINE = r"(?md)^([A-Z][a-z]+(?:\s+[A-Z]\.?\s*)?(?:\s+[A-Z][a-z]+){1,2})\s*$"
COPYRIGHT = r"(?i)[©Ⓒ]\s*(?:Copyright\s+)?(\d{4})\s+(?:by\s+)?([^.\n]{5,60})"
NOT_AUTHORS = ("the", "this", "chapter", "part", "section", "table", "figure", "new york", "press", "university")
ARABIC, CJK, CYRILLIC, LATIN = "[؀-ۿ]", "[一-鿿぀-ゟ゠-ヿ]", "[Ѐ-ӿ]", "[a-zA-Z]"


def author(first: Column) -> Column:
    head = F.substring(first, 1, 1000)
    names = [strip(F.regexp_extract(head, p, 1)) for p in (BY_AUTHOR, NAME_LINE)]
    own = [F.when((n != "") & ~F.lower(n).isin(*NOT_AUTHORS), n) for n in names]
    holder = strip(F.regexp_extract(first, COPYRIGHT, 2))
    return F.coalesce(*own, holder)


def edition(first: Column) -> Column:
    n = F.regexp_extract(first, EDITION, 1)
    return F.when(n == "", "").otherwise(F.concat(n, F.when(n == "1", "st").when(n == "2", "nd").when(n == "3", "rd").otherwise("th")))


def year(first: Column) -> Column:
    owned = F.regexp_extract(first, COPYRIGHT, 1)
    return F.when(owned != "", owned).otherwise(F.coalesce(F.array_max(F.regexp_extract_all(F.substring(first, 1, 2000), F.lit(YEAR), F.lit(1))), F.lit("")))


def subject(title: Column, text: Column) -> Column:
    where = F.concat(F.repeat(F.concat(F.lower(title), F.lit(" ")), 5), F.lower(F.substring(text, 1, 10000)))
    scores = []
    for k, (name, keys) in enumerate(SUBJECTS.items()):
        n = F.lit(0)
        for key in keys:
            n = n + occurrences(where, F.lit(key))
        scores.append(F.struct(n.alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("name")))
    best = F.array_max(F.array(*scores))
    return F.when(best.n > 0, best["name"]).otherwise("")


def language(text: Column) -> Column:
    head = F.regexp_replace(F.substring(text, 1, 5000), r"(?s)\$\$.*?\$\$|\$.*?\$|```.*?```", "")
    head = F.regexp_replace(head, r"[#*_\[\](){}|>]", "")
    a, c, y, x = (F.regexp_count(head, F.lit(p)) for p in (ARABIC, CJK, CYRILLIC, LATIN))
    share = lambda n: F.coalesce(F.try_divide(n.cast("double"), a + c + y + x), F.lit(0.0)) > 0.3
    return F.when(share(a), "ar").when(share(c), "zh").when(share(y), "ru").otherwise("en")


def extract(books: DataFrame, id_col: str = "id") -> DataFrame:
    """books(id, title, text, and info_author, info_subject if known) -> (id, author, subject, edition, year, language)."""
    t, first = F.coalesce("text", F.lit("")), F.substring(F.coalesce("text", F.lit("")), 1, 3000)
    known = lambda c: F.nullif(strip(F.col(c)), F.lit("")) if c in books.columns else F.lit(None).cast("string")
    return books.select(F.col(id_col).alias("id"), strip(F.coalesce(known("info_author"), author(first), F.lit(""))).alias("author"), F.coalesce(known("info_subject"), subject(F.coalesce("title", F.lit("")), t)).alias("subject"), edition(first).alias("edition"), year(first).alias("year"), language(t).alias("language"))
