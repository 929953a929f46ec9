"""Key concepts of chapters: ten extraction steps, merged, counted, scored and ranked.

Everything is an array expression inside the row, from the text to the ranked list: nothing is shuffled, and rows with equal ids stay
apart. Merging and bigram counting sort an array and cut it into runs of equal keys, so they cost n log n in the findings of a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import groups, let, occurrences, pieces, strip, tokens
from .structure import HEADING

# Patterns and word lists.
BOLD = r"(?d)\*\*(.+?)\*\*|__(.+?)__"
AFTER_BOLD = r"(?d)^\s*[:—–\-]+\s*(.+?)(?:\.|$)"
DEFINITION = r"""(?md)(?:^|\.\s+)(?:An?\s+)?["“]?([A-Z][^.!?]{2,60}?)["”]?\s+(?:is\s+(?:defined\s+as|a|an|the)|refers?\s+to|means?|represents?)\s+([^.!?]{10,200})[.!?]"""
PARENTHETICAL = r"(\b[A-Z][a-z]+(?:\s+[A-Za-z]+){0,3})\s+\(([^)]{10,150})\)"
ACRONYM = r"\b([A-Z]{2,6})\b"
EXPANSION = r"\b([A-Z]{2,6})\s+\(([A-Z][^)]{5,80})\)"
HYPHENATED = r"\b([a-z]+-[a-z]+(?:-[a-z]+)?)\b"
LISTED = r"(?md)(?:^[-*•]\s+|\d+\.\s+)(?:\*\*(.+?)\*\*|__(.+?)__)\s*[:—–\-]+\s*(.+?)$"
BLOCK = r"(?sid)(?:^|\n)\s*\*?\*?(Theorem|Lemma|Definition|Corollary|Proposition|Axiom|Conjecture)\s*[\d.]*\*?\*?\s*[:(.\-]\s*(.+?)(?=\n\s*\*?\*?(?:Theorem|Lemma|Definition|Corollary|Proposition|Axiom|Conjecture|Proof|$)|\n\n)"
FIRST_USE = r"\b((?:[A-Z][a-z]{2,}(?:\s+|-)){1,3}[A-Z][a-z]{2,})\b"
NOISE = (
    "the", "and", "for", "that", "this", "with", "from", "are", "was", "were", "been", "have", "has", "had", "will", "would", "could", "should",
    "may", "might", "can", "not", "but", "also", "which", "when", "where", "who", "what", "how", "why", "all", "each", "every", "some", "any", "most",
    "more", "less", "very", "just", "only", "then", "than", "into", "over", "such", "other", "figure", "table", "chapter", "section", "page",
    "example", "note", "see", "however", "therefore", "thus", "hence",
)
FIRST_USE_NOISE = (
    "the", "and", "for", "that", "this", "with", "from", "are", "was", "were", "been", "have", "has", "had", "will", "would", "could", "should",
    "may", "might", "can", "not", "but", "also", "which", "when", "where", "who", "what", "how", "why", "all", "each", "every", "some", "any", "most",
    "more", "less", "very", "just", "only", "then", "than", "into", "over", "such", "other", "figure", "table", "chapter", "section", "page",
    "example", "note", "see", "however", "therefore", "thus", "hence", "these", "those", "many",
)
COMMON_PHRASES = ("can be", "such as", "used to", "based on", "in order", "as well", "due to", "need to", "able to", "want to", "how to")
COMMON_ACRONYMS = ("IT", "OR", "IF", "IS", "AS", "IN", "ON", "TO")

CANDIDATE = "array<struct<key:string,name:string,def:string,source:string>>"


def is_noise(name: Column) -> Column:
    n = F.lower(strip(name))
    return (F.length(n) < 3) | n.isin(*NOISE) | n.rlike(r"^\d+$")


def _one(name: Column, definition: Column, source: str) -> Column:
    n = strip(name)
    return F.struct(F.lower(n).alias("key"), n.alias("name"), strip(definition).alias("def"), F.lit(source).alias("source"))


def _kept(a: Column) -> Column:
    return F.filter(a, lambda x: ~is_noise(x["name"]))


def _either(a: Column, b: Column) -> Column:
    return F.when(a != "", a).otherwise(b)


def bold(t: Column) -> Column:
    def all_of(a):
        # a match has five characters or more, so 61 entries cover the 300 characters after one
        after = lambda k: F.substring(F.array_join(F.transform(F.slice(a, k + 2, 61), lambda y: F.concat(y["p"], F.coalesce(y["m"], F.lit("")))), ""), 1, 300)
        each = F.transform(a, lambda x, k: F.when(F.length(_either(x.g1, x.g2)) < 60, _one(_either(x.g1, x.g2), F.regexp_extract(after(k), AFTER_BOLD, 1), "bold")))
        return F.filter(each, lambda x: x.isNotNull())

    return _kept(let(pieces(t, BOLD, 2), all_of))


def definitions(t: Column) -> Column:
    return _kept(F.transform(groups(t, DEFINITION, 2), lambda x: _one(x.g1, x.g2, "definition")))


def parentheticals(t: Column) -> Column:
    return F.filter(_kept(F.transform(groups(t, PARENTHETICAL, 2), lambda x: _one(x.g1, x.g2, "parenthetical"))), lambda x: (x["def"] != "") & ~x["def"].rlike(r"^\d"))


def expansions(t: Column) -> Column:
    return _kept(F.transform(groups(t, EXPANSION, 2), lambda x: _one(x.g1, x.g2, "acronym")))


def _repeated(a: Column, source: str) -> Column:
    """Distinct values seen twice or more, in order of appearance."""
    twice = lambda s: F.filter(s, lambda x, k: (k > 0) & (x == F.get(s, k - 1)))
    again = let(a, lambda v: F.array_intersect(v, let(F.array_sort(v), twice)))
    return _kept(F.transform(again, lambda v: _one(v, F.lit(""), source)))


def acronyms(t: Column) -> Column:
    return F.filter(_repeated(F.regexp_extract_all(t, F.lit(ACRONYM), F.lit(1)), "acronym"), lambda x: ~x["name"].isin(*COMMON_ACRONYMS))


def list_definitions(t: Column) -> Column:
    return _kept(F.transform(groups(t, LISTED, 3), lambda x: _one(_either(x.g1, x.g2), x.g3, "list_definition")))


def heading_terms(t: Column) -> Column:
    def clean(h):
        h = F.regexp_replace(strip(h), r"^[\d.]+\s*", "")
        return F.regexp_replace(h, r"(?i)^(?:Chapter|Part|Section)\s+\d+\s*[:.\-]*\s*", "")

    return _kept(F.transform(F.regexp_extract_all(t, F.lit(HEADING), F.lit(2)), lambda h: _one(clean(h), F.lit(""), "heading")))


def hyphenated(t: Column) -> Column:
    return _repeated(F.regexp_extract_all(t, F.lit(HYPHENATED), F.lit(1)), "hyphenated")


def theorem_blocks(t: Column) -> Column:
    def one(x):
        body = strip(x.g2)
        first = F.regexp_extract(body, r"(?d)^(.+?[.!?])\s", 1)
        name = F.regexp_extract(F.substring(body, 1, 80), r"\(([^)]{3,40})\)", 1)
        return _one(_either(name, x.g1), _either(first, F.substring(body, 1, 200)), "theorem_block")

    return _kept(F.transform(groups(t, BLOCK, 2), one))


def first_uses(t: Column, have: Column) -> Column:
    """At most ten new capitalised phrases that occur twice."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(FIRST_USE), F.lit(1)), lambda x: _one(x, F.lit(""), "first_use")))
    fresh = F.filter(found, lambda x: ~F.array_contains(have, x.key) & ~F.lower(F.regexp_extract(x["name"], r"^\S+", 0)).isin(*FIRST_USE_NOISE) & (occurrences(F.lower(t), x.key) >= 2) & ~is_noise(x["name"]))
    once = lambda a: F.filter(a, lambda x, k: ~F.exists(F.slice(a, 1, k), lambda y: y.key == x.key))
    return F.slice(let(fresh, once), 1, 10)


def runs(a: Column) -> Column:
    """array<array<x>>: the runs of equal key in an array that is sorted by key."""
    starts = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i).key != F.get(s, i - 1).key))
    cut = lambda s: let(starts(s), lambda b: F.transform(b, lambda i, k: F.slice(s, i + 1, F.coalesce(F.get(b, k + 1), F.size(s)) - i)))
    return let(a, lambda s: F.when(F.size(s) > 0, cut(s)).otherwise(F.array()))


def bigrams(t: Column) -> Column:
    """The top 40 word pairs seen twice or more, most frequent first, ties by first place."""
    words = F.transform(F.regexp_extract_all(t, F.lit(r"\b[A-Za-z]{2,}\b"), F.lit(0)), F.lower)
    pair = lambda a, b: F.when(~a.isin(*NOISE) & ~b.isin(*NOISE), F.concat(a, F.lit(" "), b))
    pairs = let(words, lambda w: F.zip_with(w, F.slice(w, 2, F.size(w)), pair))
    placed = F.filter(F.transform(pairs, lambda b, k: F.struct(b.alias("key"), k.alias("at"))), lambda x: F.length(x.key) > 5)
    counted = F.transform(F.filter(runs(F.array_sort(placed)), lambda r: F.size(r) >= 2), lambda r: F.struct((-F.size(r)).alias("n"), r[0]["at"].alias("at"), r[0].key.alias("key")))
    kept = F.filter(F.slice(F.array_sort(counted), 1, 40), lambda x: ~x.key.isin(*COMMON_PHRASES))
    return F.transform(kept, lambda x: _one(F.initcap(x.key), F.lit(""), "tfidf"))


def candidates(t: Column) -> Column:
    """All steps' findings in the order of their priority; later steps only for texts with few so far."""
    keys = lambda a: F.array_distinct(F.transform(a, lambda x: x.key))
    few = lambda c, n: F.size(keys(c)) < n
    # every stage names the one before once, so a filter on the result holds one copy of it
    fresh = lambda c, a: let(keys(c), lambda k: F.filter(a, lambda x: ~F.array_contains(k, x.key)))
    c = F.concat(bold(t), definitions(t), parentheticals(t), expansions(t))
    c = let(c, lambda c: F.concat(c, fresh(c, acronyms(t)), list_definitions(t), heading_terms(t), hyphenated(t)))
    c = let(c, lambda c: F.when(few(c, 5), F.concat(c, theorem_blocks(t))).otherwise(c))
    c = let(c, lambda c: F.when(few(c, 5), F.concat(c, fresh(c, bigrams(t)))).otherwise(c))
    return let(c, lambda c: F.when(few(c, 3), F.concat(c, let(keys(c), lambda k: first_uses(t, k)))).otherwise(c))


def merged(c: Column) -> Column:
    """Findings of equal key as one, ordered by key: array<struct<key, seq, name, definition, sources>>, the first name and the first definition."""
    placed = F.array_sort(F.transform(c, lambda x, k: F.struct(x.key.alias("key"), k.alias("seq"), x["name"].alias("name"), x["def"].alias("def"), x["source"].alias("source"))))

    def one(r):
        said = F.get(F.filter(r, lambda x: x["def"] != ""), F.lit(0))["def"]
        return F.struct(r[0].key.alias("key"), r[0].seq.alias("seq"), r[0]["name"].alias("name"), F.coalesce(said, F.lit("")).alias("definition"), F.array_sort(F.array_distinct(F.transform(r, lambda x: x["source"]))).alias("sources"))

    return F.transform(runs(placed), one)


def _scored(x: Column, low_text: Column, words: Column) -> Column:
    """A merged concept with mentions, importance and, first, what it is ranked by. words: the text's tokens, each between two spaces."""
    low = F.lower(x["name"])
    single = ~(low.contains(" ") | low.contains("-"))
    mentions = F.when(single, occurrences(words, F.concat(F.lit(" "), low, F.lit(" ")))).otherwise(occurrences(low_text, low))

    def of(m):
        has = lambda s: F.array_contains(x.sources, s)
        points = lambda c, n: F.when(c, n).otherwise(0)
        n = F.size(x.sources)
        score = points(has("heading"), 3) + points(has("bold"), 2) + points(has("definition") | has("list_definition"), 2) + points(has("acronym"), 1) + points(x.definition != "", 1)
        score = score + F.when(m >= 10, 2).when(m >= 5, 1).otherwise(0) + F.when(n >= 3, 2).when(n >= 2, 1).otherwise(0)
        order = F.when(score >= 5, 0).when(score >= 3, 1).otherwise(2)
        return F.struct(order.alias("order"), (-m).alias("less"), x.seq.alias("seq"), x.key.alias("key"), x["name"].alias("name"), x.definition.alias("definition"), x.sources.alias("sources"), F.when(score >= 5, "high").when(score >= 3, "medium").otherwise("low").alias("importance"), m.alias("mentions"))

    return let(mentions, of)


FIELDS = ("key", "name", "definition", "sources", "importance", "mentions")


def ranked(t: Column) -> Column:
    """A text's concepts, the most important first: array<struct<key, name, definition, sources, importance, mentions>>."""
    words = F.concat(F.lit(" "), F.array_join(tokens(t), "  "), F.lit(" "))
    found = let(F.lower(t), lambda low: let(words, lambda w: F.transform(merged(candidates(t)), lambda x: _scored(x, low, w))))
    return F.transform(F.array_sort(found), lambda x: F.struct(*(x[f].alias(f) for f in FIELDS)))


def with_concepts(docs: DataFrame, text_col: str = "text", name: str = "concepts") -> DataFrame:
    """docs and the ranked concepts of each text, computed once a row."""
    return docs.withColumn(name, let(F.coalesce(F.col(text_col), F.lit("")), ranked))


def extract(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, rank, key, name, definition, sources, importance, mentions)."""
    rows = with_concepts(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), "t", "c")
    return rows.select("id", F.posexplode("c").alias("at", "x")).select("id", (F.col("at") + 1).alias("rank"), *(F.col(f"x.{f}").alias(f) for f in FIELDS))


def storable(concepts: DataFrame, least: str = "medium") -> DataFrame:
    """extract()'s rows of at least that importance, as chapters keep them."""
    bands = ("high", "medium", "low")
    return concepts.where(F.col("importance").isin(*bands[: bands.index(least) + 1]))
