"""Relations between a chapter's concepts: typed edges, references, co-occurrence clusters.

Each chapter's concepts are one array beside its text (concepts.with_concepts), so relations are array expressions in the row: nothing is
shuffled, and rows are made only for results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, matches, paragraphs, strip, tokens, word_count
from .structure import section_list

# Patterns.
CROSS = r"(?i)(?:see|refer\s+to|as\s+(?:discussed|described|shown)\s+in)\s+(?:Chapter|Section|Part|Figure|Table)\s+([\d.]+(?:\s*[-–]\s*[\d.]+)?)"
BACK = r"(?i)(?:as\s+we\s+(?:saw|discussed|mentioned|noted)|mentioned\s+(?:earlier|above|previously)|as\s+(?:before|earlier|previously))"
COMPARISON = r"(?i)(?:(?:unlike|compared\s+(?:to|with)|in\s+contrast\s+(?:to|with)|(?:similar|equivalent|analogous)\s+to|differs?\s+from|as\s+opposed\s+to)\s+(?:\*\*)?([^,.*]+?)(?:\*\*)?\s*[,.]|(\S+)\s+(?:vs\.?|versus)\s+(\S+))"
CONTAINS = r"(?i)(?:\*\*)?([^.!?*]{3,40}?)(?:\*\*)?\s+(?:includes?|consists?\s+of|comprises?|contains?|is\s+(?:composed|made\s+up)\s+of)\s+([^.!?]{5,150})"
TYPES = r"(?i)(?:types?|kinds?|forms?|varieties?|categories?)\s+of\s+(?:\*\*)?([^.!?*:]{3,40}?)(?:\*\*)?\s*(?::|include|are)\s*([^.!?]{5,200})"
CONTAINED = r"(?i)\s(?:include|consist|compris|contain|is\s+(?:composed|made))"
ITEMS = r",\s*|\s+and\s+|\s+or\s+|;\s*"

EDGE = "array<struct<src:string,dst:string,type:string>>"


def reference_list(t: Column) -> Column:
    """array<struct<text, target>>: references to other parts, then to earlier content."""
    cross = F.transform(matches(t, CROSS, 1), lambda x: F.struct(x.m.alias("text"), x.g1.alias("target")))
    return F.concat(cross, F.transform(matches(t, BACK), lambda x: F.struct(x.m.alias("text"), F.lit("earlier_content").alias("target"))))


def references(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, ord, text, target), see reference_list()."""
    found = reference_list(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).alias("id"), F.posexplode(found).alias("ord", "x")).select("id", "ord", "x.text", "x.target")


def find(term: Column, names: Column) -> Column:
    """The concept that a term stands for: equal, else the first that contains it or lies in it; null without one. names: in rank order."""
    low = F.lower(strip(term))
    exact = F.filter(names, lambda n: F.lower(n) == low)
    part = F.filter(names, lambda n: F.lower(n).contains(low) | F.contains(low, F.lower(n)))
    return F.coalesce(F.try_element_at(exact, F.lit(-1)), F.try_element_at(part, F.lit(1)))


def _edge(src: Column, dst: Column, kind: str) -> Column:
    return F.struct(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"))


def _listed(t: Column, names: Column, pattern: str, kind: str, need: str | None = None) -> Column:
    """Edges from each listed concept to the concept that lists it; need: see matches()."""

    def of(x):
        head = find(strip(x.g1), names)
        items = F.filter(F.split(strip(x.g2), ITEMS, -1), lambda i: strip(i) != "")
        tails = F.transform(items, lambda i: find(strip(F.regexp_replace(strip(i), r"^\*+|\*+$", "")), names))
        return F.transform(F.filter(tails, lambda c: c.isNotNull() & head.isNotNull()), lambda c: _edge(c, head, kind))

    return F.flatten(F.transform(matches(t, pattern, 2, need), of))


def _compared(t: Column, names: Column) -> Column:
    def of(x):
        start = F.greatest(F.lit(0), x.start - 200)
        near = F.lower(F.substring(t, start + 1, F.least(F.length(t), x.stop + 200) - start))
        others = lambda own, near: F.filter(names, lambda n: own.isNotNull() & (F.lower(n) != F.lower(own)) & F.contains(near, F.lower(n)))
        told = let(find(strip(x.g1), names), lambda own: let(near, lambda w: F.transform(others(own, w), lambda n: _edge(own, n, "compared_with"))))
        pair = F.filter(F.array(_edge(find(x.g2, names), find(x.g3, names), "compared_with")), lambda e: e.src.isNotNull() & e.dst.isNotNull())
        return F.when(x.g1 != "", told).otherwise(pair)

    return F.flatten(F.transform(matches(t, COMPARISON, 3), of))


def _following(sections: Column, names: Column) -> Column:
    """Each second-level section depends on the one before it under the same top section."""
    top = lambda x: x.parent_ord.isNotNull() & F.get(sections, x.parent_ord).parent_ord.isNull()
    before = lambda kids, k: F.when(k > 0, F.get(kids, k - 1))
    pair = lambda kids, x, k: F.when(before(kids, k).parent_ord == x.parent_ord, _edge(find(x.title, names), find(before(kids, k).title, names), "depends_on"))
    return let(F.filter(sections, top), lambda kids: F.filter(F.transform(kids, lambda x, k: pair(kids, x, k)), lambda e: e.src.isNotNull() & e.dst.isNotNull()))


def edge_list(t: Column, names: Column, sections: Column) -> Column:
    """array<struct<src, dst, type>>, first of each undirected pair and type. names: of the concepts, in rank order."""
    every = F.concat(_compared(t, names), _listed(t, names, CONTAINS, "part_of", CONTAINED), _listed(t, names, TYPES, "example_of"), _following(sections, names)).cast(EDGE)
    pair = lambda e: F.struct(e.type.alias("type"), F.least(e.src, e.dst).alias("a"), F.greatest(e.src, e.dst).alias("b"))
    first = lambda e: let(F.transform(e, pair), lambda p: F.filter(e, lambda x, k: F.array_position(p, F.get(p, k)) == k + 1))
    return let(every, first)


def _names(concepts: Column) -> Column:
    return F.transform(concepts, lambda x: x["name"])


def edges(docs: DataFrame, id_col: str = "id", text_col: str = "text", concepts_col: str = "concepts") -> DataFrame:
    """docs with ranked concepts -> (id, ord, src, dst, type), see edge_list()."""
    found = let(F.coalesce(F.col(text_col), F.lit("")), lambda t: let(_names(F.col(concepts_col)), lambda n: let(section_list(t), lambda s: edge_list(t, n, s))))
    return docs.select(F.col(id_col).alias("id"), F.posexplode(found).alias("ord", "x")).select("id", "ord", "x.src", "x.dst", "x.type")


def pair_list(t: Column, names: Column) -> Column:
    """array<struct<a, b>>, a < b, distinct and sorted: concepts in one paragraph of five words or more. A paragraph's
    concepts are chained, not paired: the components are the same."""

    def of(p):
        inside = lambda low, words: F.filter(names, lambda n: F.when(n.contains(" ") | n.contains("-"), F.contains(low, F.lower(n))).otherwise(F.array_contains(words, F.lower(n))))
        here = let(F.lower(p), lambda low: let(tokens(p), lambda words: F.array_sort(F.array_distinct(inside(low, words)))))
        chain = lambda h: F.when(F.size(h) >= 2, F.zip_with(F.slice(h, 1, F.size(h) - 1), F.slice(h, 2, F.size(h)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).otherwise(F.array())
        return let(here, chain)

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(paragraphs(t), lambda p: word_count(p) >= 5), of))))


def cooccurrence(docs: DataFrame, id_col: str = "id", text_col: str = "text", concepts_col: str = "concepts") -> DataFrame:
    """docs with ranked concepts -> (id, a, b), see pair_list()."""
    found = let(F.coalesce(F.col(text_col), F.lit("")), lambda t: let(_names(F.col(concepts_col)), lambda n: pair_list(t, n)))
    return docs.select(F.col(id_col).alias("id"), F.explode(found).alias("x")).select("id", "x.a", "x.b")


def cluster_list(t: Column, names: Column, most: int = 10) -> Column:
    """array<array<string>>: connected concepts, largest first, then by their best rank, at most ``most``; a text's graph is small."""

    def add(acc, e):
        own = F.array(e.a, e.b)
        touched = F.filter(acc, lambda g: F.arrays_overlap(g, own))
        apart = F.filter(acc, lambda g: ~F.arrays_overlap(g, own))
        return F.concat(apart, F.array(F.array_sort(F.array_distinct(F.concat(F.flatten(touched), own)))))

    grown = F.aggregate(pair_list(t, names), F.array().cast("array<array<string>>"), add)
    rank = lambda g: F.array_min(F.transform(g, lambda m: F.array_position(names, m)))
    keyed = F.array_sort(F.transform(grown, lambda g: F.struct((-F.size(g)).alias("n"), rank(g).alias("r"), g.alias("m"))))
    return F.transform(F.slice(keyed, 1, most), lambda x: x.m)


def clusters(docs: DataFrame, id_col: str = "id", text_col: str = "text", concepts_col: str = "concepts", most: int = 10) -> DataFrame:
    """docs with ranked concepts -> (id, rank, members), see cluster_list()."""
    found = let(F.coalesce(F.col(text_col), F.lit("")), lambda t: let(_names(F.col(concepts_col)), lambda n: cluster_list(t, n, most)))
    return docs.select(F.col(id_col).alias("id"), F.posexplode(found).alias("k", "members")).select("id", (F.col("k") + 1).alias("rank"), "members")
