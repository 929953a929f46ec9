"""Headings, sections and chapters. Everything is computed inside the row: no shuffle, no rows but the results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, matches, short_id, strip, word_count

# Patterns and titles that decide what counts as a heading or chapter.
HEADING = r"(?md)^(#{1,6})\s+(.+)$"
SUB_HEADING = r"(?md)^#{2,3}\s+(.+)$"
NUMBERED = r"(?md)^(#{1,2})\s+(?:(?:Chapter|CHAPTER|Part|PART)\s+(\d+|[IVXLC]+)[\s:.—–-]*(.+?)|(\d+)\.\s+(.+?)|(\d+)\s+(.+?))\s*$"
TOP = r"(?md)^#\s+(.+)$"
PAGE_BREAK = r"\n-{3,}\n"
SKIPPED = ("table of contents", "contents", "preface", "foreword", "acknowledgments", "bibliography", "references", "index", "appendix", "about the author", "glossary")


def with_ends(found: Column, text: Column) -> Column:
    """Adds end: the next match's start, or the text's length."""
    nxt = F.concat(F.transform(F.slice(found, 2, F.size(found)), lambda x: x.start), F.array(F.length(text)))
    return F.zip_with(found, F.when(F.size(found) > 0, nxt).otherwise(F.array().cast("array<int>")), lambda x, e: x.withField("end", e))


def headings(text: Column) -> Column:
    """array<struct<start, end, level, title, word_count>>."""
    return F.transform(with_ends(matches(text, HEADING, 2), text), lambda x: F.struct(x.start.alias("start"), x.end.alias("end"), F.length(x.g1).alias("level"), strip(x.g2).alias("title"), word_count(F.substring(text, x.start + 1, x.end - x.start)).alias("word_count")))


SECTION = ("ord", "level", "title", "start", "end", "word_count", "parent_ord")


def section_list(t: Column) -> Column:
    """array<struct<ord, level, title, start, end, word_count, parent_ord>>; a text without headings is one section, level 1."""
    none = F.array(F.struct(F.lit(0).alias("start"), F.length(t).alias("end"), F.lit(1).alias("level"), F.lit("(No headings detected)").alias("title"), word_count(t).alias("word_count")))
    placed = let(headings(t), lambda h: F.transform(F.when(F.size(h) > 0, h).otherwise(none), lambda x, k: x.withField("ord", k)))
    # the parent is the nearest earlier heading of a smaller level
    above = lambda h, x: F.array_max(F.transform(F.filter(h, lambda y: (y.ord < x.ord) & (y.level < x.level)), lambda y: y.ord))
    one = lambda h, x: F.struct(*(x[f].alias(f) for f in SECTION[:-1]), above(h, x).alias("parent_ord"))
    return let(placed, lambda h: F.transform(h, lambda x: one(h, x)))


def depths(sections: Column) -> Column:
    """Of each section how many are above it: array<int>. Levels only say who is above; six of them bound the steps."""
    up = lambda p: F.when(p.isNotNull(), F.get(sections, p).parent_ord)

    def depth(x):
        n, p = F.lit(0), x.parent_ord
        for _ in range(5):
            n = n + F.when(p.isNotNull(), 1).otherwise(0)
            p = up(p)
        return n

    return F.transform(sections, depth)


def sections(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, ord, level, title, start, end, word_count, parent_ord), see section_list()."""
    rows = docs.select(F.col(id_col).alias("id"), let(F.coalesce(F.col(text_col), F.lit("")), section_list).alias("s"))
    return rows.select("id", F.explode("s").alias("x")).select("id", *(F.col(f"x.{c}").alias(c) for c in SECTION))


def summary(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, heading_count, max_depth)."""
    h = matches(F.coalesce(F.col(text_col), F.lit("")), HEADING, 2)
    return docs.select(F.col(id_col).alias("id"), h.alias("h")).select("id", F.size("h").alias("heading_count"), F.coalesce(F.array_max(F.transform("h", lambda x: F.length(x.g1))), F.lit(1)).alias("max_depth"))


def _subs(t: Column) -> Column:
    return F.slice(F.regexp_extract_all(t, F.lit(SUB_HEADING), F.lit(1)), 1, 20)


def chapters(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(book_id, id, number, title, level, start_index, end_index, word_count, full_text, sub_headings).

    The first rule with a result: numbered headings (at least two), top headings (at least two, front and back matter
    skipped), page breaks (pieces over 100 words), the whole text. Equal ids keep the one that starts last.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("book_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.withColumn("n", with_ends(matches(F.col("t"), NUMBERED, 7), F.col("t"))).withColumn("h", with_ends(matches(F.col("t"), TOP, 1), F.col("t")))
    piece = lambda x: strip(F.substring("t", x.start + 1, x.end - x.start))
    one = lambda num, title, level, start, end, text, seed: F.struct(num.cast("int").alias("number"), title.alias("title"), level.cast("int").alias("level"), start.cast("int").alias("start_index"), end.cast("int").alias("end_index"), text.alias("full_text"), seed.alias("seed"))
    digits = lambda x: F.when(x.g2 != "", x.g2).when(x.g4 != "", x.g4).otherwise(x.g6)
    name = lambda x: strip(F.when(x.g2 != "", x.g3).when(x.g4 != "", x.g5).otherwise(x.g7))
    number = lambda x, k: F.when(digits(x).rlike(r"^\d+$"), digits(x).try_cast("int")).otherwise(k + 1)
    by_number = F.transform("n", lambda x, k: one(number(x, k), name(x), F.length(x.g1), x.start, x.end, piece(x), F.concat(F.lit(":ch"), number(x, k).cast("string"), F.lit(":"), name(x))))
    kept = F.filter("h", lambda x: ~F.lower(strip(x.g1)).isin(*SKIPPED))
    by_top = F.transform(kept, lambda x, k: one(k + 1, strip(x.g1), F.lit(1), x.start, x.end, piece(x), F.concat(F.lit(":h:"), strip(x.g1))))
    large = F.transform(F.filter(F.split("t", PAGE_BREAK, -1), lambda p: word_count(p) > 100), strip)
    first = lambda p: F.substring(F.regexp_replace(strip(F.split(p, "\n")[0]), r"^#+\s*", ""), 1, 80)
    title = lambda p, k: F.when(first(p) != "", first(p)).otherwise(F.concat(F.lit("Section "), (k + 1).cast("string")))
    by_page = F.transform(large, lambda p, k: one(k + 1, title(p, k), F.lit(1), F.lit(0), F.length(p), p, F.concat(F.lit(":sec"), (k + 1).cast("string"), F.lit(":"), title(p, k))))
    whole = F.array(one(F.lit(1), F.lit("Full Document"), F.lit(1), F.lit(0), F.length("t"), F.col("t"), F.lit(":full")))
    chosen = F.when(F.size("n") >= 2, by_number).when((F.size("h") >= 2) & (F.size(kept) > 0), by_top).when(F.size(large) > 0, by_page).otherwise(whole)
    rows = rows.select("book_id", chosen.alias("c"))
    last = let(F.col("c"), lambda c: F.filter(c, lambda x, k: ~F.exists(F.slice(c, k + 2, F.size(c)), lambda y: y.seed == x.seed)))
    rows = rows.select("book_id", F.explode(last).alias("x"))
    return rows.select("book_id", short_id(F.concat("book_id", "x.seed")).alias("id"), "x.number", "x.title", "x.level", "x.start_index", "x.end_index", word_count(F.col("x.full_text")).alias("word_count"), "x.full_text", _subs(F.col("x.full_text")).alias("sub_headings"))
