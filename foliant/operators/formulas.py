"""Formulas with their context and variables. Array expressions inside the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, matches, strip

# Patterns.
DISPLAY = r"(?s)\$\$(.+?)\$\$"
INLINE = r"(?<!\$)\$([^$\n]+?)\$(?!\$)"
VARIABLE = r"(?i)(?:where|let|here|and)\s+[\$]?([A-Za-z\\][^$\s]*?)[\$]?\s+(?:is|=|denotes?|represents?|equals?)\s+([^.!?\n]{5,100})"
QUANTIFIER = r"(?i)(?:for\s+(?:all|each|every|any))\s+[\$]?([A-Za-z\\][^$\s]*?)[\$]?\s*(?:[,.]|\s+(?:in|from|where))"
TRIVIAL = r"^\\?[a-zA-Z]$|^\d+$"
SIGNIFICANT = r"[=<>+\-*/_^]|\\[a-z]+|\{.*\}"


def context_before(t: Column, pos: Column) -> Column:
    """The last two sentences of the 400 characters before."""
    start = F.greatest(F.lit(0), pos - 400)
    chunk = strip(F.substring(t, start + 1, pos - start))
    parts = F.split(chunk, r"(?<=[.!?])\s+", -1)
    return strip(F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, -2, 2), " ")).otherwise(chunk))


def context_after(t: Column, end: Column) -> Column:
    """The first sentence of the 300 characters after, else 200 characters."""
    chunk = strip(F.substring(t, end + 1, F.lit(300)))
    first = F.regexp_extract(chunk, r"(?d)^(.+?[.!?])\s", 1)
    return strip(F.when(first != "", first).otherwise(F.substring(chunk, 1, 200)))


def variables(t: Column, start: Column, end: Column) -> Column:
    low = F.greatest(F.lit(0), start - 200)
    window = F.substring(t, low + 1, F.least(F.length(t), end + 400) - low)
    symbols, meanings = (F.regexp_extract_all(window, F.lit(VARIABLE), F.lit(k)) for k in (1, 2))
    defined = F.zip_with(symbols, meanings, lambda s, m: F.struct(strip(s).alias("symbol"), strip(m).alias("meaning")))
    return F.concat(defined, F.transform(F.regexp_extract_all(window, F.lit(QUANTIFIER), F.lit(1)), lambda s: F.struct(strip(s).alias("symbol"), F.lit("quantified variable").alias("meaning"))))


FORMULA = ("latex", "type", "context_before", "context_after", "variables", "position")


def formula_list(t: Column) -> Column:
    """array<struct<latex, type, context_before, context_after, variables, position>>; display before inline, first of equal bodies."""
    one = lambda x, mark, kind: F.struct(F.concat(F.lit(mark), strip(x.g1), F.lit(mark)).alias("latex"), F.lit(kind).alias("type"), x.start.alias("position"), x.stop.alias("stop"))
    body = lambda x: strip(x.g1)
    shown = lambda d: F.transform(F.filter(d, lambda x: (F.length(body(x)) >= 2) & ~body(x).rlike(TRIVIAL)), lambda x: one(x, "$$", "display"))
    telling = F.filter(matches(t, INLINE, 1), lambda x: (F.length(body(x)) >= 3) & body(x).rlike(SIGNIFICANT))
    inline = lambda d: F.transform(F.filter(telling, lambda x: ~F.exists(d, lambda y: (y.start <= x.start) & (x.start < y.stop))), lambda x: one(x, "$", "inline"))
    found = let(matches(t, DISPLAY, 1), lambda d: F.concat(shown(d), inline(d)))
    bare = lambda x: F.regexp_replace(x.latex, r"\s+", "")
    first = lambda f: let(F.transform(f, bare), lambda b: F.filter(f, lambda x, k: F.array_position(b, b[k]) == k + 1))
    full = lambda x: F.struct(x.latex.alias("latex"), x.type.alias("type"), context_before(t, x.position).alias("context_before"), context_after(t, x.stop).alias("context_after"), variables(t, x.position, x.stop).alias("variables"), x.position.alias("position"))
    return F.transform(let(found, first), full)


def extract(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, ord, latex, type, context_before, context_after, variables, position), see formula_list()."""
    rows = docs.select(F.col(id_col).alias("id"), let(F.coalesce(F.col(text_col), F.lit("")), formula_list).alias("f"))
    return rows.select("id", F.posexplode("f").alias("ord", "x")).select("id", "ord", *(F.col(f"x.{f}").alias(f) for f in FORMULA))
