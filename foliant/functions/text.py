"""Column helpers for text. Java's line ends are set to LF only by (?d), as offsets and lines follow LF."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however often body and the lambdas in it use it."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def word_count(t: Column) -> Column:
    return F.regexp_count(t, F.lit(r"\S+"))


def strip(t: Column) -> Column:
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def tokens(t: Column) -> Column:
    return F.regexp_extract_all(F.lower(t), F.lit(WORD), F.lit(0))


def occurrences(t: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of a plain string."""
    gone = F.length(t) - F.length(F.replace(t, needle, F.lit("")))
    return F.when(F.length(needle) > 0, (gone / F.length(needle)).cast("int")).otherwise(0)


def paragraphs(t: Column) -> Column:
    return F.split(t, r"\n\s*\n", -1)


def groups(t: Column, pattern: str, n: int) -> Column:
    """array<struct<g1..gn>> of all non-overlapping matches, without places."""
    return F.arrays_zip(*(F.regexp_extract_all(t, F.lit(pattern), F.lit(k)).alias(f"g{k}") for k in range(1, n + 1)))


def pieces(t: Column, pattern: str, n: int = 0) -> Column:
    """array<struct<m, g1..gn, p>>: match k and the text p before it; the last entry is the rest, its m null."""
    names = ["m", *(f"g{k}" for k in range(1, n + 1))]
    return F.arrays_zip(*(F.regexp_extract_all(t, F.lit(pattern), F.lit(k)).alias(x) for k, x in enumerate(names)), F.split(t, pattern, -1).alias("p"))


#: Matches whose places are added up in one inner fold; growing an array copies it, so folds are kept short.
FOLD = 64


def matches(t: Column, pattern: str, groups: int = 0, need: str | None = None) -> Column:
    """array<struct<start, stop, m, g1..gn>> of all non-overlapping matches, offsets in code points from 0. need: a cheaper pattern that every text
    with a match has one of, too.

    Split and extract give the pieces and the matches in turn; their lengths add up to the places. No rows are made and
    nothing leaves the JVM.
    """
    names = ["m", *(f"g{k}" for k in range(1, groups + 1))]
    kind = "array<struct<start:int,stop:int," + ",".join(f"{n}:string" for n in names) + ">>"
    none = F.array().cast(kind)

    def add(acc, x):
        start = acc.at + F.length(x["p"])
        stop = start + F.length(x["m"])
        one = F.struct(start.alias("start"), stop.alias("stop"), *(x[n].alias(n) for n in names))
        return F.struct(F.coalesce(stop, acc.at).alias("at"), F.when(x["m"].isNotNull(), F.concat(acc.out, F.array(one))).otherwise(acc.out).alias("out"))

    def add_fold(acc, some):
        inner = F.aggregate(some, F.struct(acc.at.alias("at"), none.alias("out")), add)
        return let(inner, lambda x: F.struct(x.at.alias("at"), F.concat(acc.out, F.array(x.out)).alias("out")))

    folds = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / FOLD).cast("int")), lambda k: F.slice(a, k * FOLD + 1, FOLD))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
    found = F.aggregate(let(pieces(t, pattern, groups), folds), begin, add_fold, lambda acc: F.flatten(acc.out))
    some = t.rlike(pattern) if need is None else t.rlike(need) & t.rlike(pattern)
    return F.when(some, found).otherwise(none)


def short_id(seed: Column | str) -> Column:
    return F.substring(F.sha2(seed, 256), 1, 12)
