"""Books against a library: term weights, cosine over shared terms, title and chapter-sequence ratios."""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def tfidf(terms: DataFrame) -> DataFrame:
    """terms(id, term), repeats counted -> (id, term, tf, df, w) with idf ln((1 + N) / (1 + df)) + 1.

    Two aggregates and two joins; no window, so a hot book is never gathered in one task. What is counted refers to the counts below it, so that all
    branches need the same columns of the first aggregate and share its one pass over the terms.
    """
    n = terms.groupBy("id", "term").agg(F.count("*").alias("n"))
    size = n.groupBy("id").agg(F.sum("n").alias("total"))
    df = n.groupBy("term").agg(F.count_if(F.col("n") > 0).alias("df"))
    books = size.agg(F.count_if(F.col("total") > 0).alias("books"))
    w = F.col("n") / F.col("total")
    out = n.join(size, "id").join(df, "term").join(F.broadcast(books))  # a single row
    return out.select("id", "term", w.alias("tf"), "df", (w * (F.log((1 + F.col("books")) / (1 + F.col("df"))) + 1)).alias("w"))


def cosine(vectors: DataFrame, inputs: DataFrame | None = None) -> DataFrame:
    """vectors(id, term, w) -> (input_id, book_id, concept_score), rounded to 4 places; inputs(id) limits the left side."""
    v = vectors.select("id", "term", "w")
    norm = v.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    left = v if inputs is None else v.join(inputs.select("id"), "id", "left_semi")
    a, b = left.select(F.col("id").alias("input_id"), "term", F.col("w").alias("wa")), v.select(F.col("id").alias("book_id"), "term", F.col("w").alias("wb"))
    dot = a.join(b, "term").where("input_id <> book_id").groupBy("input_id", "book_id").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    na, nb = norm.select(F.col("id").alias("input_id"), F.col("norm").alias("na")), norm.select(F.col("id").alias("book_id"), F.col("norm").alias("nb"))
    out = dot.join(na, "input_id").join(nb, "book_id")
    return out.select("input_id", "book_id", F.round(F.col("dot") / (F.col("na") * F.col("nb")), 4).alias("concept_score"))


def _ratios(others, b) -> list[float]:
    """Sequence ratios of each of others against b, which is indexed once."""
    m, out = SequenceMatcher(None, "", b), []
    for a in others:
        m.set_seq1(a)
        out.append(m.ratio())
    return out


def _sequences(others: list[list[str]], b: list[str]) -> list[float]:
    """Of lists of lower-case titles; two lists of one title each are compared as titles."""
    out = _ratios(others, b)
    return [_ratios(a, b[0])[0] if len(a) == len(b) == 1 else r for a, r in zip(others, out, strict=True)]


def match(inputs: DataFrame, books: DataFrame, chapters: DataFrame, weights: tuple[float, float, float] = (0.2, 0.3, 0.5), block: int = 256) -> DataFrame:
    """inputs(id), books(id, title), chapters(book_id, number, title, terms) -> scores of every other book for each input,
    ranked: rank 1 is the largest total, ties by book id.

    The input set is stated by the caller; each of its books meets every other book, as every pair gets a score. Inputs and books are
    dealt to blocks of about ``block`` at most, and to several pairs of blocks for each core; block meets block in a task, so titles and chapter lists
    travel once a block, not once a pair.
    """
    titles = chapters.groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "title"))), lambda x: x.title).alias("chapters"))
    full = books.join(titles, books.id == titles.book_id, "left").select("id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("chapters", F.array().cast("array<string>")).alias("chapters"))
    # keys that are never null: else each join of tfidf() and cosine() filters its side by other columns, and each side tokenises all texts again
    code = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))
    terms = chapters.select(code(F.col("book_id")).alias("id"), F.explode("terms").alias("term")).select("id", code(F.lower("term")).alias("term"))
    vectors = tfidf(terms).withColumn("w", F.when(F.col("term") != "", F.col("w")).otherwise(0.0))  # a null term counts for its book's size only
    scores = cosine(vectors, inputs.select(code(F.col("id")).alias("id"))).select(F.col("input_id").alias("_a"), F.col("book_id").alias("_b"), "concept_score")
    left = full.join(inputs.select("id"), "id", "left_semi").select(F.col("id").alias("input_id"), F.col("title").alias("own"), F.col("chapters").alias("ac"))
    right = full.select(F.col("id").alias("book_id"), F.col("title").alias("bt"), F.col("chapters").alias("bc"))
    least = math.isqrt(4 * inputs.sparkSession.sparkContext.defaultParallelism)
    m, n = (max(1, -(-k // block), min(k, least)) for k in (inputs.count(), books.count()))
    dealt = lambda df, own, size, key, other, count: df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(size))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))))

    def ratios(own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        low = [(x.input_id, x.own.lower(), [t.lower() for t in x.ac]) for x in own.itertuples()]
        out = []
        for y in others.itertuples():
            some = [x for x in low if x[0] != y.book_id]
            name, titles = _ratios([x[1] for x in some], y.bt.lower()), _sequences([x[2] for x in some], [t.lower() for t in y.bc])
            out += [(x[0], y.book_id, *r) for x, *r in zip(some, name, titles, strict=True)]
        return pd.DataFrame(out, columns=["input_id", "book_id", "n", "s"])

    met = dealt(left, "a", m, "input_id", "b", n).groupBy("a", "b").cogroup(dealt(right, "b", n, "book_id", "a", m).groupBy("a", "b"))
    rated = met.applyInPandas(ratios, "input_id string, book_id string, n double, s double")
    rated = rated.join(scores, (code(F.col("input_id")) == F.col("_a")) & (code(F.col("book_id")) == F.col("_b")), "left")
    c = F.coalesce("concept_score", F.lit(0.0))
    total = weights[0] * F.col("n") + weights[1] * F.col("s") + weights[2] * c
    return rated.select("input_id", "book_id", F.round("n", 4).alias("name_score"), F.round("s", 4).alias("structure_score"), c.alias("concept_score"), F.round(total, 4).alias("total_score")).withColumn("rank", F.row_number().over(W.partitionBy("input_id").orderBy(F.desc("total_score"), "book_id")))


def with_input(books: DataFrame, chapters: DataFrame, book: DataFrame, own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A library and a book that is not in it yet, book(id, title) and its chapters, as one library for match()."""
    return books.select("id", "title").unionByName(book.select("id", "title")), chapters.select(*own.columns).unionByName(own)
