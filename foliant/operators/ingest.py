"""Ingestion: pages of files to the tables of a library. One plan for any number of files; only the markdown's own columns are carried."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, short_id, word_count
from ..sources.tables import adaptive_markdown, title_of
from . import concepts, formulas, metadata, structure


def digests_prefixed(path: Column, digest: Column) -> Column:
    """The name under which a raw file is kept: the digest of its first bytes, then its own name."""
    return F.concat_ws("_", digest, F.regexp_extract(path, r"[^/]+$", 0))


def analysed(chapters: DataFrame) -> DataFrame:
    """chapters(full_text, ...) with the concepts worth storing, high and medium ones, and the formulas."""
    t = F.coalesce("full_text", F.lit(""))
    kept = let(t, lambda x: F.filter(concepts.ranked(x), lambda c: c.importance != "low"))
    return chapters.withColumn("concepts", kept).withColumn("formulas", let(t, formulas.formula_list)).withColumn("dependencies", F.array().cast("array<string>")).withColumn("study_status", F.lit("not_started"))


def ingest(pages: DataFrame, slow: DataFrame, uploaded: float = 0.0, least_mean_words: float = 50.0) -> dict[str, DataFrame]:
    """pages(path, page, text, and info_author, info_subject, error if known) of the fast reader, slow(path, markdown) of a layout reader ->
    books, chapters and markdown.

    A file without any markdown is a book of status error, without chapters. Ids follow from paths, so a file that is read again
    replaces itself (catalog.upsert).
    """
    have = lambda c: F.max(c) if c in pages.columns else F.lit(None).cast("string")
    known = pages.groupBy("path").agg(have("info_author").alias("info_author"), have("info_subject").alias("info_subject"), have("error").alias("error"))
    text = adaptive_markdown(pages, slow, least_mean_words).join(known, "path", "left")
    text = text.withColumn("id", short_id("path")).withColumn("title", title_of(F.col("path"))).withColumn("text", F.coalesce("markdown", F.lit("")))
    found = text.where(F.col("text") != "")
    meta = metadata.extract(found)
    chapters = structure.chapters(found)
    count = chapters.groupBy("book_id").agg(F.count("*").cast("int").alias("total_chapters"), F.array_sort(F.collect_list(F.struct("start_index", "number", "id"))).alias("own"))
    books = text.select("id", "title", F.regexp_extract("path", r"[^/]+$", 0).alias("filename"), F.col("path").alias("raw_pdf_path"), F.col("pages").cast("int").alias("total_pages"), word_count(F.col("text")).alias("total_words"), F.lit(uploaded).alias("upload_date"), F.when(F.col("text") == "", "error").otherwise("ready").alias("status"))
    books = books.join(meta.select("id", "author", "subject"), "id", "left").join(count.withColumnRenamed("book_id", "id"), "id", "left")
    none = F.array().cast("array<string>")
    books = books.select("id", "title", "filename", F.coalesce("author", F.lit("")).alias("author"), F.coalesce("subject", F.lit("")).alias("subject"), F.coalesce("total_chapters", F.lit(0)).alias("total_chapters"), "total_words", "total_pages", "upload_date", "raw_pdf_path", F.coalesce(F.transform("own", lambda x: x.id), none).alias("chapter_ids"), "status")
    return {"books": books, "chapters": analysed(chapters), "markdown": found.select(F.col("id").alias("book_id"), F.col("text").alias("content"))}
