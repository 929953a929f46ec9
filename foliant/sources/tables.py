"""Sources: stored tables, web pages as markdown, documents as a library, paged files, configuration."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import short_id, strip, word_count


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, of: DataFrame | None = None, rows: int = 512) -> DataFrame:
    """df in tasks of about ``rows`` rows of ``of`` (df itself if not given, a table whose rows are cheap to count), and one for each core at least:
    analyses stay in their row and take long, and splits of files neither follow the number of cores nor stay small as files grow."""
    n = -(-(df if of is None else of).count() // rows)
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, n))


def page_markdown(pages: DataFrame) -> DataFrame:
    """pages(page_id, html) -> (id, text): the article, h1 as a heading, paragraphs apart, other tags dropped."""
    t = F.regexp_extract("html", r"(?s)<article[^>]*>(.*?)</article>", 1)
    for pattern, by in ((r"(?s)<h1[^>]*>(.*?)</h1>", "\n\n# $1\n\n"), (r"<p[^>]*>", "\n\n"), (r"<[^>]+>", ""), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = F.regexp_replace(t, pattern, by)
    return pages.select(F.col("page_id").alias("id"), strip(t).alias("text"))


def library(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """documents as books (one per source) and chapters (one per document)."""
    book = short_id(F.col("source"))
    chapters = documents.select(short_id(F.concat_ws(":", book, F.lit("ch"), F.col("doc_id"))).alias("id"), book.alias("book_id"), F.col("doc_id").alias("number"), F.substring(F.split(F.coalesce("text", F.lit("")), "\n")[0], 1, 40).alias("title"), F.coalesce("text", F.lit("")).alias("full_text"), F.lit("not_started").alias("study_status"))
    chapters = chapters.withColumn("word_count", word_count(F.col("full_text")))
    books = documents.groupBy("source").agg(F.count("*").alias("total_chapters"), F.sum(word_count(F.coalesce("text", F.lit("")))).alias("total_words"), F.max("doc_id").cast("double").alias("upload_date"))
    return books.select(short_id(F.col("source")).alias("id"), F.col("source").alias("title"), "total_chapters", "total_words", "upload_date", F.lit("ready").alias("status")), chapters


def decoded(raw: Column) -> Column:
    """Bytes as text: UTF-8, or Latin-1 where they are not valid UTF-8; stripped, null as empty."""
    return strip(F.coalesce(F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(F.decode(raw, "ISO-8859-1")), F.lit("")))


def _pypdf(raw: bytes) -> tuple[list[str], dict[str, str]]:
    import io

    from pypdf import PdfReader

    pdf = PdfReader(io.BytesIO(raw))
    info = {str(k).lstrip("/").lower(): v for k, v in (pdf.metadata or {}).items()}
    return [p.extract_text() or "" for p in pdf.pages], {k: v if isinstance(v, str) else str(v) for k, v in info.items() if k in ("author", "subject")}


def paged_files(spark: SparkSession, folder: str, extract: Callable[[bytes], list[str]] | None = None, pattern: str = "*.pdf", info: Callable[[bytes], dict] | None = None) -> DataFrame:
    """(path, digest, page, text, info_author, info_subject, error): pages of binary files. extract gives the pages and info the
    document's properties (bytes are read as UTF-8, else Latin-1); pypdf gives both if extract is not given."""
    import pandas as pd

    def clean(v) -> str:
        if isinstance(v, bytes):
            try:
                v = v.decode()
            except UnicodeDecodeError:
                v = v.decode("latin-1")
        return str(v or "").strip()

    def run(batches):
        for b in batches:
            out = []
            for r in b.itertuples():
                try:
                    raw = bytes(r.content)
                    pages, found = (extract(raw), info(raw) if info else {}) if extract else _pypdf(raw)
                    own = clean(found.get("author")), clean(found.get("subject"))
                    out += [(r.path, r.digest, k, t, *own, None) for k, t in enumerate(pages, 1)]
                except Exception as e:  # a broken file is a row with its error, not a failed job
                    out.append((r.path, r.digest, 0, "", "", "", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "digest", "page", "text", "info_author", "info_subject", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    head = F.substring(F.md5(F.substring("content", 1, 8192)), 1, 8)
    return files.select("path", head.alias("digest"), "content").mapInPandas(run, "path string, digest string, page int, text string, info_author string, info_subject string, error string")


def pages_to_markdown(pages: DataFrame, least_mean_words: float = 50.0, sample: int = 5) -> DataFrame:
    """pages(path, page, text) -> (path, pages, markdown, fast): fast if the first pages hold words enough."""
    n = word_count(F.col("text"))
    block = F.when(strip(F.col("text")) != "", F.struct("page", F.concat(F.lit("## Page "), F.col("page"), F.lit("\n\n"), F.col("text")).alias("t")))
    out = pages.groupBy("path").agg(F.count("*").alias("pages"), F.avg(F.when(F.col("page") <= sample, n)).alias("mean"), F.array_sort(F.collect_list(block)).alias("b"))
    return out.select("path", "pages", F.array_join(F.transform("b", lambda x: x.t), "\n\n---\n\n").alias("markdown"), (F.col("mean") >= least_mean_words).alias("fast"))


def adaptive_markdown(pages: DataFrame, slow: DataFrame, least_mean_words: float = 50.0, sample: int = 5) -> DataFrame:
    """pages(path, page, text) of the fast reader, slow(path, markdown) of a layout reader -> (path, pages, markdown, fast).

    Files whose first pages are too thin take the slow reader's markdown, if it has any; its page count is the fast reader's, else one
    more than its page breaks.
    """
    quick = pages_to_markdown(pages, least_mean_words, sample)
    own = slow.select("path", F.col("markdown").alias("other"))
    breaks = F.regexp_count("other", F.lit(r"\n-{3,}\n")) + 1
    both = quick.join(own, "path", "full")
    use = ~F.coalesce("fast", F.lit(False)) & F.col("other").isNotNull()
    return both.select("path", F.coalesce("pages", breaks).cast("long").alias("pages"), F.when(use, F.col("other")).otherwise(F.col("markdown")).alias("markdown"), F.coalesce("fast", F.lit(False)).alias("fast"))


def title_of(path: Column) -> Column:
    """A title from a file's name: the stem, with underscores and hyphens as spaces, in title case."""
    return F.initcap(F.regexp_replace(F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1), "[_-]", " "))


def legacy_library(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The old layout, one JSON file of books and folders of chapters: books as stored, and (book_id, chapters' columns)."""
    books = spark.read.option("multiLine", True).json(f"{folder}/index.json").where("id is not null")
    chapters = spark.read.option("multiLine", True).json(f"{folder}/books/*/chapters/*.json")
    place = F.regexp_extract(F.col("_metadata.file_path"), r"/books/([^/]+)/chapters/", 1)
    return books, chapters.withColumn("book_id", place)


@dataclass(frozen=True)
class Config:
    library_dir: str = "library"
    min_words_per_page: int = 50
    max_workers: int = 4

    @classmethod
    def load(cls, path: str) -> Config:
        """The file's known keys; a broken file reads as defaults, a missing one is written."""
        try:
            with open(path) as f:
                known = {x.name for x in fields(cls)}
                return cls(**{k: v for k, v in json.load(f).items() if k in known})
        except (OSError, ValueError, AttributeError, TypeError):
            own = cls()
            if not os.path.exists(path):
                own.save(path)
            return own

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump(asdict(self), f, ensure_ascii=False)
