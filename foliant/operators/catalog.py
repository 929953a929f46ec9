"""Catalog of stored tables: lookups, listing, upserts, cascades. Parquet has no MERGE, so changes are new frames that replace a table."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import word_count

STUDY_STATUS = ("not_started", "in_progress", "completed")
CHILDREN = {"chapters": "book_id", "markdown": "book_id", "prompts": "book_id", "analysis": "book_id"}


def listing(books: DataFrame) -> DataFrame:
    return books.orderBy(F.desc("upload_date"), "id")


def search(books: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring of the title."""
    return books.where(F.contains(F.lower("title"), F.lit(text.lower())))


def ready(books: DataFrame) -> DataFrame:
    return books.where("status = 'ready'")


def lookup(df: DataFrame, **key: str) -> DataFrame:
    """Rows of a key; the filters reach the Parquet scan."""
    for c, v in key.items():
        df = df.where(F.col(c) == v)
    return df


def chapter_listing(chapters: DataFrame, book_id: str | None = None) -> DataFrame:
    """Chapters without their text, in order."""
    rows = chapters if book_id is None else chapters.where(F.col("book_id") == book_id)
    return rows.drop("full_text").orderBy("book_id", "number")


def _free(df: DataFrame, name: str) -> str:
    """name, or a longer one that no column of df has."""
    have = {c.lower() for c in df.columns}
    while name in have:
        name += "_"
    return name


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Latest wins: new rows replace old ones of the same key; among new rows the last by order, a column that both tables have or none."""
    at = _free(new, "_n")
    new = new.withColumn(at, F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).where(F.col(at) == 1).drop(at)
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def upsert_markdown(old: DataFrame, books: DataFrame, order: Column) -> DataFrame:
    """old(book_id, content) after books(id, full_markdown) were stored: a book without markdown leaves what there is."""
    fresh = books.where(F.coalesce("full_markdown", F.lit("")) != "").withColumn("_at", order).select(F.col("id").alias("book_id"), F.col("full_markdown").alias("content"), "_at")
    return upsert(old.withColumn("_at", F.lit(None).cast(fresh.schema["_at"].dataType)), fresh, ["book_id"], F.col("_at")).drop("_at")


def delete_cascade(tables: dict[str, DataFrame], doomed: DataFrame) -> dict[str, DataFrame]:
    """tables without the books in doomed(id) and all that belongs to them."""
    gone = doomed.select(F.col("id").alias("_gone")).distinct()
    return {n: df.join(gone, df[CHILDREN.get(n, "id")] == gone["_gone"], "left_anti") for n, df in tables.items()}


def exists(books: DataFrame, book_id: str) -> bool:
    """Whether a book is there to be deleted."""
    return not lookup(books, id=book_id).isEmpty()


def clear_errors(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return delete_cascade(tables, tables["books"].where("status = 'error'").select("id"))


def clear_all(tables: dict[str, DataFrame]) -> tuple[int, dict[str, DataFrame]]:
    return tables["books"].count(), {n: df.limit(0) for n, df in tables.items()}


def orphans(chapters: DataFrame, books: DataFrame) -> DataFrame:
    """Chapters whose book is missing."""
    return chapters.join(books.select(F.col("id").alias("book_id")), "book_id", "left_anti")


def set_study_status(chapters: DataFrame, changes: DataFrame) -> DataFrame:
    """changes(id, study_status), an id at most once; unknown values are ignored."""
    name = _free(chapters, "_new")
    new = changes.where(F.col("study_status").isin(*STUDY_STATUS)).select("id", F.col("study_status").alias(name))
    return chapters.join(new, "id", "left").withColumn("study_status", F.coalesce(name, "study_status")).drop(name)


def new_files(found: DataFrame, stored: DataFrame) -> DataFrame:
    """found(path) that stored(path) does not hold: neither the path nor, as a part of any stored path, the file's name.

    Equal base names meet in a hash join. A name has no slash, so the names left over are sought inside the distinct segments of stored
    paths: every part of a segment that is as long as some name is a row of a second hash join.
    """
    name = lambda c: F.regexp_extract(c, r"[^/]+$", 0)
    key = _free(found, "_name")
    left = found.withColumn(key, name(F.col("path"))).join(stored.select(name("path").alias(key)).distinct(), key, "left_anti")
    lengths = left.agg(F.collect_set(F.length(key)).alias("_lengths"))
    segments = stored.select(F.explode(F.split("path", "/", -1)).alias("_segment")).distinct().join(F.broadcast(lengths))  # a single row
    sized = segments.select("_segment", F.explode(F.filter("_lengths", lambda n: n <= F.length("_segment"))).alias("_n"))
    parts = F.transform(F.sequence(F.lit(1), F.length("_segment") - F.col("_n") + 1), lambda k: F.substring(F.col("_segment"), k, F.col("_n")))
    inside = sized.select(F.explode(parts).alias(key)).distinct()
    return left.join(inside, key, "left_anti").select(*found.columns)


def missing(keys: DataFrame, cache: DataFrame, on: list[str]) -> DataFrame:
    """Keys whose result is not stored yet."""
    return keys.join(cache.select(*on), on, "left_anti")


def book_totals(chapters: DataFrame) -> DataFrame:
    return chapters.groupBy("book_id").agg(F.sum(word_count(F.col("full_text"))).alias("total_words"), F.count("*").alias("total_chapters"))


def encode_json(df: DataFrame, *columns: str) -> DataFrame:
    """The columns as JSON text; null stays null."""
    return df.withColumns({c: F.to_json(c) for c in columns})


def decode_json(df: DataFrame, **kinds: str) -> DataFrame:
    """Columns of JSON text as values of the given types; null and broken text become an empty array, for other types null."""
    none = lambda kind: F.array().cast(kind) if kind.startswith("array") else F.lit(None).cast(kind)
    return df.withColumns({c: F.coalesce(F.from_json(c, kind), none(kind)) for c, kind in kinds.items()})


def replace_table(df: DataFrame, path: str) -> None:
    """Replace the table at path. The new one is written beside it, the old one renamed aside, then the new one renamed in place: a
    crash leaves a whole table there or, between two renames, whole ones beside it, which read_table() finds."""
    spark: SparkSession = df.sparkSession
    fresh, aside = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old"
    df.write.parquet(fresh)
    jvm = spark._jvm.org.apache.hadoop.fs
    now, new, old = (jvm.Path(x) for x in (path, fresh, aside))
    fs = now.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(now):
        fs.delete(old, True)
        fs.rename(now, old)
    fs.rename(new, now)
    fs.delete(old, True)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The table at path, or the one that an interrupted replace_table() put aside."""
    jvm = spark._jvm.org.apache.hadoop.fs
    there = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm.Path(path))
    return spark.read.parquet(path if there else f"{path}.old")
