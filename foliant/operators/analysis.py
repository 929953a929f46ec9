"""A chapter's whole analysis as one value, and a cache of such values: look up, compute what is missing, store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..sources.tables import dealt
from . import catalog, concepts, density, formulas, graph, structure


def analyze(docs: DataFrame, keys: tuple[str, ...] = ("id",), text_col: str = "text") -> DataFrame:
    """(keys.., analysis: struct<structure, concepts, formulas, dependencies, density>), in the row; a step for each column, which the next ones read."""
    t, s, c, names = (F.col(f"_{x}") for x in ("text", "sections", "concepts", "names"))
    rows = docs.select(*keys, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.withColumn("_sections", structure.section_list(t)).withColumn("_concepts", concepts.ranked(t)).withColumn("_names", F.transform(c, lambda x: x["name"]))
    count = F.regexp_count(t, F.lit(structure.HEADING))
    shape = F.struct(s.alias("sections"), count.alias("heading_count"), F.when(count > 0, F.array_max(F.transform(s, lambda x: x.level))).otherwise(1).alias("max_depth"))
    links = F.struct(graph.edge_list(t, names, s).alias("edges"), graph.reference_list(t).alias("references"), graph.cluster_list(t, names).alias("clusters"))
    rows = rows.withColumns({"_formulas": formulas.formula_list(t), "_links": links, "_stats": let(density.counts(t), lambda n: F.struct(*(v.alias(k) for k, v in density.stats(n).items()))), "_parts": density.section_stats(t, s)})
    marks = F.struct(F.col("_stats").alias("stats"), density.labels(lambda k: F.col("_stats")[k]).alias("types"), F.col("_parts").alias("sections"))
    return rows.select(*keys, F.struct(shape.alias("structure"), c.alias("concepts"), F.col("_formulas").alias("formulas"), F.col("_links").alias("dependencies"), marks.alias("density")).alias("analysis"))


def cached(chapters: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """chapters(id, book_id, full_text), cache(book_id, chapter_id, data) -> the analyses of all chapters that have a text, as
    (book_id, chapter_id, data: JSON, cached), and the cache with those that were missing. Only the missing are computed; write
    the second with catalog.replace_table() and read the first from it, if both are wanted."""
    asked = chapters.where(F.coalesce("full_text", F.lit("")).rlike(r"\S")).select("book_id", F.col("id").alias("chapter_id"), "full_text")
    keys = ["book_id", "chapter_id"]
    known = cache.join(asked.select(*keys), keys, "left_semi").select(*keys, "data", F.lit(True).alias("cached"))
    fresh = analyze(dealt(catalog.missing(asked, cache, keys), chapters), tuple(keys), "full_text").select(*keys, F.to_json("analysis").alias("data"), F.lit(False).alias("cached"))
    return known.union(fresh), cache.select(*keys, "data").union(fresh.select(*keys, "data"))
