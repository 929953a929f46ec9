"""Study prompts: a chapter's analyses as text. All sections are built in the row from arrays; only the book's few columns are joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let, word_count
from . import concepts, density, formulas, graph, structure

# Headings and phrases that readers of prompts rely on.
BANDS = (("high", "### Critical Concepts (must understand)"), ("medium", "### Important Concepts"), ("low", "### Supporting Concepts"))
EDGES, GROUPS, REFS = "### Relationships", "### Concept Clusters (frequently co-occur)", "### External References"
NO_CONCEPTS = "## Key Concepts\n\n*No key concepts detected.*"
NO_LINKS = "*No explicit dependencies detected.*\n"
RELATED = "---\n## Related Content From Your Library\n\n"

#: (mode, name, instructions); the first is the fallback of an unknown mode.
MODES = (
    ("deep_dive", "Deep Dive", "Teach this chapter from the ground up. Take the critical concepts in the order of the chapter, explain each in your own words with an example from the text, work through every formula, and end with questions that test understanding."),
    ("quick_review", "Quick Review", "Summarise this chapter for someone who has read it before. One line for each concept, the formulas in a list, and the three points that matter most."),
    ("exam_prep", "Exam Preparation", "Prepare a student for an examination on this chapter. Ask questions of growing difficulty on the critical concepts, give model answers, and point out frequent mistakes."),
    ("connections", "Connections", "Explain how the concepts of this chapter depend on one another and on earlier chapters. Follow the dependency graph and name what each relation means."),
)


def modes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODES, "mode string, mode_name string, instructions string")


def mode_listing(spark: SparkSession) -> DataFrame:
    return modes(spark).select("mode", "mode_name", F.substring("instructions", 1, 200).alias("preview"))


def _joined(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def _if(cond: Column, *parts) -> Column:
    """The parts as one string, or an empty one."""
    return F.when(cond, F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))).otherwise("")


def tree(t: Column) -> Column:
    """Structure section: every heading under its parent, indented by how many are above it, with its density label."""

    def of(s, labelled):
        label = lambda x: F.try_element_at(F.filter(labelled, lambda y: y.title == x.title), F.lit(-1)).types[0]
        line = lambda x, d: F.concat(F.repeat(F.lit("  "), d), _if(d > 0, "├─ "), F.lit("**"), x.title, F.lit("** ("), x.word_count, F.lit(" words)"), F.coalesce(F.concat(F.lit(" ["), label(x), F.lit("]")), F.lit("")))
        return let(structure.depths(s), lambda d: _joined(F.transform(s, lambda x, k: line(x, F.get(d, k)))))

    count = F.size(F.regexp_extract_all(t, F.lit(structure.HEADING), F.lit(0)))
    body = let(structure.section_list(t), lambda s: F.concat(F.when(count > 0, F.array_max(F.transform(s, lambda x: x.level))).otherwise(1), F.lit("*\n\n"), let(density.section_stats(t, s), lambda d: of(s, d))))
    return F.concat(F.lit("---\n## Chapter Structure\n\n*"), count, F.lit(" sections, max depth "), body)


def concept_section(found: Column) -> Column:
    """Concepts by importance, numbered throughout."""
    numbered = F.transform(found, lambda x, k: x.withField("rank", k + 1))
    bold = lambda x: F.when(x.importance == "low", x["name"]).otherwise(F.concat(F.lit("**"), x["name"], F.lit("**")))
    line = lambda x: F.concat(x["rank"], F.lit(". "), bold(x), _if(x.definition != "", " — ", x.definition), _if(x.importance == "high", " *(mentioned ", x.mentions, "×)*"))

    def band(n, name, title):
        own = lambda o: F.when(F.size(o) > 0, F.concat(F.lit(title + "\n"), _joined(F.transform(o, line)), F.lit("\n")))
        return let(F.filter(n, lambda x: x.importance == name), own)

    listed = let(numbered, lambda n: F.concat_ws("\n", *(band(n, name, title) for name, title in BANDS)))
    return F.when(F.size(found) == 0, NO_CONCEPTS).otherwise(F.concat(F.lit("---\n## "), F.size(found), F.lit(" Key Concepts Identified\n\n"), listed))


def formula_section(t: Column) -> Column:
    """Formulas with their context; null without one."""
    names = lambda x: F.array_join(F.transform(x.variables, lambda v: F.concat(F.lit("`"), v.symbol, F.lit("` = "), v.meaning)), ", ")
    one = lambda x, k: F.concat(F.lit("### Formula "), k + 1, F.lit("\n"), x.latex, F.lit("\n"), _if(x.context_before != "", "\n**Context:** ", F.substring(x.context_before, 1, 200)), _if(F.size(x.variables) > 0, "\n**Variables:** ", names(x)), F.lit("\n"))
    return let(formulas.formula_list(t), lambda f: F.when(F.size(f) > 0, F.concat(F.lit("---\n## "), F.size(f), F.lit(" Formulas\n\n"), _joined(F.transform(f, one)))))


def graph_section(t: Column, found: Column) -> Column:
    """Relations, clusters and references."""
    some = lambda lines, title: let(lines, lambda a: F.when(F.size(a) > 0, F.concat(F.lit(title + "\n"), _joined(a), F.lit("\n"))))
    arrow = lambda e: F.concat(F.lit("- "), e.src, F.lit(" →["), F.replace(e.type, F.lit("_"), F.lit(" ")), F.lit("]→ "), e.dst)
    names = F.transform(found, lambda x: x["name"])
    edges = let(names, lambda n: some(F.transform(let(structure.section_list(t), lambda s: graph.edge_list(t, n, s)), arrow), EDGES))
    groups = let(names, lambda n: some(F.transform(graph.cluster_list(t, n), lambda g, k: F.concat(k + 1, F.lit(". "), F.array_join(g, ", "))), GROUPS))
    refs = some(F.transform(graph.reference_list(t), lambda r: F.concat(F.lit("- "), r.text)), REFS)
    links = F.concat_ws("\n", edges, groups, refs)
    return let(links, lambda x: F.concat(F.lit("---\n## Concept Dependency Graph\n\n"), F.when(x == "", NO_LINKS).otherwise(x)))


def stats(chapters: DataFrame) -> DataFrame:
    """(id, words, tokens): whitespace words and a quarter of the characters."""
    t = F.coalesce("full_text", F.lit(""))
    return chapters.select("id", word_count(t).alias("words"), F.floor(F.length(t) / 4).alias("tokens"))


def assemble(chapters: DataFrame, books: DataFrame, mode: str = "deep_dive", now: str = "1970-01-01 00:00", related: DataFrame | None = None) -> DataFrame:
    """chapters(id, book_id, number, title, full_text, and prev_chapter, next_chapter if known), books(id, title, author, total_chapters),
    related(id, book_title, chapter_title, relevance), rows about other books -> (id, mode, prompt)."""
    # an unknown mode falls back to the first
    _, mode_name, instructions = next((m for m in MODES if m[0] == mode), MODES[0])
    rows = chapters.join(books.select(F.col("id").alias("book_id"), F.col("title").alias("book"), F.coalesce("author", F.lit("")).alias("author"), "total_chapters"), "book_id", "left")
    if related is None:
        rows = rows.withColumn("related", F.lit(None).cast("array<string>"))
    else:
        line = F.concat(F.lit("- **"), F.coalesce("book_title", F.lit("Unknown")), F.lit("** → "), F.coalesce("chapter_title", F.lit("Unknown")), F.lit(" *("), F.coalesce("relevance", F.lit("related")), F.lit(")*"))
        rows = rows.join(related.groupBy("id").agg(F.array_sort(F.collect_list(line)).alias("related")), "id", "left")
    rows = concepts.with_concepts(rows.withColumn("full_text", F.coalesce("full_text", F.lit(""))), "full_text", "found")
    t = F.col("full_text")
    beside = [_if(F.col(c).isNotNull(), f"\n**{n}:** ", F.col(c)) for c, n in (("prev_chapter", "Previous"), ("next_chapter", "Next")) if c in chapters.columns]
    header = F.concat(F.lit("# Study Prompt: Chapter "), "number", F.lit(' — "'), "title", F.lit('"\n\n**Book:** '), F.coalesce("book", F.lit("Unknown Book")), _if(F.coalesce("author", F.lit("")) != "", "\n**Author:** ", F.col("author")), F.lit("\n**Chapter:** "), "number", F.lit(" of "), F.coalesce(F.col("total_chapters").cast("string"), F.lit("?")), F.lit(f"\n**Study Mode:** {mode_name}\n**Generated:** {now}"), *beside)
    others = F.when(F.size("related") > 0, F.concat(F.lit(RELATED), _joined(F.col("related")), F.lit("\n")))
    text = F.concat(F.lit("---\n## Full Chapter Text\n*("), word_count(t), F.lit(" words, ~"), F.format_number(F.floor(F.length(t) / 4), 0), F.lit(" tokens)*\n\n<chapter>\n"), t, F.lit("\n</chapter>"))
    end = F.lit(f"---\n## Instructions — {mode_name} Mode\n\n{instructions}")
    return rows.select("id", F.lit(mode).alias("mode"), F.concat_ws("\n\n", header, tree(t), concept_section(F.col("found")), formula_section(t), graph_section(t, F.col("found")), others, text, end).alias("prompt"))


def export(prompts: DataFrame, chapters: DataFrame, books: DataFrame, folder: str) -> None:
    """Text files, one for each prompt, by book and by name: Ch_<number>_<mode>.txt stands as the last folder's name."""
    named = prompts.join(chapters.select("id", "book_id", "number"), "id").join(books.select(F.col("id").alias("book_id"), F.col("title").alias("book_title")), "book_id")
    name = F.concat(F.lit("Ch_"), F.coalesce(F.col("number").cast("string"), F.lit("00")), F.lit("_"), "mode", F.lit(".txt"))
    named.select(F.coalesce("book_title", F.lit("Unknown Book")).alias("book_title"), name.alias("file"), F.col("prompt").alias("value")).write.mode("overwrite").option("lineSep", "\n").partitionBy("book_title", "file").text(folder)
