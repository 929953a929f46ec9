"""The reference scenarios (FIXTURES.md) on literal rows, and hand-derived results for what has no scenario there."""

import json
import math
import random
import re
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from foliant.functions.text import matches, occurrences
from foliant.operators import analysis, catalog, concepts, density, formulas, graph, ingest, library, metadata, prompts, structure
from foliant.plans import queries as plans
from foliant.sources.tables import Config, adaptive_markdown, dealt, decoded, legacy_library, paged_files, pages_to_markdown, title_of
from foliant.streaming import progress


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def names(spark, text):
    return {r["name"]: r for r in concepts.extract(docs(spark, text)).collect()}


def labels(spark, text):
    return density.analyze(docs(spark, text)).first().types


def given(df, *known):
    """df with the same concepts for every text."""
    return df.withColumn("concepts", F.array(*(F.struct(F.lit(n).alias("name")) for n in known)).cast("array<struct<name:string>>"))


def edges(spark, text, *known):
    return {(r.src, r.dst, r.type) for r in graph.edges(given(docs(spark, text), *known)).collect()}


@pytest.mark.parametrize("pattern", [r"a+", r"\d+", r"(?<!x)y", r"é."])
def test_matches_has_the_offsets_of_re(spark, pattern):
    texts = ["", "aaa b a", "1 22 x333", "xy y yy", "é😀é é", "none"]
    got = [[(x.start, x.stop, x.m) for x in r.x] for r in docs(spark, *texts).select(matches(F.col("text"), pattern).alias("x")).collect()]
    assert got == [[(m.start(), m.end(), m[0]) for m in re.finditer(pattern, t)] for t in texts]


def test_occurrences(spark):
    assert docs(spark, "aaaa").select(occurrences(F.col("text"), F.lit("aa")).alias("n")).first().n == 2


def test_bold_and_definition(spark):
    got = names(spark, "The **Lock Table** is central. A **Deadlock**: a cycle of waits. An Index is defined as a sorted copy of keys.")
    assert got["Deadlock"].definition == "a cycle of waits" and {"Lock Table", "Index"} <= set(got)


def test_plain_prose_falls_back_to_bigrams(spark):
    assert "Memory Cell" in names(spark, "memory cell maps to memory cell and a memory cell again")


def test_theorem_blocks(spark):
    got = names(spark, "Definition 1. A set is a group.\n\n  Theorem 2. Sets have sizes. Always.\n\n  Lemma 3. Small sets are finite.\n\nEnd")
    assert {"Definition", "Theorem", "Lemma"} <= set(got)


def test_importance_and_mentions(spark):
    r = names(spark, "# Cache\n\n**Cache**: fast store. cache cache cache cache cache")["Cache"]
    assert r.importance == "high" and r.mentions == 7 and r.sources == ["bold", "heading"]


def test_comparison_edges(spark):
    assert ("Queue", "Stack", "compared_with") in edges(spark, "Unlike a Queue, the Stack grows upward.", "Queue", "Stack")
    assert ("Queue", "Stack", "compared_with") in edges(spark, "Queue vs Stack: a tale", "Queue", "Stack")


def test_other_edges(spark):
    assert ("Heap", "Memory", "part_of") in edges(spark, "Memory includes the Heap and others.", "Memory", "Heap")
    assert ("Heap", "Memory", "example_of") in edges(spark, "Kinds of Memory: Heap, pools.", "Memory", "Heap")
    assert ("Two", "One", "depends_on") in edges(spark, "# Top\n\n## One\n\nx\n\n## Two\n\ny", "One", "Two")


def test_edges_of_nothing(spark):
    assert edges(spark, "") == set()


def test_clusters_join_over_paragraphs(spark):
    text = "alpha meets beta in this paragraph\n\nbeta meets gamma in that paragraph"
    assert [r.members for r in graph.clusters(given(docs(spark, text), "alpha", "beta", "gamma")).collect()] == [["alpha", "beta", "gamma"]]


def test_density_labels(spark):
    assert "math-heavy" in labels(spark, "\n\n".join(f"$$x_{k} = {k}$$" for k in range(4)))
    assert "proof-heavy" in labels(spark, "Proof. By induction. Hence done.\n\nProof. By contradiction. Q.E.D.")
    assert "problem-set" in labels(spark, "\n\n".join(f"Exercise {k}. Compute it." for k in range(6)))
    assert labels(spark, "") == ["introductory"]


def test_short_parent_hides_children(spark):
    assert density.by_section(docs(spark, "# A\nfew words\n## B\n" + "word " * 40)).count() == 0


def test_formulas(spark):
    rows = formulas.extract(docs(spark, "Energy grows. It holds: $$E = mc^2$$ where m is the mass of it. And $E = 2$ with $E = 2$.")).orderBy("ord").collect()
    assert [r.latex for r in rows] == ["$$E = mc^2$$", "$E = 2$"]
    assert {"symbol": "m", "meaning": "the mass of it"} in [v.asDict() for v in rows[0].variables]


def test_metadata(spark):
    text = "Deep Waters\nby Jane Miller\nPress\n© 2019 Jane Miller\n21st edition"
    r = metadata.extract(docs(spark, text).withColumn("title", F.lit("Algorithm and database software"))).first()
    assert ("Miller" in r.author, r.year, r.edition, r.subject, r.language) == (True, "2019", "21th", "computer science", "en")
    assert metadata.extract(docs(spark, "سلسلة من الكلمات").withColumn("title", F.lit(""))).first().language == "ar"


def test_sections(spark):
    rows = structure.sections(docs(spark, "# a\n## b\n### c\n## d\n# e")).orderBy("ord").collect()
    assert [r.parent_ord for r in rows] == [None, 0, 1, 0, None] and [r.end for r in rows] == [4, 9, 15, 20, 23]
    assert structure.sections(docs(spark, "#\n# A")).first().title == "# A"
    assert structure.summary(docs(spark, "plain")).first()[1:] == (0, 1)


def test_chapters(spark):
    of = lambda t: structure.chapters(docs(spark, t)).orderBy("number").collect()
    assert [(r.number, r.title) for r in of("pre\n# Chapter 1: One\nx\n# Chapter 2: Two\ny")] == [(1, "One"), (2, "Two")]
    assert [(r.number, r.title) for r in of("# One\nx\n# Preface\ny\n# Two\nz")] == [(1, "One"), (2, "Two")]
    assert len(of("short\n---\n" + "word " * 101 + "\n---\n" + "more " * 150)) == 2
    assert of("short")[0].title == "Full Document"
    assert [r.number for r in of("# Part I: A\nx\n# Part V: B\ny")] == [1, 2]
    assert [r.start_index for r in of("# Chapter 1: A\nx\n# Chapter 1: A\nlater")] == [17]


def test_bigrams_of_a_text_of_over_a_million_words(spark, tmp_path):
    from foliant.plans.queries import QUERIES

    one = spark.createDataFrame([(1, "a " * 1_000_001 + "tail end tail end", "en", "s", 2)], "doc_id long, text string, lang string, source string, n_chars long")
    one.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.bigram: r.n for r in QUERIES["bigram_freq"](spark, str(tmp_path)).collect()}
    assert got["a a"] == 1_000_000 and got["tail end"] == 2 and None not in got  # beside the fixture texts


def test_library_match_takes_every_book(spark):
    """Every source meets every other, however the sources are named."""
    from foliant.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/documents.parquet").select("source").distinct().count()
    got = QUERIES["library_match"](spark, sf).select("input_id", "book_id").collect()
    assert len(got) == len(set(got)) == n * (n - 1) and len({r.input_id for r in got}) == n


def test_library_ranking(spark):
    books = spark.createDataFrame([("i", "Storage Engines"), ("r", "Storage Engines II"), ("u", "Garden Birds")], "id string, title string")
    rows = [("i", 1, "Logs", ["log", "index", "page"]), ("r", 1, "Logs", ["log", "index", "page"]), ("u", 1, "Owls", ["owl", "nest"]), ("i", 2, "Trees", ["tree"]), ("r", 2, "Hashing", ["hash"]), ("u", 2, "Wrens", ["wren"])]
    chapters = spark.createDataFrame(rows, "book_id string, number int, title string, terms array<string>")
    got = {r.book_id: r for r in library.match(books.where("id = 'i'").select("id"), books, chapters, (0.3, 0.3, 0.4)).collect()}
    assert min(got["r"].name_score, got["r"].structure_score, got["r"].concept_score, got["r"].total_score) > 0.4
    assert got["u"].concept_score == 0 and got["u"].total_score < 0.2
    assert (got["r"]["rank"], got["u"]["rank"]) == (1, 2)
    # the same with a book that is not in the library yet
    both = library.with_input(books.where("id <> 'i'"), chapters.where("book_id <> 'i'"), books.where("id = 'i'"), chapters.where("book_id = 'i'"))
    again = {r.book_id: r for r in library.match(books.where("id = 'i'").select("id"), *both, (0.3, 0.3, 0.4)).collect()}
    assert again == got


def test_catalog(spark, tmp_path):
    books = spark.createDataFrame([("a", "ready"), ("b", "error")], "id string, status string")
    kids = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, book_id string")
    left = catalog.clear_errors({"books": books, "chapters": kids, "markdown": kids})
    assert [r.id for r in left["books"].collect()] == ["a"] and left["chapters"].count() == left["markdown"].count() == 1
    once = catalog.upsert(books, books.where("id = 'b'").withColumn("status", F.lit("ready")), ["id"], F.lit(1))
    assert once.where("status = 'ready'").count() == 2
    catalog.replace_table(once, str(tmp_path / "t"))
    catalog.replace_table(once.where("id = 'a'"), str(tmp_path / "t"))
    assert catalog.lookup(spark.read.parquet(str(tmp_path / "t")), id="a").count() == 1


def test_files_config_and_progress(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"one|two")
    (tmp_path / "bad.pdf").write_bytes(b"!")

    def extract(raw):
        if raw == b"!":
            raise ValueError("broken")
        return raw.decode().split("|")

    rows = paged_files(spark, str(tmp_path), extract).collect()
    assert sorted(r.text for r in rows if not r.error) == ["one", "two"] and [r.error for r in rows if r.error] == ["ValueError: broken"]
    pages = spark.createDataFrame([("p", 1, "one"), ("p", 2, ""), ("p", 3, "two")], "path string, page int, text string")
    assert pages_to_markdown(pages).first().markdown == "## Page 1\n\none\n\n---\n\n## Page 3\n\ntwo"
    assert Config.load(str(tmp_path / "c.json")) == Config() == Config.load(str(tmp_path / "c.json"))
    jobs = spark.createDataFrame([("a", 1, "new"), ("a", 2, "new"), ("a", 3, "done"), ("b", 4, "new")], "job string, seq long, state string")
    assert {(r.job, r.state) for r in progress.latest(jobs).collect()} == {("a", "done"), ("b", "new")}
    assert progress.changes(jobs).count() == 3 and [r.job for r in progress.active(jobs).collect()] == ["b"]


def test_prompt(spark):
    chapters = spark.createDataFrame([("c", "b", 1, "Logs", "# Logs\n\n**Log**: an append only file. See Section 2.")], "id string, book_id string, number int, title string, full_text string")
    books = spark.createDataFrame([("b", "Storage", "J. M.", 3)], "id string, title string, author string, total_chapters int")
    one = lambda mode: prompts.assemble(chapters, books, mode).first().prompt
    text = one("deep_dive")
    for part in ("# Study Prompt: Chapter 1", "**Author:** J. M.", "## Chapter Structure", "Key Concepts Identified", "See Section 2", "<chapter>"):
        assert part in text
    assert one("no such mode").replace("no such mode", "") == text and "## Instructions — Deep Dive Mode" in text


def test_prompt_tree_is_indented_by_nesting(spark):
    def tree(text):
        out = docs(spark, text).select(prompts.tree(F.col("text"))).first()[0]
        return [line.split("**")[0] for line in out.split("\n") if "**" in line]

    assert tree("# A\n### C\n## B\n### D") == ["", "  ├─ ", "  ├─ ", "    ├─ "]
    assert tree("## A\n#### C\n# B") == ["", "  ├─ ", ""]
    assert tree("# 1\n## 2\n### 3\n#### 4\n##### 5\n###### 6")[-1] == "  " * 5 + "├─ "
    assert tree("plain") == [""]


def test_prompt_names_related_chapters(spark):
    chapters = spark.createDataFrame([("c", "b", 1, "Logs", "# Logs", "Before", None), ("d", "b", 2, "Trees", "", None, None)], "id string, book_id string, number int, title string, full_text string, prev_chapter string, next_chapter string")
    books = spark.createDataFrame([("b", "Storage", None, 3)], "id string, title string, author string, total_chapters int")
    related = spark.createDataFrame([("c", "Disks", "Seeks", "related"), ("c", "Birds", None, None)], "id string, book_title string, chapter_title string, relevance string")
    got = {r.id: r.prompt for r in prompts.assemble(chapters, books, "exam_prep", related=related).collect()}
    assert "## Related Content From Your Library\n\n- **Birds** → Unknown *(related)*\n- **Disks** → Seeks *(related)*" in got["c"]
    assert "**Previous:** Before" in got["c"] and "**Next:**" not in got["c"] and "Related Content" not in got["d"]
    assert "No key concepts detected" in got["d"] and "## Instructions — Exam Preparation Mode" in got["d"]


def test_prompts_are_exported_by_name(spark, tmp_path):
    chapters = spark.createDataFrame([("c", "b", 1), ("d", "b", 2)], "id string, book_id string, number int")
    books = spark.createDataFrame([("b", "Storage")], "id string, title string")
    made = spark.createDataFrame([("c", "quick_review", "one\ntwo"), ("d", "quick_review", "three")], "id string, mode string, prompt string")
    prompts.export(made, chapters, books, str(tmp_path / "out"))
    files = {p.parent.name: p.read_text() for p in (tmp_path / "out").rglob("part-*")}
    assert files == {"file=Ch_1_quick_review.txt": "one\ntwo\n", "file=Ch_2_quick_review.txt": "three\n"}


def test_analysis_is_cached(spark):
    chapters = spark.createDataFrame([("c", "b", "# Logs\n\n**Log**: an append only file."), ("d", "b", "# Two\n\nother"), ("e", "b", "  ")], "id string, book_id string, full_text string")
    cache = spark.createDataFrame([("b", "d", "{}"), ("x", "y", "{}")], "book_id string, chapter_id string, data string")
    found, after = analysis.cached(chapters, cache)
    got = {r.chapter_id: r for r in found.collect()}
    assert {k: r.cached for k, r in got.items()} == {"c": False, "d": True} and got["d"].data == "{}"
    data = json.loads(got["c"].data)
    assert data["structure"]["heading_count"] == 1 and data["density"]["stats"]["word_count"] == 7
    assert "Log" in {c["name"] for c in data["concepts"]} and set(data) == {"structure", "concepts", "formulas", "dependencies", "density"}
    assert after.count() == 3 and all(r.cached for r in analysis.cached(chapters, after)[0].collect())
    assert analysis.analyze(docs(spark, None, "")).count() == 2


def test_concepts_of_rows_with_equal_ids_stay_apart(spark):
    rows = spark.createDataFrame([(1, "**Alpha**: one."), (1, "**Beta**: two."), (1, None)], "id long, text string")
    assert sorted(r["name"] for r in concepts.extract(rows).collect()) == ["Alpha", "Beta"]
    assert "Exchange" not in concepts.extract(rows)._jdf.queryExecution().executedPlan().toString()
    assert [r.importance for r in concepts.storable(concepts.extract(docs(spark, "# Cache\n\n**Cache**: fast store. cache cache cache cache cache"))).collect()][0] == "high"


def test_relations_need_no_shuffle(spark):
    rows = concepts.with_concepts(docs(spark, "**Queue** vs Stack"))
    for df in (graph.edges(rows), graph.clusters(rows), density.by_section(rows), formulas.extract(rows)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def _odd_texts(n, *patterns):
    """Texts of the literals of patterns, whole and cut, in either case, between odd characters."""
    rng = random.Random(7)
    words = sorted({w for p in patterns for w in re.findall(r"[A-Za-z.∎■-]+", re.sub(r"\\[sbSdw][+*]?", " ", p))}) + ["by induction", "is a thing that", "it follows", "Q.E.D.", "e.g.", "vs", "class x", "step 2", "is composed of", "find the"]
    gaps = ["", " ", "  ", "\n", "\n \n", "\t", "\u00a0", ".", ", ", "ſ", "K", "é", "x"]
    part = lambda w: rng.choice((w, w, w.upper(), w.title(), w[: rng.randint(1, len(w))]))
    return ["".join(part(rng.choice(words)) + rng.choice(gaps) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["", " ", "\n\n", "∎", "■", "vs", "Q.E.D."]


def test_quick_patterns_find_the_same(spark):
    rows = docs(spark, *_odd_texts(3000, *(p for _, p in density.COUNTS)))
    pairs = [(F.regexp_extract_all("text", F.lit(p), F.lit(0)), F.regexp_extract_all("text", F.lit(density.quick(p)), F.lit(0))) for p in density.HEADS]
    assert all(density.quick(p) != p for p in density.HEADS)
    for p, (n, bad) in zip(density.HEADS, zip(*[iter(rows.select(*(x for a, b in pairs for x in (F.sum(F.size(a)), F.sum((a != b).cast("int"))))).first())] * 2), strict=True):
        assert n > 100 and bad == 0, p


def test_families_are_sought_once(spark):
    """Counts and ratios share the search, in the row and in sections; paragraphs of white space alone don't count."""
    spark.conf.set("spark.sql.debug.maxToStringFields", 10_000)
    try:
        plan = density.by_section(docs(spark, "a"))._jdf.queryExecution().analyzed().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("homework") == 1
    n = density.analyze(docs(spark, "for example\n\n \t\n\nvs", " ", None)).orderBy("id").collect()
    assert [(r.word_count, r.para_count, r.example_ratio, r.comparison_count) for r in n] == [(3, 2, 0.5, 1), (0, 0, 0.0, 0), (0, 0, 0.0, 0)]


def test_library_match_reads_texts_once(spark):
    """Weights, sizes, frequencies and norms share one pass over the terms; beside it titles and books are read."""
    df = plans.QUERIES["library_match"](spark, "/root/testdata/sf0.001")
    assert df.count() > 0
    plan = df._jdf.queryExecution()
    df.collect()
    assert plan.executedPlan().toString().split("== Initial Plan")[0].count("FileScan") <= 4


def test_sequence_ratios_are_those_of_pairs(spark):
    rng = random.Random(2)
    lists = [["".join(rng.choices("ab ", k=rng.randint(0, 4))) for _ in range(n)] for n in (0, 1, 1, 2, 7, 250, 300)]
    for b in lists:
        one = lambda a: SequenceMatcher(None, a[0], b[0]).ratio() if len(a) == len(b) == 1 else SequenceMatcher(None, a, b).ratio()  # noqa: B023, E731
        assert library._sequences(lists, b) == [one(a) for a in lists]
    rows = spark.createDataFrame([(None, 1, "x", ["u"]), ("a", 1, "x", ["u", None]), ("b", 1, "y", ["u", "v"])], "book_id string, number int, title string, terms array<string>")
    books = spark.createDataFrame([("a", "A"), ("b", None), (None, "n")], "id string, title string")
    got = {(r.input_id, r.book_id): r.concept_score for r in library.match(books, books, rows).collect()}
    w = {"u": math.log(4 / 4) + 1, "v": math.log(4 / 2) + 1}
    assert got["a", "b"] == got["b", "a"] == round(w["u"] / math.hypot(w["u"], w["v"]), 4)


def test_need_of_contained(spark):
    """What matches CONTAINS holds CONTAINED."""
    found = F.regexp_extract_all("text", F.lit(graph.CONTAINS), F.lit(0))
    rows = docs(spark, *(t.replace("x", " includes ") for t in _odd_texts(3000, graph.CONTAINS))).where(F.size(found) > 0)
    assert rows.count() > 50 and rows.where(~F.col("text").rlike(graph.CONTAINED)).count() == 0


def test_tasks_do_not_grow_with_the_input(spark, tmp_path):
    """Pages in one file: the more rows, the more tasks; small inputs get one for each core."""
    pages = spark.range(2000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), "id").alias("url"), F.lit("<article><p>A b.</article>").alias("html"))
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    assert dealt(pages, rows=100).rdd.getNumPartitions() == 20 and dealt(pages, rows=10**6).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkey = dealt.__defaults__
    try:
        dealt.__defaults__ = (None, 50)
        assert plans.marked(spark, str(tmp_path)).rdd.getNumPartitions() >= 40
        assert plans.marked(spark, str(tmp_path)).count() == 2000 + len(plans.TEXTS)
    finally:
        dealt.__defaults__ = monkey


def test_new_files_are_sought_inside_stored_paths(spark):
    found = spark.createDataFrame([("/in/a.pdf",), ("/in/b.pdf",), ("/in/c.pdf",)], "path string")
    stored = spark.createDataFrame([("/raw/a.pdf",), ("/raw/1234_b.pdf",)], "path string")
    assert [r.path for r in catalog.new_files(found, stored).collect()] == ["/in/c.pdf"]


def test_new_files_meet_parts_of_paths_by_equality(spark):
    """The same rows as trying every name in every path, without doing so."""
    rng = random.Random(4)
    paths = [None, "", "/", "a/", "é/ab.c", "x\ny/z"] + ["/".join("".join(rng.choices("abé1.", k=rng.randint(0, 6))) for _ in range(rng.randint(1, 4))) for _ in range(600)]
    for some in (paths[6::9], [p for p in paths[6::9] if p and not p.endswith("/")], [None], []):
        found, stored = (spark.createDataFrame([(p,) for p in x], "path string") for x in (paths, some))
        new = catalog.new_files(found, stored)
        assert "Contains" not in new._jdf.queryExecution().toString()
        kept = [p for p in paths if p is None or not any(p.rsplit("/", 1)[-1] in s for s in some if s is not None)]
        assert Counter(r.path for r in new.collect()) == Counter(kept)


def test_json_columns(spark):
    rows = spark.createDataFrame([(1, '["a","b"]'), (2, None), (3, "broken")], "id long, sub_headings string")
    got = catalog.decode_json(rows, sub_headings="array<string>")
    assert [r.sub_headings for r in got.orderBy("id").collect()] == [["a", "b"], [], []]
    assert [r.sub_headings for r in catalog.encode_json(got, "sub_headings").orderBy("id").collect()] == ['["a","b"]', "[]", "[]"]


def test_catalog_edges(spark, tmp_path):
    books = spark.createDataFrame([("a", "ready")], "id string, status string")
    kids = spark.createDataFrame([("1", "a", "x"), ("2", "gone", "y")], "id string, book_id string, _new string")
    assert [r.id for r in catalog.orphans(kids, books).collect()] == ["2"] and catalog.exists(books, "a") and not catalog.exists(books, "b")
    assert catalog.missing(kids, kids.where("id = '1'"), ["id"]).count() == 1
    changed = catalog.set_study_status(kids.withColumn("study_status", F.lit("not_started")), spark.createDataFrame([("1", "completed"), ("2", "odd")], "id string, study_status string"))
    assert {r.id: (r.study_status, r._new) for r in changed.collect()} == {"1": ("completed", "x"), "2": ("not_started", "y")}
    marks = catalog.upsert_markdown(spark.createDataFrame([("a", "old")], "book_id string, content string"), spark.createDataFrame([("a", ""), ("b", "new")], "id string, full_markdown string"), F.lit(1))
    assert {(r.book_id, r.content) for r in marks.collect()} == {("a", "old"), ("b", "new")}
    at = str(tmp_path / "t")
    catalog.replace_table(books, at)
    (tmp_path / "t").rename(tmp_path / "t.old")  # as after a crash between the two renames
    assert catalog.read_table(spark, at).count() == 1
    catalog.replace_table(books.union(books), at)
    assert catalog.read_table(spark, at).count() == 2


def test_three_column_keys_and_order(spark):
    old = spark.createDataFrame([("b", "c", "m", "old", 1)], "book_id string, chapter_id string, mode string, content string, v int")
    new = spark.createDataFrame([("b", "c", "m", "late", 3), ("b", "c", "m", "mid", 2), ("b", "c", "n", "other", 1)], old.schema)
    got = catalog.upsert(old, new, ["book_id", "chapter_id", "mode"], F.col("v"))
    assert {(r.mode, r.content) for r in got.collect()} == {("m", "late"), ("n", "other")}


def test_adaptive_source(spark, tmp_path):
    pages = spark.createDataFrame([("thin", 1, "few"), ("thin", 2, ""), ("rich", 1, "word " * 80)], "path string, page int, text string")
    slow = spark.createDataFrame([("thin", "# Scanned"), ("only", "a\n---\nb\n-----\nc"), ("rich", "unused")], "path string, markdown string")
    got = {r.path: r for r in adaptive_markdown(pages, slow).collect()}
    assert (got["thin"].markdown, got["thin"].pages, got["thin"].fast) == ("# Scanned", 2, False)
    assert (got["only"].markdown, got["only"].pages) == ("a\n---\nb\n-----\nc", 3) and got["rich"].fast and "word" in got["rich"].markdown
    raw = spark.createDataFrame([(b"caf\xc3\xa9 ",), (b"caf\xe9",), (None,)], "x binary")
    assert [r[0] for r in raw.select(decoded(F.col("x"))).collect()] == ["café", "café", ""]
    assert spark.range(1).select(title_of(F.lit("/in/deep_waters-ii.pdf"))).first()[0] == "Deep Waters Ii"
    (tmp_path / "x.pdf").write_bytes(b"one")
    row = paged_files(spark, str(tmp_path), lambda raw: [raw.decode()], info=lambda raw: {"author": b"Jos\xe9 ", "subject": None}).first()
    assert (row.info_author, row.info_subject, row.error) == ("José", "", None)
    (tmp_path / "old" / "books" / "b" / "chapters").mkdir(parents=True)
    (tmp_path / "old" / "index.json").write_text('[{"id": "b", "title": "T"}, {"title": "none"}]')
    (tmp_path / "old" / "books" / "b" / "chapters" / "1.json").write_text('{"id": "c", "title": "One"}')
    books, chapters = legacy_library(spark, str(tmp_path / "old"))
    assert [r.id for r in books.collect()] == ["b"] and [(r.id, r.book_id) for r in chapters.collect()] == [("c", "b")]


def test_discovery_and_progress_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.pdf").write_bytes(b"1")

    def run():
        q = progress.discover(spark, str(source)).select("path").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.read.parquet(str(tmp_path / "out")).count()

    assert run() == 1
    (source / "b.pdf").write_bytes(b"2")
    assert run() == 2  # the first file is not seen again
    jobs = tmp_path / "jobs"
    spark.createDataFrame([("a", 1, "new"), ("a", 2, "done")], "job string, seq long, state string").write.parquet(str(jobs))
    q = progress.latest_stream(spark.readStream.schema("job string, seq long, state string").parquet(str(jobs))).writeStream.outputMode("update").format("memory").queryName("latest").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.job, r.state) for r in spark.table("latest").collect()] == [("a", "done")]


def test_jobs_report_their_progress(spark, tmp_path):
    jobs = progress.Jobs(spark, str(tmp_path / "events"))
    good = jobs.submit("a", lambda progress: (progress("reading", 10), progress("writing", 60), 42)[-1])
    bad = jobs.submit("b", lambda progress: 1 / 0)
    assert good.result(60) == 42 and isinstance(bad.exception(60), ZeroDivisionError)
    assert {(r.job, r.state) for r in progress.latest(jobs.events()).collect()} == {("a", "done"), ("b", "error")}
    assert [r.state for r in progress.changes(jobs.events()).where("job = 'a'").orderBy("seq").collect()] == ["reading", "writing", "done"]


def test_ingestion(spark):
    rich = "# One\n\n**Log**: an append only file. " + "word " * 60 + "\n# Two\n\nby Jane Miller\n\n$$a^2 + b = c$$ where a is the side of it."
    pages = spark.createDataFrame([("in/deep_waters.pdf", 1, rich, "J. M.", None), ("in/thin.pdf", 1, "few", "", None), ("in/bad.pdf", 0, "", "", "broken")], "path string, page int, text string, info_author string, error string")
    slow = spark.createDataFrame([("in/thin.pdf", "# Scanned\n\nby Jane Miller")], "path string, markdown string")
    made = ingest.ingest(pages, slow, uploaded=7.0)
    books = {r.filename: r for r in made["books"].collect()}
    one, thin, bad = (books[f] for f in ("deep_waters.pdf", "thin.pdf", "bad.pdf"))
    assert (one.title, one.author, one.total_chapters, one.status, one.upload_date) == ("Deep Waters", "J. M.", 2, "ready", 7.0)
    assert (thin.author, thin.status, bad.status, bad.chapter_ids) == ("Jane Miller", "ready", "error", [])
    chapters = {r.title: r for r in made["chapters"].where(F.col("book_id") == one.id).collect()}
    assert set(one.chapter_ids) == {r.id for r in chapters.values()} and {c["name"] for c in chapters["One"].concepts} == {"Log", "One"}
    assert [f.latex for f in chapters["Two"].formulas] == ["$$a^2 + b = c$$"] and made["markdown"].count() == 2
