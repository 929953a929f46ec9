"""The registered queries of the document operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import occurrences, short_id, tokens, word_count
from ..operators import analysis, catalog, concepts, density, formulas, graph, ingest, library, metadata, prompts, structure
from ..sources.tables import library as as_library
from ..sources.tables import dealt, page_markdown, table
from ..streaming import progress

#: Small texts with the markup that the driver's tables lack; the same rows stand in the SQL.
TEXTS: tuple[tuple[int, str], ...] = (
    (9000001, "# Chapter 1: Storage\n\nIntro words here.\n\n## Hash Index\n\n**Hash Index**: maps keys to places. A Hash Index is a structure that maps every key to one place on disk.\n\n## Sorted Table\n\nUnlike a Hash Index, a **Sorted Table** keeps order. See Section 2.1 for more.\n\n# Chapter 2: Logs\n\nWrite Ahead Log (an append only file of changes) helps. As we saw earlier, LSM (Log Structured Merge) wins."),
    (9000002, "Theorem 1. Every finite set has a maximum.\n\nProof. By induction. Hence it follows. Q.E.D.\n\nProof: by contradiction, therefore done.\n\n$$a^2 + b^2 = c^2$$ where $c$ is the longest side of it.\n\nLet $x_1 = 2$ and $x_1 = 2$ again."),
    (9000003, "Exercise 1. Compute the sum.\n\nProblem 2. Prove that x is even.\n\nExercise 3. Show that y is odd.\n\n- **Queue**: first in first out\n- **Stack**: last in first out\n\nTypes of Containers: Queue, Stack and Heap.\n\nQueue vs Stack is old."),
    (9000004, "Deep Waters\nby Jane Q. Miller\n\n© 2019 Jane Miller\n21st edition\n\nAn algorithm and a database of software. A compiler is a program that translates."),
    (9000005, "سلسلة من الكلمات العربية في نص قصير"),
    (9000006, "#\n# Alpha\n### Gamma\n## Beta\ntext\n# Preface\nwords\n# Omega\nwrite-ahead log and write-ahead log; log-structured log-structured"),
    (9000007, ""),
    (9000008, "Memory includes the Heap, pools and the Stack. A Container consists of **Queue**; Heap or nothing else.\n\nKinds of Memory: Heap, Stack or pools.\n\nStack versus Queue, similar to a Heap, differs from Memory.\n\nThe Heap and the Stack and Memory meet here.\n\nA Queue waits near a Container every day."),
    (9000009, "# Top\n\n## Queue\n\nThe queue holds more than the twenty words that a section needs before it is counted as one by the density of its text, so here they are.\n\n## Stack\n\n### Heap\n\nx\n\n## Memory\n\ny\n\n# Other\n\n## Heap\n\nz"),
    (9000010, "short\n---\n" + " ".join(f"w{k}" for k in range(120)) + "\n-----\n# Late\n" + "more " * 105 + "\n---\n\n---\nend"),
    (9000011, "# Part I: Alpha\nx\n# Part V: Beta\ny\n## 7. Gamma\n### Sub\n# Part V: Beta\nlater\n# 12 Delta\n## Sub one\n## Sub two\nz"),
)
#: Concepts that the relation queries are asked about, in rank order; the same stand in the SQL.
NAMES = ("Hash Index", "Sorted Table", "Queue", "Stack", "Heap", "Container", "Memory")
#: Words that occur in the documents, for co-occurrence.
COMMON = ("the", "und", "de la", "que", "heap", "stack", "queue", "memory", "container")
_V = "(VALUES " + ", ".join(f"({k}, '{t.replace(chr(39), chr(39) * 2)}')" for k, t in TEXTS) + ") AS v(id, text)"
_D = f"d AS (SELECT CAST(id AS BIGINT) AS id, text AS t FROM {_V} UNION ALL SELECT doc_id, coalesce(text, '') FROM documents)"
_ID = "substring(sha256(source), 1, 12)"


def _re2(p: str) -> str:
    return p.replace("(?md)", "(?m)").replace("(?d)", "").replace("++", "+").replace("'", "''")


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _page_sql() -> str:
    """html as markdown, as page_markdown() makes it."""
    t = "regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1)"
    for pattern, by in (("(?s)<h1[^>]*>(.*?)</h1>", "\n\n# \\1\n\n"), ("<p[^>]*>", "\n\n"), ("<[^>]+>", ""), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = f"regexp_replace({t}, '{pattern}', '{by}', 'g')"
    return _strip(t)


_P = f"p AS (SELECT CAST(id AS BIGINT) AS id, text AS t FROM {_V} UNION ALL SELECT page_id, coalesce({_page_sql()}, '') FROM pages)"


def _matches_sql(source: str, pattern: str, groups: int) -> str:
    """(id, t, k, m, g1.., start, stop): all matches in source(id, t), with offsets in code points."""
    g = "".join(f", regexp_extract_all(t, '{pattern}', {n}) AS g{n}" for n in range(1, groups + 1))
    names = "".join(f", g{n}[k] AS g{n}" for n in range(1, groups + 1))
    size = lambda a: f"coalesce(list_sum(list_transform({a}, lambda x: length(x))), 0)"
    inner = f"SELECT *, unnest(range(1, len(m) + 1)) AS k FROM (SELECT id, t, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_split_to_array(t, '{pattern}') AS p{g} FROM {source})"
    placed = f"SELECT id, t, k, m[k] AS m{names}, CAST({size('p[1:k]')} + {size('m[1:k-1]')} AS BIGINT) AS start FROM ({inner})"
    return f"SELECT *, start + length(m) AS stop FROM ({placed})"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture texts and all documents: (id, text)."""
    own = spark.createDataFrame(TEXTS, "id long, text string")
    return own.union(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit(""))))


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture texts and all pages as markdown."""
    pages = table(spark, sf_dir, "pages")
    return spark.createDataFrame(TEXTS, "id long, text string").union(dealt(page_markdown(pages), pages))


def _books(spark, sf_dir):
    return as_library(table(spark, sf_dir, "documents"))


def _terms(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("source").alias("id"), F.explode(tokens(F.coalesce("text", F.lit("")))).alias("term")).where(F.length("term") >= 3)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_WORDS = "len(regexp_extract_all(coalesce(text, ''), '\\S+'))"
_BOOKS = f"SELECT {_ID} AS id, source AS title, count(*) AS total_chapters, CAST(sum({_WORDS}) AS BIGINT) AS total_words, CAST(max(doc_id) AS DOUBLE) AS upload_date, 'ready' AS status FROM documents GROUP BY source"
_CHAPTERS = f"SELECT substring(sha256({_ID} || ':ch:' || doc_id), 1, 12) AS id, {_ID} AS book_id, doc_id AS number, substring(string_split(coalesce(text, ''), chr(10))[1], 1, 40) AS title, 'not_started' AS study_status, {_WORDS} AS word_count FROM documents"


@query(_BOOKS)
def catalog_list(spark, sf_dir):
    return catalog.listing(_books(spark, sf_dir)[0])


@query(f"SELECT * FROM ({_BOOKS}) WHERE contains(lower(title), 'c1')")
def catalog_search(spark, sf_dir):
    return catalog.ready(catalog.search(_books(spark, sf_dir)[0], "C1"))


@query(_CHAPTERS)
def catalog_chapter_listing(spark, sf_dir):
    return catalog.chapter_listing(_books(spark, sf_dir)[1])


@query(f"SELECT {_ID} AS book_id, CAST(sum({_WORDS}) AS BIGINT) AS total_words, count(*) AS total_chapters FROM documents GROUP BY 1")
def book_totals(spark, sf_dir):
    return catalog.book_totals(_books(spark, sf_dir)[1])


@query(f"SELECT doc_id, substring(sha256({_ID} || ':ch' || doc_id), 1, 12) AS id FROM documents")
def chapter_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", short_id(F.concat(short_id(F.col("source")), F.lit(":ch"), F.col("doc_id"))).alias("id"))


@query(f"WITH c AS ({_CHAPTERS}), b AS ({_BOOKS}) SELECT c.id, c.book_id FROM c JOIN b ON c.book_id = b.id WHERE b.title NOT LIKE '%0'")
def cascade_delete(spark, sf_dir):
    books, chapters = _books(spark, sf_dir)
    left = catalog.delete_cascade({"books": books, "chapters": chapters}, books.where(F.col("title").endswith("0")))
    return left["chapters"].join(left["books"].select(F.col("id").alias("book_id")), "book_id", "left_semi").select("id", "book_id")


@query(f"WITH c AS ({_CHAPTERS}), b AS ({_BOOKS}) SELECT c.id, c.book_id, c.number FROM c JOIN b ON c.book_id = b.id WHERE b.title = 'src1'")
def catalog_lookup(spark, sf_dir):
    """A book by its title, its chapters by the book's key."""
    books, chapters = _books(spark, sf_dir)
    return chapters.join(catalog.lookup(books, title="src1").select(F.col("id").alias("book_id")), "book_id", "left_semi").select("id", "book_id", "number")


@query(f"WITH c AS ({_CHAPTERS}), b AS ({_BOOKS}) SELECT c.id FROM c JOIN b ON c.book_id = b.id WHERE b.title NOT LIKE '%1'")
def clear_errored(spark, sf_dir):
    books, chapters = _books(spark, sf_dir)
    failed = books.withColumn("status", F.when(F.col("title").endswith("1"), "error").otherwise("ready"))
    return catalog.clear_errors({"books": failed, "chapters": chapters})["chapters"].select("id")


@query(f"WITH c AS ({_CHAPTERS}), b AS ({_BOOKS}) SELECT c.id, c.book_id FROM c JOIN b ON c.book_id = b.id WHERE b.title LIKE '%0'")
def orphan_chapters(spark, sf_dir):
    books, chapters = _books(spark, sf_dir)
    return catalog.orphans(chapters, books.where(~F.col("title").endswith("0"))).select("id", "book_id")


@query("SELECT coalesce(n.conv_id, o.conv_id) AS conv_id, coalesce(n.turn, o.turn) AS turn, coalesce(n.role, o.role) AS role, coalesce(n.content, o.content) AS content FROM (SELECT conv_id, turn, role, 'new ' || max(coalesce(text, '')) AS content FROM conversations WHERE turn % 3 = 0 GROUP BY 1, 2, 3) n FULL JOIN (SELECT DISTINCT conv_id, turn, role, 'old' AS content FROM conversations WHERE turn % 2 = 0) o ON n.conv_id = o.conv_id AND n.turn = o.turn AND n.role = o.role")
def upsert_prompts(spark, sf_dir):
    """A key of three columns; of several new rows of a key the largest content."""
    c = table(spark, sf_dir, "conversations")
    keys = ["conv_id", "turn", "role"]
    old = c.where("turn % 2 = 0").select(*keys, F.lit("old").alias("content")).distinct()
    new = c.where("turn % 3 = 0").select(*keys, F.concat(F.lit("new "), F.coalesce("text", F.lit(""))).alias("content"))
    return catalog.upsert(old, new, keys, F.col("content"))


@query("SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 0 ELSE quality + 10 END AS quality FROM (SELECT doc_id FROM documents) d FULL JOIN labels l ON d.doc_id = l.doc_id")
def upsert_latest(spark, sf_dir):
    old = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("quality"))
    new = table(spark, sf_dir, "labels")
    both = new.select("doc_id", "quality", F.lit(1).alias("v")).union(new.select("doc_id", F.col("quality") + 10, F.lit(2)))
    return catalog.upsert(old.withColumn("v", F.lit(0)), both, ["doc_id"], F.col("v")).select("doc_id", "quality")


@query("SELECT page_id, url AS path FROM pages p WHERE NOT EXISTS (SELECT 1 FROM pages s WHERE s.page_id % 3 = 0 AND contains(s.url, regexp_extract(p.url, '[^/]+$')))")
def new_files_anti(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"))
    return catalog.new_files(p, p.where("page_id % 3 = 0"))


@query(f"SELECT id, CASE WHEN number % 7 = 0 THEN 'completed' ELSE study_status END AS study_status FROM ({_CHAPTERS})")
def study_status_update(spark, sf_dir):
    c = _books(spark, sf_dir)[1]
    changes = c.where("number % 7 = 0").select("id", F.lit("completed").alias("study_status")).union(c.where("number % 7 = 1").select("id", F.lit("unheard_of")))
    return catalog.set_study_status(c, changes).select("id", "study_status")


@query("SELECT user_id AS job, arg_max(event_type, event_id) AS state, max(event_id) AS seq FROM events GROUP BY user_id")
def progress_latest(spark, sf_dir):
    return progress.latest(_events(spark, sf_dir))


@query("SELECT job, seq, state FROM (SELECT user_id AS job, event_id AS seq, event_type AS state, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS NULL OR b <> state")
def progress_changes(spark, sf_dir):
    return progress.changes(_events(spark, sf_dir))


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), F.col("event_type").alias("state"))


_TOK = "unnest(regexp_extract_all(lower(t), '[\\p{L}\\p{N}_]+'))"


@query(f"WITH {_D} SELECT term, count(*) AS n FROM (SELECT {_TOK} AS term FROM d) GROUP BY term")
def token_freq(spark, sf_dir):
    return texts(spark, sf_dir).select(F.explode(tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query(f"WITH {_D}, w AS (SELECT id, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]+') AS w FROM d), p AS (SELECT w[i] || ' ' || w[i + 1] AS bigram FROM (SELECT w, unnest(range(1, len(w))) AS i FROM w)) SELECT bigram, count(*) AS n FROM p GROUP BY bigram HAVING count(*) >= 2")
def bigram_freq(spark, sf_dir):
    w = texts(spark, sf_dir).select(tokens(F.col("text")).alias("w"))
    pairs = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.size("w")), lambda a, b: F.concat(a, F.lit(" "), b))
    return w.select(F.explode(pairs).alias("bigram")).groupBy("bigram").agg(F.count("*").alias("n")).where("n >= 2")


_TF = "WITH t AS (SELECT source AS id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+')) AS term FROM documents), n AS (SELECT id, term, count(*) AS n FROM t WHERE length(term) >= 3 GROUP BY 1, 2), s AS (SELECT id, sum(n) AS total FROM n GROUP BY 1), f AS (SELECT term, count(*) AS df FROM n GROUP BY 1), v AS (SELECT n.id, n.term, f.df, n.n / s.total * (ln((1 + (SELECT count(*) FROM s)) / (1 + f.df)) + 1) AS w FROM n JOIN s USING (id) JOIN f USING (term))"


@query(_TF + " SELECT term, df FROM f")
def doc_frequency(spark, sf_dir):
    return _terms(spark, sf_dir).distinct().groupBy("term").agg(F.count("*").alias("df"))


@query(_TF + " SELECT id, term, round(w, 8) AS w FROM v")
def tfidf_weights(spark, sf_dir):
    return library.tfidf(_terms(spark, sf_dir)).select("id", "term", F.round("w", 8).alias("w"))


@query(_TF + ", m AS (SELECT id, sqrt(sum(w * w)) AS norm FROM v GROUP BY id) SELECT a.id AS input_id, b.id AS book_id, round(sum(a.w * b.w) / (max(x.norm) * max(y.norm)), 4) AS concept_score FROM v a JOIN v b USING (term) JOIN m x ON x.id = a.id JOIN m y ON y.id = b.id WHERE a.id <> b.id GROUP BY 1, 2")
def concept_cosine(spark, sf_dir):
    return library.cosine(library.tfidf(_terms(spark, sf_dir)))


@query(f"WITH {_D} SELECT id, CAST((length(t) - length(replace(t, 'tion', ''))) / 4 AS INT) AS n FROM d")
def mention_counts(spark, sf_dir):
    return texts(spark, sf_dir).select("id", occurrences(F.col("text"), F.lit("tion")).alias("n"))


_HEADINGS = f"h AS (SELECT id, regexp_extract_all(text, '(?m)^(#{{1,6}})\\s+(.+)$', 1) AS l, regexp_extract_all(text, '(?m)^(#{{1,6}})\\s+(.+)$', 2) AS m FROM {_V}), e AS (SELECT id, k - 1 AS ord, length(l[k]) AS level, trim(m[k]) AS title FROM (SELECT id, l, m, unnest(range(1, len(l) + 1)) AS k FROM h))"


@query(f"WITH {_HEADINGS} SELECT CAST(e.id AS BIGINT) AS id, e.ord, e.level, e.title, (SELECT max(p.ord) FROM e p WHERE p.id = e.id AND p.ord < e.ord AND p.level < e.level) AS parent_ord FROM e UNION ALL SELECT id, 0, 1, '(No headings detected)', NULL FROM h WHERE len(l) = 0")
def heading_parents(spark, sf_dir):
    return structure.sections(spark.createDataFrame(TEXTS, "id long, text string")).select("id", "ord", "level", "title", "parent_ord")


def _sections_sql() -> str:
    """CTEs h (headings) and s (sections) of p."""
    h = _matches_sql("p", "(?m)^(#{1,6})\\s+(.+)$", 2)
    e = f"SELECT id, t, k - 1 AS ord, length(g1) AS level, {_strip('g2')} AS title, start, coalesce(lead(start) OVER (PARTITION BY id ORDER BY k), length(t)) AS stop FROM h"
    none = "SELECT id, t, 0, 1, '(No headings detected)', 0, length(t) FROM p WHERE id NOT IN (SELECT id FROM h)"
    return f"h AS ({h}), e AS ({e} UNION ALL {none}), s AS (SELECT id, ord, level, title, start, stop, substring(t, CAST(start AS INT) + 1, CAST(stop - start AS INT)) AS t, (SELECT max(x.ord) FROM e x WHERE x.id = e.id AND x.ord < e.ord AND x.level < e.level) AS parent_ord FROM e)"


@query(f"WITH {_P}, {_sections_sql()} SELECT id, ord, level, title, start, stop AS \"end\", len(regexp_extract_all(t, '\\S+')) AS word_count, parent_ord FROM s")
def section_spans(spark, sf_dir):
    return structure.sections(marked(spark, sf_dir))


@query(f"WITH {_P}, {_sections_sql()} SELECT p.id, (SELECT count(*) FROM h WHERE h.id = p.id) AS heading_count, coalesce((SELECT max(length(g1)) FROM h WHERE h.id = p.id), 1) AS max_depth FROM p")
def structure_summary(spark, sf_dir):
    return structure.summary(marked(spark, sf_dir))


def _chapters_sql() -> str:
    """The four rules, the first with a result."""
    ends = lambda src: f"SELECT *, coalesce(lead(start) OVER (PARTITION BY id ORDER BY k), length(t)) AS fin FROM ({src})"
    first = lambda *g: "CASE " + " ".join(f"WHEN coalesce({a}, '') <> '' THEN {b}" for a, b in g) + " ELSE '' END"
    piece = _strip("substring(t, CAST(start AS INT) + 1, CAST(fin - start AS INT))")
    digits, name = first(("g2", "g2"), ("g4", "g4"), ("g6", "g6")), _strip(first(("g2", "g3"), ("g4", "g5"), ("g6", "g7")))
    number = f"CASE WHEN regexp_matches({digits}, '^\\d+$') THEN TRY_CAST({digits} AS INT) ELSE k END"
    skipped = ", ".join(f"'{x}'" for x in structure.SKIPPED)
    line = f"substring(regexp_replace({_strip('string_split(x, chr(10))[1]')}, '^#+\\s*', ''), 1, 80)"
    ctes = [
        _D,
        f"n AS ({ends(_matches_sql('d', _re2(structure.NUMBERED), 7))})",
        f"h AS ({ends(_matches_sql('d', _re2(structure.TOP), 1))})",
        f"a AS (SELECT id, k, {number} AS number, {name} AS title, length(g1) AS level, start, fin, {piece} AS x, ':ch' || ({number}) || ':' || ({name}) AS seed FROM n)",
        f"u AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) AS r, {_strip('g1')} AS title FROM h WHERE lower({_strip('g1')}) NOT IN ({skipped}))",
        f"b AS (SELECT id, r AS k, r AS number, title, 1 AS level, start, fin, {piece} AS x, ':h:' || title AS seed FROM u)",
        f"l AS (SELECT id, {_strip('x')} AS x, row_number() OVER (PARTITION BY id ORDER BY j) AS k FROM (SELECT id, unnest(q) AS x, unnest(range(1, len(q) + 1)) AS j FROM (SELECT id, regexp_split_to_array(t, '\\n-{{3,}}\\n') AS q FROM d)) WHERE len(regexp_extract_all(x, '\\S+')) > 100)".replace("{{3,}}", "{3,}"),
        f"m AS (SELECT *, CASE WHEN {line} <> '' THEN {line} ELSE 'Section ' || k END AS title FROM l)",
        "c AS (SELECT id, k, k AS number, title, 1 AS level, 0 AS start, length(x) AS fin, x, ':sec' || k || ':' || title AS seed FROM m)",
        "w AS (SELECT id, 1 AS k, 1 AS number, 'Full Document' AS title, 1 AS level, 0 AS start, length(t) AS fin, t AS x, ':full' AS seed FROM d)",
        "o AS (SELECT id, CASE WHEN (SELECT count(*) FROM n WHERE n.id = d.id) >= 2 THEN 1 WHEN (SELECT count(*) FROM h WHERE h.id = d.id) >= 2 AND EXISTS (SELECT 1 FROM u WHERE u.id = d.id) THEN 2 WHEN EXISTS (SELECT 1 FROM c WHERE c.id = d.id) THEN 3 ELSE 4 END AS rule FROM d)",
        "z AS (" + " UNION ALL ".join(f"SELECT {x}.* FROM {x} JOIN o ON o.id = {x}.id AND o.rule = {r}" for r, x in enumerate("abcw", 1)) + ")",
    ]
    subs = "array_to_string(regexp_extract_all(x, '(?m)^#{2,3}\\s+(.+)$', 1)[1:20], '|')"
    return f"WITH {', '.join(ctes)} SELECT CAST(id AS VARCHAR) AS book_id, substring(sha256(CAST(id AS VARCHAR) || seed), 1, 12) AS id, number, title, level, start AS start_index, fin AS end_index, len(regexp_extract_all(x, '\\S+')) AS word_count, x AS full_text, {subs} AS sub_headings FROM z QUALIFY row_number() OVER (PARTITION BY id, seed ORDER BY k DESC) = 1"


@query(_chapters_sql())
def chapters(spark, sf_dir):
    return structure.chapters(texts(spark, sf_dir)).withColumn("sub_headings", F.array_join("sub_headings", "|"))


def _count_sql(name: str, pattern: str) -> str:
    if name == "inline_math":  # without look-around: runs of two and more dollars are hidden first
        return f"len(regexp_extract_all({_LONE}, '\\$[^$\\n\\x01]+?\\$'))"
    return f"len(regexp_extract_all(t, '{_re2(pattern)}'))"


_LONE = "regexp_replace(regexp_replace(t, '\\$\\$', chr(1) || chr(1), 'g'), '\\x01\\$', chr(1) || chr(1), 'g')"


@query(f"WITH {_D} SELECT id, len(regexp_extract_all(t, '\\S+')) AS word_count, " + ", ".join(f"CASE WHEN regexp_matches(t, '\\S') THEN {_count_sql(k, p)} ELSE 0 END AS {k}_count" for k, p in density.COUNTS) + " FROM d")
def density_counts(spark, sf_dir):
    n = dealt(texts(spark, sf_dir)).select("id", density.counts(F.col("text")).alias("n"))
    return n.select("id", F.col("n.words").alias("word_count"), *(F.col(f"n.{k}").alias(f"{k}_count") for k, _ in density.COUNTS))


def _stats_sql(source: str, keys: str) -> str:
    """keys, the statistics and the labels of source(keys.., t)."""
    counts = ", ".join(f"CASE WHEN words > 0 THEN {_count_sql(k, p)} ELSE 0 END AS n_{k}" for k, p in density.COUNTS)
    paras = f"CASE WHEN words > 0 THEN greatest(1, len(list_filter(regexp_split_to_array(t, '\\n\\s*\\n'), lambda x: {_strip('x')} <> ''))) ELSE 0 END"
    base = f"SELECT *, {paras} AS paras, {counts} FROM (SELECT *, len(regexp_extract_all(t, '\\S+')) AS words FROM {source})"
    per = lambda x: f"coalesce(CAST({x} AS DOUBLE) / nullif(paras, 0), 0.0)"
    own = {"word_count": "words", "para_count": "paras", "math_per_para": per("n_display_math + n_inline_math"), "code_per_para": per("n_code")}
    own |= {f"{k}_count": f"n_{k}" for k, _ in density.COUNTS if k != "algorithm"}
    own |= {f"{k}_ratio": per(f"n_{k}") for k in ("example", "comparison", "algorithm", "definition", "bold", "list", "proof", "problem")}
    assert set(own) == set(density.NAMES)
    stats = ", ".join(f"{v} AS {k}" for k, v in own.items())
    steps = lambda *r: "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in r) + " ELSE 0.0 END"
    score = {
        "concept-dense": steps(("definition_ratio >= 0.3", 2.0)) + " + " + steps(("bold_ratio >= 0.5", 2.0), ("bold_ratio >= 0.2", 1.0)),
        "math-heavy": steps(("math_per_para >= 1.0", 3.0), ("math_per_para >= 0.3", 1.5)) + " + " + steps(("display_math_count >= 3", 2.0)),
        "example-rich": steps(("example_ratio >= 0.3", 2.0), ("example_ratio >= 0.15", 1.0)),
        "implementation-focused": steps(("code_per_para >= 0.3", 3.0), ("code_count >= 2", 1.5)) + " + " + steps(("algorithm_ratio >= 0.2", 1.5)),
        "comparison": steps(("comparison_ratio >= 0.3", 2.5), ("comparison_ratio >= 0.15", 1.0)),
        "proof-heavy": steps(("proof_ratio >= 0.3", 3.0), ("proof_ratio >= 0.15", 1.5)) + " + " + steps(("proof_count >= 5", 1.0)),
        "problem-set": steps(("problem_ratio >= 0.3", 3.0), ("problem_ratio >= 0.15", 1.5)) + " + " + steps(("problem_count >= 5", 1.5)),
        "introductory": steps(("word_count < 300", 1.0)) + " + " + steps(("greatest(example_ratio, comparison_ratio, algorithm_ratio, definition_ratio, bold_ratio, list_ratio, proof_ratio, problem_ratio) < 0.1", 2.0)),
    }
    pairs = ", ".join(f"{{'s': -CAST({score[k]} AS DOUBLE), 'i': {i}, 'k': '{k}'}}" for i, k in enumerate(density.LABELS))
    types = f"array_to_string(list_transform(list_sort(list_filter([{pairs}], lambda x: x.s <= -1.0)), lambda x: x.k), ',')"
    return f"SELECT {keys}, {', '.join(density.NAMES)}, CASE {types} WHEN '' THEN 'general' ELSE {types} END AS types FROM (SELECT {keys}, {stats} FROM ({base}))"


@query(f"WITH {_D}, {_P}, a AS (SELECT * FROM p UNION ALL SELECT * FROM d) {_stats_sql('a', 'id')}")
def density_stats(spark, sf_dir):
    return density.analyze(marked(spark, sf_dir).union(dealt(texts(spark, sf_dir)))).withColumn("types", F.array_join("types", ","))


@query(f"WITH {_P}, {_sections_sql()}, w AS (SELECT *, len(regexp_extract_all(t, '\\S+')) AS n FROM s), k AS (SELECT id, ord, title, t FROM w WHERE n >= 20 AND (parent_ord IS NULL OR EXISTS (SELECT 1 FROM w u WHERE u.id = w.id AND u.ord = w.parent_ord AND u.parent_ord IS NULL AND u.n >= 20))) {_stats_sql('k', 'id, ord, title')}")
def density_sections(spark, sf_dir):
    return density.by_section(marked(spark, sf_dir)).withColumn("types", F.array_join("types", ","))


def _pairs(name: str, step, pattern: str, term: int, definition: int | None, more: str = ""):
    noise = ", ".join(f"'{w}'" for w in concepts.NOISE)
    p = _re2(pattern)
    second = f"regexp_extract_all(t, '{p}', {definition})" if definition else "NULL"
    trim = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    sql = f"WITH {_D}, m AS (SELECT id, regexp_extract_all(t, '{p}', {term}) AS a, {second} AS b FROM d), r AS (SELECT id, {trim('a[k]')} AS name, {trim('b[k]')} AS definition FROM (SELECT id, a, b, unnest(range(1, len(a) + 1)) AS k FROM m)) SELECT id, name, definition FROM r WHERE length(name) >= 3 AND lower(name) NOT IN ({noise}) AND NOT regexp_matches(name, '^\\d+$'){more}"

    def run(spark, sf_dir):
        return texts(spark, sf_dir).select("id", F.explode(step(F.col("text"))).alias("x")).select("id", "x.name", F.col("x.def").alias("definition"))

    run.__name__ = name
    query(sql)(run)


_pairs("concept_definition", concepts.definitions, concepts.DEFINITION, 1, 2)
_pairs("concept_parenthetical", concepts.parentheticals, concepts.PARENTHETICAL, 1, 2, " AND definition <> '' AND NOT regexp_matches(definition, '^\\d')")
_pairs("concept_acronym", concepts.expansions, concepts.EXPANSION, 1, 2)


_QUOTED = ", ".join(f"'{w}'" for w in concepts.NOISE)
_KEPT = f"length(name) >= 3 AND lower(name) NOT IN ({_QUOTED}) AND NOT regexp_matches(name, '^\\d+$')"


def _step(name: str, step, sql: str | None = None):
    def run(spark, sf_dir):
        return texts(spark, sf_dir).select("id", F.explode(step(F.col("text"))).alias("x")).select("id", "x.name", F.col("x.def").alias("definition"))

    run.__name__ = name
    query(sql and f"WITH {_D}, r AS ({sql}) SELECT id, name, definition FROM r WHERE {_KEPT}")(run)


def _heading_sql(k: str = "") -> str:
    clean = f"regexp_replace(regexp_replace({_strip('h')}, '^[\\d.]+\\s*', ''), '(?i)^(?:Chapter|Part|Section)\\s+\\d+\\s*[:.\\-]*\\s*', '')"
    return f"SELECT id, {_strip(clean)} AS name, '' AS definition{k and ', k'} FROM (SELECT id, h[k] AS h, k FROM (SELECT id, h, unnest(range(1, len(h) + 1)) AS k FROM (SELECT id, regexp_extract_all(t, '(?m)^(#{{1,6}})\\s+(.+)$', 2) AS h FROM d)))"


def _either_sql(a: str, b: str) -> str:
    return f"CASE WHEN {a} <> '' THEN {a} ELSE {b} END"


#: RE2 takes only ASCII letters for parts of words, so others become digits before words are sought.
_ASCII = "regexp_replace(t, '[À-ÖØ-öø-ʯͰ-ϿЀ-ӿ]', '0', 'g')"


def _repeated_sql(pattern: str, more: str = "TRUE") -> str:
    return f"SELECT id, name, '' AS definition FROM (SELECT id, unnest(regexp_extract_all({_ASCII}, '{pattern}', 1)) AS name FROM d) WHERE {more} GROUP BY id, name HAVING count(*) >= 2"


_BOLD_SQL = f"SELECT id, {_strip('n')} AS name, {_strip(chr(114) + 'egexp_extract(substring(t, CAST(stop AS INT) + 1, 300), ' + chr(39) + '^' + chr(92) + 's*[:—–' + chr(92) + '-]+' + chr(92) + 's*(.+?)(?:' + chr(92) + '.|' + chr(92) + 'n?' + chr(92) + 'z)' + chr(39) + ', 1)')} AS definition FROM (SELECT *, {_either_sql('g1', 'g2')} AS n FROM ({_matches_sql('d', _re2(concepts.BOLD), 2)})) WHERE length(n) < 60"
_LISTED_SQL = f"SELECT id, {_strip(_either_sql('g1', 'g2'))} AS name, {_strip('g3')} AS definition, k FROM ({_matches_sql('d', _re2(concepts.LISTED), 3)})"
_step("concept_bold", concepts.bold, _BOLD_SQL)
_step("concept_list", concepts.list_definitions, _LISTED_SQL)
_step("concept_hyphenated", concepts.hyphenated, _repeated_sql(concepts.HYPHENATED))
_step("concept_heading", concepts.heading_terms, _heading_sql())
_step("concept_theorem", concepts.theorem_blocks)
_step("concept_bare_acronym", concepts.acronyms, _repeated_sql(concepts.ACRONYM, "name NOT IN (" + ", ".join(f"'{x}'" for x in concepts.COMMON_ACRONYMS) + ")"))


def _first_use_sql() -> str:
    noise = ", ".join(f"'{w}'" for w in concepts.FIRST_USE_NOISE)
    each = f"SELECT id, t, {_strip('m[k]')} AS name, k FROM (SELECT id, t, m, unnest(range(1, len(m) + 1)) AS k FROM (SELECT id, lower(t) AS t, regexp_extract_all({_ASCII}, '{concepts.FIRST_USE}', 1) AS m FROM d))"
    kept = f"SELECT *, lower(name) AS key FROM ({each}) WHERE lower(regexp_extract(name, '^\\S+')) NOT IN ({noise}) AND (length(t) - length(replace(t, lower(name), ''))) / length(name) >= 2"
    return f"SELECT id, name, '' AS definition FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) AS r FROM (SELECT * FROM ({kept}) QUALIFY row_number() OVER (PARTITION BY id, key ORDER BY k) = 1)) WHERE r <= 10"


_step("concept_first_use", lambda t: concepts.first_uses(t, F.array().cast("array<string>")), _first_use_sql())


def _bigrams_sql() -> str:
    common = ", ".join(f"'{x}'" for x in concepts.COMMON_PHRASES)
    pair = f"SELECT id, i, w[i] AS a, w[i + 1] AS b FROM (SELECT id, w, unnest(range(1, len(w))) AS i FROM (SELECT id, list_transform(regexp_extract_all({_ASCII}, '\\b[A-Za-z]{{2,}}\\b'), lambda x: lower(x)) AS w FROM d))"
    counted = f"SELECT id, a, b, count(*) AS n, min(i) AS place FROM ({pair}) WHERE a NOT IN ({_QUOTED}) AND b NOT IN ({_QUOTED}) AND length(a) + length(b) > 4 GROUP BY id, a, b HAVING count(*) >= 2"
    cap = lambda x: f"upper({x}[1]) || {x}[2:]"
    return f"WITH {_D} SELECT id, a || ' ' || b AS key, {cap('a')} || ' ' || {cap('b')} AS name FROM (SELECT * FROM ({counted}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, place) <= 40) WHERE a || ' ' || b NOT IN ({common})"


@query(_bigrams_sql())
def bigram_top(spark, sf_dir):
    return texts(spark, sf_dir).select("id", F.explode(concepts.bigrams(F.col("text"))).alias("x")).select("id", "x.key", "x.name")


def _merged_sql() -> str:
    """Definitions, parentheses, list entries and headings, merged by lower-cased name."""
    pair = lambda p, n, extra: f"SELECT id, {_strip('g1')} AS name, {_strip('g2')} AS definition, k, {n} AS step, '{extra}' AS source FROM ({_matches_sql('d', _re2(p), 2)})"
    steps = [
        pair(concepts.DEFINITION, 0, "definition"),
        f"SELECT * FROM ({pair(concepts.PARENTHETICAL, 1, 'parenthetical')}) WHERE definition <> '' AND NOT regexp_matches(definition, '^\\d')",
        f"SELECT *, 2, 'list_definition' FROM ({_LISTED_SQL})",
        f"SELECT *, 3, 'heading' FROM ({_heading_sql('k')})",
    ]
    each = " UNION ALL ".join(steps)
    return f"WITH {_D}, c AS (SELECT *, lower(name) AS key, row_number() OVER (PARTITION BY id ORDER BY step, k) AS seq FROM ({each}) WHERE {_KEPT}) SELECT id, key, arg_min(name, seq) AS name, coalesce(arg_min(definition, seq) FILTER (definition <> ''), '') AS definition, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM c GROUP BY id, key"


@query(_merged_sql())
def concept_merged(spark, sf_dir):
    t = F.col("text")
    found = concepts.merged(F.concat(concepts.definitions(t), concepts.parentheticals(t), concepts.list_definitions(t), concepts.heading_terms(t)))
    return texts(spark, sf_dir).select("id", F.explode(found).alias("x")).select("id", "x.key", "x.name", "x.definition", F.array_join("x.sources", ",").alias("sources"))


@query()
def concept_ranked(spark, sf_dir):
    return concepts.extract(marked(spark, sf_dir))


@query()
def formula_unique(spark, sf_dir):
    return formulas.extract(texts(spark, sf_dir))


_SHOWN = f"SELECT id, t, k, {_strip('g1')} AS body, start, stop FROM ({_matches_sql('d', '(?s)' + chr(92) + '$' + chr(92) + '$(.+?)' + chr(92) + '$' + chr(92) + '$', 1)})"
_FIRST = "row_number() OVER (PARTITION BY id, regexp_replace(body, '\\s+', '', 'g') ORDER BY start) = 1"
_TRIVIAL = "regexp_matches(body, '^\\\\?[a-zA-Z]$|^\\d+$')"


def _formulas(spark, sf_dir, kind: str) -> DataFrame:
    return formulas.extract(texts(spark, sf_dir)).where(F.col("type") == kind)


@query(f"WITH {_D}, x AS ({_SHOWN}) SELECT id, '$$' || body || '$$' AS latex, start AS position FROM x WHERE length(body) >= 2 AND NOT {_TRIVIAL} QUALIFY {_FIRST}")
def formula_display(spark, sf_dir):
    return _formulas(spark, sf_dir, "display").select("id", "latex", "position")


_HIDDEN = f"l AS (SELECT id, {_LONE} AS t FROM d)"


@query(f"WITH {_D}, {_HIDDEN}, x AS ({_SHOWN}), y AS (SELECT id, {_strip('g1')} AS body, start FROM ({_matches_sql('l', chr(92) + '$([^$' + chr(92) + 'n' + chr(92) + 'x01]+?)' + chr(92) + '$', 1)})) SELECT id, '$' || body || '$' AS latex, start AS position FROM y WHERE length(body) >= 3 AND regexp_matches(body, '[=<>+\\-*/_^]|\\\\[a-z]+|\\{{.*\\}}') AND NOT EXISTS (SELECT 1 FROM x WHERE x.id = y.id AND x.start <= y.start AND y.start < x.stop) QUALIFY {_FIRST}")
def formula_inline(spark, sf_dir):
    return _formulas(spark, sf_dir, "inline").select("id", "latex", "position")


def _variables_sql() -> str:
    low = "greatest(0, start - 200)"
    window = f"substring(t, CAST({low} AS INT) + 1, CAST(least(length(t), stop + 400) - {low} AS INT))"
    shown = f"SELECT * FROM x WHERE length(body) >= 2 AND NOT {_TRIVIAL} QUALIFY {_FIRST}"
    v, q = (p.replace("'", "''") for p in (formulas.VARIABLE, formulas.QUANTIFIER))
    told = f"SELECT id, position, {_strip('a[i]')} AS symbol, {_strip('b[i]')} AS meaning FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM (SELECT id, position, regexp_extract_all(w, '{v}', 1) AS a, regexp_extract_all(w, '{v}', 2) AS b FROM w))"
    counted = f"SELECT id, position, {_strip('s')}, 'quantified variable' FROM (SELECT id, position, unnest(regexp_extract_all(w, '{q}', 1)) AS s FROM w)"
    return f"WITH {_D}, x AS ({_SHOWN}), w AS (SELECT id, start AS position, {window} AS w FROM ({shown})) {told} UNION ALL {counted}"


@query(_variables_sql())
def formula_variables(spark, sf_dir):
    """Variables of display formulas."""
    return _formulas(spark, sf_dir, "display").select("id", "position", F.explode("variables").alias("v")).select("id", "position", "v.symbol", "v.meaning")


@query()
def formula_context(spark, sf_dir):
    return formulas.extract(texts(spark, sf_dir)).select("id", "position", "context_before", "context_after")


_CROSS = graph.CROSS.replace("'", "''")


@query(f"WITH {_D} SELECT id, regexp_extract_all(t, '{_CROSS}', 0)[k] AS text, regexp_extract_all(t, '{_CROSS}', 1)[k] AS target FROM (SELECT id, t, unnest(range(1, len(regexp_extract_all(t, '{_CROSS}', 0)) + 1)) AS k FROM d) UNION ALL SELECT id, unnest(regexp_extract_all(t, '{graph.BACK}')), 'earlier_content' FROM d")
def cross_refs(spark, sf_dir):
    return graph.references(texts(spark, sf_dir)).select("id", "text", "target")


@query()
def edges_unique(spark, sf_dir):
    return graph.edges(concepts.with_concepts(marked(spark, sf_dir)))


@query()
def concept_clusters(spark, sf_dir):
    return graph.clusters(concepts.with_concepts(marked(spark, sf_dir))).withColumn("members", F.array_join("members", ","))


def _given(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """df with the same concepts for every text."""
    return df.withColumn("concepts", F.array(*(F.struct(F.lit(n).alias("name")) for n in names)))


def _find_sql(term: str) -> str:
    """The name in NAMES that a term stands for, or null."""
    low = f"lower({_strip(term)})"
    exact = " ".join(f"WHEN {low} = '{n.lower()}' THEN '{n}'" for n in NAMES)
    part = " ".join(f"WHEN contains('{n.lower()}', {low}) OR contains({low}, '{n.lower()}') THEN '{n}'" for n in NAMES)
    return f"(CASE {exact} {part} END)"


def _unique_sql(each: str, kind: str) -> str:
    """each(id, src, dst, k, j): the first of each undirected pair."""
    return f"SELECT id, src, dst, '{kind}' AS type FROM ({each}) WHERE src IS NOT NULL AND dst IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id, least(src, dst), greatest(src, dst) ORDER BY k, j) = 1"


def _compared_sql() -> str:
    low = "greatest(0, start - 200)"
    near = f"lower(substring(t, CAST({low} AS INT) + 1, CAST(least(length(t), stop + 200) - {low} AS INT)))"
    listed = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"
    m = f"SELECT *, CASE WHEN g1 <> '' THEN {_find_sql('g1')} END AS own, {near} AS near FROM ({_matches_sql('p', graph.COMPARISON, 3)})"
    told = f"SELECT id, own AS src, n AS dst, k, j FROM (SELECT id, own, near, k, unnest({listed}) AS n, unnest(range(1, {len(NAMES) + 1})) AS j FROM m WHERE own IS NOT NULL) WHERE n <> own AND contains(near, lower(n))"
    pair = f"SELECT id, {_find_sql('g2')} AS src, {_find_sql('g3')} AS dst, k, 0 AS j FROM m WHERE coalesce(g1, '') = ''"
    return f"WITH {_P}, m AS ({m}) {_unique_sql(f'{told} UNION ALL {pair}', 'compared_with')}"


def _listing_sql(pattern: str, kind: str) -> str:
    m = f"SELECT id, k, {_find_sql('g1')} AS head, regexp_split_to_array({_strip('g2')}, ',\\s*|\\s+and\\s+|\\s+or\\s+|;\\s*') AS items FROM ({_matches_sql('p', pattern, 2)})"
    i = f"SELECT id, k, head, j, {_strip('items[j]')} AS item FROM (SELECT *, unnest(range(1, len(items) + 1)) AS j FROM ({m}))"
    tail = "regexp_replace(item, '^\\*+|\\*+$', '', 'g')"
    return f"WITH {_P} {_unique_sql(f'SELECT id, {_find_sql(tail)} AS src, head AS dst, k, j FROM ({i}) WHERE item <> {chr(39) * 2}', kind)}"


_FOLLOWS = f"SELECT id, {_find_sql('title')} AS src, {_find_sql('before')} AS dst, ord AS k, 0 AS j FROM (SELECT s.*, lag(s.title) OVER (PARTITION BY s.id, s.parent_ord ORDER BY s.ord) AS before FROM s JOIN s u ON u.id = s.id AND u.ord = s.parent_ord WHERE u.parent_ord IS NULL) WHERE before IS NOT NULL"


def _edges(name: str, kind: str, sql: str):
    def run(spark, sf_dir):
        return graph.edges(_given(marked(spark, sf_dir), NAMES)).where(F.col("type") == kind).select("id", "src", "dst", "type")

    run.__name__ = name
    query(sql)(run)


_edges("edges_comparison", "compared_with", _compared_sql())
_edges("edges_part_of", "part_of", _listing_sql(graph.CONTAINS, "part_of"))
_edges("edges_example_of", "example_of", _listing_sql(graph.TYPES, "example_of"))
_edges("edges_depends_on", "depends_on", f"WITH {_P}, {_sections_sql()} {_unique_sql(_FOLLOWS, 'depends_on')}")


def _pairs_sql() -> str:
    """Chained names of the paragraphs of d."""
    here = " ".join(f"UNION ALL SELECT id, k, '{n}' AS n, {r} AS r FROM g WHERE " + (f"contains(lower(x), '{n}')" if " " in n else f"list_contains(regexp_extract_all(lower(x), '[\\p{{L}}\\p{{N}}_]+'), '{n}')") for r, n in enumerate(COMMON, 1))[10:]
    return f"{_D}, g AS (SELECT id, k, x FROM (SELECT id, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS k FROM (SELECT id, regexp_split_to_array(t, '\\n\\s*\\n') AS l FROM d)) WHERE len(regexp_extract_all(x, '\\S+')) >= 5), f AS ({here}), q AS (SELECT DISTINCT id, a, b FROM (SELECT id, n AS a, lead(n) OVER (PARTITION BY id, k ORDER BY n) AS b FROM f) WHERE b IS NOT NULL)"


@query(f"WITH {_pairs_sql()} SELECT id, a, b FROM q")
def cooccurrence_pairs(spark, sf_dir):
    return graph.cooccurrence(_given(texts(spark, sf_dir), COMMON))


_RANK = "CASE n " + " ".join(f"WHEN '{n}' THEN {r}" for r, n in enumerate(COMMON, 1)) + " END"


@query(f"WITH RECURSIVE {_pairs_sql()}, u AS (SELECT id, a, b FROM q UNION SELECT id, b, a FROM q), r AS (SELECT id, a, b FROM u UNION SELECT r.id, r.a, u.b FROM r JOIN u ON u.id = r.id AND u.a = r.b), c AS (SELECT id, a AS n, min(b) AS root FROM r GROUP BY id, a), m AS (SELECT id, root, string_agg(n, ',' ORDER BY n) AS members, count(*) AS size, min({_RANK}) AS best FROM c GROUP BY id, root) SELECT id, rank, members FROM (SELECT id, members, row_number() OVER (PARTITION BY id ORDER BY size DESC, best) AS rank FROM m) WHERE rank <= 10")
def cooccurrence_clusters(spark, sf_dir):
    return graph.clusters(_given(texts(spark, sf_dir), COMMON)).withColumn("members", F.array_join("members", ","))


_HEAD = "lower(substring(t, 1, 10000))"


def _subject_sql(title: str = "substring(t, 1, 40)") -> str:
    score = lambda keys: " + ".join(f"(length(s) - length(replace(s, '{k}', ''))) / {len(k)}" for k in keys)
    rows = " UNION ALL ".join(f"SELECT id, {k} AS o, '{n}' AS subject, {score(keys)} AS n FROM x" for k, (n, keys) in enumerate(metadata.SUBJECTS.items()))
    return f"WITH {_D}, x AS (SELECT id, repeat(lower({title}) || ' ', 5) || {_HEAD} AS s FROM d), y AS ({rows}), z AS (SELECT id, subject, n, row_number() OVER (PARTITION BY id ORDER BY n DESC, o) AS r FROM y) SELECT id, CASE WHEN n > 0 THEN subject ELSE '' END AS subject FROM z WHERE r = 1"


@query(_subject_sql())
def meta_subject(spark, sf_dir):
    return texts(spark, sf_dir).select("id", metadata.subject(F.substring("text", 1, 40), F.col("text")).alias("subject"))


@query(f"WITH {_D}, f AS (SELECT id, substring(t, 1, 3000) AS t FROM d) SELECT id, CASE regexp_extract(t, '{metadata.EDITION}', 1) WHEN '' THEN '' WHEN '1' THEN '1st' WHEN '2' THEN '2nd' WHEN '3' THEN '3rd' ELSE regexp_extract(t, '{metadata.EDITION}', 1) || 'th' END AS edition, CASE WHEN regexp_extract(t, '{metadata.COPYRIGHT}', 1) <> '' THEN regexp_extract(t, '{metadata.COPYRIGHT}', 1) ELSE coalesce(list_max(regexp_extract_all(substring(t, 1, 2000), '{metadata.YEAR}', 1)), '') END AS year FROM f")
def meta_edition_year(spark, sf_dir):
    first = F.substring("text", 1, 3000)
    return texts(spark, sf_dir).select("id", metadata.edition(first).alias("edition"), metadata.year(first).alias("year"))


def _author_sql() -> str:
    name = lambda p: _strip(f"regexp_extract(substring(f, 1, 1000), '{_re2(p)}', 1)")
    ok = lambda n: f"CASE WHEN {n} <> '' AND lower({n}) NOT IN ({', '.join(repr(x) for x in metadata.NOT_AUTHORS)}) THEN {n} END"
    holder = _strip(f"regexp_extract(f, '{metadata.COPYRIGHT}', 2)")
    return f"WITH {_D} SELECT id, coalesce({ok('a')}, {ok('b')}, {holder}) AS author FROM (SELECT *, {name(metadata.BY_AUTHOR)} AS a, {name(metadata.NAME_LINE)} AS b FROM (SELECT id, substring(t, 1, 3000) AS f FROM d))"


@query(_author_sql())
def meta_author(spark, sf_dir):
    return texts(spark, sf_dir).select("id", metadata.author(F.substring("text", 1, 3000)).alias("author"))


def _language_sql() -> str:
    head = "regexp_replace(regexp_replace(substring(t, 1, 5000), '(?s)\\$\\$.*?\\$\\$|\\$.*?\\$|```.*?```', '', 'g'), '[#*_\\[\\](){}|>]', '', 'g')"
    counts = ", ".join(f"len(regexp_extract_all(h, '{p}')) AS {n}" for n, p in (("a", metadata.ARABIC), ("c", metadata.CJK), ("y", metadata.CYRILLIC), ("x", metadata.LATIN)))
    share = lambda n: f"coalesce(CAST({n} AS DOUBLE) / nullif(a + c + y + x, 0), 0.0) > 0.3"
    return f"WITH {_D} SELECT id, CASE WHEN {share('a')} THEN 'ar' WHEN {share('c')} THEN 'zh' WHEN {share('y')} THEN 'ru' ELSE 'en' END AS language FROM (SELECT id, {counts} FROM (SELECT id, {head} AS h FROM d))"


@query(_language_sql())
def meta_language(spark, sf_dir):
    return texts(spark, sf_dir).select("id", metadata.language(F.col("text")).alias("language"))


@query()
def meta_all(spark, sf_dir):
    return metadata.extract(texts(spark, sf_dir).withColumn("title", F.substring("text", 1, 40)))


@query()
def library_match(spark, sf_dir):
    books, own = _books(spark, sf_dir)
    own = own.withColumn("terms", F.array_distinct(F.filter(tokens(F.col("full_text")), lambda w: F.length(w) >= 3)))
    return library.match(books, books, own.select("book_id", "number", "title", "terms"))


@query(f"SELECT id, {_WORDS} AS words, CAST(floor(length(text) / 4) AS BIGINT) AS tokens FROM (SELECT substring(sha256({_ID} || ':ch:' || doc_id), 1, 12) AS id, coalesce(text, '') AS text FROM documents)")
def prompt_stats(spark, sf_dir):
    return prompts.stats(_books(spark, sf_dir)[1])


@query()
def prompt_full(spark, sf_dir):
    d = marked(spark, sf_dir).select(F.col("id").cast("string").alias("id"), F.lit("b1").alias("book_id"), F.col("id").alias("number"), F.substring("text", 1, 30).alias("title"), F.col("text").alias("full_text"))
    books = spark.createDataFrame([("b1", "Fixtures", "Jane Miller", 7)], "id string, title string, author string, total_chapters int")
    return prompts.assemble(d, books)


@query(f"WITH {_D} SELECT substring(sha256('in/book_' || id || '.pdf'), 1, 12) AS id, 'Book ' || id AS title, 'book_' || id || '.pdf' AS filename, 1 AS total_pages, CASE WHEN regexp_matches(t, '\\S') THEN len(regexp_extract_all('## Page 1\n\n' || t, '\\S+')) ELSE 0 END AS total_words, CASE WHEN regexp_matches(t, '\\S') THEN 'ready' ELSE 'error' END AS status FROM d")
def ingest_books(spark, sf_dir):
    """Every text as a file of one page; no layout reader."""
    pages = texts(spark, sf_dir).select(F.concat(F.lit("in/book_"), "id", F.lit(".pdf")).alias("path"), F.lit(1).alias("page"), "text")
    slow = spark.createDataFrame([], "path string, markdown string")
    return ingest.ingest(pages, slow)["books"].select("id", "title", "filename", "total_pages", "total_words", "status")


@query("SELECT event_id, CAST(props::JSON->>'$.k' AS INT) AS k, '{\"k\":' || (props::JSON->>'$.k') || '}' AS props FROM events")
def import_json_columns(spark, sf_dir):
    read = catalog.decode_json(table(spark, sf_dir, "events").select("event_id", "props"), props="struct<k:int>")
    return catalog.encode_json(read.withColumn("k", F.col("props.k")), "props")


@query("SELECT coalesce(n.id, o.id) AS book_id, coalesce(n.content, o.content) AS content FROM (SELECT doc_id AS id, text AS content FROM documents WHERE doc_id % 3 > 0 AND coalesce(text, '') <> '') n FULL JOIN (SELECT doc_id AS id, 'old' AS content FROM documents WHERE doc_id % 2 = 0) o ON n.id = o.id")
def upsert_markdown(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    old = d.where("doc_id % 2 = 0").select(F.col("doc_id").alias("book_id"), F.lit("old").alias("content"))
    return catalog.upsert_markdown(old, d.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 > 0, F.col("text")).alias("full_markdown")), F.lit(1))


@query(f"SELECT book_id, id AS chapter_id, number % 2 = 0 AS cached, CAST(word_count AS INT) AS words FROM ({_CHAPTERS}) WHERE word_count > 0")
def analysis_cached(spark, sf_dir):
    """Even chapters are in the cache; the others are analysed."""
    chapters = _books(spark, sf_dir)[1]
    count = F.to_json(F.struct(F.struct(F.struct("word_count").alias("stats")).alias("density")))
    cache = chapters.where("number % 2 = 0").select("book_id", F.col("id").alias("chapter_id"), count.alias("data"))
    found, _ = analysis.cached(chapters, cache)
    return found.select("book_id", "chapter_id", "cached", F.get_json_object("data", "$.density.stats.word_count").cast("int").alias("words"))


_MODES = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in m) + ")" for m in prompts.MODES)


@query(f"SELECT mode, mode_name, substring(instructions, 1, 200) AS preview FROM (VALUES {_MODES}) AS m(mode, mode_name, instructions)")
def prompt_modes(spark, sf_dir):
    return prompts.mode_listing(spark)
