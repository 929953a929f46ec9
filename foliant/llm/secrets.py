"""Operator 8: secrets by corpus-wide ownership frequency. DataFrame functions only.

Spans of the base kinds come from regular expressions (offsets in code points: split and extract give the pieces and
the matches in turn, lengths add up to places). Long mixed-class tokens are further candidates. Every candidate's
digest is aggregated to distinct owners and repositories, first per (digest, owner, repository), so a value that a third of
all rows hold is combined on the map side. Values of at most ``max_owners`` owners look live; widely copied ones are examples. Live
further candidates are added to the spans; base spans stay whatever their verdict.

Only the small span table (written once to the shared folder) is joined; texts are read once and never shuffled. A hot
digest's rows split under AQE's skew join.

Defined cases: null text is an empty text; no spans: empty strings and the digest of the empty string; repeated rows are
rows of their own, and of one owner; null owners and repositories count as one unnamed each; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import matches, pieces
from .common import unused, with_row_key, written

#: Fixed patterns of the base kinds, in their order: (kind, pattern, group of the value, least length of the value).
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
FURTHER = ("generic", r"[A-Za-z0-9+/_=-]{20,}", 0, 20)


KIND = "array<struct<start:int,number:int,kind:string,stop:int,value:string>>"
HIDDEN = "\x01"


def spans(text: Column, number: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, number, kind, stop, value>> of the leftmost non-overlapping matches whose value is long enough."""
    value = lambda x: x[f"g{group}"] if group else x.m
    one = lambda x: F.struct(x.start.alias("start"), F.lit(number).alias("number"), F.lit(kind).alias("kind"), x.stop.alias("stop"), value(x).alias("value"))
    return F.transform(F.filter(matches(text, pattern, group), lambda x: F.length(value(x)) >= least), one)


def untouched(text: Column) -> Column:
    """array<boolean>: of each match of FURTHER, whether no base span overlaps it; in time proportional to the text.

    The base matches' characters that FURTHER may hold are hidden, one for one, so the runs stay the same runs, and one that
    a base span touches holds a hidden character. A base match whose value is too short hides nothing.
    """
    plain = F.translate(text, HIDDEN, "\x02")
    run = FURTHER[1].replace("[", "[" + HIDDEN, 1)
    out = None
    for _, pattern, group, least in BASE:
        runs = F.regexp_extract_all(_masked(plain, pattern, group, least), F.lit(run), F.lit(0))
        clean = F.transform(runs, lambda r: ~r.contains(HIDDEN))
        out = clean if out is None else F.zip_with(out, clean, lambda a, b: a & b)
    return out


def _masked(text: Column, pattern: str, group: int, least: int) -> Column:
    """text with the characters hidden that matches of the pattern with a value of least characters share with FURTHER."""
    one = FURTHER[1].split("{")[0]

    def of(x):
        value = x[f"g{group}"] if group else x.m
        return F.concat(x["p"], F.coalesce(F.when(F.length(value) >= least, F.regexp_replace(x.m, one, HIDDEN)).otherwise(x.m), F.lit("")))

    return F.array_join(F.transform(pieces(text, pattern, group), of), "")


def _text(of: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(of), lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.stop.cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), row: Column | None = None) -> DataFrame:
    """-> (row, doc_id, owner, repo, base, more); row: an id of each row, else made here."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    picked = docs.select((F.monotonically_increasing_id() if row is None else row).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repo_cols)).alias("repo"), text.alias("t"))
    base = F.concat(*(spans(F.col("t"), k, *b) for k, b in enumerate(BASE)))
    mixed = lambda x: x.value.rlike("[0-9]") & x.value.rlike("[a-z]") & x.value.rlike("[A-Z]")
    picked = picked.withColumn("base", base).withColumn("more", spans(F.col("t"), len(BASE), *FURTHER))
    apart = F.filter(F.zip_with("more", untouched(F.col("t")), lambda x, ok: F.when(ok & mixed(x), x)), lambda x: x.isNotNull())
    more = F.when(F.size("more") == 0, F.col("more")).when(F.size("base") == 0, F.filter("more", mixed)).otherwise(apart)
    return picked.select("row", "doc_id", "owner", "repo", "base", more.alias("more"))


def ownership(candidates: DataFrame) -> DataFrame:
    """candidates(digest, owner, repo) -> (digest, owners, repos, copies)."""
    by_repo = candidates.groupBy("digest", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("digest", "owner").agg(F.count("*").alias("r"), F.sum("n").alias("n"))
    return by_owner.groupBy("digest").agg(F.count("*").alias("owners"), F.sum("r").alias("repos"), F.sum("n").alias("copies"))


def judge(found: DataFrame, max_owners: int = 1, max_repos: int = 2) -> DataFrame:
    """found: a written scan() -> (row, x, live) for every candidate span x."""
    each = found.where((F.size("base") > 0) | (F.size("more") > 0)).select("row", "owner", "repo", F.explode(F.concat("base", "more")).alias("x")).withColumn("digest", F.sha2(F.col("x.value"), 256))
    live = (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)
    return each.select("row", "digest", "x").join(ownership(each), "digest").select("row", "x", live.alias("live"))


def find(docs: DataFrame, **columns) -> DataFrame:
    """-> (row, doc_id, base, added, n_live, n_example): spans of each row; added are the live further candidates."""
    found = written(scan(docs, **columns))
    per_row = judge(found).groupBy("row").agg(F.collect_list(F.when(F.col("live") & (F.col("x.number") == len(BASE)), F.col("x"))).alias("added"), F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_example"))
    none = F.array().cast("array<struct<start:int,number:int,kind:string,stop:int,value:string>>")
    out = found.select("row", "doc_id", "base").join(per_row, "row", "left")
    return out.select("row", "doc_id", "base", F.coalesce("added", none).alias("added"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_live", "n_example")))


def redact(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """docs with every live span replaced by mark, overlapping spans once. Only texts with a candidate are joined; others pass as they are."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    some = F.lit(False)
    for _, pattern, *_ in (*BASE, FURTHER):
        some = some | text.rlike(pattern)
    row, has, key, marked = (unused(docs, x) for x in ("_row", "_some", "_key", "_spans"))
    numbered = with_row_key(docs, row).withColumn(has, some)
    found = written(scan(numbered.where(F.col(has)), text_col=text_col, row=F.col(row)))
    live = judge(found).where("live").groupBy(F.col("row").alias(key)).agg(F.array_sort(F.collect_list("x")).alias(marked))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def cut(acc, x):
        fresh = x.start >= acc.at
        out = F.when(fresh, F.concat(acc.out, F.substring(text, acc.at + 1, x.start - acc.at), F.lit(mark))).otherwise(acc.out)
        return F.struct(F.greatest(acc.at, x.stop).alias("at"), out.alias("out"))

    clean = F.aggregate(marked, start, cut, lambda acc: F.concat(acc.out, F.substring(text, acc.at + 1, F.length(text))))
    hit = numbered.where(F.col(has)).join(live, F.col(row) == F.col(key), "left").withColumn(text_col, F.when(F.col(marked).isNotNull(), clean).otherwise(F.col(text_col)))
    if chars_col in docs.columns:
        hit = hit.withColumn(chars_col, F.when(F.col(marked).isNotNull(), F.length(text_col)).otherwise(F.col(chars_col)).cast(docs.schema[chars_col].dataType))
    return numbered.where(~F.col(has)).select(*docs.columns).union(hit.select(*docs.columns))


def digests(docs: DataFrame) -> DataFrame:
    """The query's form: counts, the digest of the base spans and all spans."""
    count = lambda kind: F.size(F.filter("base", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    return find(docs).select("doc_id", *(count(b[0]) for b in BASE), F.sha2(_text(F.col("base")), 256).alias("base_sha256"), _text(F.concat("base", "added")).alias("spans"), F.col("n_live").cast("long").alias("n_live"), F.col("n_example").cast("long").alias("n_example"))


def _sql() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    kinds = " UNION ALL ".join(
        f"SELECT r, {k} AS number, '{kind}' AS kind, {least} AS least, regexp_extract_all(t, {quoted(p)}, 0) AS m, regexp_extract_all(t, {quoted(p)}, {group}) AS v, regexp_split_to_array(t, {quoted(p)}) AS p FROM d"
        for k, (kind, p, group, least) in enumerate((*BASE, FURTHER))
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, coalesce(source, '') || '/' || coalesce(lang, '') AS repo FROM documents),
c AS ({kinds}),
e AS (SELECT r, number, kind, least, m, p, v, unnest(range(1, len(m) + 1)) AS k FROM c WHERE len(m) > 0),
s AS (SELECT r, number, kind, v[k] AS value, list_sum(list_transform(p[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k-1], lambda x: length(x))), 0) AS start, length(m[k]) AS n FROM e WHERE length(v[k]) >= least),
b AS (SELECT r, number, kind, value, start, start + n AS stop FROM s WHERE number < 3),
g AS (SELECT r, number, kind, value, start, start + n AS stop FROM s WHERE number = 3 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AND NOT EXISTS (SELECT 1 FROM b WHERE b.r = s.r AND b.start < s.start + s.n AND s.start < b.stop)),
a AS (SELECT * FROM b UNION ALL SELECT * FROM g),
o AS (SELECT a.value, count(DISTINCT d.owner) AS owners, count(DISTINCT d.owner || ' ' || d.repo) AS repos FROM a JOIN d USING (r) GROUP BY a.value),
j AS (SELECT a.*, owners <= 1 AND repos <= 2 AS live, kind || ':' || CAST(CAST(start AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop AS BIGINT) AS VARCHAR) AS span FROM a JOIN o USING (value)),
x AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  coalesce(string_agg(span, ',' ORDER BY start, number) FILTER (number < 3), '') AS base, coalesce(string_agg(span, ',' ORDER BY start, number) FILTER (number < 3 OR live), '') AS spans,
  count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example FROM j GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example FROM d LEFT JOIN x USING (r)
"""


ORACLE = _sql()
