"""Operator 9: URL filters by association rules over URL tokens, beside an explicit rule list.

A URL's tokens are its host labels, top-level domain, path segments (numbers alike), file endings and query keys, all of them. Token
sets are mined by Spark's FP-growth from a bounded sample of labelled URLs (about ``max_labelled``): the frequent sets of the blocked ones, whose
confidence is then counted among all. Tokens that always occur together count as one, and tokens that always or hardly ever mean
block are no part of larger sets, so a host whose URLs share many tokens gives one rule and not all subsets. Rules that conclude
``block`` and pass support, confidence and lift are all kept, but where a part of their tokens is a rule of at least the same
confidence. They are matched through an inverted index: each lies under its rarest token, and a URL visits the rules under its own
tokens. Judging is map-only and reads the URL column alone.

The list: a rule (host, path) fits its host and all subdomains if the path starts with the rule's; the longest wins.

Defined cases: a null URL, or one without ``://``, has an empty host and path, no tokens and the verdict allow; no labels: no
mined rules; URLs of any length are judged whole; repeated rows are judged alike; equal rules keep the first; columns other than those named are not read.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import once

#: Fixed rule list of the query: (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest fitting rule, or null. The list is code, so its size is known."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: str | None) -> list[str]:
    """Distinct tokens in order of appearance."""
    if not url or "://" not in url:
        return []
    rest = url.split("://", 1)[1].lower()
    body, _, fragment = rest.partition("#")
    body, _, query = body.partition("?")
    host, _, path = body.partition("/")
    labels = host.split(".")
    out = [f"tld:{labels[-1]}", *(f"host:{x}" for x in labels[:-1] if x), f"labels:{len(labels)}"]
    for s in path.split("/"):
        stem, dot, ending = s.rpartition(".")
        if dot and ending.isalnum():
            out.append(f"ending:{ending}")
            s = stem
        if s:
            out.append("path:#" if re.fullmatch(r"\d+", s) else f"path:{s}")
    out += [f"query:{q.partition('=')[0]}" for q in query.split("&") if q]
    if fragment:
        out.append("fragment")
    return list(dict.fromkeys(out))


class RuleIndex:
    def __init__(self, rules: list[tuple[frozenset[str], float, float]], same: dict[str, str] | None = None):
        """rules: (tokens, confidence, support); same: tokens that stand for another. Keeps a rule unless a part of its tokens is at least as confident."""
        self.same = same or {}
        kept: list[tuple[frozenset[str], float, float]] = []
        seen: dict[frozenset[str], float] = {}
        for t, c, s in sorted(rules, key=lambda r: (len(r[0]), -r[1], sorted(r[0]))):
            if t and not any(seen.get(t - {x}, 0.0) >= c for x in t):
                kept.append((t, c, s))
                seen[t] = c
            else:
                seen[t] = max([seen.get(t - {x}, 0.0) for x in t], default=0.0)
        count = Counter(x for t, _, _ in kept for x in t)
        self.under: dict[str, list[tuple[frozenset[str], float]]] = defaultdict(list)
        for t, c, _ in kept:
            self.under[min(t, key=lambda x: (count[x], x))].append((t, c))
        self.size = len(kept)

    def confidence(self, own: list[str]) -> float:
        """Of the most confident matching rule; 0 without one."""
        have = {self.same.get(x, x) for x in own}
        return max((c for x in have for t, c in self.under.get(x, ()) if t <= have), default=0.0)


def minimal_rules(spark: SparkSession, rows: list[tuple[list[str], bool]], least: int, min_confidence: float) -> RuleIndex:
    """Rules of the tokens of rows (tokens, block) that hold for at least ``least`` blocked rows, with lift over 1."""
    n, blocked = len(rows), sum(b for _, b in rows)
    places: dict[str, list[int]] = defaultdict(list)
    for k, (own, _) in enumerate(rows):
        for x in own:
            places[x].append(k)
    size = -(-n // 64) * 8

    def packed(at: list[int]) -> np.ndarray:
        bits = np.zeros(size * 8, bool)
        bits[at] = True
        return np.packbits(bits).view(np.uint64)

    bad = packed([k for k, (_, b) in enumerate(rows) if b])
    held = lambda x: int(np.bitwise_count(x).sum())
    by_cover: dict[tuple[int, ...], str] = {}
    same: dict[str, str] = {}
    rules, covers = [], {}
    for x in sorted(places):
        if least <= len(places[x]) < n:
            first = by_cover.setdefault(tuple(places[x]), x)
            cover = packed(places[x])
            hits = held(cover & bad)
            if first != x:
                same[x] = first
            elif hits >= least:
                if hits >= min_confidence * len(places[x]) and hits * n > blocked * len(places[x]):
                    rules.append((frozenset([x]), hits / len(places[x]), hits / n))
                if hits < len(places[x]):
                    covers[x] = cover
    by_cover.clear()
    baskets = [(own,) for t, b in rows if b and len(own := [x for x in t if x in covers]) > 1]
    if len(baskets) < least:
        return RuleIndex(rules, same)
    shared, key = spark.sparkContext.broadcast((covers, bad)), uuid.uuid4().hex

    def passing(batches):
        cover_of, bad = once(("covers", key), lambda: shared.value)
        for b in batches:
            out = []
            for t, hits in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                count = held(np.bitwise_and.reduce([cover_of[x] for x in t]))
                if hits >= min_confidence * count and hits * n > blocked * count:
                    out.append((t, hits / count, hits / n))
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.list_(pa.string()), pa.float64(), pa.float64()), strict=True)], names=["items", "confidence", "support"])

    frame = spark.createDataFrame(baskets, "items array<string>")
    sets = FPGrowth(itemsCol="items", minSupport=least / len(baskets)).fit(frame).freqItemsets
    found = sets.where((F.size("items") > 1) & (F.col("freq") >= least)).mapInArrow(passing, "items array<string>, confidence double, support double")
    return RuleIndex(rules + [(frozenset(r["items"]), r.confidence, r.support) for r in found.collect()], same)


def mine(urls: DataFrame, min_support: float = 0.002, least_pages: int = 20, min_confidence: float = 0.6, max_labelled: int = 50_000) -> RuleIndex:
    """urls(url, block boolean)."""
    n = urls.count()
    if not n:
        return RuleIndex([])
    rate = min(1.0, max_labelled / n)
    place = F.xxhash64(F.monotonically_increasing_id(), F.lit(9))  # any URL may be that of most rows
    picked = urls.where(F.pmod(place, F.lit(1 << 30)) < int(rate * (1 << 30))).select("url", "block").toArrow()
    rows = [(tokens(u), bool(b)) for u, b in zip(picked.column(0).to_pylist(), picked.column(1).to_pylist(), strict=True)]
    share = min(1.0, max(min_support, least_pages / max(1, n * rate)))
    return minimal_rules(urls.sparkSession, rows, max(1, math.ceil(share * len(rows))), min_confidence)


def judge(pages: DataFrame, index: RuleIndex, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """-> (page_id, host, path, rule, verdict, confidence): the list's verdict, else the mined rules'."""
    shared, key = pages.sparkSession.sparkContext.broadcast(index), uuid.uuid4().hex

    @F.arrow_udf("double")
    def confidence(url: pa.Array) -> pa.Array:
        own = once(("urls", key), lambda: shared.value)
        return pa.array([own.confidence(tokens(u)) for u in url.to_pylist()], pa.float64())

    url = F.col(url_col)
    out = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), confidence(url).alias("confidence"))
    out = out.withColumn("hit", listed(F.col("host"), F.col("path"), rules))
    return out.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.when(F.col("confidence") > 0, "block").otherwise("allow")).alias("verdict"), "confidence")


def filtered(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's form: a labelled page (page_id = doc_id) of low quality or toxic teaches block, others allow."""
    bad = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("block"))
    learn = pages.select("page_id", "url").where("url is not null").join(bad, "page_id").select("url", "block")
    return judge(pages, mine(learn))
