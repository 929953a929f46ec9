"""Operator 2: language identification by word-first backoff.

Each known word scores by its per-language log frequency. An unseen word falls back to character n-grams: at each
position the longest known n-gram (5 down to 1 characters, word ends marked) is scored and the scan moves past it.

Learning takes a bounded sample: about ``max_docs`` labelled texts of each language, picked by a hash (a rate, so
no sort). Words seen ``least`` times or more in it are known words; every word of it feeds the n-grams, all of which are kept. Words and
n-grams are counted by Spark; the broadcast model is as large as the sample's vocabulary. Prediction reads every whole text, map-only.

Defined cases: null text, or text without a letter -> ``und`` with score 0; no learned language at all -> the same;
words of unlearned scripts fall to the languages' shares; repeated rows get equal results; a row with a null id is neither
learned from nor held out; ties go to the language that sorts first; columns other than those named are not read.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, once, remainder, written

WORD = re.compile(r"[^\W\d_]+")
LONGEST = 5
_CACHE, _FLUSH = 300_000, 500_000


def _grams(word: str):
    marked = f"<{word}>"
    for n in range(1, LONGEST + 1):
        for k in range(len(marked) - n + 1):
            yield marked[k : k + n]


class Model:
    def __init__(self, langs: list[str], docs: list[int], words: dict[str, np.ndarray], seen: np.ndarray, grams: dict[str, np.ndarray]):
        """By language: docs: learning texts, words: counts of the known ones, seen: of all words, grams: weights."""
        self.langs = langs
        n = len(langs)
        self.words = {w: k for k, w in enumerate(words)}
        table = np.array(list(words.values()), float).reshape(len(words), n)
        self.table = np.log((table + 0.05) / (np.maximum(seen, 1) + 0.05 * (len(words) + 1)))
        self.grams = {g: k for k, g in enumerate(grams)}
        weight = np.array(list(grams.values()), float).reshape(len(grams), n)
        size = np.array([len(g) for g in grams], np.int64)
        total = np.array([weight[size == k].sum(0) for k in range(LONGEST + 1)])[size] if grams else weight
        self.spread = np.log((weight + 0.05) / (total + 0.05 * (len(grams) + 1)))
        self.prior = np.log(np.array(docs, float) / max(1, sum(docs)))
        self.cache: dict[str, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}}

    def unseen(self, word: str) -> np.ndarray:
        if (hit := self.cache.get(word)) is not None:
            return hit
        marked, k, found, grams = f"<{word}>", 0, [], self.grams
        while k < len(marked):
            for n in range(min(LONGEST, len(marked) - k), 0, -1):
                if (g := grams.get(marked[k : k + n])) is not None:
                    found.append(g)
                    break
            else:
                n = 1
            k += n
        out = self.spread[found].sum(0)
        if len(self.cache) >= _CACHE:
            self.cache.clear()
        self.cache[word] = out
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        tokens = WORD.findall(text.lower()) if text else []
        if not self.langs or not any(c.isalpha() for w in tokens for c in w):
            return "und", 0.0
        get = self.words.get
        ids = [get(w, -1) for w in tokens]
        known = np.array([k for k in ids if k >= 0], np.int64)
        total = self.prior.copy()
        if len(known):
            total += self.table[known].sum(0)
        if len(known) < len(ids):
            for w, c in Counter(w for w, k in zip(tokens, ids, strict=True) if k < 0).items():
                total += c * self.unseen(w)
        z = (total - total.max()) / math.sqrt(len(tokens))
        p = np.exp(z) / np.exp(z).sum()
        k = int(total.argmax())
        return self.langs[k], float(p[k])


def _tables(rows: DataFrame, langs: list[str]) -> dict[str, np.ndarray]:
    """rows(key, lang, v), unique -> v by language of each key, in the order of the keys; a key per word or n-gram of the sample."""
    got = rows.orderBy("key", "lang").toArrow()
    at = {x: k for k, x in enumerate(langs)}
    out: dict[str, np.ndarray] = {}
    for key, x, v in zip(*(got.column(c).to_pylist() for c in ("key", "lang", "v")), strict=True):
        if key not in out:
            out[key] = np.zeros(len(langs), np.float32)
        out[key][at[x]] = v
    return out


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = 3000, least: int = 2) -> Model:
    """learn: condition of the rows that may be learned from."""
    pool = docs.where(learn & F.col(lang_col).isNotNull())
    of = {r[0]: r[1] for r in pool.groupBy(F.col(lang_col)).count().collect()}
    langs = sorted(of)
    rate = F.lit(0.0)
    for x, n in of.items():
        rate = F.when(F.col(lang_col) == x, F.lit(min(1.0, max_docs / n))).otherwise(rate)
    picked = pool.where(F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(7)), F.lit(1 << 30)) < rate * (1 << 30)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("t"))

    def rows_of(out: dict):
        for x, c in out.items():
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array([x] * len(c), pa.string()), pa.array(list(c.values()), pa.float64())], names=["key", "lang", "v"])

    def count(batches):
        out: dict[str, Counter] = defaultdict(Counter)
        for b in batches:
            for x, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if t:
                    out[x].update(WORD.findall(t.lower()))
            if sum(map(len, out.values())) > _FLUSH:
                yield from rows_of(out)
                out.clear()
        yield from rows_of(out)

    def spread(batches):
        out: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        for b in batches:
            for w, x, n in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                own, v = out[x], math.sqrt(n)
                for g in _grams(w):
                    own[g] += v
                if len(own) > _FLUSH:
                    yield from rows_of(out)
                    out.clear()
        yield from rows_of(out)

    kind = "key string, lang string, v double"
    counted = written(picked.mapInArrow(count, kind).groupBy("key", "lang").agg(F.sum("v").alias("v")))
    known = counted.groupBy("key").agg(F.sum("v").alias("n")).where(F.col("n") >= least).select("key")
    words = _tables(counted.join(known, "key"), langs)
    seen = {r.lang: r.n for r in counted.groupBy("lang").agg(F.sum("v").alias("n")).collect()}
    grams = _tables(counted.mapInArrow(spread, kind).groupBy("key", "lang").agg(F.sum("v").alias("v")), langs)
    discard(counted)
    return Model(langs, [of[x] for x in langs], words, np.array([seen.get(x, 0.0) for x in langs]), grams)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (doc_id, lang_pred, score), one row per row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = uuid.uuid4().hex

    def run(batches):
        own = once(("langid", key), lambda: shared.value)
        for b in batches:
            got = [own.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """The query's form: learn where the id's remainder by 3 is not 1, predict every row."""
    learn = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1, F.lit(False))
    out = predict(docs, fit(docs, learn))
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
