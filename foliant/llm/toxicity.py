"""Operator 3: toxicity by the nearest labelled examples under exact TF-IDF cosine, found in a block-max inverted index.

Learning takes every labelled row that may be learned from. A term's weight is its delta IDF, the difference of its smoothed IDFs among the
toxic and the other examples (Martineau and Finin, 2009), times 1 + log of its count; the frequencies are counted over all examples. Every
term of every example is indexed.

The index lies in shards of at most about SHARD examples, made by tasks; the driver hands them out as packed files, one at a time, from its disk to the
disks of the executors, and tasks unpack one after the other for each batch of texts and keep the best k so far. A shard also has the weights of its share of all terms, which together give a query's norm.
So memory is bounded by a shard, while time grows with texts times examples.

A shard cuts its examples into blocks and keeps the largest weight of every frequent term in every block. A query first adds up its
rare terms; what its frequent terms can add in a block at most is a product with those largest weights, and only blocks that can still
reach the k-th best cosine of all shards so far are scored in full: the top k is exact. Votes weigh by 1 / (distance + eps); leave-one-out
votes of all examples, made monotone (pool adjacent violators), turn votes into calibrated scores. Neighbours are returned as evidence.
Scoring reads whole texts, map-only.

Defined cases: a null text is an empty one; texts without a term of positive weight score as the share of toxic examples among such
examples; without learning rows of both classes that share is 0 or the base rate; an example is a row of documents (equal rows of one id
count once), so a repeated id with other texts gives other examples; ties in cosine go to the lower id, then the lower text digest;
repeated rows score alike; labels of other values than 0 and 1 are not read, of repeated labels the highest counts; columns other than
those named are not read.
"""

from __future__ import annotations

import math
import os
import pickle
import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, once, remainder, settle, unused, written

WORD = re.compile(r"[^\W\d_]+")
#: Examples in a block; a term that over one in OFTEN examples holds, at most DENSE of them, has its weights in a dense row and is bounded by blocks before
#: it is scored. They change the time and memory, not the result.
BLOCK, OFTEN, DENSE = 32, 32, 2048
#: Examples of a shard, but for the last file that is put into it, which has as many at most.
SHARD = 8192
#: Labelled ids that are broadcast at a time.
PICKED = 250_000
#: Texts that are taken through all shards at a time, and those of them that are compared with a shard at a time.
TEXTS, TOGETHER = 4096, 128


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted XXH64 of the text's distinct words, and their counts."""
    own = Counter(WORD.findall(text.lower())) if text else {}
    key = np.fromiter(map(xxhash.xxh64_intdigest, own), np.uint64, len(own))
    order = np.argsort(key)
    return key[order], np.fromiter(own.values(), np.int32, len(own))[order]


def delta_idf(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """a, b: toxic and other examples with each term, of n1 and n0."""
    return np.abs(np.log((n0 + 1) / (b + 1)) - np.log((n1 + 1) / (a + 1)))


def _top(owner: np.ndarray, term: np.ndarray, value: np.ndarray, size: int) -> np.ndarray:
    """The first term of the largest value of each owner, or -1; owners ascend."""
    out = np.full(size, -1, np.int64)
    if len(owner):
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        at = np.flatnonzero(value == np.repeat(np.maximum.reduceat(value, first), np.diff(np.r_[first, len(owner)])))[::-1]
        out[owner[at]] = term[at]
    return out


class Index:
    """A shard: unit TF-IDF vectors of its examples in blocks, largest weights by term and block."""

    def __init__(self, terms: np.ndarray, idf: np.ndarray, ids: np.ndarray, y: np.ndarray, counts: list[tuple[np.ndarray, np.ndarray]], weight: tuple[float, float], blank: float, k: int = 15, ties: np.ndarray | None = None, home: tuple[np.ndarray, np.ndarray] | None = None):
        """terms: sorted hashes; counts: of each example, places in terms (ascending) and counts. Examples are in the order that breaks ties,
        by id and ties. home: the terms, sorted, that this shard adds to the norms of queries, and their weights; all terms if there is one shard."""
        self.terms, self.idf, self.k, self.blank = terms, idf, k, blank
        self.home = home or (terms, idf)
        doc = np.repeat(np.arange(len(counts), dtype=np.int32), [len(t) for t, _ in counts])
        term, count = (np.concatenate([c[j] for c in counts]).astype(np.int32) if counts else np.zeros(0, np.int32) for j in (0, 1))
        if not (idf > 0).all():
            some = idf[term] > 0
            term, doc, count = term[some], doc[some], count[some]
        w = (1 + np.log(count)) * idf[term]
        norm = np.sqrt(np.bincount(doc, w * w, len(counts)))
        # blocks of one language and class that share a heavy term have tight bounds
        order = np.lexsort((_top(doc, term, w, len(counts)), y, _top(doc, term, np.bincount(term, minlength=len(terms))[term], len(counts))))
        del w
        self.rank, self.ids, self.y, self.norm = order, ids[order], y[order].astype(float), norm[order]
        self.ties = np.zeros(len(order), np.uint64) if ties is None else ties[order]
        doc = order.argsort().astype(np.int32)[doc]
        by = np.lexsort((doc, term))
        self.first = np.searchsorted(term[by], np.arange(len(terms) + 1))
        self._lay(doc[by], count[by])

    def _lay(self, doc: np.ndarray, count: np.ndarray) -> None:
        """Postings by term and example, and dense rows of the frequent terms."""
        held = np.diff(self.first)
        term = np.repeat(np.arange(len(held), dtype=np.int32), held)
        # a posting's two numbers lie together, as memory is what a query waits for
        post = np.empty((len(doc), 2), np.int32)
        post[:, 0] = doc
        for k in range(0, len(doc), 1 << 18):
            p = slice(k, k + (1 << 18))
            post[p, 1] = ((np.log(count[p], dtype=float) + 1) * self.idf[term[p]] / self.norm[doc[p]]).astype(np.float32).view(np.int32)
        del term
        self.posting = post.view(np.int64).ravel()
        self.doc, self.value, self.count = self.posting.view(np.int32)[::2], self.posting.view(np.float32)[1::2], count
        often = np.flatnonzero(held * OFTEN > len(self.ids))
        often = np.sort(often[np.argsort(-held[often], kind="stable")[:DENSE]])
        self.often = np.full(len(self.terms), -1, np.int32)
        self.often[often] = np.arange(len(often))
        self.blocks = -(-len(self.ids) // BLOCK)
        self.dense = np.zeros((self.blocks, len(often), BLOCK), np.float32)
        for n, t in enumerate(often):
            own = slice(self.first[t], self.first[t + 1])
            self.dense[doc[own] // BLOCK, n, doc[own] % BLOCK] = self.value[own]
        self.most = np.ascontiguousarray(self.dense.max(2, initial=0).T)

    def packed(self) -> bytes:
        """What unpacked() needs: gaps between examples and counts instead of weights, compressed."""
        narrow = np.uint16 if len(self.ids) <= 1 << 16 else np.uint32
        most = int(self.count.max(initial=0))
        parts = [self.terms, np.diff(self.first).astype(np.uint32), self.idf, *self.home, self.ids, self.y, self.ties, self.rank, self.norm]
        parts += [np.diff(self.doc.astype(narrow), prepend=narrow(0)), self.count.astype(np.uint8 if most < 1 << 8 else np.uint32)]
        return pickle.dumps((self.k, self.blank, [(x.dtype.str, x.nbytes, pa.compress(x.tobytes(), "zstd", asbytes=True)) for x in parts]), 5)

    @classmethod
    def unpacked(cls, data: bytes) -> Index:
        self = cls.__new__(cls)
        self.k, self.blank, parts = pickle.loads(data)
        self.terms, held, self.idf, a, b, self.ids, self.y, self.ties, self.rank, self.norm, gap, count = (np.frombuffer(pa.decompress(x, size, "zstd"), kind) for kind, size, x in parts)
        self.home = a, b
        self.first = np.r_[0, np.cumsum(held, dtype=np.int64)]
        self._lay(np.cumsum(gap, dtype=gap.dtype).astype(np.int32), count)
        return self

    @property
    def vectors(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each example, places in terms and weights."""
        term = np.repeat(np.arange(len(self.terms)), np.diff(self.first))
        by = np.argsort(self.doc, kind="stable")
        end = np.cumsum(np.bincount(self.doc, minlength=len(self.ids)))[:-1]
        return list(zip(np.split(term[by], end), np.split(self.value[by], end), strict=True))

    def _unit(self, at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(count)) * self.idf[at]
        at, w = at[w > 0], w[w > 0]
        return at, w / math.sqrt((w * w).sum()) if len(w) else w

    @staticmethod
    def _looked_up(sorted_terms: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Places of keys, or -1."""
        if not len(sorted_terms):
            return np.full(len(keys), -1)
        place = np.minimum(np.searchsorted(sorted_terms, keys), len(sorted_terms) - 1)
        return np.where(sorted_terms[place] == keys, place, -1)

    def nearest(self, terms: np.ndarray, w: np.ndarray, skip: int = -1, floor: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the largest positive product with w, exactly: (numbers, products). Those below floor may be left out."""
        return self.many([(terms, w, skip, floor)])[0]

    def many(self, queries: list[tuple[np.ndarray, np.ndarray, int, float]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """nearest() of each query. Frequent terms of all of them are multiplied together, block by block, in 32 bits; what comes near the k-th best is
        then added up again in 64 bits, in an order that doesn't depend on the other queries."""
        size, width = len(queries), self.blocks * BLOCK
        rare, score = np.zeros((size, width)), np.zeros((size, width))
        weights = np.zeros((size, self.dense.shape[1]), np.float32)
        floors, frequent = np.zeros(size), []
        for q, (terms, w, skip, floor) in enumerate(queries):
            row = self.often[terms]
            m = row >= 0
            frequent.append((row[m], w[m]))
            weights[q, row[m]] = w[m]
            some = terms[~m]
            if len(some):
                spans = list(zip(self.first[some].tolist(), self.first[some + 1].tolist(), strict=True))
                post = np.concatenate([self.posting[i:j] for i, j in spans]).view(np.int32)
                rare[q] = np.bincount(post[::2], np.repeat(w[~m], [j - i for i, j in spans]) * post.view(np.float32)[1::2], width)
            if skip >= 0:
                rare[q, skip] = 0
            floors[q] = floor or self._floor(rare[q])
        score[:] = rare
        if self.dense.shape[1]:
            used = np.flatnonzero(weights.any(0))
            weights = np.ascontiguousarray(weights[:, used])
            need = (weights @ self.most[used] + rare.reshape(size, self.blocks, BLOCK).max(2)) * (1 + 1e-4) >= floors[:, None]
            for b in np.flatnonzero(need.any(0)).tolist():
                own = np.flatnonzero(need[:, b])
                score[own, b * BLOCK : (b + 1) * BLOCK] += weights[own] @ self.dense[b][used]
        out = []
        for q, (_, _, skip, floor) in enumerate(queries):
            row, w = frequent[q]
            slack = 1e-4 * math.sqrt((w * w).sum())
            if skip >= 0:
                score[q, skip] = -1 - slack
            n = np.flatnonzero(score[q] >= floors[q] - slack)
            if len(n) > self.k:
                n = n[score[q, n] >= max(floors[q], self._floor(score[q, n])) - slack]
            n = n[n != skip]
            s = rare[q, n]
            if len(row) and len(n):
                s = s + (w[:, None] * self.dense[(n // BLOCK)[None], row[:, None], (n % BLOCK)[None]]).sum(0)
            n, s = n[m := (s > 0) & (s >= floor)], s[m]
            best = np.lexsort((self.rank[n], -s))[: self.k]
            out.append((n[best], s[best]))
        return out

    def _floor(self, score: np.ndarray) -> float:
        return np.partition(score, -self.k)[-self.k] if len(score) > self.k else 0.0


class Shard:
    """An Index.packed() as a file that executors fetch. Unlike a broadcast's, its bytes lie in no process's memory, neither the driver's nor an
    executor's, so that these don't grow with the number of shards. The files stay until the session's context stops."""

    def __init__(self, spark: SparkSession, data: bytes):
        self.name = f"foliant-shard-{uuid.uuid4().hex}"
        path = os.path.join(spark.sparkContext._temp_dir, self.name)
        with open(path, "wb") as f:
            f.write(data)
        spark.sparkContext.addFile(path)

    @property
    def value(self) -> bytes:
        with open(SparkFiles.get(self.name), "rb") as f:
            return f.read()


class Model:
    """All shards and calibrated votes."""

    def __init__(self, shards: list[Shard], blank: float, k: int = 15, eps: float = 0.05):
        self.shards, self.blank, self.k, self.eps, self.key = shards, blank, k, eps, uuid.uuid4().hex
        self.x = self.p = np.zeros(0)

    def indexes(self):
        """The shards, one at a time: of several, none stays in memory."""
        if len(self.shards) == 1:
            yield once(("toxicity", self.key), lambda: Index.unpacked(self.shards[0].value))
            return
        for b in self.shards:
            yield Index.unpacked(b.value)

    ids = property(lambda self: np.concatenate([i.ids for i in self.indexes()]))
    ties = property(lambda self: np.concatenate([i.ties for i in self.indexes()]))
    rank = property(lambda self: np.lexsort((self.ties, self.ids)).argsort(), doc="Places of the examples in the order that breaks ties.")
    y = property(lambda self: np.concatenate([i.y for i in self.indexes()]))

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], own: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """queries: of counted() -> cosines, ids and classes of the k nearest examples of each. own: id and ties of the example that a query is and leaves out."""
        size = np.array([len(t) for t, _ in queries], np.int64)
        end = np.cumsum(size)
        owner = np.repeat(np.arange(len(queries)), size)
        every, at = np.unique(np.concatenate([t for t, _ in queries]), return_inverse=True) if queries else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        owner, at = owner.astype(np.int32), at.astype(np.int32)
        tf = 1 + np.log(np.concatenate([c for _, c in queries])) if queries else np.zeros(0)
        square = np.zeros(len(queries))
        none = np.zeros(0)
        best = [(none, none.astype(np.int64), none.astype(np.uint64), none)] * len(queries)
        order = None
        for index in self.indexes():
            place = index._looked_up(index.home[0], every)
            square += np.bincount(owner, np.where(place >= 0, index.home[1][place], 0.0)[at] ** 2 * tf**2, len(queries)) if len(index.home[0]) else 0
            place = index._looked_up(index.terms, every).astype(np.int32)
            idf = np.where(place >= 0, index.idf[place], 0.0) if len(index.terms) else np.zeros(len(every))
            number = {key: n for n, key in enumerate(zip(index.ids.tolist(), index.ties.tolist(), strict=True))} if own else {}
            if order is None:  # texts of a language have terms in common
                m = idf[at] > 0
                held = place[at[m]]
                order = np.argsort(_top(owner[m], held, np.diff(index.first)[held], len(queries)), kind="stable").tolist()
                del m, held
            for start in range(0, len(queries), TOGETHER):
                some = order[start : start + TOGETHER]
                asked = []
                for q in some:
                    a, b = end[q] - size[q], end[q]
                    known = idf[at[a:b]] > 0
                    own_at = at[a:b][known]
                    skip = number.get((int(own[0][q]), int(own[1][q])), -1) if own else -1
                    asked.append((place[own_at], idf[own_at] * tf[a:b][known], skip, best[q][0][-1] * (1 - 1e-6) if len(best[q][0]) == self.k else 0.0))
                for q, (n, s) in zip(some, index.many(asked), strict=True):
                    if len(n):
                        both = [np.concatenate(x) for x in zip(best[q], (s, index.ids[n], index.ties[n], index.y[n]), strict=True)]
                        first = np.lexsort((both[2], both[1], -both[0]))[: self.k]
                        best[q] = tuple(x[first] for x in both)
            del index, place, idf, number  # before the next shard is unpacked
        norm = np.sqrt(square)
        return [(s / norm[q] if len(s) else s, ids, y) for q, (s, ids, _, y) in enumerate(best)]

    def vote(self, s: np.ndarray, y: np.ndarray) -> float:
        w = 1 / (1 - np.minimum(s, 1) + self.eps)
        return float((w * y).sum() / w.sum())

    def calibrate(self, cells: dict[float, tuple[int, int]]) -> None:
        """cells: by vote, the toxic and all examples whose left-out vote it is. From then on votes are mapped to scores."""
        pools: list[list[float]] = []
        for x in sorted(cells):
            pools.append([*cells[x], x, x])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                a, b = pools[-2:]
                pools[-2:] = [[a[0] + b[0], a[1] + b[1], a[2], b[3]]]
        self.x = np.array([v for p in pools for v in p[2:]])
        self.p = np.array([p[0] / p[1] for p in pools for _ in range(2)])

    def scores(self, texts: list[str | None]) -> list[tuple[float, list[int]]]:
        places: dict[str, int] = {}
        at = [places.setdefault(t or "", len(places)) for t in texts]  # copies score alike
        out = []
        for s, ids, y in self.nearest([counted(t) for t in places]):
            out.append((float(np.interp(self.vote(s, y), self.x, self.p)) if len(s) and len(self.x) else self.blank, ids.tolist()))
        return [out[k] for k in at]

    def score(self, text: str | None) -> tuple[float, list[int]]:
        return self.scores([text])[0]


def examples(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """docs(doc_id, t), picked(doc_id, y) -> (doc_id, y, digest, terms, counts): a row of words for each row."""

    def run(batches):
        for b in batches:
            got = [counted(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array([k.tobytes() for k, _ in got], pa.binary()), pa.array([c.tobytes() for _, c in got], pa.binary())], names=["doc_id", "y", "digest", "terms", "counts"])

    rows = docs.join(picked, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("y").cast("int").alias("y"), "t", F.coalesce(F.md5("t"), F.lit("")).alias("digest"))
    return rows.mapInArrow(run, "doc_id long, y int, digest string, terms binary, counts binary")


def _learnt(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """examples() as a table. Ids are broadcast in parts of about PICKED, each to a scan of its own, so that what the driver holds of them is bounded
    and texts are not shuffled."""
    n = max(1, -(-picked.count() // PICKED))
    part = lambda df, k: df.where(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(n)) == k) if n > 1 else df
    found = None
    for k in range(n):
        found = written(examples(part(docs, k), F.broadcast(part(picked, k))), into=found, most=SHARD)
    return found


def tie(digests: list[str]) -> np.ndarray:
    """The first 64 bits of digests, in the same order."""
    return np.array([int(d[:16] or "0", 16) for d in digests], np.uint64)


def placed(found: DataFrame, shard: dict[str, int]) -> DataFrame:
    """found: examples -> with s, the shard that their file belongs to."""
    places = F.broadcast(found.sparkSession.createDataFrame(list(shard.items()), "file string, s int"))
    return found.withColumn("file", found.metadataColumn("_metadata")["file_path"]).join(places, "file").drop("file")


def frequencies(rows: DataFrame, n: int) -> DataFrame:
    """rows: of placed(), in n shards -> (term, a, b: toxic and other examples with it, shards: those that hold it and the one it is at home in)."""

    def run(batches):
        for b in batches:
            own, y = np.array(b.column(2).to_pylist()), b.column(0).to_numpy()
            for s in set(own.tolist()):
                rows = np.flatnonzero(own == s)
                keys = [np.frombuffer(b.column(1)[k].as_py(), np.int64) for k in rows.tolist()]
                term, at = np.unique(np.concatenate(keys), return_inverse=True)
                a = np.bincount(at, np.repeat(y[rows], [len(k) for k in keys]), len(term)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(a), pa.array(np.bincount(at, minlength=len(term)) - a), pa.array(np.full(len(term), s, np.int32))], names=["term", "a", "b", "s"])

    home = F.pmod("term", F.lit(n)).cast("int")
    return rows.select("y", "terms", "s").mapInArrow(run, "term long, a long, b long, s int").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.collect_set("s").alias("shards")).withColumn("home", home).withColumn("shards", F.array_union("shards", F.array("home")))


def indexed(rows: DataFrame, freq: DataFrame, n: tuple[int, int], k: int) -> DataFrame:
    """rows: of placed(), freq: of frequencies(), n: toxic and other examples -> (s, data: Index.packed(), bare0, bare1: other and toxic examples of the
    shard without a term of positive weight). The shards are made in tasks, so that the driver holds no more than one, packed."""

    def run(rows: pa.Table, freq: pa.Table) -> pa.Table:
        s = (rows if rows.num_rows else freq).column("s")[0].as_py()
        data, bare = _shard(rows, freq, n, k)
        settle()
        return pa.table({"s": pa.array([s], pa.int32()), "data": pa.array([data], pa.binary()), "bare0": pa.array([bare[0]], pa.int64()), "bare1": pa.array([bare[1]], pa.int64())})

    terms = freq.select(F.explode("shards").alias("s"), "term", "a", "b", "home")
    return rows.groupBy("s").cogroup(terms.groupBy("s")).applyInArrow(run, "s int, data binary, bare0 long, bare1 long")


def fit(docs: DataFrame, labels: DataFrame, learn: Column, k: int = 15) -> Model:
    """docs(doc_id, text), labels(doc_id, toxic); learn: condition on doc_id of the labels that may be learned from. All of them are examples."""
    spark = docs.sparkSession
    picked = labels.where(learn & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    found = _learnt(docs.select("doc_id", F.col("text").alias("t")), picked)
    if len(found.groupBy("doc_id", "digest").count().where("count > 1").take(1)):
        own = written(found.dropDuplicates(["doc_id", "digest"]), most=SHARD)
        discard(found)
        found = own
    sizes = found.groupBy(found.metadataColumn("_metadata")["file_path"].alias("file")).agg(F.count("*").alias("n"), F.sum("y").alias("n1")).orderBy("file").collect()
    n1 = sum(r.n1 for r in sizes)
    n0 = sum(r.n for r in sizes) - n1
    if not n1 or not n0:
        discard(found)
        none = np.zeros(0, np.uint64)
        return Model([Shard(spark, Index(none, np.zeros(0), np.zeros(0, np.int64), np.zeros(0), [], (1.0, 1.0), float(bool(n1)), k).packed())], float(bool(n1)), k)
    files: list[list[str]] = [[]]
    held = 0
    for r in sizes:
        if held >= SHARD or held and held + r.n > SHARD * 5 // 4:
            files.append([])
            held = 0
        files[-1].append(r.file)
        held += r.n
    rows = placed(found, {f: s for s, own in enumerate(files) for f in own})
    freq = written(frequencies(rows, len(files)), release=True)
    shards = written(indexed(rows, freq, (n1, n0), k), release=True)
    discard(freq)
    model, blank = Model([], 0.0, k), np.zeros(2)
    for s in range(len(files)):
        row = shards.where(F.col("s") == s).first()
        model.shards.append(Shard(spark, bytes(row.data)))
        blank += row.bare0, row.bare1
        del row
        settle()
        spark._jvm.System.gc()  # else the driver's heap grows with each shard that goes through it
    discard(shards)
    model.blank = float(blank[1] / max(blank.sum(), 1e-9))
    model.calibrate(_left_out(found, model))
    discard(found)
    return model


def _shard(rows: pa.Table, freq: pa.Table, n: tuple[int, int], k: int) -> tuple[bytes, np.ndarray]:
    """Index of some examples, packed, and how many of either class, other and toxic, have no term of positive weight."""
    terms = freq.column("term").to_numpy().view(np.uint64)
    order = np.argsort(terms)
    terms, home = terms[order], (freq.column("home").to_numpy() == freq.column("s").to_numpy())[order]
    idf = delta_idf(*(freq.column(c).to_numpy()[order] for c in "ab"), *n)
    order = pc.sort_indices(rows.select(["doc_id", "digest"]), [("doc_id", "ascending"), ("digest", "ascending")]).to_pylist()
    ids, y = (rows.column(c).to_numpy()[order] for c in ("doc_id", "y"))
    words, times, digests = (rows.column(c) for c in ("terms", "counts", "digest"))
    places = [np.searchsorted(terms, np.frombuffer(words[j].as_buffer(), np.uint64)).astype(np.int32) for j in order]
    held = np.zeros(len(terms), bool)
    for p in places:
        held[p] = True
    new = np.cumsum(held, dtype=np.int32) - np.int32(1)
    useful = [j for j, p in enumerate(places) if (idf[p] > 0).any()]
    count = [(new[places[j]], np.frombuffer(times[order[j]].as_buffer(), np.int32)) for j in useful]
    ties = tie([digests[order[j]].as_py() for j in useful])
    index = Index(terms[held], idf[held], ids[useful], y[useful], count, (1.0, 1.0), 0.0, k, ties, (terms[home], idf[home]))
    return index.packed(), np.array([(y == v).sum() - (y[useful] == v).sum() for v in (0, 1)])


def _left_out(found: DataFrame, model: Model) -> dict[float, tuple[int, int]]:
    """By vote of the others, the toxic and all examples."""

    def run(batches):
        for b in (b.slice(k, TEXTS) for b in batches for k in range(0, b.num_rows, TEXTS)):
            ids, y = b.column(0).to_numpy(), b.column(1).to_numpy()
            settle()
            queries = [(np.frombuffer(t, np.uint64), np.frombuffer(c, np.int32)) for t, c in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
            near = model.nearest(queries, (ids, tie(b.column(2).to_pylist())))
            votes = [(model.vote(s, c), int(y[j])) for j, (s, _, c) in enumerate(near) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([round(v, 2) for v, _ in votes], pa.float64()), pa.array([v for _, v in votes], pa.int32())], names=["v", "y"])

    return {r.v: (r.n1, r.n) for r in found.mapInArrow(run, "v double, y int").groupBy("v").agg(F.sum("y").alias("n1"), F.count("*").alias("n")).collect()}


def with_scores(docs: DataFrame, model: Model, text_col: str = "text", name: str = "_toxicity") -> DataFrame:
    """docs and name (struct of score and evidence, the neighbours' ids)."""

    @F.arrow_udf("struct<score double, evidence array<bigint>>")
    def score(text: pa.Array) -> pa.Array:
        settle()
        got = [x for k in range(0, len(text), TEXTS) for x in model.scores(text.slice(k, TEXTS).to_pylist())]
        settle()
        return pa.StructArray.from_arrays([pa.array([s for s, _ in got], pa.float64()), pa.array([e for _, e in got], pa.list_(pa.int64()))], names=["score", "evidence"])

    return docs.withColumn(name, score(F.col(text_col)))


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(docs, labels, remainder("doc_id", 5) != 0)


def acceptable(docs: DataFrame, model: Model) -> DataFrame:
    """docs without those whose score is 0.5 or more."""
    name = unused(docs, "_toxicity")
    return with_scores(docs, model, name=name).where(F.col(name)["score"] < 0.5).drop(name)


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's form: learn where the id's remainder by 5 is not 0, score every row."""
    s = F.col("_toxicity.score")
    out = with_scores(docs.select("doc_id", "text"), learned(docs, labels))
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), s.alias("score"), (s >= 0.5).cast("int").alias("predicted"), F.col("_toxicity.evidence").alias("evidence"))
