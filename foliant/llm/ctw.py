"""Operator 7: context-tree weighting (Willems, Shtarkov, Tjalkens 1995) over bytes, beside a word-unigram base.

A byte is eight binary decisions; a decision's node is (the last d bytes, the byte's bits so far), for d = 0..``DEPTH``. Every node
has a Krichevsky-Trofimov estimate; weights mix the estimates of all depths by how well each coded the learning texts.

Learning: byte (DEPTH + 1)-grams of every text are counted with map-side combining and one shuffle; those of learning texts
make the tree, whole: nothing is pruned, it grows with the corpus and stays distributed. The tree is cut at ``ROOT`` context bytes into
subtrees, which lie together in partitions of about ``part_grams`` grams. A first pass weighs the subtrees and sums them by their parents; the
driver weighs the few levels above (by bytes at most 2^24 nodes); a second pass gives every gram that occurs in any text its code length.

Scoring: the code lengths of the most frequent grams (at most ``max_hot``) and words (``hot_words``) are broadcast and added on the map
side; a text's other grams and words meet the tables in one shuffle join. The bounds decide where a lookup happens, not its result.

The model's text is the words (lower-case A-Z) joined by single spaces and an end byte 0xFF, which UTF-8 never holds.
A context with no node at depth d is predicted by its deepest node, so every prediction is a proper distribution.

Defined cases: null is an empty text (one token, the end); without learning texts the counts are zero and the byte model
is uniform over bits; repeated rows score alike, each in its own row; columns other than those named are not read.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, once, remainder, words, written

DEPTH = 5
ROOT = 3
_CHUNK = 1 << 21
_END = b"\xff"
_GRAM = b" g"  # marks a gram among words, which have no space


def byte_grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(DEPTH + 1)-grams of all texts in a row, as integers, and where each text's grams begin. Contexts start as zeros."""
    raw = np.frombuffer(b"".join(b"\0" * DEPTH + t for t in texts), np.uint8).astype(np.int64)
    n = len(raw) - DEPTH
    g = np.zeros(n, np.int64)
    for k in range(DEPTH + 1):
        g <<= 8
        g |= raw[k : k + n]
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    keep = np.ones(n, bool)
    gaps = (ends[:-1] + DEPTH * np.arange(len(texts) - 1))[:, None] + np.arange(DEPTH)
    keep[gaps.ravel()] = False
    return g[keep], np.concatenate(([0], ends[:-1]))


def _texts(column: list[bytes | None]):
    """Lists of (model text) of bounded total size."""
    out, size = [], 0
    for t in column:
        out.append(b" ".join(words(t)) + _END)
        size += len(out[-1])
        if size > _CHUNK:
            yield out
            out, size = [], 0
    if out:
        yield out


def _merge(g: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums by distinct g, sorted. The stable sort merges what comes as sorted runs."""
    if not len(g):
        return g, *counts
    order = np.argsort(g, kind="stable")
    g = g[order]
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    return g[first], *(np.add.reduceat(n[order], first) for n in counts)


def gram_counts(docs: DataFrame, held: int = 1 << 20) -> DataFrame:
    """docs(t binary, learned boolean) -> (gram, n, seen): occurrences in learning texts and in all texts.
    A task combines until it holds so many grams, then hands them on."""

    def rows(own):
        g, n = own
        for k in range(0, len(g), 1 << 17):
            u, c = g[k : k + (1 << 17)], n[k : k + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(u >> 1), pa.array(np.where(u & 1, c, 0)), pa.array(c)], names=["gram", "n", "seen"])

    def run(batches):
        own, fresh, size = (np.zeros(0, np.int64), np.zeros(0, np.int64)), [], 0
        for b in batches:
            texts, learned = b.column(0).to_pylist(), b.column(1).to_pylist()
            for kind in (True, False):
                for part in _texts([t for t, x in zip(texts, learned, strict=True) if x == kind]):
                    fresh.append(np.unique(byte_grams(part)[0] << 1 | kind, return_counts=True))
                    size += len(fresh[-1][0])
                    if size > held:
                        own, fresh, size = _merge(*(np.concatenate(x) for x in zip(own, *fresh, strict=True))), [], 0
                        if len(own[0]) > held:
                            yield from rows(own)
                            own = own[0][:0], own[1][:0]
        yield from rows(_merge(*(np.concatenate(x) for x in zip(own, *fresh, strict=True))))

    return docs.mapInArrow(run, "gram long, n long, seen long").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))


def _lgamma(x: np.ndarray) -> np.ndarray:
    low = np.zeros_like(x)
    for k in range(8):
        low += np.log(x + k)
    x = x + 8
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) - low


def kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log probability that Krichevsky-Trofimov gives a sequence of n0 zeros and n1 ones."""
    return _lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - _lgamma(n0 + n1 + 1.0) - math.log(math.pi)


def _nodes(g: np.ndarray, n: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted grams and their counts -> the nodes of a byte's decision j: (context and bits so far, zeros, ones)."""
    if not len(g):
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    key = (g >> 8) << 8 | (1 << j) | ((g & 255) >> (8 - j))  # in order, as the grams are
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    n1 = np.add.reduceat(np.where(g >> (7 - j) & 1, n, 0).astype(float), first)
    return key[first], np.add.reduceat(n.astype(float), first) - n1, n1


def _above(keys: np.ndarray, depth: int) -> np.ndarray:
    """The keys of nodes cut to so many context bytes."""
    return (keys >> 8 & (1 << 8 * depth) - 1) << 8 | keys & 255


def _weigh(nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]], depth: int, below: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """nodes: levels from depth on; below: log weights of the last level's children, None for leaves.
    -> the first level's log weights, and each level's share of its own estimate."""
    own = kt(*nodes[-1][1:])
    weighted, shares = own, [np.ones(len(own))]
    for d in range(len(nodes) - 1, -1, -1):
        if d < len(nodes) - 1:
            own, up = kt(*nodes[d][1:]), np.searchsorted(nodes[d][0], _above(nodes[d + 1][0], depth + d))
            below = np.bincount(up, weights=weighted, minlength=len(own))
        elif below is None:
            continue
        else:
            shares = []
        weighted = np.logaddexp(own, below) - math.log(2)
        shares.insert(0, 1 / (1 + np.exp(np.clip(below - own, -700, 700))))
    return weighted, shares


def _mix(nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]], depth: int, shares: list[np.ndarray], gathered: np.ndarray, left: np.ndarray):
    """-> by level (keys, probability of a one where the level is the deepest there is); and what the last level hands down."""
    out = []
    for d, (keys, n0, n1) in enumerate(nodes):
        if d:
            up = np.searchsorted(nodes[d - 1][0], _above(keys, depth + d - 1))
            gathered, left = gathered[up], left[up]
        one = (n1 + 0.5) / (n0 + n1 + 1)
        out.append((keys, np.clip(gathered + left * one, 1e-12, 1 - 1e-12)))
        gathered, left = gathered + left * shares[d] * one, left * (1 - shares[d])
    return out, gathered, left


class Top:
    """The tree above its subtrees: contexts of less than ROOT bytes, by decision."""

    def __init__(self, keys: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray):
        """Nodes with ROOT - 1 context bytes, and the summed log weights of the subtrees under each."""
        order = np.argsort(keys)
        keys, n0, n1, below = (x[order] for x in (keys, n0, n1, below))
        self.levels, self.handed = [], []
        for j in range(8):
            own = (keys & 255) >> j == 1
            nodes = [(keys[own], n0[own], n1[own])]
            for d in range(ROOT - 2, -1, -1):
                nodes.insert(0, _merge(_above(nodes[0][0], d), *nodes[0][1:]))
            _, shares = _weigh(nodes, 0, below[own])
            levels, *handed = _mix(nodes, 0, shares, np.zeros(len(nodes[0][0])), np.ones(len(nodes[0][0])))
            self.levels.append(levels)
            self.handed.append(handed)


def _subtree_levels(grams: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Grams of whole subtrees -> (grams, counts) with ROOT..DEPTH context bytes, sorted."""
    return [_merge(grams & (1 << 8 * (d + 1)) - 1, n) for d in range(ROOT, DEPTH + 1)]


def roots(grams: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Grams of whole subtrees -> (key, zeros, ones, log weight) summed by the parents of the subtrees."""
    levels, out = _subtree_levels(grams, n), []
    for j in range(8):
        nodes = [_nodes(g, c, j) for g, c in levels]
        out.append((_above(nodes[0][0], ROOT - 1), *nodes[0][1:], _weigh(nodes, ROOT)[0]))
    return _merge(*(np.concatenate(x) for x in zip(*out, strict=True)))


def codes(grams: np.ndarray, n: np.ndarray, asked: np.ndarray, top: Top) -> np.ndarray:
    """log10 probability of each asked gram's last byte after the others, decision by decision at the deepest node there is.
    grams, n: the learned grams of all subtrees that asked grams lie in."""
    levels, out, byte = _subtree_levels(grams, n), np.zeros(len(asked)), asked & 255
    for j in range(8):
        nodes = [_nodes(g, c, j) for g, c in levels]
        _, shares = _weigh(nodes, ROOT)
        up = np.searchsorted(top.levels[j][-1][0], _above(nodes[0][0], ROOT - 1))
        own, *_ = _mix(nodes, ROOT, shares, *(x[up] for x in top.handed[j]))
        prefix, bit = (1 << j) | (byte >> (8 - j)), (byte >> (7 - j)) & 1
        p, todo = np.full(len(asked), 0.5), np.arange(len(asked))
        for d, (keys, ones) in reversed(list(enumerate([*top.levels[j], *own]))):
            if len(todo) and len(keys):
                want = (asked[todo] >> 8 & (1 << 8 * d) - 1) << 8 | prefix[todo]
                at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                hit = keys[at] == want
                p[todo[hit]] = ones[at[hit]]
                todo = todo[~hit]
        out += np.log10(np.where(bit == 1, p, 1 - p))
    return out


def gram_codes(counts: DataFrame, part_grams: int = 1 << 18) -> DataFrame:
    """counts: a written gram_counts() -> (gram, seen, code) of every gram that occurs in any text."""
    parts = max(1, -(-counts.count() // part_grams))
    dealt = counts.repartition(parts, F.shiftright("gram", 8).bitwiseAND((1 << 8 * ROOT) - 1))

    def columns(batches):
        whole = list(batches)
        return [np.concatenate([b.column(k).to_numpy() for b in whole]) if whole else np.zeros(0, np.int64) for k in range(3)]

    def weigh(batches):
        g, n, _ = columns(batches)
        out = roots(g[n > 0], n[n > 0])
        for k in range(0, len(out[0]), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(c[k : k + (1 << 17)]) for c in out], names=["key", "n0", "n1", "below"])

    summed = dealt.where("n > 0").mapInArrow(weigh, "key long, n0 double, n1 double, below double").groupBy("key").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "below"))).toArrow()
    shared = counts.sparkSession.sparkContext.broadcast(Top(*(c.to_numpy() for c in summed.columns)))

    def code(batches):
        g, n, seen = columns(batches)
        out = g, seen, codes(g[n > 0], n[n > 0], g, shared.value)
        for k in range(0, len(g), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(c[k : k + (1 << 17)]) for c in out], names=["gram", "seen", "code"])

    return dealt.mapInArrow(code, "gram long, seen long, code double")


class HotCodes:
    """Code lengths of the most frequent grams, by open addressing."""

    def __init__(self, grams: np.ndarray, code: np.ndarray):
        self.bits = max(10, int(2 * len(grams) + 1).bit_length())
        self.slot_key, self.slot_code = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.float64)
        todo, step = np.arange(len(grams)), 0
        while len(todo):
            at = self._slot(grams[todo]) + step & (1 << self.bits) - 1
            free = self.slot_key[at] < 0
            self.slot_key[at[free]] = grams[todo[free]]
            placed = self.slot_key[at] == grams[todo]
            self.slot_code[at[placed]] = code[todo[placed]]
            todo, step = todo[~placed], step + 1

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return ((grams.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """-> (codes, with 0 where there is none; places of the grams that are not held)."""
        out, todo, step = np.zeros(len(grams)), None, 0
        slots, mask = self._slot(grams), (1 << self.bits) - 1
        missed = []
        while todo is None or len(todo):
            at = slots if todo is None else slots[todo] + step & mask
            key, want = self.slot_key[at], grams if todo is None else grams[todo]
            hit = key == want
            where = np.flatnonzero(hit) if todo is None else todo[hit]
            out[where] = self.slot_code[at[hit]]
            empty = key < 0
            missed.append(np.flatnonzero(empty) if todo is None else todo[empty])
            todo = np.flatnonzero(~hit & ~empty) if todo is None else todo[~hit & ~empty]
            step += 1
        return out, np.concatenate(missed)


def _frequent(counts: DataFrame, n: str, most: int) -> Column:
    """Condition of the most frequent rows, at most so many: a threshold from a histogram, not a sort."""
    size = F.col(n).cast("double")
    class_of = F.when(size < 1024, size).otherwise(1024 + F.floor(16 * F.log2(size / 1024)))
    least, above = -1.0, 0
    for r in sorted(counts.groupBy(class_of.cast("double").alias("c")).count().collect(), reverse=True):
        above += r["count"]
        if above > most:
            least = r.c + 0.5
            break
    return class_of >= least


def word_counts(docs: DataFrame) -> DataFrame:
    """docs(t binary) -> (w binary, n)."""

    def run(batches):
        def rows(own):
            w = list(own)
            for k in range(0, len(w), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(w[k : k + (1 << 17)], pa.binary()), pa.array([own[x] for x in w[k : k + (1 << 17)]], pa.int64())], names=["w", "n"])

        own: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                own.update(words(t))
                if len(own) > 300_000:
                    yield from rows(own)
                    own = Counter()
        yield from rows(own)

    return docs.mapInArrow(run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", hot_words: int = 100_000, max_hot: int = 1 << 20) -> DataFrame:
    """-> (doc_id, learned, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte), a row per row of docs."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"), F.coalesce(learn, F.lit(False)).alias("learned"))
    grams = written(gram_counts(picked.select("t", "learned")))
    coded = written(gram_codes(grams))
    discard(grams)
    is_hot = _frequent(coded, "seen", max_hot)
    hot = coded.where(is_hot).select("gram", "code").toArrow()
    held = HotCodes(*(c.to_numpy() for c in hot.columns))
    pool = picked.where("learned").select("t")
    counts = written(word_counts(pool))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = pool.count()
    n, v = total.n + ends, total.v + bool(ends)
    norm = math.log10(n + 0.1 * (v + 1))
    is_hot_word = _frequent(counts, "n", hot_words)
    hot = counts.where(is_hot_word).toArrow()
    logs = {w: math.log10(c + 0.1) for w, c in zip(hot.column("w").to_pylist(), hot.column("n").to_pylist(), strict=True)}
    shared, key = docs.sparkSession.sparkContext.broadcast((held, logs)), uuid.uuid4().hex
    del held, logs, hot
    end_base, end_known = math.log10(ends + 0.1), int(ends > 0)
    schema = "row long, doc_id long, learned boolean, n_tokens long, n_known long, base double, score double, bytes long, tail array<struct<w binary, n long>>"

    def run(batches):
        held, logs = once(("ctw", key), lambda: shared.value)
        for b in (x.slice(k, 1024) for x in batches for k in range(0, len(x), 1024)):
            texts = b.column(2).to_pylist()
            scores, sizes, colder = [], [], []
            for part in _texts(texts):
                g, starts = byte_grams(part)
                code, missed = held.look(g)
                scores.append(np.add.reduceat(code, starts))
                sizes += [len(t) for t in part]
                colder += [[] for _ in part]
                owner = np.searchsorted(starts, missed, "right") - 1 + len(colder) - len(part)
                order = np.lexsort((g[missed], owner))
                owner, rest = owner[order], g[missed][order]
                first = np.flatnonzero(np.r_[True, (rest[1:] != rest[:-1]) | (owner[1:] != owner[:-1])]) if len(rest) else rest
                for o, x, c in zip(owner[first].tolist(), rest[first].tolist(), np.diff(np.r_[first, len(rest)]).tolist(), strict=True):
                    colder[o].append({"w": _GRAM + x.to_bytes(DEPTH + 1, "big"), "n": c})
            out = []
            for row, t, tail in zip(b.column(0).to_pylist(), texts, colder, strict=True):
                own = Counter(words(t))
                known, base = end_known, end_base
                tail.append({"w": b" %d" % row, "n": 0})  # no word has a space: a row for every text
                for w, c in own.items():
                    if (x := logs.get(w)) is None:
                        tail.append({"w": w, "n": c})
                    else:
                        known += c
                        base += c * x
                out.append((own.total() + 1, known, base, tail))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(3), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(np.concatenate(scores) if scores else [], pa.float64()), pa.array(sizes, pa.int64()), pa.array(cols[3], pa.list_(pa.struct([("w", pa.binary()), ("n", pa.int64())])))],
                names=["row", "doc_id", "learned", "n_tokens", "n_known", "base", "score", "bytes", "tail"],
            )

    by_map = picked.select(F.monotonically_increasing_id().alias("row"), "doc_id", "t", "learned").mapInArrow(run, schema)
    first = F.col("x.n") == 0
    rows = by_map.withColumn("x", F.explode("tail")).select("row", "x.w", F.col("x.n").alias("k"), *(F.when(first, F.col(c)).alias(c) for c in ("doc_id", "learned", "n_tokens", "n_known", "base", "score", "bytes")))
    gram_key = F.concat(F.lit(_GRAM), F.unhex(F.lpad(F.hex("gram"), 2 * DEPTH + 2, "0")))
    colder = counts.where(~is_hot_word).select("w", "n", F.lit(None).cast("double").alias("code")).union(coded.where(~is_hot).select(gram_key, F.lit(None).cast("long"), "code"))
    joined = rows.join(colder, "w", "left")
    c = F.coalesce("n", F.lit(0))
    found = joined.groupBy("row").agg(
        *(F.max(x).alias(x) for x in ("doc_id", "learned", "n_tokens", "n_known", "base", "score", "bytes")),
        F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("more"),
        F.sum(F.when(F.col("code").isNull(), F.col("k") * F.log10(c + 0.1)).otherwise(0.0)).alias("rare"),
        F.sum(F.coalesce(F.col("k") * F.col("code"), F.lit(0.0))).alias("cold"),
    )
    total_score = F.col("score") + F.col("cold")
    return found.select("doc_id", "learned", "n_tokens", (F.col("n_known") + F.col("more")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.col("rare") - F.col("n_tokens") * norm).alias("base_score"), total_score.alias("score"), (-total_score * math.log2(10) / F.col("bytes")).alias("bits_per_byte"))


def language_model(docs: DataFrame) -> DataFrame:
    """The query's form: learn where the id's remainder by 10 is not 0, score every row."""
    out = score(docs, remainder("doc_id", 10) != 0)
    return out.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
