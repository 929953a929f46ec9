"""Operator 1: SimHash near-duplicates by the generalised pigeonhole principle (Qin et al., GPH, ICDE 2018).

Texts become 64-bit fingerprints; fingerprints at most ``max_distance`` bits apart are linked, and a group is a
connected component of links. The 64 bits are dealt to a few partitions, correlated bits together. A pair
within distance T agrees within t_i bits on some partition i whenever the t_i add up to T - parts + 1 (t_i >= -1;
-1 skips a partition). Each fingerprint gets its own t_i: a dynamic program minimises the estimated number of
probes and candidates, from histograms of the fingerprints themselves. Probing is an equi-join on the partition's
value, verified in the join condition by the exact bit count, so no true link is lost.

Scale: equal fingerprints collapse before anything is paired; the number of partitions follows from that of the fingerprints (wider
partitions for more), so that a value holds few of them. A partition value with more than ``bucket`` fingerprints leaves the
join: its n fingerprints and m probes are dealt to blocks of bounded size and block is compared with block, n m comparisons in
n m / 1024^2 tasks of one size; a pair of blocks emits a forest of its links, 2,048 rows at most, not all pairs.

Defined cases: null text is an empty text; empty texts have fingerprint 0 and are linked like any other; repeated rows
are rows of one group; a null id takes part, and a component's id is its least non-null id (null if there is none);
columns other than the named id and text are not read.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keys_side, stored, unused, with_row_key, words, written
from .graph import connected_components

BITS = 64
SALTS = 16
_CHUNK = 1 << 16


def digests(text: bytes | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of the text's word shingles in order, repeats included; fewer words are one shingle, no words none."""
    tokens = words(text)
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum([len(w) + 1 for w in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(tokens) - width + 1)
    last = ends[width - 1 :] if len(tokens) >= width else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)


def majority(h: np.ndarray) -> int:
    """Bit b is 1 if set in over half of the digests."""
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(h), _CHUNK):
        counts += _bits(h[k : k + _CHUNK]).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, width: int = 4) -> int:
    return majority(digests(text, width))


def fingerprint_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """-> (row binary, doc_id, fp long as signed 64 bits), one row per row of docs; row is its key, see with_row_key()."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, width) for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp, pa.int64())], names=["row", "doc_id", "fp"])

    row = unused(docs, "_row")
    picked = with_row_key(docs, row).select(F.col(row).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    return picked.mapInArrow(run, "row binary, doc_id long, fp long")


def _unsigned(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _gather(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), np.int64)
    for k, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def _counted(fps: DataFrame, cells) -> dict[int, int]:
    """Sum over all fingerprints of cells(array) -> counts by cell number; the number of cells is fixed."""

    def run(batches):
        total = None
        for b in batches:
            got = cells(_unsigned(b.column(0)))
            total = got if total is None else total + got
        if total is not None:
            k = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(total[k], pa.int64())], names=["cell", "n"])

    return {r.cell: r.n for r in fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}


def correlated_partitions(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """both[i, j]: fingerprints with bits i and j set. Greedy: start at the free bit with most correlation, add the most correlated."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    free, out = set(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        left = sorted(free)
        group = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        free.remove(group[0])
        while len(group) < size:
            best = max(sorted(free), key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        out.append(group)
    return out


def _masks(bits: int, most: int) -> list[np.ndarray]:
    """By radius 0..most: all masks with at most so many of the bits."""
    out, so_far = [], []
    for r in range(most + 1):
        so_far += [sum(1 << b for b in c) for c in combinations(range(bits), r)]
        out.append(np.array(so_far, np.int64))
    return out


def allocate(cost: np.ndarray, budget: int) -> np.ndarray:
    """cost[q, part, t + 1] for t = -1..T -> thresholds[q, part] of the least total cost that add up to budget."""
    n, parts, levels = cost.shape
    low, high = -parts, levels * parts
    best = np.full((n, high - low + 1), np.inf)
    best[:, -low] = 0
    choice = np.zeros((parts, n, high - low + 1), np.int8)
    for i in range(parts):
        after = np.full_like(best, np.inf)
        for k in range(levels):
            t = k - 1
            src = best[:, max(0, -t) : best.shape[1] - max(0, t)] + cost[:, i, k][:, None]
            at = slice(max(0, t), best.shape[1] + min(0, t))
            better = src < after[:, at]
            after[:, at] = np.where(better, src, after[:, at])
            choice[i][:, at] = np.where(better, k, choice[i][:, at])
        best = after
    out, at, rows = np.zeros((n, parts), np.int64), np.full(n, budget - low), np.arange(n)
    for i in reversed(range(parts)):
        out[:, i] = choice[i][rows, at].astype(np.int64) - 1
        at = at - out[:, i]
    return out


class Plan:
    """Partitions, their sub-block histograms and the cost of a probe; small and of fixed size."""

    def __init__(self, parts: list[list[int]], n: int, max_distance: int, histogram: dict[int, int]):
        self.parts, self.n, self.t = parts, n, max_distance
        self.blocks = [[p[k : k + 11] for k in range(0, len(p), 11)] for p in parts]
        self.near, cell = [], 0
        for blocks in self.blocks:  # share of fingerprints at distance 0..t from each value of a sub-block
            own = []
            for b in blocks:
                h = np.array([histogram.get(cell + v, 0) for v in range(1 << len(b))], float) / max(n, 1)
                d = np.zeros((1 << len(b), max_distance + 1))
                for m in range(1 << len(b)):
                    if (r := m.bit_count()) <= max_distance:
                        d[:, r] += h[np.arange(1 << len(b)) ^ m]
                own.append(d)
                cell += 1 << len(b)
            self.near.append(own)
        self.masks = [_masks(len(p), max_distance) for p in parts]

    @staticmethod
    def cells(parts: list[list[int]]):
        blocks = [p[k : k + 11] for p in parts for k in range(0, len(p), 11)]
        return lambda fps: np.concatenate([np.bincount(_gather(fps, b), minlength=1 << len(b)) for b in blocks])

    def thresholds(self, fps: np.ndarray) -> np.ndarray:
        cost = np.zeros((len(fps), len(self.parts), self.t + 2))
        for i, (blocks, near) in enumerate(zip(self.blocks, self.near, strict=True)):
            share = None
            for b, d in zip(blocks, near, strict=True):
                own = d[_gather(fps, b)]
                share = own if share is None else np.stack([sum(share[:, j] * own[:, r - j] for j in range(r + 1)) for r in range(self.t + 1)], 1)
            found = np.cumsum(share, 1) * self.n
            for t in range(self.t + 1):
                cost[:, i, t + 1] = found[:, t] + len(self.masks[i][t])
        return allocate(cost, self.t - len(self.parts) + 1)


def _keyed(part: int, value: np.ndarray) -> np.ndarray:
    return (np.int64(part) << np.int64(40)) | value


def index_and_probes(fps: DataFrame, plan: Plan) -> tuple[DataFrame, DataFrame]:
    """(key, fp) for each partition's own value; (key, fp) for each value that the fingerprint's thresholds ask for."""

    def own(batches):
        for b in batches:
            x = _unsigned(b.column(0))
            keys = np.concatenate([_keyed(i, _gather(x, p)) for i, p in enumerate(plan.parts)])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.tile(x.view(np.int64), len(plan.parts)))], names=["key", "fp"])

    def probes(batches):
        for b in batches:
            for k in range(0, len(b), 4096):
                x = _unsigned(b.column(0)[k : k + 4096])
                t = plan.thresholds(x)
                for i, p in enumerate(plan.parts):
                    v = _gather(x, p)
                    for r in range(plan.t + 1):
                        if len(at := np.flatnonzero(t[:, i] == r)):
                            keys = _keyed(i, v[at][:, None] ^ plan.masks[i][r][None]).ravel()
                            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(x[at].view(np.int64), len(plan.masks[i][r])))], names=["key", "fp"])

    return fps.select("fp").mapInArrow(own, "key long, fp long"), fps.select("fp").mapInArrow(probes, "key long, fp long")


def _forest(probe: np.ndarray, index: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest with the same components as the links between two blocks of fingerprints, as (a, b) rows."""
    near = np.bitwise_count(probe[:, None] ^ index[None]) <= most
    near &= probe[:, None] != index[None]
    big = np.iinfo(np.int64).max
    p, q = np.arange(len(probe)), np.full(len(index), big)
    linked_p, linked_q = near.any(1), near.any(0)
    while True:  # least label over the bipartite links
        q_new = np.minimum(q, np.where(near, p[:, None], big).min(0, initial=big))
        p_new = np.minimum(p, np.where(near, q_new[None], big).min(1, initial=big))
        if (q_new == q).all() and (p_new == p).all():
            break
        p, q = p_new, q_new
    a = np.concatenate([probe[linked_p], index[linked_q]])
    b = np.concatenate([probe[p[linked_p]], probe[q[linked_q]]])
    return a[a != b], b[a != b]


def links(fps: DataFrame, plan: Plan, bucket: int = 64, block: int = 1024) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """fps(fp), distinct -> (a, b): links whose components are those of all pairs within the plan's distance; and the tables it made."""
    most = plan.t
    index, probes = index_and_probes(fps, plan)
    index, probes = written(index), written(probes)
    hot = written(index.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > bucket).join(probes.groupBy("key").agg(F.count("*").alias("m")), "key"))
    cold = probes.alias("p").join(index.join(hot.select("key"), "key", "left_anti").alias("i"), (F.col("p.key") == F.col("i.key")) & (F.col("p.fp") < F.col("i.fp")) & (F.bit_count(F.col("p.fp").bitwiseXOR(F.col("i.fp"))) <= most)).select(F.col("p.fp").alias("a"), F.col("i.fp").alias("b"))
    rows = lambda df, own, n, other, m, kind: (
        df.join(hot, "key")
        .withColumn(own, F.pmod(F.xxhash64("fp"), F.ceil(F.col(n) / block)).cast("int"))
        .withColumn(other, F.explode(F.sequence(F.lit(0), (F.ceil(F.col(m) / block) - 1).cast("int"))))
        .select("key", "s", "r", "fp", F.lit(kind).alias("probe"))
    )
    dealt = rows(index, "s", "n", "r", "m", False).union(rows(probes, "r", "m", "s", "n", True))

    def compare(group: pa.Table) -> pa.Table:
        fp, probe = _unsigned(group.column("fp").combine_chunks()), group.column("probe").to_numpy()
        a, b = _forest(fp[probe], fp[~probe], most)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return cold.union(dealt.groupBy("key", "s", "r").applyInArrow(compare, "a long, b long")), (index, probes, hot)


def best_parts(n: int, max_distance: int) -> int:
    """The number of partitions with the least probes and candidates of a fingerprint among n that are spread evenly."""
    best = {}
    for parts in range(2, max(3, max_distance + 2)):
        bits = [BITS // parts + (k < BITS % parts) for k in range(parts)]
        masks = np.array([np.cumsum([0.0, *(comb(b, r) for r in range(max_distance + 1))]) for b in bits])
        cost = masks * (1 + n / 2.0 ** np.array(bits)[:, None])
        t = allocate(cost[None], max_distance - parts + 1)[0]
        best[parts] = sum(cost[i, t[i] + 1] for i in range(parts))
    return min(best, key=best.get)


def linked(distinct: DataFrame, max_distance: int = 4, parts: int | None = None, bucket: int = 64) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """distinct(fp), a stored table -> links(), by partitions and thresholds fitted to these fingerprints."""
    n = distinct.count()
    parts = parts or best_parts(n, max_distance)

    def pairs(fps):
        b = _bits(fps).astype(np.float32)
        return np.rint(b.T @ b).astype(np.int64).ravel()

    counts = _counted(distinct, pairs)
    both = np.array([counts.get(k, 0) for k in range(BITS * BITS)], float).reshape(BITS, BITS)
    partitions = correlated_partitions(both, n, parts)
    return links(distinct, Plan(partitions, n, max_distance, _counted(distinct, Plan.cells(partitions))), bucket)


def least_of(grouped: DataFrame, roots: DataFrame, node: str) -> DataFrame:
    """grouped(node, first), roots(node, root) -> (node, least): the least first of the node's component.

    Nodes without a link are their own component and meet no join by root; the others are salted, so a component of any
    size is dealt to SALTS tasks.
    """
    members = grouped.join(roots.select(F.col("node").alias(node), "root"), node, "left")
    alone = members.where("root is null").select(node, F.col("first").alias("least"))
    some = members.where("root is not null").withColumn("salt", F.pmod(F.xxhash64(node), F.lit(SALTS)).cast("int"))
    least = some.groupBy("root").agg(F.min("first").alias("least")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return alone.union(some.join(least, ["root", "salt"]).select(node, "least"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, max_distance: int = 4, parts: int | None = None) -> DataFrame:
    """-> (row, doc_id, fp, component_id, keep): keep marks one row of each group, that of the least id (then of the least row key)."""
    rows = written(fingerprint_rows(docs, id_col, text_col, width))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    distinct = written(rows.groupBy("fp").agg(first.alias("first")))
    found, scratch = linked(distinct, max_distance, parts)
    roots = connected_components(found)
    discard(*scratch)
    labelled = least_of(distinct, roots, "fp").select("fp", F.col("least.doc_id").alias("component_id"), F.col("least.row").alias("kept"))
    return rows.join(labelled, "fp").select("row", "doc_id", "fp", "component_id", (F.col("row") == F.col("kept")).alias("keep"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one document of each group; rows are told apart by their place in the stored table, see with_row_key()."""
    docs = stored(docs)
    row = unused(docs, "_row")
    dropped = near_duplicates(docs, id_col, text_col, **options).where(~F.col("keep")).select(F.col("row").alias(row))
    return with_row_key(docs, row).join(keys_side(written(dropped)), row, "left_anti").select(*docs.columns)
