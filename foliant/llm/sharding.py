"""Operator 5: k-d tree sharding. Groups of equal texts are points in metadata space, weighted by their bytes; nodes are
split at distributed weighted medians along their widest dimension until leaves reach the target bytes.

A dimension's coordinate is its value's place between the node's weighted least and most, with a hash below it that
breaks ties, so a split can fall inside a heap of equal values but never inside a group. A median is found exactly by narrowing
histograms: every pass counts bytes of all open nodes in ``BINS`` bins at once (one small aggregate with map-side
combining), so a level costs a few jobs however many nodes it has, and nothing but histograms reaches the driver.

Only ids, sizes and digests are carried; texts are never shuffled. A group larger than a shard stays whole, and its shard is
that much larger. A group with many rows is broadcast to them. Slots come from counts of hash buckets of rows, so no task numbers a whole shard.

Defined cases: null text has size 1 (no bytes plus 1), crc32 0, and nulls are one group; empty input gives no rows;
null metadata counts as an empty string, of a repeated text the least value counts; repeated rows are rows of one group, told apart by their place
in the table; columns other than those named are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, join_counted, stored, unused, with_row_key, written

BINS = 512
SPAN = 1 << 40  # a coordinate: 24 bits of the value's place, 16 bits of hash


@dataclass
class Node:
    shards: int
    first: int  # its first shard
    weight: int = 0
    dim: int = 0
    low: float = 0.0
    high: float = 0.0
    frm: int = 0  # the bin range that holds the split
    to: int = SPAN
    below: int = 0  # bytes under frm
    cut: int = 0
    children: list[int] = field(default_factory=list)


def _place(dims: list[str], nodes: dict[int, Node]) -> Column:
    """The coordinate of a row in its node's dimension, 0 to SPAN - 1."""
    tie = F.pmod(F.col("tie"), F.lit(1 << 16))
    out = F.lit(None).cast("long")
    for n, node in nodes.items():
        width = max(node.high - node.low, 1e-9)
        value = F.least(F.floor((F.col(dims[node.dim]) - node.low) / width * ((1 << 24) - 1)), F.lit((1 << 24) - 1))
        out = F.when(F.col("node") == n, value * (1 << 16) + tie).otherwise(out)
    return out


def kd_leaves(groups: DataFrame, dims: list[str], shards: int) -> tuple[dict[int, Node], Column]:
    """groups(weight, tie, *dims as doubles) -> the tree, and an expression for a row's shard."""
    nodes = {0: Node(shards, 0)}
    node = F.lit(0)
    fresh = [0]
    while fresh:
        placed = groups.withColumn("node", node)
        spans = [f(d) for d in dims for f in (F.min, F.max, lambda c: F.sum(F.col(c) * F.col("weight")), lambda c: F.sum(F.col(c) * F.col(c) * F.col("weight")))]
        for r in placed.where(F.col("node").isin(fresh)).groupBy("node").agg(F.sum("weight").alias("w"), *spans).collect():
            own = nodes[r[0]]
            own.weight = int(r[1])
            spread = []
            for k in range(len(dims)):
                low, high, s, ss = r[2 + 4 * k : 6 + 4 * k]
                spread.append((math.sqrt(max(0.0, ss / own.weight - (s / own.weight) ** 2)) if high > low else 0.0, -k, low, high))
            _, k, own.low, own.high = max(spread)
            own.dim = -k
        open_nodes = {n: nodes[n] for n in fresh if nodes[n].shards > 1}
        for x in open_nodes.values():
            x.frm, x.to, x.below, x.cut = 0, SPAN, 0, -1
        while todo := {n: x for n, x in open_nodes.items() if x.cut < 0}:
            step, start, stop = (F.lit(None).cast("long") for _ in range(3))
            for n, x in todo.items():
                here = F.col("node") == n
                step, start, stop = (F.when(here, F.lit(v)).otherwise(c) for v, c in ((-(-(x.to - x.frm) // BINS), step), (x.frm, start), (x.to, stop)))
            at = F.floor((F.col("at") - start) / step).cast("int")
            rows = placed.where(F.col("node").isin(list(todo))).withColumn("at", _place(dims, todo)).where((F.col("at") >= start) & (F.col("at") < stop))
            histogram: dict[int, dict[int, int]] = {n: {} for n in todo}
            for r in rows.groupBy("node", at.alias("bin")).agg(F.sum("weight").alias("w")).collect():
                histogram[r[0]][r[1]] = int(r[2])
            for n, x in todo.items():
                width = -(-(x.to - x.frm) // BINS)
                goal = x.weight * (x.shards // 2) / x.shards
                for b in range(BINS):
                    w = histogram[n].get(b, 0)
                    if x.below + w >= goal or b == BINS - 1:
                        break
                    x.below += w
                frm = x.frm + b * width
                if width == 1 or w <= max(1, x.weight // 20_000):
                    x.cut = frm + (width if abs(x.below + w - goal) < abs(x.below - goal) else 0)
                else:
                    x.frm, x.to = frm, min(x.to, frm + width)
        fresh = []
        if open_nodes:
            right, left = F.lit(None).cast("int"), F.lit(None).cast("int")
            for n, x in open_nodes.items():
                half = x.shards // 2
                x.children = [len(nodes), len(nodes) + 1]
                nodes[x.children[0]], nodes[x.children[1]] = Node(half, x.first), Node(x.shards - half, x.first + half)
                fresh += x.children
            tree = {n: x for n, x in nodes.items() if x.children}
            node = _descend(dims, tree)
    return nodes, node


def _descend(dims: list[str], tree: dict[int, Node]) -> Column:
    """The node a row ends in, as nested conditions."""
    tie = F.pmod(F.col("tie"), F.lit(1 << 16))

    def at(n: int) -> Column:
        if n not in tree:
            return F.lit(n)
        x = tree[n]
        width = max(x.high - x.low, 1e-9)
        value = F.least(F.floor((F.col(dims[x.dim]) - x.low) / width * ((1 << 24) - 1)), F.lit((1 << 24) - 1))
        return F.when(value * (1 << 16) + tie < x.cut, at(x.children[0])).otherwise(at(x.children[1]))

    return at(0)


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = ("source", "lang"), slot_rows: int = 20_000) -> DataFrame:
    """-> (doc_id, size, text_crc32, law, shard, slot, grown_shard); shards of near-equal bytes, equal texts together."""
    text = F.col(text_col)
    digest = F.coalesce(F.md5(text), F.lit("null"))
    docs = stored(docs)
    key = unused(docs, "_row")
    rows = with_row_key(docs, key).select(F.xxhash64(key).alias("row"), F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(text), F.lit(0)).alias("text_crc32"), digest.alias("grp"), *(F.coalesce(F.col(m).cast("string"), F.lit("")).alias(f"m{k}") for k, m in enumerate(metadata)))
    rows = written(rows)
    unit = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 24)) / float(1 << 24)  # noqa: E731  a category's coordinate
    scale = rows.agg(F.max(F.log("size")), F.max("doc_id"), F.min("doc_id"), F.count("*")).first()
    top, last, first, n = scale[0] or 1.0, scale[1] or 0, scale[2] or 0, scale[3]
    dims = ["d_size", "d_id", *(f"d{k}" for k in range(len(metadata)))]
    groups = rows.groupBy("grp").agg(F.count("*").alias("n"), F.sum("size").alias("weight"), F.xxhash64("grp").alias("tie"), (F.log(F.max("size")) / max(top, 1e-9)).alias("d_size"), F.coalesce((F.min("doc_id") - first) / float(max(last - first, 1)), F.lit(0.0)).alias("d_id"), *(unit(F.min(f"m{k}")).alias(f"d{k}") for k in range(len(metadata))))
    groups = written(groups)
    nodes, node = kd_leaves(groups, dims, shards)
    number = F.lit(0)
    for k, x in nodes.items():
        if not x.children:
            number = F.when(F.col("node") == k, F.lit(x.first)).otherwise(number)
    placed = groups.withColumn("node", node).select("grp", "n", number.alias("shard"))
    bucket = F.pmod(F.xxhash64("row", F.lit(5)), F.lit(max(1, -(-n // slot_rows)))).cast("int")
    dealt = join_counted(rows, placed, "grp", "n").select("doc_id", "size", "text_crc32", "shard", bucket.alias("bucket"), "row")
    dealt = written(dealt)
    counts = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size", "row")) - 1
    out = dealt.withColumn("k", inside).join(before, ["shard", "bucket"])
    discard(groups, rows)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("before") + F.col("k")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
