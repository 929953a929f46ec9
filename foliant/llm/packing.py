"""Operator 4: packing by first-fit decreasing with a tournament tree of bin capacities, in randomised groups.

A document's ids (and the end id) are cut into full windows and one rest. Pieces are dealt at random (a hash of the row's place in
its file and of the piece's start, so however the scan is cut into tasks the packing is the same) to groups of about ``group_pieces``; each group is packed by itself, so
the memory of a task is bounded whatever the input, and one shuffle carries a few numbers per piece, never ids.
The tree holds the free room of every bin: its root path finds the first bin with room in O(log bins).

Rooms are ``window`` tokens. What is left of a group's rests meets bins that are nearly full, so padding is a fraction of a
window per group. Sequence ids are the group's number times 2^32 plus the bin's number.

Defined cases: null text is an empty text (the end id alone); empty input gives no rows; texts of any length are read
whole; pieces of equal length are packed in the order of their rows' keys; repeated rows and null ids are packed as documents of their own; columns other than those named are not read.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import once, stored, unused, with_row_key

WINDOW = 4096
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row binary"


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = 2) -> DataFrame:
    """One row per piece; row is the key of its document's row, see with_row_key()."""

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from .tokens import WordTokenizer

        own = once(("tokenizer", tokenizer), lambda: WordTokenizer(tokenizer))
        for b in (x.slice(k, 512) for x in batches for k in range(0, len(x), 512)):
            out = []
            for i, row, found in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), own.many([t or "" for t in b.column(1).to_pylist()]), strict=True):
                ids = np.append(found, np.array([end_id], "<u4"))
                for k in range(0, len(ids), window):
                    cut = ids[k : k + window]
                    out.append((i, k, len(cut), zlib.crc32(cut.tobytes()), len(ids), row))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.binary())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row"])

    row = unused(docs, "_row")
    return with_row_key(docs, row).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"), F.col(row)).mapInArrow(run, PIECES)


def first_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """-> (bin, offset) of each piece. Ties in length keep their order."""
    order = np.argsort(-lengths, kind="stable")
    leaves = 1 << max(1, int(len(lengths))).bit_length()
    room = [window] * (2 * leaves)  # a node holds the most room below it
    used, bins, offsets = [0] * leaves, np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k in order.tolist():
        size, node = int(lengths[k]), 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        at = node - leaves
        bins[k], offsets[k] = at, used[at]
        used[at] += size
        room[node] -= size
        while node > 1:
            node //= 2
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = 2, group_pieces: int = 8192, seed: int = 11) -> DataFrame:
    """-> (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row per piece."""
    docs = stored(docs)
    groups = max(1, -(-docs.count() // group_pieces))
    group = F.pmod(F.xxhash64("row", "start", F.lit(seed)), F.lit(groups))

    def run(part: pa.Table) -> pa.Table:
        number = part.column("grp")[0].as_py()
        part = part.sort_by([("row", "ascending"), ("start", "ascending")])
        bins, offsets = first_fit_decreasing(part.column("length").to_numpy(), window)
        return part.drop_columns(["row", "grp"]).append_column("sequence_id", pa.array((number << 32) + bins)).append_column("offset", pa.array(offsets))

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return pieces(docs, tokenizer, id_col, text_col, window, end_id).withColumn("grp", group).groupBy("grp").applyInArrow(run, schema)
