"""Shared helpers: the shared scratch folder, word splitting, membership of the learning sets."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only in local mode, where driver and executors are one process."""
    sc = spark.sparkContext
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not hasattr(spark, "_foliant_scratch"):
        folder = tempfile.mkdtemp(prefix="foliant-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark._foliant_scratch = "file://" + folder
    return spark._foliant_scratch


def written(df: DataFrame, release: bool = False, into: DataFrame | None = None, most: int = 0) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives the loss of any executor, is computed once.
    release: let go of the shuffle files that made it; Spark deletes them once nothing on the driver refers to them.
    into: a table of the same columns, made here, that df's rows are added to. most: rows of a file, 0 for any number."""
    spark = df.sparkSession
    path = into._foliant_path if into is not None else f"{shared_folder(spark)}/foliant-{uuid.uuid4().hex}"
    df.write.mode("error" if into is None else "append").option("maxRecordsPerFile", most).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._foliant_path = path
    if not hasattr(spark, "_foliant_tables"):
        spark._foliant_tables = set()
    spark._foliant_tables.add(path)
    if release:
        spark._jvm.System.gc()
    return out


def stored(docs: DataFrame) -> DataFrame:
    """docs itself if its rows can be told by their place in files, else a written copy."""
    try:
        docs.select(docs.metadataColumn("_metadata")["row_index"])
    except AnalysisException:
        return written(docs)
    return docs


def with_row_key(docs: DataFrame, name: str = "_row") -> DataFrame:
    """docs and a key of each row: the digest of its file and place in it. It stays the same in every scan of a stored table,
    however executors come and go between them and the scan is cut into tasks. What is not a stored table is written first."""
    docs = stored(docs)
    place = docs.metadataColumn("_metadata")
    return docs.withColumn(name, F.unhex(F.md5(F.concat_ws(":", place["file_path"], place["row_index"]))))


def unused(docs: DataFrame, name: str) -> str:
    """name, or a longer one that no column of docs has."""
    have = {c.lower() for c in docs.columns}
    while name in have:
        name += "_"
    return name


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    spark._foliant_tables.discard(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by written() that no result needs any more, and let go of the shuffle files that made them."""
    for df in tables:
        _delete(df.sparkSession, df._foliant_path)
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def discard_all(spark: SparkSession) -> None:
    """Delete every table that written() made in this session; results that were not stored yet are lost with them."""
    for path in list(getattr(spark, "_foliant_tables", ())):
        _delete(spark, path)


def join_counted(rows: DataFrame, groups: DataFrame, key: str, count: str, most: int = 1000) -> DataFrame:
    """rows(key, ...) with the columns of groups(key, count, ...), unique by key; count: the rows of rows that have the key.

    Groups that hold over one in ``most`` of all rows, so fewer than ``most`` of them, are broadcast; the others are joined.
    No key, however hot, then lands in one task.
    """
    total = groups.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    large = F.col(count) * most > int(total)
    hot = F.broadcast(groups.where(large))
    rest = rows.join(F.broadcast(groups.where(large).select(key)), key, "left_anti").join(groups.where(~large), key)
    return rows.join(hot, key).unionByName(rest)


def keys_side(keys: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A stored table of row keys as the side of a semi or anti join: broadcast if it has at most ``most`` rows of 16 bytes, so that the other side,
    with its texts, need not be shuffled; else joined as any other. The result is the same."""
    return F.broadcast(keys) if keys.count() <= most else keys


def remainder(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as remainder 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(mod)), F.lit(0))


def words(text: bytes | None) -> list[bytes]:
    """Lower-case A-Z only, split at bytes 0x20 and 0x09-0x0D, which is what bytes.split() does."""
    return text.lower().split() if text else []


#: Models by broadcast id; a worker keeps the last one it used.
_KEPT: dict = {}


def once(key, make):
    """make() once per Python worker and key."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Let go of the model that once() keeps in this worker."""
    _KEPT.clear()
    settle()


def settle() -> None:
    """Give memory that this process has freed back to the system; the C library otherwise keeps what lies between small arrays."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
