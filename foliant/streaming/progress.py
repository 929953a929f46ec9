"""Ingestion progress: job events folded to the latest state, changes only, and incremental discovery of files."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(events: DataFrame) -> DataFrame:
    """events(job, seq, state) -> (job, state, seq): the last state, with map-side combining."""
    return events.groupBy("job").agg(F.max_by("state", "seq").alias("state"), F.max("seq").alias("seq"))


def changes(events: DataFrame) -> DataFrame:
    """(job, seq, state) where a job's state differs from the one before."""
    before = F.lag("state").over(W.partitionBy("job").orderBy("seq"))
    return events.select("job", "seq", "state", before.alias("before")).where("before is null or before <> state").select("job", "seq", "state")


def active(events: DataFrame) -> DataFrame:
    """Jobs whose last state is not terminal."""
    return latest(events).where(~F.col("state").isin("done", "error"))


def discover(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """A stream of new files (path, modified, length, content); the query's checkpoint remembers what was seen."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(folder)


def latest_stream(events: DataFrame) -> DataFrame:
    """The same fold over a stream, for outputMode update."""
    return latest(events)


EVENT = "job string, seq long, state string, percent int, detail string"


class Jobs:
    """Work in the background whose progress is a folder of event files, which any session can fold (latest) or stream."""

    def __init__(self, spark: SparkSession, folder: str, workers: int = 4):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.pool = ThreadPoolExecutor(workers)

    def report(self, job: str, state: str, percent: int = 0, detail: str = "") -> None:
        """Append one event; the file appears whole or not at all."""
        row = json.dumps({"job": job, "seq": time.time_ns(), "state": state, "percent": percent, "detail": detail}, ensure_ascii=False)
        hidden, shown = (self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{x}{uuid.uuid4().hex}.json") for x in ("_", ""))
        fs = shown.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = fs.create(hidden)
        out.write(bytearray(row.encode()))
        out.close()
        fs.rename(hidden, shown)

    def submit(self, job: str, work: Callable[[Callable[[str, int], None]], object]) -> Future:
        """Run work(progress) in the background; progress(step, percent) reports. Ends in done, or in error with its message."""

        def run():
            try:
                out = work(lambda step, percent=0: self.report(job, step, percent))
            except Exception as e:
                self.report(job, "error", 100, f"{type(e).__name__}: {e}")
                raise
            self.report(job, "done", 100)
            return out

        return self.pool.submit(run)

    def events(self) -> DataFrame:
        return self.spark.read.schema(EVENT).json(self.folder)
