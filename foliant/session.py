"""SparkSession with the settings the operators expect."""

from pyspark.sql import SparkSession


def session(master: str = "local[8]", **conf: str) -> SparkSession:
    b = SparkSession.builder.master(master).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
    for k, v in ({"spark.sql.shuffle.partitions": "8"} | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
