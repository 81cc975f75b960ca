"""Written tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new path under ``spark.checkpoint.dir``; where that is unset and all of Spark runs in one process, under a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def saved(df: DataFrame, path: str) -> DataFrame:
    """``df`` written once as Parquet to ``path`` and read back."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back.

    What follows starts from files: lineage ends here, and a lost executor costs
    no more than the tasks that it ran.
    """
    return saved(df, shared_folder(df.sparkSession))


def remove(spark: SparkSession, path: str) -> None:
    """Removes what ``saved`` wrote to ``path``, once no later step reads it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables that are needed only within a ``with`` block: at its end they go, and so do the shuffle files of what was computed.

    Spark removes shuffle files when the driver's JVM collects the plans that made them, so it is asked to.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def written(self, df: DataFrame) -> DataFrame:
        self.paths.append(shared_folder(self.spark))
        return saved(df, self.paths[-1])

    def __exit__(self, *_) -> None:
        for path in self.paths:
            remove(self.spark, path)
        gc.collect()
        self.spark._jvm.System.gc()


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """In what runs within, at most ``rows`` rows go to a Python worker at a time: JVM and worker both hold such a batch whole, the JVM in buffers of up to three times its bytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(was)) if int(was) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, was)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def bounded_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, those with the least hash of ``key``; the same ones on every run.

    A range of hashes that holds a few more rows is cut out first, so that what the
    last sort sees doesn't grow with the number of partitions.
    """
    total, place = rows.count(), F.pmod(F.xxhash64(key), F.lit(1 << 40))
    if total > 2 * most:
        rows = rows.filter(place < int((1 << 40) * min(1.0, 1.5 * most / total)))
    return rows.orderBy(place, key).limit(most)
