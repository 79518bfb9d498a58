"""What the operators of this subpackage share: written intermediates, running totals, text keys."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PACKAGE_ROOT = str(Path(__file__).resolve().parents[2])

#: Bytes that separate words where a contract splits at white space.
BLANKS = r"[\x20\x09-\x0D]+"


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder in local mode, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="nivo-llm-"))
    return spark.sparkContext.getCheckpointDir()


def workers_find_package(spark: SparkSession) -> None:
    """Lets Python workers of this machine import the package wherever the driver was started.

    On a cluster the package is shipped with ``--py-files`` as usual.
    """
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(":")
    if PACKAGE_ROOT not in paths:
        env["PYTHONPATH"] = ":".join([PACKAGE_ROOT, *filter(None, paths)])


class Scratch:
    """Tables of one run of an operator, written to the shared folder and read back.

    A written table is computed once however often it is read, a lost executor costs none of
    it, and Spark knows its size. ``drop`` removes tables that are no longer read; those behind
    a returned frame stay until the owner of the folder clears it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def running(scratch: Scratch, df: DataFrame, name: str, order: list[Column], value: Column) -> DataFrame:
    """The rows with ``position`` (0, 1, ...) and ``before``, the sum of ``value`` over earlier rows.

    The order runs over the whole table, yet no task sees more than its range of it: rows are
    range-partitioned and written, each range is summed, and the sums of earlier ranges (one
    row per range) are added to the running sums within a range. A frequent key is cut
    like any other stretch. ``order`` must tell all rows apart that differ in what is kept;
    rows alike in it are interchangeable.
    """
    ranged = df.withColumn("_value", value.cast("long")).repartitionByRange(*order)
    ranged = scratch.write(ranged.withColumn("_range", F.spark_partition_id()), name)
    sums = ranged.groupBy("_range").agg(
        F.count(F.lit(1)).alias("_rows"), F.sum("_value").alias("_sum")
    )
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "_range",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_sum"),
    )
    within = Window.partitionBy("_range").orderBy(*order)
    inner = within.rowsBetween(Window.unboundedPreceding, -1)
    # One row per shuffle partition: bounded by the partition number.
    return (
        ranged.withColumn("_at", F.row_number().over(within) - 1)
        .withColumn("_cum", F.coalesce(F.sum("_value").over(inner), F.lit(0)))
        .join(F.broadcast(offsets), "_range")
        .withColumn("position", F.col("_at") + F.col("_rows"))
        .withColumn("before", F.col("_cum") + F.col("_sum"))
        .drop("_range", "_value", "_at", "_cum", "_rows", "_sum")
    )


def packed(df: DataFrame, *without: str) -> Column:
    """All columns in one struct, but those that a result replaces."""
    out = {name.lower() for name in without}
    return F.struct(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in out])


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else; pure ASCII texts take the fast way."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower())
    )


def words(text: Column, separators: str = BLANKS) -> Column:
    """The pieces of a text between runs of separators; none of NULL or a blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores until no frame has such a column (names differ by more than case)."""
    taken = {column.lower() for frame in frames for column in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name
