"""Writing tables, dimension updates and text files."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from nivo import contracts
from nivo.operators import frames, quality, weather


def write_table(
    df: DataFrame,
    path: str,
    schema: StructType,
    mode: str = "overwrite",
    partition_by: dict[str, Column] | tuple[str, ...] = (),
    require_rows: bool = True,
    optional: tuple[str, ...] = (),
) -> int:
    """Write a frame under its contract and return the number of rows written.

    ``"overwrite"`` replaces the table, ``"append"`` adds to it, ``"replace_partitions"``
    replaces the partitions the frame has rows for, so running it twice changes nothing.
    ``partition_by`` names columns or gives derived ones, such as the month of a date.
    With ``require_rows`` an empty frame is refused and leaves the table as it was.

    Rows are counted while they are written, so the plan runs once. An overwrite goes to a folder
    beside the table; the old table is renamed away, the new one put in its place, and only then is the old
    one removed. If a run breaks off between the two, the next one puts the old table back
    (:func:`recover`). Before a partitioned write Spark rebalances the rows by partition: small ones are merged,
    large ones split, so there are neither many small files nor one overloaded task.
    """
    return _write(df, path, schema, mode, partition_by, require_rows, optional)[0]


def write_checked(
    df: DataFrame,
    path: str,
    schema: StructType,
    checks: Sequence[quality.Check],
    partition_by: dict[str, Column] | tuple[str, ...] = (),
    kept: Column | None = None,
    before: Sequence[quality.Check] = (),
) -> list[tuple[str, str, float | None, bool]]:
    """Overwrite a table and measure the checks while its rows pass by, without another scan.

    If a check of severity ``error`` fails, the old table stays and :class:`quality.ChecksFailed` is raised.
    ``before`` is measured on all rows, ``checks`` on those that ``kept`` holds for, which are written.
    """
    rows, measured = _write(df, path, schema, "overwrite", partition_by, False, (), [(None, before), (kept, checks)])
    return measured


def _write(df, path, schema, mode, partition_by, require_rows, optional, stages=()):
    if mode not in ("overwrite", "append", "replace_partitions"):
        raise ValueError(f"unknown mode {mode!r}")
    derived = partition_by if isinstance(partition_by, dict) else {}
    names = list(partition_by)
    if mode == "replace_partitions" and not names:
        raise ValueError("replace_partitions needs partition columns")
    observed = []
    for kept, checks in stages:
        df = df if kept is None else df.where(kept)
        if checks:
            observed.append((Observation(), checks))
            df = df.observe(observed[-1][0], *[check.value.alias(check.name) for check in checks])
    table = contracts.conform(df, schema, optional).withColumns(derived)
    if names:
        table = table.hint("rebalance", *names)
    count = Observation()
    counted = table.observe(count, F.count(F.lit(1)).alias("rows"))
    writer = counted.write.mode("append" if mode == "append" else "overwrite")
    writer = writer.option("partitionOverwriteMode", "dynamic" if mode == "replace_partitions" else "static")
    if names:
        writer = writer.partitionBy(*names)
    files = _Files(df.sparkSession)
    files.recover(path)
    target = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}" if mode == "overwrite" else path
    writer.parquet(target)
    rows = count.get["rows"]
    results = [r for seen, checks in observed for r in quality.judge(checks, seen.get)]
    if any(severity == "error" and not passed for _, severity, _, passed in results):
        files.delete(target)
        raise quality.ChecksFailed(results)
    if require_rows and rows == 0:
        if mode == "overwrite":
            files.delete(target)
        raise ValueError(f"refusing to write an empty table to {path}")
    if mode == "overwrite":
        files.replace(target, path)
    return rows, results


def recover(spark: SparkSession, path: str) -> None:
    """Puts a table back that a broken-off overwrite has renamed away and not yet replaced."""
    _Files(spark).recover(path)


class _Files:
    """Folders in whatever file system their paths name."""

    def __init__(self, spark: SparkSession):
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _system(self, path: str):
        folder = self._path(path.rstrip("/"))
        return folder.getFileSystem(self._conf), folder

    def delete(self, path: str) -> None:
        system, folder = self._system(path)
        system.delete(folder, True)

    def rename(self, old: str, new: str) -> None:
        system, folder = self._system(old)
        if not system.rename(folder, self._path(new.rstrip("/"))):
            raise OSError(f"cannot move {old} to {new}")

    def replace(self, new: str, path: str) -> None:
        system, folder = self._system(path)
        aside = f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
        if system.exists(folder):
            self.rename(path, aside)
        self.rename(new, path)
        self.delete(aside)

    def recover(self, path: str) -> None:
        system, folder = self._system(path)
        if system.exists(folder) or not system.exists(folder.getParent()):
            return
        aside = system.globStatus(self._path(f"{path.rstrip('/')}.old-*"))
        if aside:
            system.rename(max(aside, key=lambda status: status.getModificationTime()).getPath(), folder)


def by_month(date_col: str = "date") -> dict[str, Column]:
    """Partition by month: a partition per location and day would hold a row or two."""
    return {"month": weather.month(F.col(date_col))}


def write_text(df: DataFrame, path: str, partition_by: tuple[str, ...], text_col: str = "bulletin_text") -> None:
    """Write one text per row below ``path``, one directory and file per partition key."""
    keys = list(partition_by)
    (
        df.select(*keys, F.col(text_col).alias("value"))
        .repartition(*keys)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .text(path)
    )


def upsert_dim(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Dimension rows with those of ``new`` added or put in place of rows of equal keys."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [F.desc("_new"), *[F.col(c) for c in existing.columns if c not in keys]]
    return frames.newest_per_key(both, keys, rest).drop("_new")
