"""Table scans with guards. A location is a path (it contains a slash) or a catalog name."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def find(spark: SparkSession, location: str, schema: StructType | None = None) -> DataFrame | None:
    """The table, or None when it does not exist. Other failures are raised."""
    if "/" not in location:
        return spark.table(location) if spark.catalog.tableExists(location) else None
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        return reader.parquet(location)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_table(
    spark: SparkSession, location: str, schema: StructType | None = None, require_rows: bool = True
) -> DataFrame:
    """Scan a table; a missing one, or with ``require_rows`` an empty one, is an error."""
    df = find(spark, location, schema)
    if df is None:
        raise FileNotFoundError(f"table {location} does not exist")
    if require_rows and df.isEmpty():
        raise ValueError(f"table {location} is empty")
    return df


def read_or_default(
    spark: SparkSession, location: str, schema: StructType, default: DataFrame | None = None
) -> DataFrame:
    """Scan an optional table; a missing one is replaced by ``default`` or an empty frame."""
    df = find(spark, location, schema)
    if df is not None:
        return df
    return default if default is not None else spark.createDataFrame([], schema)


def literal(spark: SparkSession, rows: list, schema: StructType) -> DataFrame:
    """A small inline table; values that do not fit the schema, or NULLs it forbids, raise."""
    return spark.createDataFrame(rows, schema, verifySchema=True)
