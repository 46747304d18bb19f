"""Helpers shared by the operators: tables, scratch tables, word splitting."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package

#: White space between words in the contracts: space, tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; Spark alone opens the path."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to a new table in the shared checkpoint folder.

    Used for small per-document tables that several branches read: the
    work behind them runs once, readers get column pruning, and a lost
    executor only costs a re-read.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    """Number of salts: the session's own shuffle width, so it grows with the cluster."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers."""
    ship_package(spark)


def let(value: Column, body) -> Column:
    """``body(v)`` with ``v`` bound to ``value``: evaluated once per row even
    where ``body`` uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array."""
    return F.array_remove(F.split(text, SPACE + "+"), "")
