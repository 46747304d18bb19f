"""Container log lines as a source (S6) and their parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.someip import log_match, log_payload


def log_stream(spark: SparkSession, directory: str, glob: str = "*.log") -> DataFrame:
    """Follow log files as a text stream: one row per line, the container
    name taken from the file name (``ecu-gps.log`` -> ``ecu-gps``)."""
    lines = spark.readStream.option("pathGlobFilter", glob).text(directory)
    return lines.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.log$", 1).alias("container"),
                        F.trim("value").alias("line"), F.current_timestamp().alias("ts"))


def parse_logs(lines: DataFrame) -> DataFrame:
    """Lines that match the container's send/receive pattern, with the
    displayed payload (60 characters after the first ']')."""
    return lines.where(log_match("container", "line")) \
        .withColumn("last_payload", log_payload("line"))


def log_totals(parsed: DataFrame) -> DataFrame:
    """Per container: matched lines so far and the latest displayed payload
    (arrival order), as a streaming aggregation in complete mode."""
    return parsed.groupBy("container").agg(
        F.count(F.lit(1)).alias("total"),
        F.max_by("last_payload", F.struct("ts", "line")).alias("last_payload"))
