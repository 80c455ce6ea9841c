"""Sinks: partitioned Parquet, JSON lines and CSV, each replaced as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write(df: DataFrame, path: str, format: str = "parquet", partition_by: list[str] | None = None) -> None:
    """format: parquet, json or csv (with a header). Nested columns need parquet or json."""
    if format not in ("parquet", "json", "csv"):
        raise ValueError(f"no such format: {format}")
    writer = df.write.mode("overwrite").format(format)
    if format == "csv":
        writer = writer.option("header", "true")
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
