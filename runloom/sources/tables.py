"""Scans of the given parquet tables and of registry tables.

Only columns that a plan uses are read: callers select, Catalyst prunes the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

GIVEN_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A text parquet scan of one column (plus the explicit position column if present)."""
    df = spark.read.parquet(path)
    cols = [c for c in ("doc_id", "text") if c in df.columns]
    return df.select(*cols)


def read_registry(spark: SparkSession, base: str, table: str) -> DataFrame:
    """Scan of a registry table written by :func:`runloom.sources.registry_io.append_tables`."""
    return spark.read.parquet(f"{base.rstrip('/')}/{table}")
