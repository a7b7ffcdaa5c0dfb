"""Readers for the parquet tables of a data folder (``<sf_dir>/<name>.parquet``).

Only the named columns are read (``ReadSchema`` in the scan), so a 2-column
projection never touches the text columns.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


_SCHEMAS: dict = {}


def read_table(spark: SparkSession, sf_dir: str, name: str, columns=None) -> DataFrame:
    """The table, read with its footer schema inferred once per Spark
    context and path (later reads pass it explicitly and skip the footer
    read). The input tables are immutable for the life of a session."""
    path = table_path(sf_dir, name)
    try:
        owner = id(spark.sparkContext)
    except Exception:  # noqa: BLE001 - no SparkContext on this session type
        owner = id(spark)
    key = (owner, path)
    schema = _SCHEMAS.get(key)
    if schema is None:
        df = spark.read.parquet(path)
        _SCHEMAS[key] = df.schema
    else:
        df = spark.read.schema(schema).parquet(path)
    if columns:
        df = df.select(*columns)
    return df


def ensure_parallelism(df: DataFrame) -> DataFrame:
    """Even out a few large rows (whole HTML pages, long documents) before a
    per-row heavy step: Spark cuts the rebalanced rows into partitions of the
    advisory size. No job runs while the plan is built."""
    return df.hint("rebalance")
