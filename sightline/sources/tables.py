"""Reading and copying the answer-log tables.

A copy writes its files to a folder of its own and a manifest last: readers see the copy
before or the whole new one. Plain folders without a manifest are read as they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sightline import schema
from sightline.sources.snapshots import Files, Manifests

# Parents first, so a reader never sees a child without its parent.
COPY_ORDER = list(schema.TABLES)


def _folder(spark: SparkSession, root: str, name: str) -> str:
    _, now = Manifests(Files(spark, root)).read()
    return (now or {}).get("tables", {}).get(name, name)


def scan_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table with its declared schema (no inference)."""
    return spark.read.schema(schema.TABLES[name]).parquet(f"{root}/{_folder(spark, root, name)}")


def scan_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {name: scan_table(spark, root, name) for name in schema.TABLES}


def _is_empty(spark: SparkSession, root: str, name: str) -> bool:
    return not Files(spark, root).exists(_folder(spark, root, name)) or scan_table(spark, root, name).isEmpty()


def snapshot_copy(spark: SparkSession, tables: dict[str, DataFrame], target: str, force: bool = False) -> list[str]:
    """Copy all tables; refuse a target that already holds results or inspections unless forced.

    Tables that are not given stay as they are in the target.
    """
    if not force and not all(_is_empty(spark, target, t) for t in ("results", "inspections")):
        raise ValueError(f"{target} already holds results or inspections")
    manifests = Manifests(Files(spark, target))
    version, now = manifests.read()
    folder = f"copies/{uuid.uuid4().hex}"
    written = [name for name in COPY_ORDER if name in tables]
    for name in written:
        tables[name].write.parquet(f"{target}/{folder}/{name}")
    manifests.add(version, {"tables": (now or {}).get("tables", {}) | {name: f"{folder}/{name}" for name in written}})
    return written
