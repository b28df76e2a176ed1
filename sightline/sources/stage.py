"""Stage tables: a result that several steps or queries read is written once."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.sources.snapshots import Files


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; without one, the warehouse,
    which a cluster shares too."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return named or f"{spark.conf.get('spark.sql.warehouse.dir')}/stages"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: the steps that follow start from files,
    read only the columns they use, and survive lost executors without recomputing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept_path(spark: SparkSession, name: str, root: str) -> str:
    """Where an application keeps a table derived from the files below ``root``: another place as
    soon as a file there is added, replaced or removed."""
    inputs = hashlib.sha256(repr((root, Files(spark, root).listing())).encode()).hexdigest()[:16]
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{inputs}"


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt evenly by a key before heavy work per row (parsing a page, reading a long text):
    how the files were cut then decides nothing, and one source's long rows do not meet in one task.

    Dealt by a hash of the key: where rows are hashed by the key itself already, Spark leaves this
    shuffle out and joins the small partitions before it into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(key))
