"""What the operators share: the shared work folder, written tables, size-checked joins."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table that was counted may be broadcast.
BROADCAST_ROWS = 20_000


def work_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, as a full URI of its file system; where that is unset, one of our own in a local session and an error on a cluster."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="stormshift-work-")
        spark.conf.set("spark.checkpoint.dir", root)
    if "://" not in root:  # a path of the cluster's default file system
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        root = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
        root = root if "://" in root else root.replace(":", "://", 1)
    return root.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    return f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, no lineage behind it."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """name, or a longer one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checked_broadcast(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df marked for broadcast if it has few rows; otherwise as it is, for a shuffled join."""
    n = df.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: str = "text"):
    """The bytes of a text column, null as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def ascii_lower(column: str):
    """A-Z in lower case, every other letter as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.octet_length(column) == F.length(column)  # code points of one octet alone: the faster function does the same
    return F.when(plain, F.lower(column)).otherwise(F.translate(F.col(column), upper, upper.lower()))
