"""Gridded precipitation records: listing, filtering, reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the mark of a missing cell in gridded records.
NODATA = -3.4028234663852886e38


def list_storms(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """storm_path (the file's stem) and file of the folder itself, not of folders in it, in order of name; an error if there is none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path")
    storms = files.select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("storm_path"), F.col("path").alias("file")).orderBy("storm_path")
    if storms.isEmpty():
        raise ValueError(f"no storms in {path}")
    return storms


def read_storms(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """Gridded records of the files that list_storms finds, one per storm; storm_path is the file's stem."""
    cells = spark.read.option("pathGlobFilter", pattern).parquet(path)
    return cells.withColumn("storm_path", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1))


def precipitation(cells: DataFrame, marks: tuple[str, ...] = ("PRECIPITATION", "SHG"), nodata: float = NODATA, check: bool = True) -> DataFrame:
    """Only records whose name holds all marks; nodata becomes null. check: every storm must keep a record."""
    own = F.lit(True)
    for mark in marks:
        own = own & F.col("record").contains(mark)
    if check:
        has = cells.groupBy("storm_path").agg(F.coalesce(F.bool_or(own), F.lit(False)).alias("has"))
        bare = has.where("not has").limit(5).collect()
        if bare:
            raise ValueError(f"storms without a precipitation record: {', '.join(r[0] for r in bare)}")
    value = F.col("value")
    return cells.where(own).withColumn("value", F.when(F.isnan(value) | (value <= F.lit(nodata * (1 - 1e-6))), None).otherwise(value))
