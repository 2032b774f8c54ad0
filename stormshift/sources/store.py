"""Writing and reading a prepared catalog."""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, fields
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormshift.operators.geometry import Grid, run_cells


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, in spark.checkpoint.dir; where that is unset, a local one of a local session."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="stormshift-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def snapshot(df: DataFrame, name: str) -> DataFrame:
    """df as a written table: computed once, and later plans start from its files."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed_snapshot(df: DataFrame, name: str, *by: str) -> DataFrame:
    """snapshot as buckets of `by`, one for each shuffle partition: later groups and windows by these columns, or by more, need no shuffle."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    write_buckets(df, path, by, buckets)
    return bucketed(spark, path, by, buckets)


def growing(df: DataFrame) -> DataFrame:
    """df as a side of a join that is merged, never collected by the driver.

    For tables with a row per storm, run, cell or event. Spark takes the size of a table from its compressed files, and knows no
    growth by explode, so it would broadcast a side of millions of rows whose files hold a few megabytes.
    """
    return df.hint("merge")


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df by `by` in as many tasks as there are shuffle partitions, for writers of many files.

    The number is given, as Spark would put small partitions together by their bytes: then one task writes thousands of small files, one after another.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def bucketed(spark: SparkSession, path: str, by: tuple[str, ...], buckets: int) -> DataFrame:
    """A table whose files under path are buckets of `by`, read as such: a join on these columns needs no shuffle of it."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    name, keys = f"buckets_{uuid.uuid4().hex}", ", ".join(by)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def write_buckets(df: DataFrame, path: str, by: tuple[str, ...], buckets: int, mode: str = "error") -> None:
    """One file for each bucket."""
    name = f"buckets_{uuid.uuid4().hex}"
    df.repartition(buckets, *by).write.mode(mode).bucketBy(buckets, *by).sortBy(*by).option("path", path).saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # its files stay


@dataclass(frozen=True)
class Catalog:
    """Everything a study draws from; each field is a lazy table. Sets of cells are runs (row, c0, c1).

    storm_cells(storm_path, row, col, x, y, precip_mm, x0, y0, cell_size), storm_centers(storm_path, x, y, pmax_mm),
    storm_grids(storm_path, grid_id, x0, y0, cell_size, rows, cols), storm_rows(storm_path, row, first, ps, seen): see
    depth.running_rows; layer_stats(layer, minx, miny, maxx, maxy, x, y, range_x, range_y),
    watershed_mask(watershed, grid_id, row, c0, c1) on the grid of each storm, valid_runs(watershed, storm_path, row, c0, c1, before, count)
    and grid_meta(x0, y0, cell_size, rows, cols, grid_id), one row, on the grid of the domain.
    """

    storm_cells: DataFrame
    storm_centers: DataFrame
    storm_grids: DataFrame
    storm_rows: DataFrame
    layer_stats: DataFrame
    watershed_mask: DataFrame
    valid_runs: DataFrame
    grid_meta: DataFrame

    PARTITIONED = {"valid_runs": ["watershed"]}
    #: What depths are looked up in, by storm; buckets rather than a folder for each of millions of storms.
    BUCKETED = {"storm_cells": ("storm_path",), "storm_rows": ("storm_path",)}

    @cached_property
    def domain_grid(self) -> Grid:
        return Grid(**self.grid_meta.first().asDict())

    # written once, as every step of a study reads them: plans that hold their joins each time fill the driver's memory

    @cached_property
    def live_runs(self) -> DataFrame:
        """valid_runs of the storms that have a centre."""
        return snapshot(self.valid_runs.join(growing(self.storm_centers.select("storm_path")), "storm_path", "left_semi"), "live_runs")

    @cached_property
    def alike_storms(self) -> DataFrame:
        """draw.alike of live_runs."""
        from stormshift.operators.draw import alike  # draws read this module

        return snapshot(alike(self.live_runs), "alike")

    @cached_property
    def shared_runs(self) -> DataFrame:
        """live_runs of one storm for each set of valid runs: what draws choose from does not grow with storms whose centres coincide."""
        first = self.alike_storms.where("storm_path = like").select("watershed", "storm_path")
        return snapshot(self.live_runs.join(growing(first), ["watershed", "storm_path"], "left_semi"), "shared_runs")

    @cached_property
    def storm_places(self) -> DataFrame:
        """storm_path, x, y, pmax_mm, grid_id, cell_size: each storm's centre and the grid it lies on."""
        return snapshot(self.storm_centers.join(growing(self.storm_grids.drop("x0", "y0", "rows", "cols")), "storm_path"), "storm_places")

    @property
    def grid(self) -> DataFrame:
        """row, col, x, y of all cells of the domain's grid."""
        return self.domain_grid.cells(self.grid_meta.sparkSession)

    @property
    def valid_cells(self) -> DataFrame:
        """watershed, storm_path, row, col, x, y: a row for each cell of valid_runs."""
        return self.domain_grid.placed(run_cells(self.valid_runs, "watershed", "storm_path")).select("watershed", "storm_path", "row", "col", "x", "y")

    @property
    def mask_cells(self) -> DataFrame:
        """watershed, grid_id, row, col: a row for each cell of watershed_mask."""
        return run_cells(self.watershed_mask, "watershed", "grid_id")

    @classmethod
    def _keys(cls) -> str:
        return "; ".join(f"{name}: {', '.join(by)}" for name, by in cls.BUCKETED.items())

    def save(self, path: str, mode: str = "error") -> None:
        """All tables, several at a time: most of them are small."""
        spark = self.grid_meta.sparkSession
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

        def put(name: str) -> None:
            df = getattr(self, name)
            if name in self.BUCKETED:
                return write_buckets(df, f"{path}/{name}", self.BUCKETED[name], buckets, mode)
            by = self.PARTITIONED.get(name, [])
            df = df.repartition(*by, *(c for c in ("storm_path",) if by and c in df.columns and c not in by)) if by else df
            return df.write.mode(mode).partitionBy(*by).parquet(f"{path}/{name}")

        with ThreadPoolExecutor(4) as pool:
            list(pool.map(put, [f.name for f in fields(self)]))
        spark.range(1).select(F.lit(buckets).alias("buckets"), F.lit(self._keys()).alias("keys")).write.mode(mode).parquet(f"{path}/layout")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Catalog:
        try:
            tables = {f.name: spark.read.parquet(f"{path}/{f.name}") for f in fields(cls) if f.name not in cls.BUCKETED}
            layout = spark.read.parquet(f"{path}/layout").first().asDict()
            alike = layout.get("keys") == cls._keys()  # else saved with other buckets: read as it is
            tables |= {name: bucketed(spark, f"{path}/{name}", by, layout["buckets"]) if alike else spark.read.parquet(f"{path}/{name}") for name, by in cls.BUCKETED.items()}
        except AnalysisException as e:
            raise ValueError(f"{path} holds no prepared catalog") from e
        return cls(**tables)

    def written(self) -> Catalog:
        """The same catalog, saved in the shared folder and loaded from there."""
        spark = self.grid_meta.sparkSession
        path = scratch(spark, "catalog")
        self.save(path)
        return self.load(spark, path)


def write_table(df: DataFrame, path: str, by: tuple[str, ...] = ("watershed",), form: str = "parquet", mode: str = "error") -> None:
    """Summaries, metrics, depths and other results; CSV with a header for hand-over."""
    by = [c for c in by if c in df.columns]
    writer = df.write.mode(mode).partitionBy(*by)
    writer.option("header", True).csv(path) if form == "csv" else writer.parquet(path)


#: Columns that a baseline summary must have.
BASELINE = ("RP", "median_in", "ci95_low_in", "ci95_high_in")


def read_baseline(spark: SparkSession, path: str, required: tuple[str, ...] = BASELINE) -> DataFrame:
    df = spark.read.parquet(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"baseline without {', '.join(missing)}")
    return df.orderBy("RP")
