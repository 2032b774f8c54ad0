"""Preparing a catalog: fields, centres, grid, and the places each storm may be moved to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stormshift.functions.albers import Albers
from stormshift.operators import depth, fields, geometry
from stormshift.operators.geometry import Grid
from stormshift.sources.polygons import read_geojson
from stormshift.sources.records import list_storms, precipitation, read_storms
from stormshift.sources.store import Catalog, bucketed_snapshot, snapshot

_CONFIG = """watershed struct<id: string, geometry_file: string>, transposition_region struct<id: string, geometry_file: string>,
    catalog struct<id: string, catalog_folder: string>, preprocess_opts struct<valid_region_max_seg_len: double, valid_region_simplify_tol: double>"""


def standing_region(domain: DataFrame, watersheds: DataFrame, grid: Grid, max_seg_len: float = 100.0) -> DataFrame:
    """watershed, row, c0, c1: where each watershed's centroid may stand so that the whole of it lies in the domain."""
    offsets = snapshot(geometry.boundary_offsets(watersheds, geometry.layer_stats(watersheds), max_seg_len), "offsets")  # read twice
    return geometry.standing_runs(domain, offsets, grid)


def prepare_catalog(grid_cells: DataFrame, domain: DataFrame, watersheds: DataFrame, cell: float, max_seg_len: float = 100.0, bounds: tuple[float, float, float, float] | None = None) -> Catalog:
    """grid_cells(storm_path, record, row, col, value, ll_x, ll_y, cell_size); polygons as vertex tables.

    Storms keep grids of their own, wherever these start: each watershed's mask is cut on every one of them. New centres lie
    on one grid of `cell` over bounds (minx, miny, maxx, maxy; the domain's by default).
    """
    storm_cells = bucketed_snapshot(fields.cumulative(precipitation(grid_cells)), "storm_cells", "storm_path")
    centers = snapshot(fields.storm_centers(storm_cells), "centers")  # read twice
    grids = snapshot(fields.storm_grids(storm_cells), "storm_grids")
    stats = geometry.layer_stats(domain.unionByName(watersheds))
    box = bounds
    if box is None:
        outer = geometry.layer_stats(domain).first()
        box = (outer.minx, outer.miny, outer.maxx, outer.maxy)
    grid = geometry.Grid.over(*box, cell)
    region = snapshot(standing_region(domain, watersheds, grid, max_seg_len), "region")
    valid = geometry.valid_runs(geometry.layer_runs(domain, grid), region, centers, geometry.layer_stats(watersheds), grid)
    mask = geometry.layer_runs(watersheds, grids.drop("storm_path").distinct()).withColumnRenamed("layer", "watershed")
    return Catalog(
        storm_cells=storm_cells, storm_centers=centers, storm_grids=grids, storm_rows=depth.running_rows(storm_cells), layer_stats=stats,
        watershed_mask=mask, valid_runs=valid, grid_meta=grid.frame(grid_cells.sparkSession),
    )


def catalog_from_config(spark: SparkSession, path: str, projection: Albers | None = Albers(), cell: float | None = None) -> Catalog:
    """The catalog that a JSON file describes: watershed.geometry_file and transposition_region.geometry_file (GeoJSON in
    longitude and latitude; projection None: in metres already), catalog.catalog_folder (a Parquet file of gridded
    records per storm) and preprocess_opts.valid_region_max_seg_len. The watershed's layer is its id.

    cell: size of the grid of new centres; the storms' own by default.

    Refused: a file without these entries, a folder without storms, storms of several cell sizes without `cell`, and valid_region_simplify_tol above 0, as
    outlines are never simplified.
    """
    c = spark.read.schema(_CONFIG).json(path, multiLine=True).first()
    files = c and (c.watershed and c.watershed.geometry_file, c.transposition_region and c.transposition_region.geometry_file, c.catalog and c.catalog.catalog_folder)
    if not files or not all(files):
        raise ValueError(f"{path}: watershed.geometry_file, transposition_region.geometry_file and catalog.catalog_folder are needed")
    segment = c.preprocess_opts and c.preprocess_opts.valid_region_max_seg_len
    if c.preprocess_opts and (c.preprocess_opts.valid_region_simplify_tol or 0) > 0:
        raise ValueError(f"{path}: outlines are not simplified; leave out valid_region_simplify_tol")
    watershed, domain, folder = files
    list_storms(spark, folder)
    cells = read_storms(spark, folder)
    # snapshots: each outline is parsed and projected once
    sheds = snapshot(read_geojson(spark, watershed, c.watershed.id or "watershed", projection), "watershed")
    region = snapshot(read_geojson(spark, domain, "domain", projection), "domain")
    sizes = [r[0] for r in cells.where("cell_size is not null").select("cell_size").distinct().take(2)]
    if not sizes:
        raise ValueError(f"no gridded records in {folder}")
    if cell is None and len(sizes) > 1:
        raise ValueError(f"{folder} holds storms of several cell sizes; name the cell of new centres")
    return prepare_catalog(cells, region, sheds, float(sizes[0] if cell is None else cell), 100.0 if segment is None else segment)
