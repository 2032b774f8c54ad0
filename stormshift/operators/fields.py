"""Cumulative fields and storm centres."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormshift.functions.scalars import center


#: Parts of a millimetre in which records are added up, and the value from which they are added as they are.
UNITS, LARGE = 2.0**32, 2.0**13


def cumulative(cells: DataFrame) -> DataFrame:
    """Total of all records per storm and cell, missing as 0, with the cell's centre and grid. Sums are partial before the shuffle.

    Records are added in whole units of 2^-32 mm (half to even), which holds 32-bit values from 1/512 mm on as they are: the total does not depend
    on the order of rows, so neither do the ties between cells and the cells above a share of the peak.
    """
    grid = ("ll_x", "ll_y", "cell_size")
    value = F.col("value").cast("double")
    small = F.abs(value) < LARGE
    units, rest = F.sum(F.when(small, F.rint(value * UNITS).cast("long"))), F.sum(F.when(~small, value))
    total = cells.groupBy("storm_path", "row", "col", *grid).agg((F.coalesce(units.cast("double") / UNITS, F.lit(0.0)) + F.coalesce(rest, F.lit(0.0))).alias("precip_mm"))
    x, y = F.expr(center("ll_x", "col", "cell_size")), F.expr(center("ll_y", "row", "cell_size"))
    return total.select("storm_path", "row", "col", x.alias("x"), y.alias("y"), "precip_mm", F.col("ll_x").alias("x0"), F.col("ll_y").alias("y0"), "cell_size")


def storm_grids(storm_cells: DataFrame) -> DataFrame:
    """storm_path, grid_id, x0, y0, cell_size, rows, cols: the grid of each storm. Storms of one origin and cell share a grid, as large as the largest of them.

    A storm whose records lie on several grids is an error.
    """
    own = ["x0", "y0", "cell_size"]
    each = storm_cells.groupBy("storm_path", *own).agg(F.max("row").alias("_row"), F.max("col").alias("_col"))
    mixed = each.groupBy("storm_path").count().where("count > 1").limit(5).collect()
    if mixed:
        raise ValueError(f"storms on more than one grid: {', '.join(r[0] for r in mixed)}")
    size = each.groupBy(*own).agg((F.max("_row") + 1).alias("rows"), (F.max("_col") + 1).alias("cols"))
    return each.select("storm_path", *own).join(size, own).select("storm_path", F.concat_ws(":", *own).alias("grid_id"), *own, "rows", "cols")


def storm_centers(storm_cells: DataFrame) -> DataFrame:
    """Wettest cell of each storm, the first in row-major order on ties, and its depth."""
    first = F.struct("precip_mm", -F.col("row"), -F.col("col"))
    best = storm_cells.groupBy("storm_path").agg(F.max_by(F.struct("x", "y"), first).alias("c"), F.max("precip_mm").alias("pmax_mm"))
    return best.select("storm_path", "c.x", "c.y", "pmax_mm")


def require_unique_storms(centers: DataFrame) -> DataFrame:
    twice = centers.groupBy("storm_path").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"storms with more than one centre: {', '.join(r[0] for r in twice)}")
    return centers


def require_one_grid(storm_cells: DataFrame) -> DataFrame:
    """storm_cells, if all its storms cover one and the same set of axes; else an error."""
    per_storm = storm_cells.groupBy("storm_path").agg(*(F.sort_array(F.collect_set(c)).alias(c) for c in "xy"))  # axes: rows and columns of a grid
    if len(per_storm.select("x", "y").distinct().take(2)) > 1:
        raise ValueError("the storms' axes differ")
    return storm_cells


def normalized(storm_cells: DataFrame, storm_column: str = "storm_path") -> DataFrame:
    """A cube of cells under any name of its storm column, as the one long table that all steps read."""
    need = [storm_column, "row", "col", "x", "y", "precip_mm"]
    if missing := [c for c in need if c not in storm_cells.columns]:
        raise TypeError(f"not a table of storm cells: {', '.join(missing)} missing")
    return storm_cells.select(F.col(storm_column).cast("string").alias("storm_path"), *need[1:])


def stack(*storms: DataFrame, any_grid: bool = False) -> DataFrame:
    """Cells of several storms or sets of storms, one below another. Their axes must be equal, unless any_grid."""
    first, *rest = storms
    for df in rest:
        first = first.unionByName(df, allowMissingColumns=True)
    return first if any_grid else require_one_grid(first)
