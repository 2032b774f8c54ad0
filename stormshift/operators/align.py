"""Reading one grid on the cells of another."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stormshift.sources.store import snapshot

#: Cells of the source in a task of align; each gives a few rows.
CELLS_PER_TASK = 200_000


def axis_map(source: DataFrame, target: DataFrame, v: str = "v", method: str = "nearest") -> DataFrame:
    """target(v) -> v, below, above, t: neighbours on the source axis and the place between them; no row outside it.

    Axes hold one value per row or column of a grid; the as-of search is one window over their union.
    nearest: below is the nearest value (the lower one on ties) and t is 0.
    """
    both = source.select(F.col(v).alias("v"), F.lit(True).alias("s")).distinct().unionByName(target.select(F.col(v).alias("v"), F.lit(False).alias("s")).distinct())
    own = F.when(F.col("s"), F.col("v"))
    up, down = Window.orderBy(F.asc("v"), F.desc("s")), Window.orderBy(F.desc("v"), F.desc("s"))  # an axis: rows or columns of one grid
    far = (Window.unboundedPreceding, 0)
    both = both.withColumns({"below": F.last(own, True).over(up.rowsBetween(*far)), "above": F.last(own, True).over(down.rowsBetween(*far))})
    out = both.where("not s and below is not null and above is not null")
    t = F.coalesce(F.expr("try_divide(v - below, above - below)"), F.lit(0.0))
    if method == "linear":
        return out.select("v", "below", "above", t.alias("t"))
    if method != "nearest":
        raise ValueError(f"no such method: {method}")
    near = F.when(F.col("v") - F.col("below") <= F.col("above") - F.col("v"), F.col("below")).otherwise(F.col("above"))
    return out.select("v", near.alias("below"), near.alias("above"), F.lit(0.0).alias("t"))


def align(storm_cells: DataFrame, grid: DataFrame, method: str = "nearest", allowed: bool = True) -> DataFrame:
    """storm_cells on grid(row, col, x, y); cells outside the source's axes are missing.

    allowed: else axes that differ are an error.

    The source is dealt by storm to as many tasks as its cells need, so that a task's memory does not grow with the storms; the grid,
    with the corners of its cells, goes to all tasks, and a storm's cells are added up where they are.
    """
    storm_cells = snapshot(storm_cells.select("storm_path", "x", "y", "precip_mm"), "source")  # read for its axes, its count and its cells
    if not allowed:
        for a in "xy":
            if not grid.select(a).distinct().exceptAll(storm_cells.select(a).distinct()).isEmpty():
                raise ValueError("the storms' grid differs from the mask's")
    maps = {a: axis_map(storm_cells, grid, a, method).select(F.col("v").alias(a), *(F.col(c).alias(f"{c}_{a}") for c in ("below", "above", "t"))) for a in "xy"}
    cells = grid.select("row", "col", "x", "y").join(maps["x"], "x").join(maps["y"], "y")
    weight = {"below": "(1 - t_{0})", "above": "t_{0}"}
    corners = ", ".join(f"named_struct('sx', {i}_x, 'sy', {j}_y, 'w', {weight[i].format('x')} * {weight[j].format('y')})" for i in weight for j in weight)
    cells = cells.withColumn("k", F.explode(F.expr(f"filter(array({corners}), k -> k.w > 0)"))).select("row", "col", "x", "y", "k.*")
    source = storm_cells.select("storm_path", F.col("x").alias("sx"), F.col("y").alias("sy"), "precip_mm")
    source = source.repartition(1 + storm_cells.count() // CELLS_PER_TASK, "storm_path")
    joined = source.join(F.broadcast(cells), ["sx", "sy"])
    return joined.groupBy("storm_path", "row", "col", "x", "y").agg(F.sum(F.col("w") * F.col("precip_mm")).alias("precip_mm"))
