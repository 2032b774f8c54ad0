"""Polygons as tables: statistics, boundaries, and sets of grid cells as runs.

A set of cells is kept as runs (row, c0, c1) of one grid row each: outlines become runs by scanlines, sets are shifted, met
and counted as intervals, and work grows with edges and runs, not with cells. Cell (row, col) of a grid
has its centre at x0 + (col + 1/2) cell_size, y0 + (row + 1/2) cell_size; many grids are a table with Grid's names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormshift.functions.scalars import center
from stormshift.functions.text import num


def edges(vertices: DataFrame) -> DataFrame:
    """layer, part, ring, seq, x1, y1, x2, y2 of closed rings."""
    w = Window.partitionBy("layer", "part", "ring").orderBy("seq")
    e = vertices.select("layer", "part", "ring", "seq", F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2"))
    return e.where("x2 is not null")


def layer_stats(vertices: DataFrame) -> DataFrame:
    """Bounds, centroid of the area (holes taken off), and ranges of each layer."""
    e = edges(vertices)
    box = vertices.groupBy("layer").agg(*(f(c).alias(f"{n}{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xy"))
    # about the layer's corner, so that squares of large coordinates don't cancel
    e = e.join(box.select("layer", "minx", "miny"), "layer")
    ax, ay, bx, by = F.col("x1") - F.col("minx"), F.col("y1") - F.col("miny"), F.col("x2") - F.col("minx"), F.col("y2") - F.col("miny")
    cross = ax * by - bx * ay
    rings = e.groupBy("layer", "part", "ring").agg(F.sum(cross).alias("a"), F.sum((ax + bx) * cross).alias("sx"), F.sum((ay + by) * cross).alias("sy"))
    sign = F.when(F.col("ring") == 0, F.signum("a")).otherwise(-F.signum("a"))
    area = rings.groupBy("layer").agg(*(F.sum(sign * F.col(c)).alias(c) for c in ("a", "sx", "sy")))
    out = box.join(area, "layer")
    x, y = (F.col(f"min{c}") + F.try_divide(F.col(f"s{c}"), 3 * F.col("a")) for c in "xy")
    return out.select("layer", "minx", "miny", "maxx", "maxy", x.alias("x"), y.alias("y"), (F.col("maxx") - F.col("minx")).alias("range_x"), (F.col("maxy") - F.col("miny")).alias("range_y"))


@dataclass(frozen=True)
class Grid:
    """One grid as numbers; `on` puts them beside every row, so that no join is needed."""

    x0: float
    y0: float
    cell_size: float
    rows: int
    cols: int
    grid_id: str = "master"

    @classmethod
    def over(cls, minx: float, miny: float, maxx: float, maxy: float, cell: float) -> Grid:
        """All cells that cover the bounds, from their lower left corner."""
        return cls(float(minx), float(miny), float(cell), _ceil((maxy - miny) / cell), _ceil((maxx - minx) / cell))

    def on(self, df: DataFrame) -> DataFrame:
        return df.withColumns({k: F.lit(v) for k, v in vars(self).items()})

    def frame(self, spark) -> DataFrame:
        return self.on(spark.range(1)).drop("id")

    def cells(self, spark) -> DataFrame:
        """row, col, x, y of all cells."""
        i = spark.range(self.rows * self.cols).select(F.expr(f"CAST(id div {self.cols} AS INT)").alias("row"), F.expr(f"CAST(id % {self.cols} AS INT)").alias("col"))
        return self.placed(i)

    def placed(self, cells: DataFrame) -> DataFrame:
        """cells(row, col, ...) with x and y."""
        return cells.withColumns({"x": F.expr(center(num(self.x0), "col", num(self.cell_size))), "y": F.expr(center(num(self.y0), "row", num(self.cell_size)))})


def on_grids(df: DataFrame, grids: Grid | DataFrame) -> DataFrame:
    return grids.on(df) if isinstance(grids, Grid) else df.crossJoin(grids)


def first_center(bound: str, origin: str = "x0", cell: str = "cell_size", moved: str = "") -> str:
    """SQL: index of the first cell whose centre (and `moved`, if given) is not below bound. The comparison is that of the points themselves."""
    at = lambda i: f"({center(origin, i, cell)}{moved})"
    guess = f"CAST(ceil(({bound} - ({origin}{moved})) / {cell} - 5e-1) AS INT)"
    return f"CASE WHEN {at(f'({guess} - 1)')} >= {bound} THEN {guess} - 1 WHEN {at(guess)} < {bound} THEN {guess} + 1 ELSE {guess} END"


def _between_crossings(crossings: DataFrame, keys: list[str], moved: str = "") -> DataFrame:
    """crossings(keys, row, at, x0, cell_size, cols): of each scanline the columns between its odd crossings and the next, as keys, row, c0, c1."""
    w = Window.partitionBy(*keys, "row").orderBy("at")
    spans = crossings.select("*", F.row_number().over(w).alias("_k"), F.lead("at").over(w).alias("_next")).where("_k % 2 = 1 and _next is not null")
    spans = spans.select("*", F.expr(first_center("at", moved=moved)).alias("_a"), F.expr(first_center("_next", moved=moved)).alias("_b"))
    spans = spans.select(*keys, "row", F.greatest(F.lit(0), F.col("_a")).alias("c0"), F.least(F.col("cols"), F.col("_b")).alias("_end"))
    return spans.select(*keys, "row", "c0", (F.col("_end") - 1).alias("c1")).where("c0 <= c1")


def layer_runs(vertices: DataFrame, grids: Grid | DataFrame) -> DataFrame:
    """layer, grid_id, row, c0, c1: the cells of each grid whose centre lies in the layer (parity of crossings).

    An edge meets only the rows that it crosses. Every layer is looked up on every grid, which is what is asked for.
    """
    e = on_grids(edges(vertices), grids)
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    first, last = (F.floor((y - F.col("y0")) / F.col("cell_size") - 0.5 + d).cast("int") for y, d in ((low, 0.0), (high, 1.0)))
    e = e.withColumns({"_first": F.greatest(F.lit(0), first), "_last": F.least(F.col("rows") - 1, last)}).where("_first <= _last")
    e = e.withColumn("row", F.explode(F.expr("sequence(_first, _last)"))).withColumn("y", F.expr(center("y0", "row", "cell_size")))
    e = e.where("(y1 > y) != (y2 > y)").withColumn("at", F.expr("(x2 - x1) * (y - y1) / (y2 - y1) + x1"))
    return _between_crossings(e, ["layer", "grid_id"])


def run_cells(runs: DataFrame, *names: str) -> DataFrame:
    """A row per cell of runs(names, row, c0, c1): names, row, col."""
    return runs.select(*names, "row", F.explode(F.expr("sequence(c0, c1)")).alias("col"))


def cells_in_layers(grid: Grid, vertices: DataFrame) -> DataFrame:
    """layer, row, col, x, y of the cells in each layer."""
    return grid.placed(run_cells(layer_runs(vertices, grid), "layer"))


def points_in_layers(cells: DataFrame, vertices: DataFrame, y0: float, cell: float) -> DataFrame:
    """The same for cells(row, y, x, ...) of any kind, point by point: a join on grid rows, in which edges meet only the cells of rows that they cross."""
    e = edges(vertices)
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    band = F.sequence(F.floor((low - y0) / cell).cast("int"), F.floor((high - y0) / cell).cast("int"))
    e = e.select("layer", "x1", "y1", "x2", "y2", F.explode(band).alias("row"))
    at = F.expr("try_divide((x2 - x1) * (y - y1), y2 - y1) + x1")
    hit = cells.join(e, "row").where(((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))) & (F.col("x") < at))
    return hit.groupBy("layer", *cells.columns).agg(F.count("*").alias("n")).where("n % 2 = 1").drop("n")


def depth_of_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row, c0, c1, depth: disjoint runs and how many of the given ones lie over them, by a sweep over their ends."""
    ends = runs.select(*keys, "row", F.explode(F.array(F.struct(F.col("c0").alias("at"), F.lit(1).alias("d")), F.struct((F.col("c1") + 1).alias("at"), F.lit(-1).alias("d")))).alias("e"))
    ends = ends.groupBy(*keys, "row", F.col("e.at").alias("c0")).agg(F.sum("e.d").alias("_d"))  # no more than columns in a row, however many runs
    w = Window.partitionBy(*keys, "row").orderBy("c0")
    swept = ends.select(*keys, "row", "c0", (F.lead("c0").over(w) - 1).alias("c1"), F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("depth"))
    return swept.where("depth > 0")


def densify(vertices: DataFrame, longest: float) -> DataFrame:
    """Boundary points at most `longest` apart; vertices alone if it is not positive. The closing point stays."""
    e = edges(vertices)
    pieces = F.greatest(F.lit(1), F.ceil(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) / longest)) if longest > 0 else F.lit(1)
    e = e.withColumn("n", pieces.cast("int")).withColumn("k", F.explode(F.expr("sequence(0, n - 1)")))
    t = F.col("k") / F.col("n")
    start = e.select("layer", "part", "ring", (F.col("seq") + t).alias("at"), (F.col("x1") + t * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + t * (F.col("y2") - F.col("y1"))).alias("y"))
    last = vertices.groupBy("layer", "part", "ring").agg(F.max_by(F.struct(F.col("seq").cast("double").alias("at"), "x", "y"), "seq").alias("p")).select("layer", "part", "ring", "p.*")
    return start.unionByName(last)


def boundary_offsets(vertices: DataFrame, stats: DataFrame, longest: float) -> DataFrame:
    """layer, dx, dy: boundary points about the layer's centroid, each once to nine places."""
    p = densify(vertices, longest).join(stats.select("layer", F.col("x").alias("cx"), F.col("y").alias("cy")), "layer")
    p = p.select("layer", (F.col("x") - F.col("cx")).alias("dx"), (F.col("y") - F.col("cy")).alias("dy"))
    keyed = p.withColumns({"kx": F.round("dx", 9), "ky": F.round("dy", 9)})
    return keyed.groupBy("layer", "kx", "ky").agg(F.min(F.struct("dx", "dy")).alias("d")).select("layer", "d.dx", "d.dy")


def _ceil(x: float) -> int:
    return max(1, int(-(-x // 1)))


def flat_index(row: Column, col: Column, cols: int) -> Column:
    return row.cast("long") * cols + col


def from_flat_index(index: Column, cols: int) -> tuple[Column, Column]:
    return F.floor(index / cols).cast("int"), F.pmod(index, F.lit(cols)).cast("int")


def standing_runs(domain: DataFrame, offsets: DataFrame, grid: Grid) -> DataFrame:
    """watershed, row, c0, c1: cells on which its centroid may stand: all its boundary points, moved along, lie in the domain.

    A boundary point (dx, dy) allows, in each grid row, the cells under the domain's scanline at that row's y + dy, moved by -dx.
    Cells that all points allow are the standing ones, found by counting runs. Points and edges meet by bands of one
    cell's height, so the work is points x rows x the edges of a band.
    """
    e = grid.on(edges(domain))
    band = lambda y: F.floor((y - F.col("y0")) / F.col("cell_size")).cast("int")
    e = e.select("x1", "y1", "x2", "y2", F.explode(F.sequence(band(F.least("y1", "y2")), band(F.greatest("y1", "y2")))).alias("band"))
    p = offsets.select(F.col("layer").alias("watershed"), "dx", "dy")
    p = grid.on(p)
    p = p.withColumn("row", F.explode(F.expr("sequence(0, rows - 1)")))
    p = p.withColumn("y", F.expr(f"{center('y0', 'row', 'cell_size')} + dy")).withColumn("band", band(F.col("y")))
    hit = p.join(e, "band").where("(y1 > y) != (y2 > y)").withColumn("at", F.expr("(x2 - x1) * (y - y1) / (y2 - y1) + x1"))
    allowed = _between_crossings(hit, ["watershed", "dx", "dy"], " + dx")
    need = offsets.groupBy(F.col("layer").alias("watershed")).agg(F.count("*").alias("need"))
    deep = depth_of_runs(allowed, ["watershed"]).join(need, "watershed").where("depth = need")
    return deep.select("watershed", "row", "c0", "c1")


def valid_runs(domain_runs: DataFrame, region: DataFrame, centers: DataFrame, stats: DataFrame, grid: Grid) -> DataFrame:
    """watershed, storm_path, row, c0, c1, before, count: the cells P to which the storm's centre may be moved, as runs.

    Moving centre C to P moves the watershed's centroid c, seen from the storm, to c + C - P: its nearest cell must be one where
    the watershed may stand, and P a cell of the domain. So a run of standing cells is turned round and shifted as a whole,
    once for each storm, and met with the domain's runs of that row. before: cells of earlier runs in order of (row, c0);
    count: cells of the storm.
    """
    places = stats.select(F.col("layer").alias("watershed"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    pairs = centers.select("storm_path", F.col("x").alias("sx"), F.col("y").alias("sy")).crossJoin(places)  # every storm for every watershed: the question itself
    to = lambda i, c, s, o: f"CAST(rint(({c} + {s} - {center(o, i, 'cell_size')}) / cell_size - ({o} / cell_size + 5e-1)) AS INT)"
    p = grid.on(region.select("watershed", F.col("row").alias("r"), F.col("c0").alias("r0"), F.col("c1").alias("r1")).join(pairs, "watershed"))
    near = "CAST(rint((cy + sy - 2e0 * y0) / cell_size - 1e0) AS INT) - r"
    p = p.withColumn("row", F.explode(F.expr(f"filter(sequence({near} - 2, {near} + 2), row -> row >= 0 AND row < rows AND {to('row', 'cy', 'sy', 'y0')} = r)")))
    middle = "CAST(rint((cx + sx - 2e0 * x0) / cell_size - 1e0) AS INT)"
    col = lambda i: to(f"({i})", "cx", "sx", "x0")
    # the column's image falls as the column rises: ends are guessed and set right within two cells, by the image itself
    least = f"array_min(filter(sequence({middle} - r1 - 2, {middle} - r1 + 2), i -> {col('i')} <= r1))"
    most = f"array_max(filter(sequence({middle} - r0 - 2, {middle} - r0 + 2), i -> {col('i')} >= r0))"
    p = p.select("watershed", "storm_path", "row", F.expr(least).alias("a"), F.expr(most).alias("b")).where("a <= b")
    met = p.join(domain_runs.select("row", "c0", "c1"), "row")
    met = met.select("watershed", "storm_path", "row", F.greatest("a", "c0").alias("c0"), F.least("b", "c1").alias("c1")).where("c0 <= c1")
    return numbered_runs(met, ["watershed", "storm_path"])


def numbered_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """runs with before, the cells of earlier runs of the group, and count, all its cells."""
    w = Window.partitionBy(*keys)
    size = (F.col("c1") - F.col("c0") + 1).cast("long")
    before = F.coalesce(F.sum(size).over(w.orderBy("row", "c0").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return runs.select(*keys, "row", "c0", "c1", before.alias("before"), F.sum(size).over(w).alias("count"))
