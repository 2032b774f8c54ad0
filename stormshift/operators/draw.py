"""Drawing events: uniforms, storms, cells and weights.

Tables per storm, scenario or realization grow with the study, so no join here broadcasts them; only the row per watershed is sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormshift.operators.geometry import Grid, run_cells
from stormshift.sources.store import dealt, growing

KEYS = ["watershed", "scenario"]
RUN = 5_000
#: More than a share of the mass can change by rounding.
ROUNDING = 1e-14


def hashed(seed: int) -> Callable[[int], Column]:
    """Uniforms in [0, 1) from a counter: the same for any partitioning. One stream per use."""
    return lambda stream: F.shiftrightunsigned(F.xxhash64(F.lit(seed), "watershed", "scenario", "realization", "event_id", F.lit(stream)), 11) * F.lit(2.0**-53)


def portable(part: int = 0) -> Callable[[int], Column]:
    """Uniforms by two rounds of a Lehmer generator, in integer arithmetic that every SQL engine has; for checks.

    Each watershed and scenario starts at a place of its own, by the first letters of their names, and so does each part of
    a study that draws several times.
    """
    at = f"((realization - 1) * n + event_id - 1 + {50_000_017 * part}L + 1000003L * (131 * ascii(scenario) + ascii(watershed)))"
    draws = {1: (48271, 82166, 16807), 2: (69621, 95028, 39373)}

    def stream(k: int) -> Column:
        a, c, m = draws[k]
        return F.expr(f"CAST(((({at} * {a}L + {c}L) % 2147483647L) * {m}L) % 2147483647L AS DOUBLE) / 2147483647e0")

    return stream


def generate(plan: DataFrame, seed: int = 0) -> DataFrame:
    """plan(watershed, scenario, n, realizations) -> an event per row: n events in each realization, numbered from 1."""
    r = plan.withColumn("realization", F.explode(F.expr("sequence(1, CAST(realizations AS INT))")))
    # in runs of RUN events, so that neither an array nor a task holds a whole realization
    r = r.withColumn("_run", F.explode(F.expr(f"sequence(0L, greatest(0L, (CAST(n AS BIGINT) - 1) div {RUN}))"))).where("n > 0")
    r = r.withColumn("realization_seed", F.xxhash64(F.lit(seed), "watershed", "scenario", "realization"))
    r = dealt(r, *KEYS, "realization", "_run")  # by a given number of tasks, as the runs are few bytes but many events
    events = F.expr(f"sequence(CAST(_run * {RUN} + 1 AS INT), CAST(least(n, (_run + 1) * {RUN}) AS INT))")
    return r.select(*KEYS, "n", "realization", "realization_seed", F.explode(events).alias("event_id"))


def require_rows(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(message)
    return df


def drawable_storms(valid: DataFrame, centers: DataFrame) -> DataFrame:
    """watershed, storm_path, x, y, index from 0, storms: the storms that have a centre and a valid cell."""
    live = valid.select("watershed", "storm_path").distinct().join(growing(centers.select("storm_path", "x", "y")), "storm_path")
    w = Window.partitionBy("watershed")
    return live.select("watershed", "storm_path", "x", "y", (F.row_number().over(w.orderBy("storm_path")) - 1).cast("int").alias("index"), F.count("*").over(w).alias("storms"))


def alike(valid: DataFrame) -> DataFrame:
    """watershed, storm_path, like, count, _runs: for each storm the first, by name, of those with the very same valid runs, and how many cells and runs these are.

    What a storm may be moved to hangs on its centre alone, so storms on one grid have no more sets of valid cells than the grid has cells.
    """
    runs = F.array_sort(F.collect_list(F.struct("row", "c0", "c1"))).cast("string")
    each = valid.groupBy("watershed", "storm_path").agg(F.sha2(runs, 256).alias("_set"), F.first("count").alias("count"), F.count("*").alias("_runs"))
    return each.withColumn("like", F.min("storm_path").over(Window.partitionBy("watershed", "_set"))).select("watershed", "storm_path", "like", "count", "_runs")


def weigh_cells(valid: DataFrame, density: DataFrame, grid: Grid) -> DataFrame:
    """Cells of valid runs for each scenario, with the densities, the running mass (lo, hi] and mass of their storm, its count, and rank.

    Mass is added in whole units, 2^62 / count of them for the storm's densest cell: as fine as doubles are, but a total that the order
    of adding does not change, and that stays below 2^63.
    """
    cells = grid.placed(run_cells(valid, "watershed", "storm_path", "c0", "before", "count"))
    cells = cells.withColumn("rank", F.col("before") + F.col("col") - F.col("c0")).drop("c0", "before")
    cells = cells.join(density.hint("shuffle_hash"), ["watershed", "row", "col"])  # no more rows than the grid has cells, for each scenario
    w = Window.partitionBy(*KEYS, "storm_path")
    cells = cells.withColumn("_top", F.max("q").over(w)).withColumn("_scale", F.lit(2.0**62) / F.col("count"))
    cells = cells.withColumn("_units", F.floor(F.col("q") / F.col("_top") * F.col("_scale")))
    upto = F.sum("_units").over(w.orderBy("row", "col").rowsBetween(Window.unboundedPreceding, 0))
    cells = cells.withColumns({"_upto": upto, "_total": F.sum("_units").over(w)})
    mass = lambda units: units / F.col("_scale") * F.col("_top")
    cells = cells.withColumns({"hi": mass(F.col("_upto")), "lo": mass(F.col("_upto") - F.col("_units")), "mass": mass(F.col("_total"))})
    return cells.drop("_top", "_scale", "_units", "_upto", "_total")


def draw_storms(events: DataFrame, storms: DataFrame, u: Column) -> DataFrame:
    """Every storm equally likely."""
    sizes = storms.groupBy("watershed").agg(F.max("storms").alias("storms"))
    e = events.join(F.broadcast(sizes), "watershed").withColumn("index", F.floor(u * F.col("storms")).cast("int"))
    return e.drop("storms").join(growing(storms.drop("storms")), ["watershed", "index"]).drop("index")


def draw_uniform_cells(events: DataFrame, valid: DataFrame, u: Column, grid: Grid) -> DataFrame:
    """The floor(u count)-th valid cell of the event's storm, found in its runs by their counts.

    A storm's ranks are cut into as many equal buckets as it has runs; a run lies under the buckets that it reaches into, twice as
    many rows as runs at most, and an event meets the few runs of its bucket. Events may hold count and _runs, see alike.
    """
    sizes = valid.groupBy("watershed", "storm_path").agg(F.first("count").alias("count"), F.count("*").alias("_runs"))
    bucket = lambda k: f"({k}) * _runs div count"
    runs = valid.select("watershed", "storm_path", "row", "c0", "before", (F.col("c1") - F.col("c0") + 1).alias("_size")).join(growing(sizes), ["watershed", "storm_path"])
    runs = runs.withColumn("_bucket", F.explode(F.expr(f"sequence({bucket('before')}, {bucket('before + _size - 1')})"))).drop("_runs", "count")
    e = events if "_runs" in events.columns else events.join(growing(sizes), ["watershed", "storm_path"])
    e = e.withColumn("_k", F.floor(u * F.col("count"))).withColumn("_bucket", F.expr(bucket("_k")))
    e = e.join(growing(runs), ["watershed", "storm_path", "_bucket"]).where("before <= _k and _k < before + _size")
    e = e.withColumn("col", F.expr("CAST(c0 + _k - before AS INT)"))
    e = grid.placed(e.withColumnsRenamed({"x": "_x", "y": "_y"})).withColumnsRenamed({"x": "newx", "y": "newy", "_x": "x", "_y": "y"})
    return e.withColumns({"q": F.lit(1.0), "mass": F.col("count").cast("double")}).drop("_k", "_bucket", "_runs", "_size", "before", "c0", "row", "col")


def guide_table(weighed: DataFrame) -> DataFrame:
    """Cells under the buckets of equal mass that they reach into, and that rounding may reach: hardly more than twice as many rows as cells."""
    to = lambda c, of: F.expr(f"CAST(least(floor({c} / mass * count * {of!r}), count - 1) AS LONG)")
    return weighed.withColumn("_bucket", F.explode(F.sequence(to("lo", 1 - ROUNDING), to("hi", 1 + ROUNDING))))


def draw_weighted_cells(events: DataFrame, weighed: DataFrame, u: Column) -> DataFrame:
    """The cell whose running mass holds u times the storm's mass: an equi-join on the bucket, not a range join. Events may hold count, see alike."""
    if "count" not in events.columns:
        events = events.join(growing(weighed.groupBy(*KEYS, "storm_path").agg(F.first("count").alias("count"))), [*KEYS, "storm_path"])
    e = events.withColumn("_u", u).withColumn("_bucket", F.expr("CAST(least(floor(_u * count), count - 1) AS LONG)")).drop("count")
    own = [c for c in ("q_narrow", "q_wide") if c in weighed.columns]
    cells = guide_table(weighed).select(*KEYS, "storm_path", "_bucket", "lo", "hi", F.col("x").alias("newx"), F.col("y").alias("newy"), "row", "col", "q", "mass", "count", *own)
    return e.join(growing(cells), [*KEYS, "storm_path", "_bucket"]).where("lo <= _u * mass and _u * mass < hi").drop("_bucket", "_u", "lo", "hi")


def with_weights(events: DataFrame, fallback: bool = False) -> DataFrame:
    """weight_raw = mass / (count q), and weight, which sums to 1 in each realization.

    A realization whose sum is not positive and finite is an error, or falls back to equal weights.
    """
    e = events.withColumn("weight_raw", F.col("mass") / (F.col("count") * F.col("q")))
    sums = e.groupBy(*KEYS, "realization").agg(F.sum("weight_raw").alias("_sum"), F.count("*").alias("_n"))
    ok = (F.col("_sum") > 0) & (F.col("_sum") < F.lit(float("inf")))
    even = F.lit(1.0) / F.col("_n") if fallback else F.raise_error(F.lit("weights of a realization have no positive, finite sum"))
    return e.join(sums, [*KEYS, "realization"]).withColumn("weight", F.when(ok, F.expr("try_divide(weight_raw, _sum)")).otherwise(even)).drop("_sum", "_n")


def with_shifts(events: DataFrame, storms: DataFrame) -> DataFrame:
    """Events with grid_id and the shift of their storm in whole cells of its grid, half to even. storms(storm_path, x, y, grid_id, cell_size)."""
    at = storms.select("storm_path", "grid_id", "cell_size", F.col("x").alias("_x"), F.col("y").alias("_y"))
    e = events.join(growing(at), "storm_path")
    shift = lambda to, of: F.rint((F.col(to) - F.col(of)) / F.col("cell_size")).cast("int")
    return e.withColumns({"dx": shift("newx", "_x"), "dy": shift("newy", "_y")}).drop("_x", "_y", "cell_size")
