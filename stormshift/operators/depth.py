"""Depth of moved storms over watersheds, and exceedance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormshift.sources.store import growing, snapshot

PLACE = ["watershed", "storm_path", "dy", "dx"]


def _rows_met(shifts: DataFrame, mask: DataFrame, size: Column, rows: DataFrame) -> DataFrame:
    """Each distinct shift, and how many cells its mask has (`size` of mask's rows), with its storm's rows that come to lie on the mask's and what mask has there, or nulls.

    Rows meet shifts by storm alone, and the mask is looked up beside them, so neither shifts nor lookups are shuffled where rows are bucketed by storm.
    """
    spans = mask.groupBy("watershed", "grid_id").agg(size.alias("cells"), F.min("row").alias("_low"), F.max("row").alias("_high"))
    wanted = shifts.select(*PLACE, "grid_id").distinct().join(spans, ["watershed", "grid_id"])
    on = (F.col("storm_path") == F.col("_storm")) & (F.col("_row") + F.col("dy")).between(F.col("_low"), F.col("_high"))
    met = wanted.join(growing(rows.withColumnsRenamed({"storm_path": "_storm", "row": "_row"})), on, "left").withColumn("row", F.col("_row") + F.col("dy"))
    return met.drop("_storm", "_row", "_low", "_high").join(mask, ["watershed", "grid_id", "row"], "left")


def mean_depths(shifts: DataFrame, mask: DataFrame, storm_cells: DataFrame, zero_pad: bool = True) -> DataFrame:
    """precip_avg_mm for each distinct (watershed, storm_path, dy, dx), cell by cell of mask(watershed, grid_id, row, col).

    Rows and columns are those of the storm's own grid, on which the mask was cut. Moving a storm by (dy, dx) puts its cell
    (r - dy, c - dx) on cell (r, c) of the watershed. A cell off the storm's grid is 0; without zero_pad, one missing cell
    makes the mean missing.
    """
    rows = storm_cells.groupBy("storm_path", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "precip_mm"))).alias("_own"))
    found = _rows_met(shifts, mask, F.count("*"), rows)
    found = found.withColumn("precip_mm", F.expr("_own[col - dx]"))
    total = found.groupBy(*PLACE, "cells").agg(F.sum("precip_mm").alias("total"), F.count("precip_mm").alias("seen"))
    mean = F.coalesce("total", F.lit(0.0)) / F.col("cells")
    return total.select(*PLACE, (mean if zero_pad else F.when(F.col("seen") == F.col("cells"), mean)).alias("precip_avg_mm"))


def running_rows(storm_cells: DataFrame) -> DataFrame:
    """storm_path, row, first, ps, seen: of each row of a storm, from its first cell on to its last, precipitation up to and with each column, and cells that have one."""
    w = Window.partitionBy("storm_path", "row").orderBy("col")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    cells = storm_cells.select(
        "storm_path", "row", "col", F.sum(F.coalesce("precip_mm", F.lit(0.0))).over(upto).alias("p"), F.count("precip_mm").over(upto).cast("int").alias("n"),
        F.coalesce(F.lead("col").over(w) - F.col("col"), F.lit(1)).alias("wide"),
    )
    rows = cells.groupBy("storm_path", "row").agg(F.min("col").alias("first"), F.sort_array(F.collect_list(F.struct("col", "p", "n", "wide"))).alias("c"))
    filled = (F.expr(f"flatten(transform(c, x -> array_repeat(x.{key}, x.wide)))").alias(name) for name, key in (("ps", "p"), ("seen", "n")))
    return rows.select("storm_path", "row", "first", *filled)


def mean_depths_by_runs(shifts: DataFrame, mask: DataFrame, storm_rows: DataFrame, zero_pad: bool = True) -> DataFrame:
    """mean_depths by one lookup per run of mask(watershed, grid_id, row, c0, c1), in the running sums of the storm's row.

    shifts need the storm's grid_id. storm_rows is the side that stays in place if it is bucketed by storm.
    """
    found = _rows_met(shifts, mask, F.sum(F.col("c1") - F.col("c0") + 1), storm_rows)
    found = found.withColumns({"_before": F.col("c0") - F.col("dx") - 1, "_last": F.col("c1") - F.col("dx")})
    upto = lambda name, at: F.expr(f"CASE WHEN {at} < first OR {at} IS NULL OR first IS NULL THEN 0 ELSE {name}[least({at} - first, size({name}) - 1)] END")
    part = {name: upto(name, "_last") - upto(name, "_before") for name in ("ps", "seen")}
    total = found.groupBy(*PLACE, "cells").agg(F.sum(part["ps"]).alias("total"), F.sum(part["seen"]).alias("seen"))
    mean = F.col("total") / F.col("cells")
    return total.select(*PLACE, (mean if zero_pad else F.when(F.col("seen") == F.col("cells"), mean)).alias("precip_avg_mm"))


def exceedance(depths: DataFrame, keys: tuple = ("watershed", "scenario", "realization"), depth: str = "precip_avg_mm", weight: str = "weight", renormalize: bool = False) -> DataFrame:
    """exc_prb: weight of all events of the realization at least as deep, ties by event_id; none for a missing depth."""
    df = depths
    if renormalize:
        sums = df.groupBy(*keys).agg(F.sum(weight).alias("_sum"), F.count("*").alias("_n"))
        w = F.when(F.col("_sum") > 0, F.expr(f"try_divide({weight}, _sum)")).otherwise(1 / F.col("_n"))
        df = df.join(sums.hint("shuffle_hash"), list(keys)).withColumn("_w", w)
    else:
        df = df.withColumn("_w", F.col(weight))
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(depth), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("exc_prb", F.when(F.col(depth).isNotNull(), F.sum("_w").over(order))).select(*depths.columns, "exc_prb")


#: Events of a realization up to which one task sorts it.
ONE_TASK = 5_000_000


def exceedance_by_size(depths: DataFrame, events: DataFrame, keys: tuple = ("watershed", "scenario", "realization"), renormalize: bool = False, largest: int | None = None, **names) -> DataFrame:
    """exceedance, or the same by ranges where a realization of events, which depths come from, has more than ONE_TASK rows.

    largest: rows of the largest realization, where they are known; else they are counted.
    """
    if largest is None:
        largest = events.groupBy(*keys).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    if largest <= ONE_TASK:
        return exceedance(depths, keys, renormalize=renormalize, **names)
    weight = names.get("weight", "weight")
    if not renormalize:
        return exceedance_by_ranges(depths, max(64, 4 * largest // ONE_TASK), keys, **names)
    sums = depths.groupBy(*keys).agg(F.sum(weight).alias("_sum"), F.count("*").alias("_n"))
    scaled = depths.join(sums.hint("shuffle_hash"), list(keys)).withColumn("_weight", F.col(weight))
    scaled = scaled.withColumn(weight, F.when(F.col("_sum") > 0, F.expr(f"try_divide({weight}, _sum)")).otherwise(1 / F.col("_n"))).drop("_sum", "_n")
    out = exceedance_by_ranges(scaled, max(64, 4 * largest // ONE_TASK), keys, **names)
    return out.withColumn(weight, F.col("_weight")).drop("_weight")


def exceedance_by_ranges(depths: DataFrame, ranges: int = 256, keys: tuple = ("watershed", "scenario", "realization"), depth: str = "precip_avg_mm", weight: str = "weight") -> DataFrame:
    """exceedance for realizations too large for one task: a running sum inside ranges of the order, plus the weight of all ranges before.

    Events are dealt by ranges of (realization, depth, event), so a depth that many events share is split like any other,
    and event ids may be of any type that has an order. A task holds one range; offsets are a row for each realization and range.
    """
    keys = list(keys)
    order = [*keys, F.desc(depth), F.asc("event_id")]
    known = depths.where(F.col(depth).isNotNull()).repartitionByRange(ranges, *order)
    dealt = snapshot(known.withColumn("_p", F.spark_partition_id()), "ranges")  # read twice, and dealt once
    sums = dealt.groupBy(*keys, "_p").agg(F.sum(weight).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_p", F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_p").orderBy(F.desc(depth), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumn("_own", F.sum(weight).over(inside)).join(sums.hint("shuffle_hash"), [*keys, "_p"]).withColumn("exc_prb", F.col("_before") + F.col("_own"))
    missing = depths.where(F.col(depth).isNull()).withColumn("exc_prb", F.lit(None).cast("double"))
    return out.select(*depths.columns, "exc_prb").unionByName(missing)
