"""Tables that grow: what the driver must not collect, what must not depend on the order of rows."""

import math
import re

from pyspark.sql import functions as F

from stormshift.functions import scalars
from stormshift.operators import align, curves, depth, draw, fields
from stormshift.operators.geometry import Grid
from stormshift.operators.proposal import Proposal
from stormshift.plans import prepare, study
from stormshift.sources.store import dealt, snapshot


def events_of(spark, n=1000):
    e = spark.range(n).select(F.lit("a").alias("watershed"), F.lit("s").alias("scenario"), F.lit(1).alias("realization"), (F.col("id") + 1).cast("int").alias("event_id"), F.lit("storm_1").alias("storm_path"))
    return e.withColumns({"newx": F.lit(2.0), "newy": F.lit(3.0), "weight": F.lit(1.0 / n)})


def test_no_growing_table_is_broadcast(spark):
    """Read-back tables are small on disk; Spark's guess from their files must not send them to the driver."""
    events = snapshot(events_of(spark), "events")
    storms = snapshot(spark.createDataFrame([("storm_1", 0.0, 0.0, "g", 1.0)], "storm_path string, x double, y double, grid_id string, cell_size double"), "storms")
    mask = spark.createDataFrame([("a", "g", 3, 1, 2)], "watershed string, grid_id string, row int, c0 int, c1 int")
    rows = snapshot(spark.createDataFrame([("storm_1", 0, -1, [1.0, 3.0], [1, 2])], "storm_path string, row int, first int, ps array<double>, seen array<int>"), "rows")
    placed = draw.with_shifts(events, storms)
    runs = snapshot(spark.createDataFrame([("a", "storm_1", 0, 0, 9, 0, 10)], "watershed string, storm_path string, row int, c0 int, c1 int, before long, count long"), "runs")
    weighed = snapshot(spark.createDataFrame([("a", "s", "storm_1", 0, 0, 0.0, 1.0, 1.0, 1, 1.0, 0.5, 0.5)], "watershed string, scenario string, storm_path string, row int, col int, lo double, hi double, mass double, count long, q double, x double, y double"), "weighed")
    for df in (placed, draw.draw_weighted_cells(events, weighed, F.lit(0.5)), draw.drawable_storms(runs, storms)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    means = depth.mean_depths_by_runs(placed, mask, rows)
    assert means._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") <= 1  # the mask
    assert [r.precip_avg_mm for r in means.collect()] == [1.5]


def test_totals_do_not_depend_on_the_order_of_rows(spark):
    """0.1 + 0.2 + 0.3 is not 0.3 + 0.2 + 0.1 in floating point; the first of two equal cells must be the centre in any order."""
    rows = [("s", f"r{i}", 0, col, v, 0.0, 0.0, 1.0) for col, vs in ((0, (0.1, 0.2, 0.3)), (1, (0.3, 0.2, 0.1))) for i, v in enumerate(vs)]
    names = "storm_path string, record string, row int, col int, value double, ll_x double, ll_y double, cell_size double"
    for each in (rows, rows[::-1]):
        c = fields.cumulative(spark.createDataFrame(each, names).coalesce(1))
        assert len({r.precip_mm for r in c.collect()}) == 1
        assert fields.storm_centers(c).first().x == 0.5
    odd = [("s", "r", 0, i, v, 0.0, 0.0, 1.0) for i, v in enumerate((None, float("inf"), float("nan"), 1e30))]
    got = {r.col: r.precip_mm for r in fields.cumulative(spark.createDataFrame(odd, names)).collect()}
    assert got[0] == 0.0 and got[1] == float("inf") and got[2] != got[2] and got[3] == 1e30


def test_alignment_deals_its_source_by_size(spark, monkeypatch):
    """Tasks grow with the source, so that the memory of one does not."""
    monkeypatch.setattr(align, "CELLS_PER_TASK", 8)
    cells = spark.sql("SELECT concat('s', s) AS storm_path, x + 5e-1 AS x, y + 5e-1 AS y, CAST(10 * s + x + y AS DOUBLE) AS precip_mm FROM (SELECT explode(sequence(1, 8)) AS s), (SELECT explode(sequence(0, 1)) AS x), (SELECT explode(sequence(0, 1)) AS y)")
    grid = spark.createDataFrame([(0, 0, 1.0, 1.0), (0, 1, 0.5, 1.5)], "row int, col int, x double, y double")
    out = align.align(cells, grid, "linear")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(storm_path" in plan and ", 5)" in plan.split("hashpartitioning(storm_path", 1)[1][:40]
    assert {(r.storm_path, r.col): r.precip_mm for r in out.collect()} == {(f"s{s}", c): 10 * s + 1.0 for s in range(1, 9) for c in (0, 1)}


def test_masses_do_not_depend_on_the_order_of_adding(spark):
    """Sums of doubles differ in their last bits between engines; masses are whole units of the densest cell, the same however they are added."""
    n = 300
    valid = spark.createDataFrame([("a", "storm_1", 0, 0, n - 1, 0, n)], "watershed string, storm_path string, row int, c0 int, c1 int, before long, count long")
    q = [1e-10 / (1 + 0.37 * i) ** 2 for i in range(n)]
    density = spark.createDataFrame([("a", "s", 0, i, x, x, x) for i, x in enumerate(q)], "watershed string, scenario string, row int, col int, q double, q_narrow double, q_wide double")
    got = {r.col: r for r in draw.weigh_cells(valid, density, Grid.over(0, 0, n, 1, 1.0)).collect()}
    top, scale = max(q), 2.0**62 / n
    units = [math.floor(x / top * scale) for x in q]
    mass = lambda u: u / scale * top
    for i in range(n):
        assert (got[i].lo, got[i].hi, got[i].mass) == (mass(sum(units[:i])), mass(sum(units[: i + 1])), mass(sum(units)))
    assert abs(got[0].mass - math.fsum(q)) < 1e-14 * math.fsum(q)


def test_densities_end_before_the_bits_that_engines_differ_in(spark):
    x = spark.createDataFrame([(1.0,), (0.1,), (math.nextafter(0.1, 1.0),), (3.7e-10,), (1e-300,), (1e301,)], "q double")
    got = [r[0] for r in x.select(F.expr(scalars.short("q"))).collect()]
    assert got[0] == 1.0 and got[1] == got[2] and got[5] == 1e301
    for want, value in zip((1.0, 0.1, 0.1, 3.7e-10, 1e-300), got):
        assert abs(value - want) <= 2.0**-32 * want and (math.frexp(value)[0] * 2**32).is_integer()


def test_plans_of_a_study_are_cut(spark):
    """A plan that holds the steps before it, once for each time it reads them, fills the driver's memory: one of m6 had 49 scans, each with broadcasts of its own."""
    cells = spark.sql("SELECT 'storm_1' AS storm_path, 'SHG PRECIPITATION' AS record, r AS row, c AS col, CAST(r + c AS DOUBLE) AS value, 0e0 AS ll_x, 0e0 AS ll_y, 1e0 AS cell_size FROM (SELECT explode(sequence(0, 5)) AS r), (SELECT explode(sequence(0, 5)) AS c)")
    ring = lambda name, a, b: [(name, 0, 0, i, x, y) for i, (x, y) in enumerate(((a, a), (b, a), (b, b), (a, b), (a, a)))]
    domain, shed = (spark.createDataFrame(ring(*x), "layer string, part int, ring int, seq int, x double, y double") for x in (("domain", 0.0, 6.0), ("a", 2.0, 4.0)))
    catalog = prepare.prepare_catalog(cells, domain, shed, 1.0, 1.0).written()
    scans = lambda df: df._jdf.queryExecution().executedPlan().toString().count("FileScan")
    events = study.sample_events(catalog, {"u": Proposal(), "g": Proposal("gaussian", sd_x=2.0, sd_y=2.0)}, {"u": (50, 2), "g": (40, 2)})
    assert scans(events) == 4  # drawn events of both kinds, and the sums of their weights
    events = snapshot(events, "events")
    depths = study.evaluate_depths(events, catalog)
    assert scans(depths) == 3  # events, places of storms, means
    summary = curves.summarize(depths)
    assert scans(summary) == 3  # depths for the curves, for the longest period, and for the census
    assert depths.count() == 180 and {(r.scenario, r.n_realizations, r.n_samples_per_realization) for r in summary.collect()} == {("u", 2, 50), ("g", 2, 40)}


def test_files_of_many_storms_are_written_by_many_tasks(spark):
    """Spark puts small partitions together by their bytes, but a task's work is the number of files that it writes."""
    storms = spark.range(64).select(F.concat(F.lit("storm_"), "id").alias("storm_path"))
    assert dealt(storms, "storm_path").select(F.spark_partition_id()).distinct().count() == 4
    assert storms.repartition("storm_path").select(F.spark_partition_id()).distinct().count() == 1


def same_place_study(spark, storms=5):
    """A catalog of storms with one centre and one with another, and its domain of 6 by 6 cells."""
    wet = "CASE WHEN s = 1 THEN r = 2 AND c = 2 ELSE r = 3 AND c = 3 END"
    cells = spark.sql(f"SELECT concat('storm_', s) AS storm_path, 'SHG PRECIPITATION' AS record, r AS row, c AS col, CAST(r + c + s + IF({wet}, 50, 0) AS DOUBLE) AS value, 0e0 AS ll_x, 0e0 AS ll_y, 1e0 AS cell_size FROM (SELECT explode(sequence(1, {storms})) AS s), (SELECT explode(sequence(0, 5)) AS r), (SELECT explode(sequence(0, 5)) AS c)")
    ring = lambda name, a, b: [(name, 0, 0, i, x, y) for i, (x, y) in enumerate(((a, a), (b, a), (b, b), (a, b), (a, a)))]
    domain, shed = (spark.createDataFrame(ring(*x), "layer string, part int, ring int, seq int, x double, y double") for x in (("domain", 0.0, 6.0), ("a", 2.0, 4.0)))
    return prepare.prepare_catalog(cells, domain, shed, 1.0, 1.0).written()


def test_storms_that_may_go_to_the_same_cells_share_them(spark):
    """Cells with their masses, and the buckets they are drawn by, were written once for each storm and scenario; they hang on its centre alone."""
    catalog = same_place_study(spark)
    like = {r.storm_path: (r.like, r["count"]) for r in catalog.alike_storms.collect()}
    assert {n: x[0] for n, x in like.items()} == {"storm_1": "storm_1"} | {f"storm_{i}": "storm_2" for i in range(2, 6)}
    own = {r.storm_path: r["count"] for r in catalog.valid_runs.select("storm_path", "count").distinct().collect()}
    assert {n: x[1] for n, x in like.items()} == own
    assert {r.storm_path for r in catalog.shared_runs.select("storm_path").distinct().collect()} == {"storm_1", "storm_2"}
    proposals = {"u": Proposal(), "g": Proposal("gaussian", sd_x=2.0, sd_y=2.0)}
    got = study.sample_events(catalog, proposals, {"u": (300, 2), "g": (300, 2)})
    assert got.count() == 1200 and {r.storm_path for r in got.collect()} == set(own)
    valid = catalog.valid_cells.select("storm_path", F.col("x").alias("newx"), F.col("y").alias("newy"))
    assert got.join(valid, ["storm_path", "newx", "newy"], "left_semi").count() == 1200
    # each storm's own cells and densities give the same draws
    plan = study.sampling_plan(catalog, {"g": (300, 2)})
    rows = study.proposal.components({"g": proposals["g"]}, catalog.layer_stats.where("layer = 'a'"))
    weighed, u = study.weighed_cells(catalog, rows), draw.hashed(0)
    e = draw.draw_storms(draw.generate(plan, 0), draw.drawable_storms(catalog.live_runs, catalog.storm_centers), u(1)).withColumn("u", u(2))
    plain = e.join(weighed.withColumnsRenamed({"x": "newx", "y": "newy"}), ["watershed", "scenario", "storm_path"]).where("lo <= u * mass and u * mass < hi")
    names = ["realization", "event_id", "storm_path", "newx", "newy"]
    plain, drawn = plain.select(*names), got.where("scenario = 'g'").select(*names)
    assert plain.count() == 600 and drawn.exceptAll(plain).isEmpty()


def test_no_shift_is_shuffled_to_be_looked_up(spark):
    """A run or a cell of the mask was a row of two shuffles; rows of storms are bucketed by storm, by which shifts are dealt already."""
    catalog = same_place_study(spark)
    shifts = study.placed(snapshot(events_of(spark), "events"), catalog)
    for means in (depth.mean_depths_by_runs(shifts, catalog.watershed_mask, catalog.storm_rows), depth.mean_depths(shifts, catalog.mask_cells, catalog.storm_cells)):
        plan = means._jdf.queryExecution().executedPlan().toString()
        exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
        assert sum("storm_path" in x for x in exchanges) == 2  # events and places of storms, to be placed
        assert not any("dy" in x or "row" in x for x in exchanges)
        assert [r.precip_avg_mm for r in means.collect()]


def test_curves_keep_what_reaches_the_least_period(spark):
    """Nine of ten events come more often than every other year, and were shuffled twice."""
    exc = [0.001, 0.01, 0.03, 0.05, 0.0693, 0.0694, 0.0694, 0.2, 0.9]
    rows = [("a", k, float(100 - i), x) for k in (1, 2) for i, x in enumerate(exc)] + [("a", 3, 7.0, 0.5)]
    d = spark.createDataFrame(rows, "watershed string, realization int, precip_avg_mm double, exc_prb double")
    every, kept = curves.curve_points(d, ["watershed"]), curves.curve_points(d, ["watershed"], rp_min=2)
    assert every.count() == 2 * 8 + 1 and kept.count() == 2 * 6 + 1
    assert max(r.depth_in for r in kept.where("realization = 1 and RP < 2").collect()) == 95.0 / 25.4  # the deepest of two of one period
    for common in (True, False):
        top = [curves.top_period(p, ["watershed"], 2, 2000, common) for p in (every, kept)]
        a, b = (sorted(map(tuple, curves.interpolate(p, ["watershed"], 2, t).collect())) for p, t in zip((every, kept), top))
        assert a == b and (common or a)


def test_depths_that_nobody_ranks_are_not_ranked(spark, monkeypatch):
    """A sweep ranked the largest sample, dropped the ranks, and ranked its parts."""
    catalog = same_place_study(spark)
    calls, plain = [], depth.exceedance_by_size
    monkeypatch.setattr(depth, "exceedance_by_size", lambda *a, **k: calls.append(1) or plain(*a, **k))
    base = spark.createDataFrame([("a", 2, *[1.0] * 6)], "watershed string, RP int, " + ", ".join(f"{s}_in double" for s in curves.STATISTICS))
    out = study.sweep(catalog, Proposal("gaussian", sd_x=2.0, sd_y=2.0), [40, 80], 2, base, 100)
    assert {r.num_simulations for r in out.collect()} == {40, 80} and len(calls) == 1


def test_events_are_generated_by_many_tasks(spark):
    """Runs of events are a few bytes each, so Spark put them together, and one task made millions of events."""
    plan = spark.createDataFrame([("a", "s", 200_000, 2)], "watershed string, scenario string, n long, realizations long")
    events = draw.generate(plan)
    assert events.select(F.spark_partition_id()).distinct().count() == 4
    assert events.count() == 400_000 and events.select("realization", "event_id").distinct().count() == 400_000
