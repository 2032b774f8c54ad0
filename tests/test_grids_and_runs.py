"""Storms on grids of their own, sets of cells as runs, tails of distributions, memos, nested samples and selections, against plain models."""

import decimal
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stormshift.functions.normal import truncated
from stormshift.operators import curves, depth, draw, fields, geometry
from stormshift.operators.geometry import Grid
from stormshift.operators.proposal import Proposal
from stormshift.plans import study
from stormshift.plans.adapt import AdaptedProposals, Adaptation
from stormshift.plans.prepare import prepare_catalog
from stormshift.registry import QUERIES
from stormshift.sources.store import snapshot
from test_operators import RECORDS, VERTICES, grid_rows, ring

D = decimal.Decimal
#: No boundary point of the watershed can stand on the domain's edge, where parity is undecided.
DOMAIN = [(0.3, 0.3), (15.7, 0.3), (15.7, 9.1), (11.9, 11.7), (0.3, 11.7)]
SHED = [(4, 3), (8, 3), (8, 6), (6.2, 6), (6.2, 5), (4, 5)]


def tables(spark, corners):
    draw_ = np.random.default_rng(3)
    storms = {n: draw_.random((14, 18)) + 5 * np.exp(-((np.arange(14)[:, None] - 4 - i) ** 2 + (np.arange(18)[None] - 5 - i) ** 2) / 6) for i, n in enumerate(corners)}
    cells = spark.createDataFrame([r for n, f in storms.items() for r in grid_rows(n, f, *corners[n])], RECORDS)
    return storms, cells, spark.createDataFrame(ring("domain", DOMAIN), VERTICES), spark.createDataFrame(ring("w", SHED), VERTICES)


CORNERS = {"a": (0.0, 0.0), "b": (-5.0, -5.0), "c": (3.3, -1.7)}


@pytest.fixture(scope="module")
def study_(spark):
    storms, cells, domain, sheds = tables(spark, CORNERS)
    return storms, prepare_catalog(cells, domain, sheds, 1.0, 0.5).written()


def within(x, y, points):
    n = 0
    for (x1, y1), (x2, y2) in zip(points, [*points[1:], points[0]]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            n += 1
    return n % 2 == 1


def plain_mean(field, corner, delta):
    """Mean over the storm's own cells whose centre lies in the watershed, of the storm moved by delta, by coordinates."""
    rows, cols = field.shape
    at = [(r, c) for r in range(rows) for c in range(cols) if within(corner[0] + c + 0.5, corner[1] + r + 0.5, SHED)]
    dx, dy = (int(np.rint(d)) for d in delta)
    return sum(field[r - dy, c - dx] if 0 <= r - dy < rows and 0 <= c - dx < cols else 0 for r, c in at) / len(at)


def test_depths_on_each_storms_own_grid(spark, study_):
    """Corners that differ from the domain's and from each other, the domain's bounds, no shift and others."""
    storms, c = study_
    centers = {r.storm_path: (r.x, r.y) for r in c.storm_centers.collect()}
    moves = [(0.0, 0.0), (1.0, -2.0), (-3.4, 2.6), (40.0, 0.0)]
    rows = [("w", n, i, x + dx, y + dy, 1.0) for n, (x, y) in centers.items() for i, (dx, dy) in enumerate(moves)]
    events = spark.createDataFrame(rows, "watershed string, storm_path string, event_id int, newx double, newy double, weight double")
    for by_cells in (False, True):
        got = {(r.storm_path, r.event_id): r.precip_avg_mm for r in study.evaluate_depths(events, c, by_cells=by_cells).collect()}
        assert len(got) == len(rows)
        for (n, i), v in got.items():
            assert abs(v - plain_mean(storms[n], CORNERS[n], moves[i])) < 1e-9
    assert c.storm_grids.select("grid_id").distinct().count() == 3
    assert abs(got["a", 0] - got["b", 0]) > 0.1  # the same cells numbers would give other places


def test_unequal_axes_raise(spark):
    _, cells, *_ = tables(spark, CORNERS)
    one = fields.cumulative(cells.where("storm_path = 'a'"))
    other = fields.cumulative(cells.where("storm_path = 'b'"))
    assert fields.stack(one, one.withColumn("storm_path", F.lit("z"))).count() == 2 * one.count()
    assert fields.stack(one, other, any_grid=True).count() == one.count() + other.count()
    with pytest.raises(ValueError):
        fields.stack(one, other)
    mixed = fields.cumulative(cells.unionByName(cells.where("storm_path = 'b'").withColumn("storm_path", F.lit("a"))))
    with pytest.raises(ValueError):
        fields.storm_grids(mixed)


def test_catalog_holds_runs(study_):
    storms, c = study_
    grid = c.domain_grid
    centers = {r.storm_path: (r.x, r.y) for r in c.storm_centers.collect()}
    stat = c.layer_stats.where("layer = 'w'").first()
    center = lambda r, k: (grid.x0 + (0.5 + k) * grid.cell_size, grid.y0 + (0.5 + r) * grid.cell_size)
    boundary = []
    for (x1, y1), (x2, y2) in zip(SHED, [*SHED[1:], SHED[0]]):
        n = max(1, math.ceil(math.hypot(x2 - x1, y2 - y1) / 0.5))
        boundary += [(x1 + k / n * (x2 - x1), y1 + k / n * (y2 - y1)) for k in range(n)]
    every = [(r, k) for r in range(grid.rows) for k in range(grid.cols)]
    stands = {rc for rc in every if all(within(center(*rc)[0] + x - stat.x, center(*rc)[1] + y - stat.y, DOMAIN) for x, y in boundary)}
    want = set()
    for n, (sx, sy) in centers.items():
        for rc in every:
            x, y = center(*rc)
            to = tuple(int(np.rint(v / grid.cell_size - (o / grid.cell_size + 0.5))) for v, o in ((stat.y + sy - y, grid.y0), (stat.x + sx - x, grid.x0)))
            if within(x, y, DOMAIN) and to in stands:
                want.add((n, *rc))
    got = [(r.storm_path, r.row, r.col) for r in c.valid_cells.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
    runs = c.valid_runs.collect()
    assert len(runs) < len(want) / 2
    for n in centers:
        at = 0
        for r in sorted((r for r in runs if r.storm_path == n), key=lambda r: (r.row, r.c0)):
            assert r.before == at and r["count"] == sum(w[0] == n for w in want)
            at += r.c1 - r.c0 + 1


def test_region_plan_has_no_cross_join_and_no_walk_over_edges(spark, capsys):
    _, _, domain, sheds = tables(spark, CORNERS)
    offsets = geometry.boundary_offsets(sheds, geometry.layer_stats(sheds), 0.5)
    geometry.standing_runs(domain, offsets, Grid.over(0.3, 0.3, 15.7, 11.7, 1.0)).explain()
    plan = capsys.readouterr().out
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "lambda" not in plan and "Join" in plan


def test_runs_with_holes_and_shared_columns(spark):
    """Outlines with slanted edges and holes, on a grid whose cells are not whole numbers."""
    grid = Grid.over(-0.35, -0.2, 9.0, 7.9, 0.7)
    outer, hole = [(0, 0), (8, 0.5), (6, 7), (3, 3), (0.5, 7.3)], [(1.9, 1.1), (3.1, 1.3), (2.2, 2.7)]
    v = spark.createDataFrame(ring("p", outer) + [(n, 0, 1, i, x, y) for n, _, _, i, x, y in ring("p", hole)] + ring("q", [(1, 1), (1.2, 1), (1.2, 6), (1, 6)]), VERTICES)
    got = {(r.layer, r.row, r.col) for r in geometry.cells_in_layers(grid, v).collect()}
    at = lambda r, k: (grid.x0 + (0.5 + k) * 0.7, grid.y0 + (0.5 + r) * 0.7)
    every = [(r, k) for r in range(grid.rows) for k in range(grid.cols)]
    assert got == {("p", *rc) for rc in every if within(*at(*rc), outer) != within(*at(*rc), hole)} | {("q", *rc) for rc in every if within(*at(*rc), [(1, 1), (1.2, 1), (1.2, 6), (1, 6)])}


def test_rank_draws_take_the_kth_cell(spark, study_):
    _, c = study_
    plan = spark.createDataFrame([("w", "u", 400, 2)], "watershed string, scenario string, n long, realizations long")
    u = draw.hashed(8)
    e = draw.draw_storms(draw.generate(plan), draw.drawable_storms(c.valid_runs, c.storm_centers), u(1)).withColumn("u", u(2))
    e = snapshot(e, "e")
    got = draw.draw_uniform_cells(e, c.valid_runs, F.col("u"), c.domain_grid).collect()
    cells = {n: sorted((r.row, r.col, r.x, r.y) for r in c.valid_cells.where(F.col("storm_path") == n).collect()) for n in CORNERS}
    assert len(got) == 800
    for r in got:
        own = cells[r.storm_path]
        assert (r.newx, r.newy) == own[math.floor(r.u * len(own))][2:] and r.mass == r["count"] == len(own)


def tail(x):
    """The lower tail of the normal distribution for Decimal x, by series or continued fraction."""
    root = (2 * D("3.14159265358979323846264338327950288419716939937510582097")).sqrt()
    if x < -6:
        v = -x
        for i in range(400, 0, -1):
            v = -x + D(i) / v
        return (-x * x / 2).exp() / v / root
    if x > 6:
        return 1 - tail(-x)
    total, term, k = x, x, 0
    while abs(term) > D(10) ** -60 or k < 40:
        k += 1
        term = -term * x * x / (2 * k)
        total += term / (2 * k + 1)
    return D("0.5") + total / root


@pytest.mark.parametrize(("mu", "sd"), [(-150.0, 20.0), (-200.0, 20.0), (328.0, 20.0), (-598.0, 20.0), (726.0, 20.0), (64.0, 500.0), (64.0, 9.0), (2.0, 5.0)])
def test_truncated_normal_far_outside(spark, mu, sd):
    """Means up to thirty deviations outside on either side."""
    decimal.getcontext().prec = 60
    lo, hi = 2.0, 126.0
    df = spark.range(0, 32).select((F.lit(lo) + 4 * F.col("id")).alias("v"), F.lit(mu).alias("mu"), F.lit(sd).alias("sd"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
    z = lambda v: (D(v) - D(mu)) / D(sd)
    between = lambda a, b: tail(b) - tail(a) if a + b < 0 else tail(-a) - tail(-b)
    mass = between(z(lo), z(hi))
    root = (2 * D("3.14159265358979323846264338327950288419716939937510582097")).sqrt()
    for r in truncated(df).collect():
        f, c = (-z(r.v) ** 2 / 2).exp() / root / D(sd) / mass, between(z(lo), z(r.v)) / mass
        assert abs(D(r.f) / f - 1) < D("1e-9")
        assert r.v in (lo, hi) or abs(D(r.c) / c - 1) < D("1e-9")
        assert -7.95 < r.s < 7.95
    one = truncated(df.withColumn("hi", F.lit(lo)).where("v = lo")).first()  # an axis of one value
    assert one.f == 1 and one.c == 0


def test_second_iteration_evaluates_new_shifts_only(spark, study_):
    _, c = study_
    a = AdaptedProposals(c, {("w", s): Adaptation(sd_x_n=2.0, sd_y_n=2.0, sd_x_w=6.0, sd_y_w=6.0, mix=m) for s, m in (("one", 0.3), ("two", 0.6))})
    a.adapt(3, 250, seed=2)
    assert len(a.memo.evaluated) == 3 and a.memo.evaluated[0] > 3 * a.memo.evaluated[1] > 0
    known = spark.read.parquet(f"{a.memo.path}/*")
    assert known.count() == sum(a.memo.evaluated) == known.select(*depth.PLACE).distinct().count()
    every = c.valid_cells.select("watershed", "storm_path", F.col("x").alias("newx"), F.col("y").alias("newy"))
    want = depth.mean_depths_by_runs(study.placed(every, c), c.watershed_mask, c.storm_rows).withColumnRenamed("precip_avg_mm", "again")
    both = known.join(want, depth.PLACE)
    assert both.count() == known.count() and both.where("abs(again - precip_avg_mm) > 1e-12").isEmpty()


def test_storms_stay_in_place(spark, study_, capsys):
    """The side of the storms' rows is read in its buckets: no exchange between its scan and the join."""
    _, c = study_
    every = c.valid_cells.select("watershed", "storm_path", F.col("x").alias("newx"), F.col("y").alias("newy"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        depth.mean_depths_by_runs(study.placed(every, c), c.watershed_mask, c.storm_rows).explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
    lines = capsys.readouterr().out.splitlines()
    at = next(i for i, x in enumerate(lines) if "Bucketed: true" in x)
    indent = lambda x: max(x.find("+- "), x.find(":- "))
    path, level = [], indent(lines[at])
    for x in reversed(lines[:at]):
        if indent(x) < level:
            level = indent(x)
            path.append(x)
            if "Join" in x:
                break
    assert "Join" in path[-1] and not any("Exchange" in x for x in path)


def test_nested_samples(spark, study_):
    """Prefixes of one stream: each as if it had been drawn and weighed alone."""
    _, c = study_
    p = Proposal("gaussian", sd_x=3.0, sd_y=3.0)
    events = study.sample_events(c, {"n": p}, {"n": (120, 3)}, seed=5)
    depths = study.evaluate_depths(events, c)
    got = study.nested_depths(depths, [40, 120])
    assert {(r.scenario, r["count"]) for r in got.groupBy("scenario").count().collect()} == {("n40", 120), ("n120", 360)}
    alone = study.evaluate_depths(draw.with_weights(events.where("event_id <= 40").withColumns({"mass": F.col("weight_raw"), "count": F.lit(1), "q": F.lit(1.0)})), c)
    for scenario, want in (("n40", alone), ("n120", depths)):
        both = got.where(F.col("scenario") == scenario).join(want.select("realization", "event_id", F.col("weight").alias("w"), F.col("exc_prb").alias("e"), F.col("precip_avg_mm").alias("d")), ["realization", "event_id"])
        assert both.count() == (120 if scenario == "n40" else 360)
        assert both.where("abs(w - weight) > 1e-12 or abs(e - exc_prb) > 1e-12 or d <> precip_avg_mm").isEmpty()


def test_exact_bands_of_many_curves(spark):
    """A hundred thousand realizations, ties, a constant group, a small group and missing values."""
    big = spark.range(100_000).select(F.lit("a").alias("k"), F.lit(2).alias("RP"), F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.exp(F.hash("id") / 3e8)).alias("depth_in"))
    flat = spark.range(3_000).select(F.lit("a").alias("k"), F.lit(3).alias("RP"), F.lit(1.5).alias("depth_in"))
    small = spark.createDataFrame([("b", 2, 1.0), ("b", 2, 4.0), ("b", 2, None), ("c", 9, 5.0), ("d", 4, None)], "k string, RP int, depth_in double")
    df = big.unionByName(flat).unionByName(small)
    want = {(r.k, r.RP): r for r in curves.bands(df, ["k"]).collect()}
    got = {(r.k, r.RP): r for r in curves.bands_by_selection(df, ["k"], leaf=200).collect()}
    assert got.keys() == want.keys()
    for key, r in got.items():
        for name in ("median_in", "ci90_low_in", "ci90_high_in", "ci95_low_in", "ci95_high_in"):
            assert r[name] == want[key][name]
        assert r.mean_in == want[key].mean_in or abs(r.mean_in - want[key].mean_in) < 1e-9


def test_renormalized_exceedance_of_a_large_realization(spark, monkeypatch):
    rows = [(k, i, float(i % 5), 0.3 + i % 3) for k in (1, 2) for i in range(300)]
    df = spark.createDataFrame(rows, "realization int, event_id int, precip_avg_mm double, weight double")
    by = ("realization",)
    want = {(r.realization, r.event_id): r.exc_prb for r in depth.exceedance_by_size(df, df, by, renormalize=True).collect()}
    monkeypatch.setattr(depth, "ONE_TASK", 40)
    got = depth.exceedance_by_size(df, df, by, renormalize=True)
    assert got.columns == [*df.columns, "exc_prb"]
    assert all(abs(r.exc_prb - want[r.realization, r.event_id]) < 1e-12 for r in got.collect()) and len(want) == 600


def test_curves_to_the_longest_period_of_any(spark):
    rows = [(k, i, float(100 - i), (i + 1) / n) for k, n in ((1, 200), (2, 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "realization int, event_id int, precip_avg_mm double, exc_prb double")
    common, any_ = (curves.summarize(df, use_common_min=x).agg(F.max("RP")).first()[0] for x in (True, False))
    assert common == math.floor(1 / -math.expm1(-10 / 40)) and any_ == math.floor(1 / -math.expm1(-10 / 200))


def test_nothing_is_kept_between_calls(spark, tmp_path):
    """A folder whose tables change gives other results."""
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    for k, kept in enumerate((lines, lines.where("l_suppkey <> 3"))):
        kept.toPandas().to_parquet(tmp_path / "lineitem.parquet", coerce_timestamps="us")
        found = {r.storm_path for r in QUERIES["j8_valid_counts"](spark, str(tmp_path)).collect()}
        assert ("storm_3" in found) == (k == 0)
        spark.catalog.refreshByPath(str(tmp_path))
