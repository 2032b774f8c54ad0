"""Operators against numpy models on small data."""

import json
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from stormshift.operators import align, curves, depth, draw, fields, geometry
from stormshift.operators.proposal import Proposal
from stormshift.plans.adapt import AdaptedProposals, Adaptation
from stormshift.plans.prepare import catalog_from_config, prepare_catalog
from stormshift.plans.study import evaluate_depths, sample_events
from stormshift.sources import derived, polygons, records, store

CELL = 1.0


def grid_rows(name, field, ll_x=0.0, ll_y=0.0):
    return [(name, "/SHG/PRECIPITATION/1", r, c, float(v), ll_x, ll_y, CELL) for r, line in enumerate(field) for c, v in enumerate(line)]


RECORDS = "storm_path string, record string, row int, col int, value double, ll_x double, ll_y double, cell_size double"
VERTICES = "layer string, part int, ring int, seq int, x double, y double"


def ring(layer, points):
    return [(layer, 0, 0, i, float(x), float(y)) for i, (x, y) in enumerate([*points, points[0]])]


@pytest.fixture(scope="module")
def catalog(spark):
    draw_ = np.random.default_rng(1)
    storms = {f"s{i}": draw_.random((12, 16)) + 5 * np.exp(-((np.arange(12)[:, None] - 4) ** 2 + (np.arange(16)[None] - 5) ** 2) / 6) for i in range(3)}
    cells = spark.createDataFrame([r for n, f in storms.items() for r in grid_rows(n, f)], RECORDS)
    # no boundary point of the watershed can stand on the domain's edge, where parity is undecided
    domain = spark.createDataFrame(ring("domain", [(0.3, 0.3), (15.7, 0.3), (15.7, 11.7), (0.3, 11.7)]), VERTICES)
    sheds = spark.createDataFrame(ring("w", [(4, 3), (8, 3), (8, 6), (4, 6)]), VERTICES)
    return storms, prepare_catalog(cells, domain, sheds, CELL, 0.5, bounds=(0.0, 0.0, 16.0, 12.0)).written()


def test_centers_take_the_first_cell_on_ties(spark):
    cells = spark.createDataFrame([("a", r, c, c + 0.5, r + 0.5, 1.0) for r in range(3) for c in range(3)], "storm_path string, row int, col int, x double, y double, precip_mm double")
    row = fields.storm_centers(cells).first()
    assert (row.x, row.y, row.pmax_mm) == (0.5, 0.5, 1.0)
    with pytest.raises(ValueError):
        fields.require_unique_storms(spark.createDataFrame([("a", 1), ("a", 2)], "storm_path string, x int"))


def test_missing_records(spark):
    raw = spark.createDataFrame([("a", "/SHG/PRECIPITATION/1", 0, 0, -3.4028234663852886e38), ("a", "/SHG/PRECIPITATION/2", 0, 0, 2.0), ("b", "/SHG/TEMP/1", 0, 0, 1.0)], "storm_path string, record string, row int, col int, value double")
    with pytest.raises(ValueError):
        records.precipitation(raw)
    assert [r.value for r in records.precipitation(raw, check=False).orderBy("record").collect()] == [None, 2.0]


def test_polygon_with_hole(spark):
    v = spark.createDataFrame(ring("a", [(0, 0), (4, 0), (4, 4), (0, 4)]) + [(n, 0, 1, i, x, y) for n, _, _, i, x, y in ring("a", [(1, 1), (1, 2), (2, 2), (2, 1)])], VERTICES)
    s = geometry.layer_stats(v).first()
    assert abs(s.x - (16 * 2 - 1.5) / 15) < 1e-12 and (s.minx, s.maxx, s.range_y) == (0, 4, 4)
    grid = geometry.Grid.over(0, 0, 4, 4, 1.0)
    for hit in (geometry.cells_in_layers(grid, v), geometry.points_in_layers(grid.cells(spark), v, 0.0, 1.0)):
        assert {(r.row, r.col) for r in hit.collect()} == {(r, c) for r in range(4) for c in range(4)} - {(1, 1)}


def test_densify_keeps_vertices(spark):
    v = spark.createDataFrame(ring("a", [(0, 0), (2, 0), (2, 1)]), VERTICES)
    points = {(round(r.x, 6), round(r.y, 6)) for r in geometry.densify(v, 0.5).collect()}
    assert {(0, 0), (2, 0), (2, 1), (0.5, 0), (1.5, 0), (2, 0.5)} <= points
    assert geometry.densify(v, 0).count() == 4


def test_geojson(spark, tmp_path):
    (tmp_path / "a.geojson").write_text('{"type": "FeatureCollection", "features": [{"properties": {"name": "p"}, "geometry": {"type": "Polygon", "coordinates": [[[0,0],[1,0],[1,1],[0,0]]]}}, {"properties": {"name": "m"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[2,2],[3,2],[3,3],[2,2]]], [[[5,5],[6,5],[6,6],[5,5]]]]}}]}')
    v = polygons.read_geojson(spark, str(tmp_path / "a.geojson"), layer_property="name").collect()
    assert len(v) == 12 and {r.layer for r in v} == {"p", "m"} and len({r.part for r in v if r.layer == "m"}) == 2


def test_valid_cells_against_a_plain_model(catalog):
    storms, c = catalog
    centers = {r.storm_path: (r.x, r.y) for r in c.storm_centers.collect()}
    cx, cy = 6.0, 4.5
    got = {(r.storm_path, r.row, r.col) for r in c.valid_cells.collect()}

    def stands(x, y):
        return x - 2 > 0.3 and x + 2 < 15.7 and y - 1.5 > 0.3 and y + 1.5 < 11.7

    want = set()
    for name, (sx, sy) in centers.items():
        for r in range(12):
            for col in range(16):
                i, j = int(np.rint(cy + sy - (r + 0.5) - 0.5)), int(np.rint(cx + sx - (col + 0.5) - 0.5))
                if 0 <= i < 12 and 0 <= j < 16 and stands(j + 0.5, i + 0.5):
                    want.add((name, r, col))
    assert got == want


def test_depths_equal_roll_and_cut(spark, catalog):
    storms, c = catalog
    grid_id = c.storm_grids.first().grid_id
    shifts = [("w", n, grid_id, dy, dx) for n in storms for dy in (-20, -3, 0, 2, 11) for dx in (-17, -1, 0, 4)]
    df = spark.createDataFrame(shifts, "watershed string, storm_path string, grid_id string, dy int, dx int")
    mask = {(r.row, r.col) for r in c.mask_cells.collect()}
    want = {}
    for _, n, _, dy, dx in shifts:
        f = storms[n]
        want[n, dy, dx] = sum(f[r - dy, k - dx] if 0 <= r - dy < 12 and 0 <= k - dx < 16 else 0 for r, k in mask) / len(mask)
    plain = depth.mean_depths(df, c.mask_cells, c.storm_cells)
    runs = depth.mean_depths_by_runs(df, c.watershed_mask, c.storm_rows)
    for got in (plain, runs):
        rows = got.collect()
        assert len(rows) == len(shifts)
        assert all(abs(r.precip_avg_mm - want[r.storm_path, r.dy, r.dx]) < 1e-9 for r in rows)
    holes = c.storm_cells.where("not (storm_path = 's1' and row = 5 and col = 6)")
    strict = {(r.storm_path, r.dy, r.dx): r.precip_avg_mm for r in depth.mean_depths(df, c.mask_cells, holes, False).collect()}
    assert strict["s0", -20, 0] is None and strict["s1", 0, 0] is None and abs(strict["s0", 0, 0] - want["s0", 0, 0]) < 1e-9
    by_runs = {(r.storm_path, r.dy, r.dx): r.precip_avg_mm for r in depth.mean_depths_by_runs(df, c.watershed_mask, depth.running_rows(holes), False).collect()}
    assert by_runs.keys() == strict.keys()
    assert all((x is None) == (by_runs[k] is None) and (x is None or abs(x - by_runs[k]) < 1e-9) for k, x in strict.items())


def test_catalog_from_config(spark, tmp_path):
    """Files in, the catalog of the same tables out; what the file can't mean is refused."""
    field = np.random.default_rng(2).random((8, 10))
    for name in ("a", "b"):
        spark.createDataFrame([(*x[1:],) for x in grid_rows(name, field if name == "a" else field[::-1])], RECORDS.split(", ", 1)[1]).toPandas().to_parquet(tmp_path / f"{name}.parquet")
    outline = {"shed": [(3, 2), (6, 2), (6, 5), (3, 5), (3, 2)], "domain": [(0.3, 0.3), (9.7, 0.3), (9.7, 7.7), (0.3, 7.7), (0.3, 0.3)]}
    for name, points in outline.items():
        (tmp_path / f"{name}.geojson").write_text(json.dumps({"features": [{"properties": {}, "geometry": {"type": "Polygon", "coordinates": [points]}}]}))
    entries = {"watershed": {"id": "w", "geometry_file": f"{tmp_path}/shed.geojson"}, "transposition_region": {"geometry_file": f"{tmp_path}/domain.geojson"}, "catalog": {"catalog_folder": f"{tmp_path}/*.parquet"}}
    opts = {"preprocess_opts": {"valid_region_max_seg_len": 0.5}}

    def load(**more):
        (tmp_path / "config.json").write_text(json.dumps({**entries, **more}, indent=2))
        return catalog_from_config(spark, str(tmp_path / "config.json"), projection=None)

    got = load(**opts)
    cells = spark.createDataFrame(grid_rows("a", field) + grid_rows("b", field[::-1]), RECORDS)
    want = prepare_catalog(cells, *(spark.createDataFrame(ring(n, outline[k][:-1]), VERTICES) for n, k in (("domain", "domain"), ("w", "shed"))), CELL, 0.5)
    for part in ("storm_centers", "layer_stats", "watershed_mask", "valid_cells", "grid", "storm_grids"):
        a, b = getattr(got, part), getattr(want, part)
        assert a.count() and sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect())), part
    for bad in ({"preprocess_opts": {"valid_region_simplify_tol": 5.0}}, {"watershed": {"id": "w"}}, {"catalog": {"catalog_folder": f"{tmp_path}/*.geojson"}}):
        with pytest.raises(ValueError):
            load(**bad)


def test_guided_draw_is_the_range_join(spark, catalog):
    _, c = catalog
    peaked = c.grid.select(F.lit("w").alias("watershed"), F.lit("s").alias("scenario"), "row", "col", F.exp(-((F.col("x") - 5) ** 2 + (F.col("y") - 4) ** 2)).alias("q"))
    w = store.snapshot(draw.weigh_cells(c.valid_runs, peaked, c.domain_grid), "weighed")
    plan = spark.createDataFrame([("w", "s", 500, 4)], "watershed string, scenario string, n long, realizations long")
    u = draw.hashed(5)
    e = store.snapshot(draw.draw_storms(draw.generate(plan), draw.drawable_storms(c.valid_runs, c.storm_centers), u(1)).withColumn("u", u(2)), "e")
    got = draw.draw_weighted_cells(e, w, F.col("u")).select("realization", "event_id", "newx", "newy")
    plain = e.join(w.withColumnsRenamed({"x": "newx", "y": "newy"}), ["watershed", "scenario", "storm_path"]).where("lo <= u * mass and u * mass < hi").select("realization", "event_id", "newx", "newy")
    assert got.count() == 2000 and got.exceptAll(plain).isEmpty() and plain.exceptAll(got).isEmpty()


def test_samples(catalog):
    _, c = catalog
    proposals = {"u": Proposal(), "g": Proposal("gaussian", sd_x=3.0, sd_y=3.0), "own": Proposal("custom", density=lambda x, y: F.exp(-x / 10))}
    e = sample_events(c, proposals, {"u": (200, 3), "g": (300, 2), "own": (100, 1)}, seed=3)
    rows = e.groupBy("scenario", "realization").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).collect()
    assert {(r.scenario, r.n) for r in rows} == {("u", 200), ("g", 300), ("own", 100)} and all(abs(r.w - 1) < 1e-9 for r in rows)
    again = sample_events(c, proposals, {"u": (200, 3), "g": (300, 2), "own": (100, 1)}, seed=3).repartition(7)
    assert e.exceptAll(again).isEmpty()
    d = evaluate_depths(e, c)
    top = d.groupBy("scenario", "realization").agg(F.max("exc_prb").alias("m")).collect()
    assert all(abs(r.m - 1) < 1e-9 for r in top)
    assert evaluate_depths(e.limit(0), c).isEmpty()
    unknown = e.withColumn("storm_path", F.lit("nowhere"))
    assert evaluate_depths(unknown, c).isEmpty()


def test_proposal_checks():
    for wrong in (dict(family="nothing"), dict(family="gaussian", sd_x=0.0, sd_y=1.0), dict(family="copula", sd_x=1.0, sd_y=1.0, rho=1.0), dict(family="mixture", mix=1.5, narrow={}, wide={})):
        with pytest.raises(ValueError):
            Proposal(**wrong)
    mix = Proposal("mixture", mu_x=1.0, rho=0.3, mix=0.4, narrow={"sd_x": 1.0, "sd_y": 1.0}, wide={"sd_x": 2.0, "sd_y": 2.0, "rho": 0.1})
    assert [(c[1], c[3], c[7]) for c in mix.components()] == [(0.4, 1.0, 0.3), (0.6, 1.0, 0.1)]


def test_exceedance(spark):
    df = spark.createDataFrame([(1, i, float(d) if d is not None else None, 0.25) for i, d in enumerate([5, 7, 7, None])], "realization int, event_id int, depth double, weight double")
    want = {0: 0.75, 1: 0.25, 2: 0.5, 3: None}
    for f in (depth.exceedance, depth.exceedance_by_ranges):
        got = {r.event_id: r.exc_prb for r in f(df, keys=("realization",), depth="depth").collect()}
        assert got == want
    # text ids, many ties, several realizations, more ranges than some of them have events
    rows = [(k, f"e{i:03d}", float(i % 3), 1.0 + i % 4) for k, n in ((1, 200), (2, 5), (3, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "realization int, event_id string, depth double, weight double").repartition(3)
    one, other = ({(r.realization, r.event_id): r.exc_prb for r in f(df).collect()} for f in (lambda d: depth.exceedance(d, ("realization",), "depth"), lambda d: depth.exceedance_by_ranges(d, 11, ("realization",), "depth")))
    assert one == other and len(one) == 206


def test_curves_equal_numpy(spark):
    draw_ = np.random.default_rng(2)
    rows, curves_ = [], []
    for k in range(1, 7):
        d = np.sort(draw_.gamma(2, 20, 300))[::-1]
        exc = np.cumsum(np.full(300, 1 / 300))
        rows += [(k, i, float(x), float(e)) for i, (x, e) in enumerate(zip(d, exc))]
        curves_.append((1 / -np.expm1(-10 * exc[::-1]), d[::-1] / 25.4))
    df = spark.createDataFrame(rows, "realization int, event_id int, precip_avg_mm double, exc_prb double")
    got = {r.RP: r for r in curves.summarize(df).collect()}
    top = int(min(c[0].max() for c in curves_))
    grid = np.arange(2, top + 1)
    stack = np.array([np.interp(grid, *c, left=np.nan, right=np.nan) for c in curves_])
    assert sorted(got) == grid.tolist()
    for i, rp in enumerate(grid.tolist()):
        want = [np.nanmean(stack[:, i]), *np.nanpercentile(stack[:, i], [50, 5, 95, 2.5, 97.5])]
        assert np.allclose([got[rp][c] for c in ("mean_in", "median_in", "ci90_low_in", "ci90_high_in", "ci95_low_in", "ci95_high_in")], want, rtol=1e-9)
    assert got[2].n_realizations == 6 and got[2].n_samples_per_realization == 300
    assert curves.summarize(df, rp_min=5000).isEmpty() and curves.summarize(df.limit(0)).isEmpty()


def test_metrics(spark):
    base = spark.createDataFrame([(r, *[float(r)] * 6) for r in (2, 3, 4)], "RP int, " + ", ".join(f"{s}_in double" for s in curves.STATISTICS))
    sim = base.select("RP", *((F.col(c) + F.when(F.col("RP") == 4, 3.0).otherwise(0.0)).alias(c) for c in base.columns[1:]))
    row = curves.compare(base, sim).first()
    assert (row.n_points, row.rp_min_used, row.rp_max_used) == (3, 2.0, 4.0) and abs(row.rmse_median - 3**0.5) < 1e-12 and row.me_mean == 1 and row.diff_at_maxrp_ci95_low == 3
    none = curves.compare(base, sim.withColumn("RP", F.col("RP") + 100)).first()
    assert none.n_points == 0 and none.rmse_mean is None
    mm = base.select("RP", *(F.col(f"{s}_in").alias(f"{s}_mm") for s in curves.STATISTICS))
    assert abs(curves.ensure_inches(mm).first().median_in - 2 / 25.4) < 1e-12


def test_alignment(spark):
    field = np.arange(12, dtype=float).reshape(3, 4) ** 1.5
    cells = spark.createDataFrame([("a", r, c, c + 0.5, r + 0.5, float(field[r, c])) for r in range(3) for c in range(4)], "storm_path string, row int, col int, x double, y double, precip_mm double")
    grid = spark.createDataFrame([(0, 0, 0.5, 0.5), (0, 1, 1.25, 0.75), (1, 0, 3.5, 2.5), (1, 1, 9.0, 1.0)], "row int, col int, x double, y double")
    near = {(r.row, r.col): r.precip_mm for r in align.align(cells, grid).collect()}
    assert near == {(0, 0): field[0, 0], (0, 1): field[0, 1], (1, 0): field[2, 3]}
    line = {(r.row, r.col): r.precip_mm for r in align.align(cells, grid, "linear").collect()}
    assert abs(line[0, 1] - (0.75 * (0.25 * field[0, 0] + 0.75 * field[0, 1]) + 0.25 * (0.25 * field[1, 0] + 0.75 * field[1, 1]))) < 1e-12
    with pytest.raises(ValueError):
        align.align(cells, grid, allowed=False)


def test_adaptation_moves_to_the_wet_corner(spark, catalog):
    _, c = catalog
    a = AdaptedProposals(c, {("w", "s"): Adaptation(sd_x_n=2.0, sd_y_n=2.0, sd_x_w=8.0, sd_y_w=8.0, mu_x_n=10.0, mu_y_n=7.0)})
    h = {r.iter: r for r in a.adapt(2, 300, threshold=1.0, seed=4).collect()}
    assert sorted(h) == [0, 1, 2] and h[0].mix == 0.3 and all(0.05 <= r.mix <= 0.95 for r in h.values()) and h[1].updated == 1
    assert abs(h[2].mu_x_n - 5.5) < abs(h[0].mu_x_n - 5.5)
    final = a.sample_final(50, 2)
    assert final.count() == 100 and abs(final.groupBy("realization").agg(F.max("exc_prb").alias("m")).first().m - 1) < 1e-9
    assert "exc_prb" not in a.sample_final(20, with_depths=False).columns


def test_storms_from_files(spark, tmp_path):
    with pytest.raises(ValueError):
        records.list_storms(spark, str(tmp_path))
    for name in ("b", "a"):
        spark.createDataFrame([(0, 0, 1.0)], "row int, col int, value double").toPandas().to_parquet(tmp_path / f"{name}.parquet")
    assert [r.storm_path for r in records.list_storms(spark, str(tmp_path)).collect()] == ["a", "b"]
    assert {r.storm_path for r in records.read_storms(spark, str(tmp_path)).collect()} == {"a", "b"}
    (tmp_path / "deeper").mkdir()
    spark.createDataFrame([(0, 0, 1.0)], "row int, col int, value double").toPandas().to_parquet(tmp_path / "deeper" / "c.parquet")
    spark.createDataFrame([(0, 0, 1.0)], "row int, col int, value double").toPandas().to_parquet(tmp_path / "d.other")
    assert [r.storm_path for r in records.list_storms(spark, str(tmp_path)).collect()] == ["a", "b"]
    assert {r.storm_path for r in records.read_storms(spark, str(tmp_path)).collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        records.list_storms(spark, str(tmp_path), "*.none")


def test_no_local_folder_on_a_cluster():
    session = lambda master, **conf: SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: {}), conf=conf)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            store.scratch(session(master), "x")
        assert store.scratch(session(master, **{"spark.checkpoint.dir": "hdfs://all/work"}), "x").startswith("hdfs://all/work/x-")


def test_baseline_columns(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "x"))
    with pytest.raises(ValueError):
        store.read_baseline(spark, str(tmp_path / "x"))
    with pytest.raises(ValueError):
        store.Catalog.load(spark, str(tmp_path / "none"))


def test_stream_of_records(spark, tmp_path):
    from stormshift.streaming.fields import running_fields

    rows = grid_rows("a", np.ones((2, 2))) + grid_rows("a", 2 * np.ones((2, 2)))
    spark.createDataFrame(rows, RECORDS).write.parquet(str(tmp_path / "in"))
    q = running_fields(spark.readStream.schema(RECORDS).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        q.processAllAvailable()
        assert {r.precip_mm for r in spark.table("running").collect()} == {3.0}
    finally:
        q.stop()


def test_domain_of_the_derived_study(spark):
    grid = geometry.Grid.over(0, 0, 128000, 96000, derived.CELL)
    v = derived.watershed_vertices(spark)
    s = geometry.layer_stats(v).where("layer = 'bend'").first()
    assert abs(s.x - 58363.636363636364) < 1e-6 and abs(s.y - 47818.181818181818) < 1e-6
    assert geometry.cells_in_layers(grid, v).where("layer = 'bend'").count() == 33
