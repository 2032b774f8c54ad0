"""Registered queries: each operator on storms derived from the given tables, with the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormshift.functions import normal, scalars
from stormshift.functions.albers import Albers
from stormshift.operators import align, curves, depth, draw, fields, geometry, proposal
from stormshift.operators.proposal import Proposal
from stormshift.plans import prepare, sql, study
from stormshift.plans.adapt import AdaptedProposals, Adaptation
from stormshift.sources import derived, polygons, records, store
from stormshift.sources.records import precipitation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
CELL = derived.CELL
DOMAIN_GRID = geometry.Grid.over(0, 0, derived.COLS * CELL, derived.ROWS * CELL, CELL)


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return put


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def r(columns: str, places: int = 6) -> str:
    """Rounded columns for the SQL side."""
    return ", ".join(f"round({c}, {places}) AS {c}" for c in columns.split())


def catalog(spark: SparkSession, sf_dir: str, shifted: bool = False) -> store.Catalog:
    """Prepared from the line items' storms, written, and read from there, as a study would have it."""
    return prepared(spark, sf_dir, shifted).written()


def prepared(spark: SparkSession, sf_dir: str, shifted: bool = False) -> store.Catalog:
    return prepare.prepare_catalog(derived.grid_cells(spark, sf_dir, shifted), derived.domain_vertices(spark), derived.watershed_vertices(spark), CELL, max_seg_len=1000.0)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.cumulative(precipitation(derived.grid_cells(spark, sf_dir)))


# fields and centres -------------------------------------------------------------------------------------------


@query("a1_cumulative_fields", sql.steps(sql.GRID) + f" SELECT storm_path, row, col, x, y, {r('precip_mm')} FROM storm_cells")
def a1(spark, sf_dir):
    return rounded(cells(spark, sf_dir).drop("x0", "y0", "cell_size"))


@query("a2_storm_centers", sql.steps(sql.GRID) + f" SELECT storm_path, x, y, {r('pmax_mm')} FROM centers")
def a2(spark, sf_dir):
    return rounded(fields.require_unique_storms(fields.storm_centers(cells(spark, sf_dir))))


@query(
    "s4_precipitation_records",
    sql.steps(sql.GRID) + " SELECT storm_path, record, count(CASE WHEN record NOT LIKE '%7' AND NOT (row = 0 AND col = 0) THEN 1 END) AS cells, round(sum(CASE WHEN row = 0 AND col = 0 THEN NULL ELSE value END), 6) AS total FROM records WHERE record NOT LIKE '%7' GROUP BY storm_path, record",
)
def s4(spark, sf_dir):
    """Temperature records are left out, and the corner cell holds the mark of missing data."""
    raw = derived.grid_cells(spark, sf_dir)
    raw = raw.withColumn("record", F.when(F.col("record").endswith("7"), F.lit("/SHG/TEMPERATURE/7")).otherwise(F.col("record")))
    raw = raw.withColumn("value", F.when((F.col("row") == 0) & (F.col("col") == 0), F.lit(-3.4028234663852886e38)).otherwise(F.col("value")))
    kept = precipitation(raw).groupBy("storm_path", "record").agg(F.count("value").alias("cells"), F.round(F.sum("value"), 6).alias("total"))
    return kept


@query("s10_normalized_cube", sql.steps(sql.GRID) + " SELECT storm_path, count(*) AS cells, round(sum(precip_mm), 6) AS total, min(x) AS x0, max(y) AS y1 FROM storm_cells GROUP BY storm_path")
def s10(spark, sf_dir):
    """Two cubes under different names become one table; their axes are equal."""
    c = cells(spark, sf_dir)
    first = fields.normalized(c.where("storm_path < 'storm_4'").withColumnRenamed("storm_path", "storm"), "storm")
    both = fields.stack(first, fields.normalized(c.where("storm_path >= 'storm_4'")))
    return both.groupBy("storm_path").agg(F.count("*").alias("cells"), F.round(F.sum("precip_mm"), 6).alias("total"), F.min("x").alias("x0"), F.max("y").alias("y1"))


# geometry: outlines are the boxes around each storm's wettest cells -----------------------------------------------

_WET = "SELECT storm_path, min(x) - 1e3 AS a, min(y) - 1e3 AS b, max(x) + 1e3 AS c, max(y) + 1e3 AS d FROM {cells} WHERE precip_mm >= 0.6 * peak GROUP BY storm_path"
#: A box without its upper right corner, as a closed ring.
_RING = "SELECT storm_path AS layer, 0 AS part, 0 AS ring, seq, CASE seq WHEN 0 THEN a WHEN 1 THEN c WHEN 2 THEN c WHEN 3 THEN (a + c) / 2 WHEN 4 THEN a ELSE a END AS x, CASE seq WHEN 0 THEN b WHEN 1 THEN b WHEN 2 THEN (b + d) / 2 WHEN 3 THEN d WHEN 4 THEN d ELSE b END AS y"
_FOOT = f"wet AS (SELECT s.*, max(precip_mm) OVER (PARTITION BY storm_path) AS peak FROM storm_cells s), boxes AS ({_WET.format(cells='wet')}), foot AS ({_RING} FROM boxes, range(6) t(seq)), {sql.edges('foot_edges', 'foot')}"


def footprints(c: DataFrame) -> DataFrame:
    peak = c.groupBy("storm_path").agg(F.max("precip_mm").alias("peak"))
    boxes = c.sparkSession.sql(_WET.format(cells="{c}"), c=c.join(peak, "storm_path"))
    rings = boxes.withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(5))))
    return rings.sparkSession.sql(_RING + " FROM {t}", t=rings)


@query("a4_layer_stats", sql.steps(sql.GRID, _FOOT, sql.stats("foot_stats", "foot", "foot_edges")) + f" SELECT layer, {r('minx miny maxx maxy x y range_x range_y', 4)} FROM foot_stats")
def a4(spark, sf_dir):
    return rounded(geometry.layer_stats(footprints(cells(spark, sf_dir))), 4)


_INSIDE = sql.steps(sql.GRID, _FOOT, sql.within("hit", "grid", "p.row, p.col", "foot_edges")) + " SELECT layer, row, col FROM hit"


@query("j9_cells_in_polygons", _INSIDE)
def j9(spark, sf_dir):
    return geometry.cells_in_layers(DOMAIN_GRID, footprints(cells(spark, sf_dir))).select("layer", "row", "col")


@query("j9_cells_in_polygons_by_bands", _INSIDE)
def j9_bands(spark, sf_dir):
    """Point by point instead of by scanlines."""
    return geometry.points_in_layers(DOMAIN_GRID.cells(spark), footprints(cells(spark, sf_dir)), 0.0, CELL).select("layer", "row", "col")


@query(
    "p23_boundary_offsets",
    sql.steps(sql.GRID, _FOOT, sql.stats("foot_stats", "foot", "foot_edges"))
    + """, pieces AS (SELECT e.*, greatest(1, CAST(ceil(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) / 2.5e3) AS BIGINT)) AS n FROM foot_edges e),
pts AS (SELECT layer, x1 + CAST(k AS DOUBLE) / n * (x2 - x1) AS x, y1 + CAST(k AS DOUBLE) / n * (y2 - y1) AS y FROM (SELECT *, unnest(range(n)) AS k FROM pieces))
SELECT DISTINCT p.layer, round(p.x - s.x, 4) AS dx, round(p.y - s.y, 4) AS dy FROM pts p JOIN foot_stats s ON s.layer = p.layer""",
)
def p23(spark, sf_dir):
    v = footprints(cells(spark, sf_dir))
    return rounded(geometry.boundary_offsets(v, geometry.layer_stats(v), 2500.0), 4)


@query(
    "p1_albers",
    "SELECT event_id, round(x, 3) AS x, round(y, 3) AS y FROM (SELECT event_id, {} AS x, {} AS y FROM (SELECT event_id, -1.2e2 + 5e-2 * (event_id % 1000) AS lon, 2.6e1 + 2e-2 * (event_id % 997) AS lat FROM events) t) u".format(*Albers().sql("lon", "lat")),
)
def p1(spark, sf_dir):
    points = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.expr("-1.2e2 + 5e-2 * (event_id % 1000)").alias("lon"), F.expr("2.6e1 + 2e-2 * (event_id % 997)").alias("lat"))
    x, y = Albers().columns("lon", "lat")
    return points.select("event_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query("p3_flat_index", sql.steps(sql.GRID) + " SELECT storm_path, CAST(row * 32 + col AS BIGINT) AS flat, row AS row_back, col AS col_back FROM storm_cells")
def p3(spark, sf_dir):
    c = cells(spark, sf_dir).withColumn("flat", geometry.flat_index(F.col("row"), F.col("col"), derived.COLS))
    row, col = geometry.from_flat_index(F.col("flat"), derived.COLS)
    return c.select("storm_path", "flat", row.alias("row_back"), col.alias("col_back"))


# scalar formulas on line items ------------------------------------------------------------------------------------

_SCALARS = f"""SELECT l_orderkey, l_linenumber, round({normal.cdf('z')}, 9) AS cdf, round({normal.ppf('p')}, 6) AS quantile, round({normal.pdf('z')}, 9) AS density,
  round({scalars.inches('l_quantity')}, 6) AS inches, round({scalars.reward('l_quantity', '2.5e1')}, 6) AS reward, round({scalars.responsibility('3e-1', 'p', 'l_discount')}, 6) AS responsibility
FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, (l_quantity - 2.55e1) / 6e0 AS z, (l_quantity - 5e-1) / 5e1 AS p FROM {{lines}}) t"""


@query("p6_scalar_formulas", _SCALARS.format(lines="lineitem"))
def p6(spark, sf_dir):
    return spark.sql(_SCALARS, lines=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


@query("p16_return_periods", "SELECT l_orderkey, l_linenumber, round(1e0 / (1e0 - exp(-1e1 * l_discount)), 6) AS rp FROM lineitem WHERE l_discount > 0")
def p16(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.select("l_orderkey", "l_linenumber", F.round(F.expr(scalars.return_period("l_discount", 10)), 6).alias("rp")).where("rp is not null")


# catalog ------------------------------------------------------------------------------------------------------------


@query("m3_valid_cells", sql.steps(sql.GRID, sql.PLACES) + " SELECT watershed, storm_path, row, col, x, y FROM valid")
def m3(spark, sf_dir):
    return catalog(spark, sf_dir).valid_cells


@query(
    "j8_valid_counts",
    sql.steps(sql.GRID, sql.PLACES) + " SELECT watershed, storm_path, count(*) AS cells FROM valid GROUP BY watershed, storm_path",
)
def j8(spark, sf_dir):
    """A row per storm comes from the runs' own counts."""
    return catalog(spark, sf_dir).valid_runs.groupBy("watershed", "storm_path").agg(F.max("count").alias("cells"))


#: Total of a column of whole units of 2^-32, rounded to four places in whole numbers, so that no order of rows changes it.
_EXACT = "CAST(((sum(CAST(CAST({rint}({c} * 4294967296e0{of}) AS BIGINT) AS {kind})) * 20000 + 4294967296) {whole} 8589934592) AS DOUBLE) / 1e4"


@query(
    "s8_catalog_reload",
    sql.steps(sql.GRID, sql.PLACES)
    + f""" SELECT 'storm_cells' AS name, count(*) AS n, {_EXACT.format(c='precip_mm', rint='round_even', of=', 0', whole='//', kind='HUGEINT')} AS total FROM storm_cells UNION ALL SELECT 'storm_centers', count(*), {_EXACT.format(c='pmax_mm', rint='round_even', of=', 0', whole='//', kind='HUGEINT')} FROM centers
UNION ALL SELECT 'valid_cells', count(*), round(sum(x), 4) FROM valid UNION ALL SELECT 'mask_cells', count(*), CAST(sum(row) AS DOUBLE) FROM mask UNION ALL SELECT 'grid', count(*), round(sum(x), 4) FROM grid""",
)
def s8(spark, sf_dir):
    """Saved, loaded again, and counted."""
    path = store.scratch(spark, "catalog")
    prepared(spark, sf_dir).save(path)
    c = store.Catalog.load(spark, path)
    exact = lambda column: F.expr(_EXACT.format(c=column, rint="rint", of="", whole="div", kind="DECIMAL(19, 0)"))
    total = lambda name, column: getattr(c, name).agg(F.lit(name).alias("name"), F.count("*").alias("n"), (exact(column) if column.endswith("_mm") else F.round(F.sum(column).cast("double"), 4)).alias("total"))
    out = total("storm_cells", "precip_mm")
    for name, column in (("storm_centers", "pmax_mm"), ("valid_cells", "x"), ("mask_cells", "row"), ("grid", "x")):
        out = out.unionByName(total(name, column))
    return out


# drawing ------------------------------------------------------------------------------------------------------------

PROPOSALS = {
    "uniform": Proposal(),
    "gaussian": Proposal("gaussian", sd_x=24000.0, sd_y=18000.0),
    "copula": Proposal("copula", mu_x=60000.0, mu_y=50000.0, sd_x=30000.0, sd_y=20000.0, rho=0.4),
    "mixture": Proposal("mixture", rho=0.2, mix=0.35, narrow={"sd_x": 15000.0, "sd_y": 12000.0, "rho": 0.5}, wide={"sd_x": 60000.0, "sd_y": 50000.0}),
}
ROWS = [(s, *c) for s, p in PROPOSALS.items() for c in p.components()]
#: Realizations; each has as many events as the tables have customers.
REALIZATIONS = 5
SIZES = {s: (derived.DRAWS_SQL, REALIZATIONS) for s in PROPOSALS}


def sampled(spark, sf_dir, names=None, realizations=REALIZATIONS, shifted=False):
    c, n = catalog(spark, sf_dir, shifted), derived.draws(spark, sf_dir)
    names = names or list(PROPOSALS)
    events = study.sample_events(c, {s: PROPOSALS[s] for s in names}, {s: (n, realizations) for s in names}, uniforms=draw.portable())
    return c, store.snapshot(events, "events")


def components(c, proposals):
    return proposal.components(proposals, c.layer_stats.where("layer <> 'domain'"))


def rows_of(*names: str) -> list[tuple]:
    return [x for x in ROWS if x[0] in names]


#: A mean twelve deviations below the grid, where both tails of the distribution are all but 0.
FAR = {"far": Proposal("gaussian", sd_x=30000.0, mu_y=-58000.0, sd_y=5000.0)}
_DENSITY = sql.steps(sql.GRID, sql.PLACES, sql.densities(ROWS + [("far", *c) for c in FAR["far"].components()]))


@query("p8_proposal_densities", _DENSITY + f" SELECT v.storm_path, d.watershed, d.scenario, d.row, d.col, round(ln(q), 6) AS q, round(ln(q_narrow), 6) AS q_narrow, round(ln(q_wide), 6) AS q_wide FROM density d JOIN valid v ON v.watershed = d.watershed AND v.row = d.row AND v.col = d.col")
def p8(spark, sf_dir):
    """On the valid cells of every storm, as logarithms: densities per square metre are small."""
    c = catalog(spark, sf_dir)
    w = study.weighed_cells(c, components(c, PROPOSALS | FAR))
    return rounded(w.select("storm_path", "watershed", "scenario", "row", "col", *(F.ln(c).alias(c) for c in ("q", "q_narrow", "q_wide"))))


_DRAWN = sql.steps(sql.GRID, sql.PLACES, sql.densities(ROWS), sql.draws(SIZES))


@query("w4_running_mass", _DRAWN + f" SELECT watershed, scenario, storm_path, row, col, rank, cnt, round(lo / mass, 9) AS lo, round(hi / mass, 9) AS hi, round(ln(mass), 9) AS mass FROM weighed")
def w4(spark, sf_dir):
    """Running mass in shares of the total, the total's logarithm, and rank of cells (a5: mass and count per storm; w7: rank)."""
    c = catalog(spark, sf_dir)
    w = study.weighed_cells(c, components(c, PROPOSALS)).select("watershed", "scenario", "storm_path", "row", "col", F.col("rank").cast("long").alias("rank"), F.col("count").alias("cnt"), (F.col("lo") / F.col("mass")).alias("lo"), (F.col("hi") / F.col("mass")).alias("hi"), F.ln("mass").alias("mass"))
    return rounded(w, 9)


_EVENT = "watershed, scenario, realization, event_id, storm_path, x, y, newx, newy, delx, dely"


@query("m4_sample_events", _DRAWN + f" SELECT {_EVENT}, {r('weight_raw weight', 9)} FROM samples")
def m4(spark, sf_dir):
    """g7, j1-j6, p13, a6: storms evenly, cells by rank or by a guide table of mass, weights that sum to 1."""
    return rounded(sampled(spark, sf_dir)[1].drop("realization_seed"), 9)


# depths -------------------------------------------------------------------------------------------------------------

_DEPTHS = sql.steps(sql.GRID, sql.PLACES, sql.densities(ROWS), sql.draws(SIZES), sql.DEPTHS)
_SHIFTED = sql.steps(sql.SHIFTED, sql.PLACES, sql.densities(rows_of("copula")), sql.draws({"copula": SIZES["copula"]}), sql.DEPTHS)


@query("m5_depths", _DEPTHS + f" SELECT watershed, scenario, realization, event_id, storm_path, {r('precip_avg_mm exc_prb weight')} FROM depths")
def m5(spark, sf_dir):
    """j7, a7, j13, w1: moved storms read on the watershed's cells, then exceedance."""
    c, e = sampled(spark, sf_dir)
    d = study.curve_depths(e, c, "storm_path").select("watershed", "scenario", "realization", "event_id", "storm_path", "precip_avg_mm", "exc_prb", "weight")
    return rounded(d)


@query("m5_shifted_storms", _SHIFTED + f" SELECT watershed, scenario, realization, event_id, storm_path, {r('precip_avg_mm exc_prb weight')} FROM depths")
def m5_shifted(spark, sf_dir):
    """Storms whose grids start elsewhere than the domain's, at six corners: the mask is cut on each storm's own cells."""
    c, e = sampled(spark, sf_dir, ["copula"], shifted=True)
    return rounded(study.curve_depths(e, c, "storm_path").select("watershed", "scenario", "realization", "event_id", "storm_path", "precip_avg_mm", "exc_prb", "weight"))


@query("j7_depths_by_cells", _DEPTHS + f" SELECT watershed, scenario, realization, event_id, {r('precip_avg_mm')} FROM depths")
def j7_cells(spark, sf_dir):
    """One lookup per cell of the mask."""
    c, e = sampled(spark, sf_dir)
    return rounded(study.event_depths(e, c, by_cells=True).select("watershed", "scenario", "realization", "event_id", "precip_avg_mm"))


@query("j7_depths_by_runs", _DEPTHS + f" SELECT watershed, scenario, realization, event_id, {r('precip_avg_mm')} FROM depths")
def j7_runs(spark, sf_dir):
    """One lookup of running sums per run of the mask."""
    c, e = sampled(spark, sf_dir)
    return rounded(study.event_depths(e, c).select("watershed", "scenario", "realization", "event_id", "precip_avg_mm"))


@query("a7_strict_depths", _DEPTHS + " SELECT watershed, storm_path, dy, dx, round(strict_mm, 6) AS precip_avg_mm FROM means")
def a7_strict(spark, sf_dir):
    """A mean with a missing cell is missing."""
    c, e = sampled(spark, sf_dir)
    return rounded(depth.mean_depths_by_runs(study.placed(e, c), c.watershed_mask, c.storm_rows, zero_pad=False))


_ONCE = {"uniform": (derived.DRAWS_SQL, 1)}


@query("p26_default_realization", sql.steps(sql.GRID, sql.PLACES, sql.densities(rows_of("uniform")), sql.draws(_ONCE), sql.DEPTHS) + f" SELECT watershed, realization, event_id, storm_path, {r('precip_avg_mm exc_prb')} FROM depths")
def p26(spark, sf_dir):
    """Events without a realization belong to realization 1."""
    c, e = sampled(spark, sf_dir, ["uniform"], 1)
    d = study.evaluate_depths(e.drop("realization", "realization_seed"), c)
    return rounded(d.select("watershed", "realization", "event_id", "storm_path", "precip_avg_mm", "exc_prb"))


#: Depth-like rows without sampling: ten realizations of user events.
_EVENTS = "SELECT event_id, CAST(user_id % 10 AS INT) AS realization, value AS depth, 1e0 AS weight FROM {events}"
_RUN = "SUM({w}) OVER (PARTITION BY realization ORDER BY depth DESC NULLS LAST, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def event_depths(spark, sf_dir):
    return spark.sql(_EVENTS, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


@query("w1_exceedance", f"SELECT event_id, realization, round({_RUN.format(w='weight')}, 6) AS exc_prb FROM ({_EVENTS.format(events='events')})")
def w1(spark, sf_dir):
    return rounded(depth.exceedance(event_depths(spark, sf_dir), ("realization",), "depth").select("event_id", "realization", "exc_prb"))


@query("w2_renormalized_exceedance", f"SELECT event_id, realization, round({_RUN.format(w='w')}, 9) AS exc_prb FROM (SELECT *, weight / sum(weight) OVER (PARTITION BY realization) AS w FROM ({_EVENTS.format(events='events')}))")
def w2(spark, sf_dir):
    return rounded(depth.exceedance(event_depths(spark, sf_dir), ("realization",), "depth", renormalize=True).select("event_id", "realization", "exc_prb"), 9)


@query("w3_exceedance_by_buckets", ORACLE_SQL["w1_exceedance"])
def w3(spark, sf_dir):
    """By ranges of the order, each of which one task holds."""
    return rounded(depth.exceedance_by_ranges(event_depths(spark, sf_dir), 64, ("realization",), "depth").select("event_id", "realization", "exc_prb"))


# curves -------------------------------------------------------------------------------------------------------------

_CURVES = sql.steps(sql.GRID, sql.PLACES, sql.densities(ROWS), sql.draws(SIZES), sql.DEPTHS, sql.curves())
_STATS = "mean_in median_in ci90_low_in ci90_high_in ci95_low_in ci95_high_in"


@query("m6_return_periods", _CURVES + f" SELECT watershed, scenario, RP, {r(_STATS)}, n_realizations, n_samples_per_realization FROM summary JOIN census USING (watershed, scenario)")
def m6(spark, sf_dir):
    """p16-p18, w5, w6, a8-a10: sample, depth, exceedance, curve and bands for all watersheds and scenarios."""
    c, e = sampled(spark, sf_dir)
    return rounded(curves.summarize(study.curve_depths(e, c)))


@query("w6_curves", _CURVES + " SELECT watershed, scenario, realization, CAST(RP AS INT) AS RP, round(d, 6) AS depth_in FROM whole")
def w6(spark, sf_dir):
    c, e = sampled(spark, sf_dir)
    keys = ["watershed", "scenario"]
    points = store.snapshot(curves.curve_points(store.snapshot(study.curve_depths(e, c), "depths"), keys, rp_min=2), "points")  # each is read twice
    return rounded(curves.interpolate(points, keys, 2, curves.top_period(points, keys, 2, 2000, True)))


_NAMES = curves.STATISTICS


def _errors(obs: str, sim: str, on: str, by: str) -> str:
    err = lambda s: f"(s.{s}_in - o.{s}_in)"
    cols = [f"round(sqrt(avg({err(s)} * {err(s)})), 6) AS rmse_{s}, round(avg({err(s)}), 6) AS me_{s}, round(arg_max({err(s)}, s.RP), 6) AS diff_at_maxrp_{s}" for s in _NAMES]
    return f"SELECT {by}, count(*) AS n_points, CAST(min(s.RP) AS DOUBLE) AS rp_min_used, CAST(max(s.RP) AS DOUBLE) AS rp_max_used, {', '.join(cols)} FROM {obs} o JOIN {sim} s ON {on} GROUP BY {by}"


@query("m7_metrics", _CURVES + ", base AS (SELECT * FROM summary WHERE scenario = 'uniform'), sim AS (SELECT * FROM summary WHERE scenario <> 'uniform') " + _errors("base", "sim", "o.watershed = s.watershed AND o.RP = s.RP", "s.watershed, s.scenario"))
def m7(spark, sf_dir):
    """j12, a11, a12, m12: each proposal against the uniform baseline of its watershed."""
    s = m6_raw(spark, sf_dir)
    return rounded(study.combined_metrics(s.where("scenario = 'uniform'").drop("scenario"), s.where("scenario <> 'uniform'")))


def m6_raw(spark, sf_dir):
    c, e = sampled(spark, sf_dir)
    return store.snapshot(curves.summarize(study.curve_depths(e, c)), "summary")  # read three times


_BASE = {"uniform": (derived.DRAWS_SQL, 10)}
_BASE_SQL = sql.steps(sql.GRID, sql.PLACES, sql.densities(rows_of("uniform")), sql.draws(_BASE), sql.DEPTHS, sql.curves(rp_min=2, cap=500))


@query("m10_baseline", _BASE_SQL + f" SELECT watershed, RP, {r(_STATS)}, n_realizations, n_samples_per_realization FROM summary JOIN census USING (watershed, scenario)")
def m10(spark, sf_dir):
    """The full Monte Carlo baseline of all watersheds in one job."""
    c, e = sampled(spark, sf_dir, ["uniform"], 10)
    return rounded(curves.summarize(study.curve_depths(e, c), rp_max_cap=500).drop("scenario"))


#: The mixture's draws, in tenths of the baseline's.
_SWEEP = (3, 6, 9)
_TENTHS = [f"{derived.DRAWS_SQL} * {k} // 10" for k in _SWEEP]
_SWEEP_ROWS = [("n", *c) for c in PROPOSALS["mixture"].components()]
_SWEEP_SQL = sql.steps(sql.GRID, sql.PLACES, sql.densities(_SWEEP_ROWS), sql.draws({"n": (_TENTHS[-1], 10)}), sql.depths(), sql.nested(_TENTHS), sql.curves())
_SWEEP_BASE = sql.steps(sql.GRID, sql.PLACES, sql.densities(rows_of("uniform")), sql.draws(_BASE), sql.DEPTHS, sql.curves()) + " SELECT * FROM summary"


@query(
    "m11_sweep",
    f"WITH base AS ({_SWEEP_BASE}), sim AS ({_SWEEP_SQL} SELECT * FROM summary), m AS ("
    + _errors("base", "sim", "o.watershed = s.watershed AND o.RP = s.RP", "s.watershed, s.scenario")
    + f") SELECT *, CAST(substr(scenario, 2) AS BIGINT) AS num_simulations, round(1e2 * ({derived.DRAWS_SQL} - CAST(substr(scenario, 2) AS BIGINT)) / CAST({derived.DRAWS_SQL} AS DOUBLE), 6) AS reduction_pct FROM m",
)
def m11(spark, sf_dir):
    """Numbers of draws of a mixture against the baseline: prefixes of one sample, whose depths are evaluated once."""
    c, e = sampled(spark, sf_dir, ["uniform"], 10)
    n = derived.draws(spark, sf_dir)
    base = store.snapshot(curves.summarize(study.curve_depths(e, c)).drop("scenario"), "baseline")
    return rounded(study.sweep(c, PROPOSALS["mixture"], [n * k // 10 for k in _SWEEP], 10, base, n, uniforms=draw.portable()))


# sources and sinks ---------------------------------------------------------------------------------------------------


@query("s2_polygon_layers", sql.steps(sql.GRID, _FOOT) + " SELECT layer, ring, seq, round(x, 4) AS x, round(y, 4) AS y FROM foot")
def s2(spark, sf_dir):
    """Outlines written as one GeoJSON file and read again as vertices."""
    points = footprints(cells(spark, sf_dir)).groupBy("layer", "ring").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("p"))
    features = points.select(F.expr("""named_struct('type', 'Feature', 'properties', map('name', layer),
        'geometry', named_struct('type', 'Polygon', 'coordinates', array(transform(p, v -> array(v.x, v.y))))) AS f"""))  # a feature per storm
    text = features.agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list("f").alias("features"))).alias("value"))
    path = store.scratch(spark, "outlines")
    text.coalesce(1).write.text(path)
    return rounded(polygons.read_geojson(spark, path, layer_property="name").select("layer", "ring", "seq", "x", "y"), 4)


@query("s3_file_listing", "SELECT concat('storm_', CAST(l_suppkey AS STRING)) AS storm_path, count(*) AS records, count(DISTINCT l_linenumber) AS lines FROM lineitem GROUP BY l_suppkey")
def s3(spark, sf_dir):
    """A file of gridded records for each storm: listed by their stems, and read by the same pattern."""
    path = store.scratch(spark, "storms")
    store.dealt(derived.grid_cells(spark, sf_dir), "storm_path").write.partitionBy("storm_path").parquet(path)
    files = records.list_storms(spark, path)
    stem = lambda c: F.regexp_extract(c, "storm_path=([^/]+)", 1)
    found = records.read_storms(spark, path).select(stem("_metadata.file_path").alias("storm_path"), "record")
    counts = found.groupBy("storm_path").agg(F.count("*").alias("records"), F.countDistinct("record").alias("lines"))
    return files.select(stem("file").alias("storm_path")).join(counts, "storm_path")


@query("s5_tables_as_csv", sql.steps(sql.GRID) + f" SELECT storm_path, x, y, {r('pmax_mm')} FROM centers")
def s5(spark, sf_dir):
    """Written as CSV, a folder per storm, and read again."""
    path = store.scratch(spark, "centers")
    store.write_table(store.dealt(fields.storm_centers(cells(spark, sf_dir)), "storm_path"), path, ("storm_path",), "csv")
    return rounded(spark.read.option("header", True).schema("x double, y double, pmax_mm double, storm_path string").csv(path).select("storm_path", "x", "y", "pmax_mm"))


_BASELINE = "SELECT CAST(l_linenumber AS INT) AS RP, round(avg(l_quantity), 6) AS median_in, min(l_quantity) AS ci95_low_in, max(l_quantity) AS ci95_high_in FROM {lines} GROUP BY l_linenumber"


@query("s11_baseline", _BASELINE.format(lines="lineitem"))
def s11(spark, sf_dir):
    """A summary written, then read as a baseline: its columns are checked."""
    path = store.scratch(spark, "baseline")
    store.write_table(spark.sql(_BASELINE, lines=spark.read.parquet(f"{sf_dir}/lineitem.parquet")), path, ())
    return store.read_baseline(spark, path)


@query("g8_uniforms", "SELECT CAST(d AS INT) AS tenth, s AS stream, true AS even FROM range(10) a(d), (VALUES (1), (2)) b(s)")
def g8(spark, sf_dir):
    """Hashed uniforms of a row per line item: each tenth holds a tenth of them, in both streams, within five deviations."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_returnflag").alias("watershed"), F.col("l_linestatus").alias("scenario"), F.col("l_linenumber").alias("realization"), F.col("l_orderkey").alias("event_id"))
    u = draw.hashed(11)
    each = lines.select(F.explode(F.array(*(F.struct(F.lit(s).alias("stream"), u(s).alias("u")) for s in (1, 2)))).alias("e")).select("e.stream", F.floor(10 * F.col("e.u")).cast("int").alias("tenth"))
    n = each.groupBy("stream", "tenth").agg(F.count("*").alias("n"))
    total = each.groupBy("stream").agg(F.count("*").alias("total"))
    return n.join(total, "stream").select("tenth", "stream", (F.abs(F.col("n") - F.col("total") / 10) < 5 * F.sqrt(0.09 * F.col("total"))).alias("even"))


_EVERY = "samples AS (SELECT v.watershed, v.storm_path, v.x - c.x AS delx, v.y - c.y AS dely FROM valid v JOIN centers c ON c.storm_path = v.storm_path)"


@query(
    "g8_unbiased_depths",
    sql.steps(sql.GRID, sql.PLACES, _EVERY, sql.means())
    + f""" SELECT watershed, scenario, round(avg(m), 6) AS expected_mm, {derived.DRAWS_SQL} * {REALIZATIONS} AS events, true AS reached
FROM (SELECT watershed, storm_path, avg(precip_avg_mm) AS m FROM means GROUP BY watershed, storm_path), (VALUES ('uniform'), ('gaussian')) AS v(scenario) GROUP BY watershed, scenario""",
)
def g8_unbiased(spark, sf_dir):
    """Hashed streams in a whole study: the weighted mean depth of each proposal reaches that of all valid cells of all storms within six deviations."""
    c, n = catalog(spark, sf_dir), derived.draws(spark, sf_dir)
    every = study.placed(c.valid_cells.select("watershed", "storm_path", F.col("x").alias("newx"), F.col("y").alias("newy")), c)
    means = depth.mean_depths_by_runs(every, c.watershed_mask, c.storm_rows)
    expected = store.snapshot(means.groupBy("watershed", "storm_path").agg(F.avg("precip_avg_mm").alias("m")).groupBy("watershed").agg(F.avg("m").alias("expected_mm")), "expected")
    names = ("uniform", "gaussian")
    events = store.snapshot(study.sample_events(c, {s: PROPOSALS[s] for s in names}, {s: (n, REALIZATIONS) for s in names}, seed=7), "events")
    d = study.evaluate_depths(events, c, largest=n).join(expected, "watershed").withColumn("off", F.col("weight") * (F.col("precip_avg_mm") - F.col("expected_mm")))
    sums = d.groupBy("watershed", "scenario", "expected_mm").agg(F.count("*").alias("events"), F.sum("off").alias("off"), F.sum(F.col("off") * F.col("off")).alias("square"))
    return sums.select("watershed", "scenario", F.round("expected_mm", 6).alias("expected_mm"), "events", (F.abs("off") < 6 * F.sqrt("square")).alias("reached"))


# grids ---------------------------------------------------------------------------------------------------------------

_FINE = "fine AS (SELECT CAST(i // 40 AS INT) AS row, CAST(i % 40 AS INT) AS col, (5e-1 + i % 40) * 3e3 AS x, (5e-1 + i // 40) * 3e3 AS y FROM range(1200) t(i))"


def fine(spark):
    return geometry.Grid.over(0, 0, 120000, 90000, 3000.0).cells(spark)


@query(
    "j11_align_nearest",
    sql.steps(sql.GRID, _FINE)
    + f""" SELECT c.storm_path, f.row, f.col, f.x, f.y, round(c.precip_mm, 6) AS precip_mm FROM fine f, storm_cells c
WHERE f.x >= 2e3 AND f.y >= 2e3 AND c.col = ceil(f.x / 4e3 - 1e0) AND c.row = ceil(f.y / 4e3 - 1e0) AND c.x <= {derived.COLS * CELL!r} AND c.y <= {derived.ROWS * CELL!r}""",
)
def j11_nearest(spark, sf_dir):
    return rounded(align.align(cells(spark, sf_dir), fine(spark)))


@query(
    "j11_align_linear",
    sql.steps(sql.GRID, _FINE)
    + """, corner AS (SELECT f.row, f.col, f.x, f.y, floor((f.x - 2e3) / 4e3) + i AS c, floor((f.y - 2e3) / 4e3) + j AS r,
  (CASE WHEN i = 1 THEN 1 ELSE -1 END) * ((f.x - 2e3) / 4e3 - floor((f.x - 2e3) / 4e3)) + 1 - i AS wx, (CASE WHEN j = 1 THEN 1 ELSE -1 END) * ((f.y - 2e3) / 4e3 - floor((f.y - 2e3) / 4e3)) + 1 - j AS wy
  FROM fine f, range(2) a(i), range(2) b(j) WHERE f.x >= 2e3 AND f.y >= 2e3)
SELECT s.storm_path, k.row, k.col, k.x, k.y, round(sum(wx * wy * s.precip_mm), 9) AS precip_mm FROM corner k JOIN storm_cells s ON s.row = k.r AND s.col = k.c WHERE wx * wy > 0 GROUP BY ALL""",
)
def j11_linear(spark, sf_dir):
    return rounded(align.align(cells(spark, sf_dir), fine(spark), "linear"), 9)


# adaptation ----------------------------------------------------------------------------------------------------------

ADAPTED = Adaptation(sd_x_n=20000.0, sd_y_n=15000.0, sd_x_w=70000.0, sd_y_w=60000.0, rho_n=0.1)
_DRAWS, _ITERATIONS = 500, 2
_HISTORY = " UNION ALL ".join(
    f"SELECT watershed, scenario, {i} AS iter, CAST({_DRAWS if i else 0} AS BIGINT) AS n, updated, {r('mix mu_x_n mu_y_n sd_x_n sd_y_n rho_n')}, round(beta, 6) AS beta_hat_reward FROM state{i}" for i in range(_ITERATIONS + 1)
)


def adapted(spark, sf_dir, iterations: int = _ITERATIONS):
    c = catalog(spark, sf_dir)
    a = AdaptedProposals(c, {(w, "storms"): ADAPTED for w in derived.WATERSHEDS})
    a.adapt(iterations, _DRAWS, threshold=1.0, uniforms=draw.portable)
    return a


@query("m8_adapt", sql.steps(sql.GRID, sql.PLACES, sql.adaptation(_ITERATIONS, _DRAWS, 1.0, ADAPTED, "storms")) + f" SELECT * FROM ({_HISTORY})")
def m8(spark, sf_dir):
    """p14, p15, a13-a16: history of the adapted mixtures."""
    return rounded(adapted(spark, sf_dir).history())


@query(
    "m9_final_draw",
    sql.steps(sql.GRID, sql.PLACES, sql.adaptation(1, _DRAWS, 1.0, ADAPTED, "storms", (derived.DRAWS_SQL, 3))) + f" SELECT {_EVENT}, {r('weight_raw weight', 9)}, {r('precip_avg_mm exc_prb')} FROM depths_final",
)
def m9(spark, sf_dir):
    a = adapted(spark, sf_dir, 1)
    e = a.sample_final(derived.draws(spark, sf_dir), 3, uniforms=draw.portable(2)).drop("realization_seed")
    return e.select(*(F.round(c, 9 if c.startswith("weight") else 6).alias(c) if t == "double" and c not in ("x", "y", "newx", "newy", "delx", "dely") else F.col(c) for c, t in e.dtypes))
