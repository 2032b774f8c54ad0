"""Depth against return period: curves, bands and errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormshift.functions.scalars import inches, return_period
from stormshift.sources.store import snapshot

STATISTICS = ("mean", "median", "ci90_low", "ci90_high", "ci95_low", "ci95_high")


def census(depths: DataFrame, keys: list[str], realization: str = "realization") -> DataFrame:
    """n_realizations, and rows per realization, counted before any row is dropped."""
    counts = depths.groupBy(*keys).agg(F.countDistinct(realization).alias("n_realizations"), F.count("*").alias("_rows"))
    return counts.withColumn("n_samples_per_realization", F.expr("CAST(_rows div n_realizations AS LONG)")).drop("_rows")


def curve_points(depths: DataFrame, keys: list[str], per_year: float = 10.0, depth: str = "precip_avg_mm", exceedance: str = "exc_prb", realization: str = "realization", rp_min: float = 1) -> DataFrame:
    """keys, realization, RP, depth_in: finite points; of equal periods the largest depth.

    Of points below rp_min only the last of each curve is kept, from which a segment may reach rp_min: most events are that frequent, and are not shuffled.
    """
    points = depths.where(F.col(depth).isNotNull() & F.col(exceedance).isNotNull())
    points = points.select(*keys, F.col(realization).alias("realization"), F.expr(return_period(exceedance, per_year)).alias("RP"), F.expr(inches(depth)).alias("depth_in"))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    points = points.where(finite("RP") & finite("depth_in"))
    if rp_min <= 1:  # no period is shorter
        return points.groupBy(*keys, "realization", "RP").agg(F.max("depth_in").alias("depth_in"))
    rest = points.where(F.col("RP") >= rp_min).groupBy(*keys, "realization", "RP").agg(F.max("depth_in").alias("depth_in"))
    last = points.where(F.col("RP") < rp_min).groupBy(*keys, "realization").agg(F.max(F.struct("RP", "depth_in")).alias("p"))
    return rest.unionByName(last.select(*keys, "realization", "p.*"))


def interpolate(points: DataFrame, keys: list[str], rp_min: int, top: DataFrame) -> DataFrame:
    """Depths at whole return periods from rp_min to the group's rp_top: each segment of a curve yields its own whole periods."""
    w = Window.partitionBy(*keys, "realization").orderBy("RP")
    s = points.withColumns({"RP2": F.lead("RP").over(w), "d2": F.lead("depth_in").over(w)})
    s = s.join(top, keys)
    last = F.when(F.col("RP2").isNull(), F.col("RP")).otherwise(F.ceil("RP2") - 1)
    s = s.withColumns({"a": F.greatest(F.ceil("RP").cast("long"), F.lit(rp_min).cast("long")), "b": F.least(F.floor(last).cast("long"), F.col("rp_top"))})
    s = s.where("a <= b").withColumn("RP0", F.col("RP")).withColumn("RP", F.explode(F.expr("sequence(a, b)")))
    depth = F.when(F.col("RP2").isNull() | (F.col("RP") == F.col("RP0")), F.col("depth_in")).otherwise(F.col("depth_in") + (F.col("d2") - F.col("depth_in")) * F.expr("try_divide(RP - RP0, RP2 - RP0)"))
    return s.select(*keys, "realization", F.col("RP").cast("int").alias("RP"), depth.alias("depth_in"))


def top_period(points: DataFrame, keys: list[str], rp_min: int, rp_max_cap: int, use_common_min: bool) -> DataFrame:
    """keys, rp_top: the longest period that all curves (or any curve) reach; groups that don't reach rp_min are left out."""
    per = points.groupBy(*keys, "realization").agg(F.max("RP").alias("m"))
    both = per.groupBy(*keys).agg((F.min if use_common_min else F.max)("m").alias("m"))
    return both.select(*keys, F.least(F.floor("m").cast("long"), F.lit(rp_max_cap).cast("long")).alias("rp_top")).where(F.col("rp_top") >= rp_min)


def bands(curves: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, median and 90 and 95 % bands over realizations at each period."""
    q = F.percentile("depth_in", F.array(*(F.lit(x) for x in (0.5, 0.05, 0.95, 0.025, 0.975))))
    out = curves.groupBy(*keys, "RP").agg(F.avg("depth_in").alias("mean_in"), q.alias("q"))
    names = ("median_in", "ci90_low_in", "ci90_high_in", "ci95_low_in", "ci95_high_in")
    return out.select(*keys, "RP", "mean_in", *(F.col("q")[i].alias(n) for i, n in enumerate(names)))


#: Curves of a group up to which the values of one period are sorted by one task.
ONE_TASK = 50_000
#: Cuts of each interval in one round of the selection.
CUTS = 512


def order_statistics(values: DataFrame, keys: list[str], wanted: DataFrame, value: str = "v", leaf: int = ONE_TASK) -> DataFrame:
    """keys, rank, x: the value of each wanted(keys, rank) rank, from 0, among values(keys, value), for groups of any size.

    Selection by histograms: each round counts the values of an interval in CUTS equal parts (a partial aggregate: no
    task sees a whole group), and each rank goes on in the part that holds it, until that part holds `leaf` values at most,
    or one repeated value, and is sorted. Values outside all parts that are left are dropped on the way.
    """
    v = values.select(*keys, F.col(value).alias("_v")).where("_v is not null")
    ends = v.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"))
    # an interval is one row of keys, _lo, _hi, _n values in it, _below values of the group under it; ranks point to intervals
    ranks = snapshot(wanted.join(ends, keys).withColumn("_below", F.lit(0).cast("long")), "ranks")
    v = v.join(ends.select(*keys, "_lo", "_hi"), keys)
    own, found = [*keys, "_lo", "_hi"], None
    while True:
        done = ranks.where((F.col("_n") <= leaf) | (F.col("_lo") == F.col("_hi")))
        found = done if found is None else found.unionByName(done)
        ranks = ranks.where((F.col("_n") > leaf) & (F.col("_lo") < F.col("_hi")))
        if ranks.isEmpty():
            break
        part = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * CUTS), F.lit(CUTS - 1))
        live = v.join(ranks.select(*own).distinct(), own).withColumn("_part", part)
        parts = live.groupBy(*own, "_part").agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"), F.count("*").alias("_m"))
        w = Window.partitionBy(*own).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
        parts = snapshot(parts.withColumn("_upto", F.sum("_m").over(w)), "parts")
        inside = (F.col("rank") >= F.col("_below") + F.col("_upto") - F.col("_m")) & (F.col("rank") < F.col("_below") + F.col("_upto"))
        ranks = ranks.join(parts, own).where(inside)
        ranks = ranks.select(*keys, "rank", F.col("_a").alias("_lo"), F.col("_b").alias("_hi"), F.col("_m").alias("_n"), (F.col("_below") + F.col("_upto") - F.col("_m")).alias("_below"))
        ranks = snapshot(ranks, "ranks")
        # only values of parts that go on, each under its part's name; a part of one repeated value is done
        rest = ranks.where("_lo < _hi").select(*keys, "_lo", "_hi").distinct()
        named = parts.select(*own, "_part", "_a", "_b")
        v = live.join(named, [*own, "_part"]).select(*keys, "_v", F.col("_a").alias("_lo"), F.col("_b").alias("_hi")).join(rest, own)
        v = snapshot(v, "values") if not rest.isEmpty() else v.limit(0)
        found = snapshot(found, "found")
    found = snapshot(found, "found")
    same = found.where("_lo = _hi").select(*keys, "rank", F.col("_lo").alias("x"))
    sort = found.where("_lo < _hi")
    w = Window.partitionBy(*own).orderBy("_v")
    leaves = values.select(*keys, F.col(value).alias("_v")).join(sort.select(*own).distinct(), keys).where("_v >= _lo and _v <= _hi")
    leaves = leaves.withColumn("_at", F.row_number().over(w) - 1)
    picked = sort.join(leaves, own).where(F.col("rank") - F.col("_below") == F.col("_at")).select(*keys, "rank", F.col("_v").alias("x"))
    return same.unionByName(picked)


def bands_by_selection(curves: DataFrame, keys: list[str], leaf: int = ONE_TASK) -> DataFrame:
    """bands for more curves than one buffer should hold: the same numbers, from order statistics on either side of each quantile."""
    names = {"median_in": 0.5, "ci90_low_in": 0.05, "ci90_high_in": 0.95, "ci95_low_in": 0.025, "ci95_high_in": 0.975}
    by = [*keys, "RP"]
    sizes = snapshot(curves.groupBy(*by).agg(F.avg("depth_in").alias("mean_in"), F.count("depth_in").alias("_n")), "sizes")
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(p).alias("p")) for n, p in names.items())))
    at = sizes.select(*by, "_n", each.alias("q")).select(*by, "q.name", ((F.col("_n") - 1) * F.col("q.p")).alias("h")).where("h >= 0")
    at = at.select(*by, "name", F.floor("h").alias("low"), F.ceil("h").alias("high"), "h")
    wanted = at.select(*by, F.explode(F.array("low", "high")).alias("rank")).distinct()
    x = snapshot(order_statistics(curves, by, wanted, "depth_in", leaf), "order-statistics")
    a, b = (x.withColumnsRenamed({"rank": r, "x": f"x_{r}"}) for r in ("low", "high"))
    # blended as percentile does it
    blend = (F.col("high") - F.col("h")) * F.col("x_low") + (F.col("h") - F.col("low")) * F.col("x_high")
    q = at.join(a, [*by, "low"]).join(b, [*by, "high"]).withColumn("x", F.when(F.col("low") == F.col("high"), F.col("x_low")).otherwise(blend))
    wide = q.groupBy(*by).agg(*(F.max(F.when(F.col("name") == n, F.col("x"))).alias(n) for n in names))
    return sizes.join(wide, by, "left").select(*by, "mean_in", *names)


def summarize(
    depths: DataFrame, keys: tuple = ("watershed", "scenario"), precip_col: str = "precip_avg_mm", exc_col: str = "exc_prb", realization_col: str = "realization",
    k: float = 10.0, rp_min: int = 2, rp_max_cap: int = 2000, use_common_min: bool = True, realizations: int = 0,
) -> DataFrame:
    """Depths by return period for every group of keys at once. An empty input, or curves below rp_min, give no rows.

    realizations: how many curves a group has at most; above ONE_TASK their bands are selected instead of sorted.
    """
    keys = [c for c in keys if c in depths.columns]
    grouped = depths if keys else depths.withColumn("_all", F.lit(0))
    by = keys or ["_all"]
    grouped = snapshot(grouped.select(*by, realization_col, precip_col, exc_col), "depths")  # read three times
    points = snapshot(curve_points(grouped, by, k, precip_col, exc_col, realization_col, rp_min), "points")  # read twice
    curves = interpolate(points, by, rp_min, top_period(points, by, rp_min, rp_max_cap, use_common_min))
    out = (bands_by_selection if realizations > ONE_TASK else bands)(curves, by).where(F.coalesce("mean_in", "median_in").isNotNull())
    out = out.join(census(grouped, by, realization_col), by)
    return out.select(*keys, "RP", "mean_in", "median_in", "ci90_low_in", "ci90_high_in", "ci95_low_in", "ci95_high_in", "n_realizations", "n_samples_per_realization")


def ensure_inches(df: DataFrame) -> DataFrame:
    """Statistics in millimetres, or without a unit, as columns in inches."""
    for s in STATISTICS:
        if f"{s}_in" not in df.columns:
            for c in (f"{s}_mm", s):
                if c in df.columns:
                    df = df.withColumn(f"{s}_in", F.expr(inches(f"`{c}`")))
                    break
    return df


def compare(obs: DataFrame, sim: DataFrame, keys: tuple = ("watershed",), sim_keys: tuple = ("scenario",), rp_col: str = "RP", stats_map: dict[str, str] | None = None, rp_min: float = 2, rp_max: float = 2000) -> DataFrame:
    """Errors of sim against obs at shared periods: a row per group of sim, with 0 points where none is shared."""
    stats = stats_map or {s: f"{s}_in" for s in STATISTICS}
    for df, name in ((obs, "obs"), (sim, "sim")):
        if missing := [c for c in (rp_col, *stats.values()) if c not in df.columns]:
            raise ValueError(f"{name} without {', '.join(missing)}")
    on = [c for c in keys if c in obs.columns and c in sim.columns]
    groups = [*on, *(c for c in sim_keys if c in sim.columns)]
    window = (F.col(rp_col) >= rp_min) & (F.col(rp_col) <= rp_max)
    o = obs.where(window).select(*on, F.col(rp_col).alias("_rp"), *(F.col(c).alias(f"o_{s}") for s, c in stats.items()))
    both = sim.where(window).select(*groups, F.col(rp_col).alias("_rp"), *(F.col(c).alias(f"s_{s}") for s, c in stats.items())).join(o, [*on, "_rp"])
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)
    error = {s: finite(F.col(f"s_{s}") - F.col(f"o_{s}")) for s in stats}
    aggs: list[Column] = [F.count("*").alias("n_points"), F.min("_rp").cast("double").alias("rp_min_used"), F.max("_rp").cast("double").alias("rp_max_used")]
    aggs += [F.sqrt(F.avg(e * e)).alias(f"rmse_{s}") for s, e in error.items()] + [F.avg(e).alias(f"me_{s}") for s, e in error.items()]
    aggs += [F.max_by(e, "_rp").alias(f"diff_at_maxrp_{s}") for s, e in error.items()]
    if not groups:
        return both.agg(*aggs)
    out = sim.select(*groups).distinct().join(both.groupBy(*groups).agg(*aggs), groups, "left")
    return out.fillna(0, ["n_points"])
