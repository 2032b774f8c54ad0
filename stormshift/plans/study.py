"""Sampling, depths and curves for all watersheds and scenarios at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormshift.operators import curves, depth, draw, proposal
from stormshift.operators.geometry import depth_of_runs, run_cells
from stormshift.operators.proposal import Proposal
from stormshift.sources.store import Catalog, growing, snapshot

SAMPLES = ("watershed", "scenario", "realization", "realization_seed", "event_id", "storm_path", "x", "y", "newx", "newy", "delx", "dely", "weight_raw", "weight")


def sampling_plan(catalog: Catalog, sizes: dict[str, tuple[int, int]]) -> DataFrame:
    """watershed, scenario, n, realizations for scenario -> (n, realizations)."""
    names = catalog.valid_runs.select("watershed").distinct()
    each = F.array(*(F.struct(F.lit(s).alias("scenario"), F.lit(int(n)).cast("long").alias("n"), F.lit(int(r)).cast("long").alias("realizations")) for s, (n, r) in sizes.items()))
    return names.select("watershed", F.explode(each).alias("p")).select("watershed", "p.*")


def weighed_cells(catalog: Catalog, components: DataFrame, custom: dict[str, Proposal] | None = None, floor: float = proposal.FLOOR, runs: DataFrame | None = None) -> DataFrame:
    """The cells that weighted draws choose from, with densities of the cells that are valid for any storm. runs: those of all storms, by default."""
    grid = catalog.domain_grid
    valid = catalog.live_runs if runs is None else runs
    places = run_cells(depth_of_runs(valid, ["watershed"]), "watershed")
    density = proposal.densities(places, components, grid, floor, custom)
    return draw.weigh_cells(valid, density, grid)


def sample_with(catalog: Catalog, plan: DataFrame, components: DataFrame, seed: int = 0, uniforms: Callable | None = None, guided: bool = True, fallback: bool = False, custom: dict[str, Proposal] | None = None, floor: float = proposal.FLOOR) -> DataFrame:
    """Events of every row of plan, with the density at the cell drawn. guided: by mass; else by rank, for uniform proposals."""
    storms = draw.drawable_storms(catalog.live_runs, catalog.storm_centers).join(growing(catalog.alike_storms), ["watershed", "storm_path"])
    storms = snapshot(storms, "storms")  # read twice
    u = uniforms or draw.hashed(seed)
    events = draw.draw_storms(draw.generate(plan, seed), storms, u(1))
    # cells are looked up under the first storm that has the same
    valid, events = catalog.shared_runs, events.withColumnsRenamed({"storm_path": "_storm", "like": "storm_path"})
    if guided:
        weighed = snapshot(weighed_cells(catalog, components, custom, floor, valid), "weighed")
        events = draw.draw_weighted_cells(events.drop("_runs"), weighed, u(2))
    else:
        events = draw.draw_uniform_cells(events, valid, u(2), catalog.domain_grid)
    events = events.drop("storm_path").withColumnRenamed("_storm", "storm_path")
    events = draw.with_weights(snapshot(events, "drawn"), fallback)  # read twice: for the sum of weights, and to be weighed
    return events.withColumns({"delx": F.col("newx") - F.col("x"), "dely": F.col("newy") - F.col("y")})


def sample_events(catalog: Catalog, proposals: dict[str, Proposal], sizes: dict[str, tuple[int, int]], seed: int = 0, uniforms: Callable | None = None, floor: float = proposal.FLOOR) -> DataFrame:
    """SAMPLES for each watershed of the catalog and each scenario.

    Uniform scenarios draw a cell by rank, the others by mass; both give the same distribution for a uniform proposal.
    """
    draw.require_rows(catalog.live_runs.limit(1), "no storm has a valid cell")
    stats = catalog.layer_stats.join(catalog.valid_runs.select(F.col("watershed").alias("layer")).distinct(), "layer", "left_semi")
    custom = {s: p for s, p in proposals.items() if p.family == "custom"}
    out = []
    for guided in (False, True):
        chosen = {s: p for s, p in proposals.items() if (p.family == "uniform") != guided}
        if chosen:
            plan = sampling_plan(catalog, {s: sizes[s] for s in chosen})
            out.append(sample_with(catalog, plan, proposal.components(chosen, stats), seed, uniforms, guided, custom=custom, floor=floor).select(*SAMPLES))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def placed(events: DataFrame, catalog: Catalog) -> DataFrame:
    """Events of known storms with grid_id and the shift (dy, dx) in cells of the storm's own grid."""
    return draw.with_shifts(events, catalog.storm_places)


def event_depths(events: DataFrame, catalog: Catalog, zero_pad: bool = True, by_cells: bool = False) -> DataFrame:
    """Mean depth over the watershed for each event. x, y are the new centre, as are newx, newy.

    Events without a realization belong to realization 1; events of unknown storms are dropped; empty in, empty out.
    by_cells: cell by cell instead of run by run.
    """
    events = _with_keys(events)
    e = placed(events, catalog)
    means = depth.mean_depths(e, catalog.mask_cells, catalog.storm_cells, zero_pad) if by_cells else depth.mean_depths_by_runs(e, catalog.watershed_mask, catalog.storm_rows, zero_pad)
    e = e.join(growing(snapshot(means, "means")), depth.PLACE)  # a plan of its own: else every later one holds it, as often as it reads depths
    names = [c for c in ("realization_seed",) if c in events.columns]
    return e.select("watershed", "scenario", "realization", *names, "event_id", "storm_path", F.col("newx").alias("x"), F.col("newy").alias("y"), "newx", "newy", "weight", "precip_avg_mm")


def _with_keys(events: DataFrame) -> DataFrame:
    return events.withColumns({c: F.lit(value) for c, value in (("realization", 1), ("scenario", "")) if c not in events.columns})


def evaluate_depths(events: DataFrame, catalog: Catalog, zero_pad: bool = True, by_cells: bool = False, renormalize: bool = False, largest: int | None = None) -> DataFrame:
    """event_depths and exceedance for each event. largest: events of the largest realization, if known."""
    return depth.exceedance_by_size(event_depths(events, catalog, zero_pad, by_cells), _with_keys(events), renormalize=renormalize, largest=largest)


def curve_depths(events: DataFrame, catalog: Catalog, *names: str, largest: int | None = None) -> DataFrame:
    """evaluate_depths with no more columns than curves need, and names: large realizations are written in between, with all that they hold."""
    d = event_depths(events, catalog).select("watershed", "scenario", "realization", "event_id", *names, "weight", "precip_avg_mm")
    return depth.exceedance_by_size(d, _with_keys(events), largest=largest)


def study(catalog: Catalog, proposals: dict[str, Proposal], sizes: dict[str, tuple[int, int]], seed: int = 0, uniforms: Callable | None = None, **summary) -> DataFrame:
    """Sample, evaluate, summarize."""
    events = snapshot(sample_events(catalog, proposals, sizes, seed, uniforms), "events")  # read twice
    n, realizations = (max(x) for x in zip(*sizes.values()))
    return curves.summarize(curve_depths(events, catalog, largest=n), realizations=realizations, **summary)


def nested_depths(depths: DataFrame, numbers: list[int]) -> DataFrame:
    """depths of one scenario -> a scenario n<number> for each of numbers: its first events, with weights and exceedance of their own.

    An event's depth does not depend on how many others are drawn, so the largest sample is evaluated once. Events are
    numbered in the order they are drawn, and a prefix of a stream is a smaller sample of it.
    """
    each = F.filter(F.array(*(F.lit(int(n)) for n in numbers)), lambda n: n >= F.col("event_id"))
    d = depths.drop("exc_prb").withColumn("_n", F.explode(each)).withColumn("scenario", F.concat(F.lit("n"), F.col("_n").cast("string"))).drop("_n")
    by = ["watershed", "scenario", "realization"]
    sums = d.groupBy(*by).agg(F.sum("weight").alias("_sum"), F.count("*").alias("_rows"))
    share = F.when((F.col("_sum") > 0) & (F.col("_sum") < F.lit(float("inf"))), F.expr("try_divide(weight, _sum)")).otherwise(1 / F.col("_rows"))
    d = d.join(sums.hint("shuffle_hash"), by).withColumn("weight", share).drop("_sum", "_rows")
    return depth.exceedance_by_size(d, d, largest=max(numbers))


def sweep(catalog: Catalog, family: Proposal, numbers: list[int], realizations: int, baseline: DataFrame, baseline_n: int, seed: int = 0, uniforms: Callable | None = None, **summary) -> DataFrame:
    """Errors against a baseline for several numbers of draws, with the draws saved in per cent. Smaller samples are the first events of larger ones."""
    most = max(numbers)
    events = snapshot(sample_events(catalog, {"n": family}, {"n": (most, realizations)}, seed, uniforms), "events")  # read twice
    depths = snapshot(event_depths(events, catalog), "depths")  # read for all numbers, and for the sums of their weights
    sim = snapshot(curves.summarize(nested_depths(depths, numbers), realizations=realizations, **summary), "summary")  # read twice
    out = curves.compare(baseline, sim)
    out = out.withColumn("num_simulations", F.substring("scenario", 2, 20).cast("long"))
    return out.withColumn("reduction_pct", 100.0 * (baseline_n - F.col("num_simulations")) / baseline_n)


def combined_metrics(baselines: DataFrame, summaries: DataFrame) -> DataFrame:
    """Errors of every watershed and scenario against the watershed's own baseline, as one table."""
    return curves.compare(baselines, summaries).orderBy("watershed", *[c for c in ("scenario",) if c in summaries.columns])
