"""Densities from which new storm centres are drawn.

A proposal is a row per component: watershed, scenario, component, share, family ('uniform', 'gaussian', 'copula'),
mu_x, sd_x, mu_y, sd_y, rho. A mixture has a narrow and a wide component. Normal distributions are evaluated on the grid's axes
(rows + cols values per component), never on cells.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormshift.functions.normal import CLIP, copula, truncated
from stormshift.functions.scalars import center, short
from stormshift.functions.text import num
from stormshift.operators.geometry import Grid

FLOOR = 1e-300
COMPONENTS = "watershed string, scenario string, component string, share double, family string, mu_x double, sd_x double, mu_y double, sd_y double, rho double"


@dataclass(frozen=True)
class Proposal:
    """One distribution; mu falls back to the watershed's centroid, a mixture's own mu and rho to the plain ones, rho to 0."""

    family: str = "uniform"
    mu_x: float | None = None
    mu_y: float | None = None
    sd_x: float | None = None
    sd_y: float | None = None
    rho: float | None = None
    mix: float | None = None
    narrow: dict | None = None
    wide: dict | None = None
    density: Callable[[Column, Column], Column] | None = None

    def __post_init__(self):
        if self.family not in ("uniform", "gaussian", "copula", "mixture", "custom"):
            raise ValueError(f"no such distribution: {self.family}")
        if self.family == "mixture":
            if self.mix is None or not 0 <= self.mix <= 1:
                raise ValueError("mix must be in [0, 1]")
            parts = [self._part(p) for p in (self.narrow, self.wide)]
        else:
            parts = [] if self.family in ("uniform", "custom") else [self._part({})]
        for p in parts:
            for k in ("sd_x", "sd_y"):
                if p[k] is None or not p[k] > 0:
                    raise ValueError(f"{k} must be positive")
            if not -1 < p["rho"] < 1:
                raise ValueError("rho must be in (-1, 1)")

    def _part(self, own: dict | None) -> dict:
        own = own or {}
        pick = lambda k: own[k] if own.get(k) is not None else getattr(self, k)
        return {k: pick(k) for k in ("mu_x", "sd_x", "mu_y", "sd_y")} | {"rho": pick("rho") or 0.0}

    def components(self) -> list[tuple]:
        """component, share, family, mu_x, sd_x, mu_y, sd_y, rho."""
        if self.family == "mixture":
            return [(name, share, "copula", *self._part(own).values()) for name, share, own in (("narrow", self.mix, self.narrow), ("wide", 1 - self.mix, self.wide))]
        if self.family in ("uniform", "custom"):
            return [("only", 1.0, self.family, None, None, None, None, None)]
        p = self._part({})
        return [("only", 1.0, self.family, *p.values())]


def components(proposals: dict[str, Proposal], stats: DataFrame) -> DataFrame:
    """COMPONENTS for all scenarios and all watersheds of stats (layer, x, y)."""
    names = ("scenario", "component", "share", "family", "mu_x", "sd_x", "mu_y", "sd_y", "rho")
    kinds = dict(c.split() for c in COMPONENTS.split(", "))
    rows = [(s, *c) for s, p in proposals.items() for c in p.components()]
    each = F.array(*(F.struct(*(F.lit(v).cast(kinds[n]).alias(n) for n, v in zip(names, row))) for row in rows))
    t = stats.select(F.col("layer").alias("watershed"), "x", "y", F.explode(each).alias("c")).select("watershed", "x", "y", "c.*")
    need = F.col("family").isin("gaussian", "copula")
    t = t.withColumns({f"mu_{c}": F.when(need, F.coalesce(f"mu_{c}", c)) for c in "xy"})
    return t.select("watershed", "scenario", "component", "share", "family", "mu_x", "sd_x", "mu_y", "sd_y", "rho")


def axis_scores(component_rows: DataFrame, grid: Grid, axis: str, clip: float = CLIP) -> DataFrame:
    """watershed, scenario, component, row or col, density f and latent score s along one axis; bounds are the first and last centre."""
    i, n, origin = {"x": ("col", grid.cols, grid.x0), "y": ("row", grid.rows, grid.y0)}[axis]
    at = lambda k: F.expr(center(num(origin), k, num(grid.cell_size)))
    t = component_rows.where(F.col("family").isin("gaussian", "copula")).select("watershed", "scenario", "component", F.col(f"mu_{axis}").alias("mu"), F.col(f"sd_{axis}").alias("sd"))
    t = t.withColumn(i, F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumns({"v": at(i), "lo": at("0"), "hi": at(str(n - 1))})
    return truncated(t, clip).select("watershed", "scenario", "component", i, F.col("f").alias(f"f{axis}"), F.col("s").alias(f"s{axis}"))


def densities(places: DataFrame, component_rows: DataFrame, grid: Grid, floor: float = FLOOR, custom: dict[str, Proposal] | None = None) -> DataFrame:
    """watershed, scenario, row, col, q, q_narrow, q_wide for places(watershed, row, col): the cells that are asked for, not the grid.

    q has 32 bits, so that the last bit of a logarithm, which engines differ in, does not reach masses and weights.
    """
    keys = ["watershed", "scenario", "component"]
    fx, fy = (axis_scores(component_rows, grid, a) for a in "xy")
    t = grid.placed(places.select("watershed", "row", "col")).join(component_rows, "watershed")
    t = t.join(fx, [*keys, "col"], "left").join(fy, [*keys, "row"], "left")
    own = F.when(F.col("family") == "uniform", F.lit(1.0))
    own = own.when(F.col("family") == "gaussian", F.greatest("fx", F.lit(floor)) * F.greatest("fy", F.lit(floor)))
    own = own.when(F.col("family") == "copula", F.expr(copula("sx", "sy", "rho")) * F.col("fx") * F.col("fy"))
    for scenario, p in (custom or {}).items():
        own = own.when((F.col("scenario") == scenario) & (F.col("family") == "custom"), p.density(F.col("x"), F.col("y")))
    t = t.withColumn("d", own)
    q = F.greatest(F.sum(F.col("share") * F.col("d")), F.lit(floor))
    of = lambda name: F.max(F.when(F.col("component") == name, F.greatest("d", F.lit(floor))))
    out = t.groupBy("watershed", "scenario", "row", "col").agg(q.alias("q"), of("narrow").alias("q_narrow"), of("wide").alias("q_wide"))
    return out.withColumn("q", F.expr(short("q")))
