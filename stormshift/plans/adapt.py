"""Moving a mixture proposal towards the placements that matter, for many watersheds and scenarios together.

The state is a row per (watershed, scenario) with some twenty numbers. An iteration draws events, evaluates them, and
reduces them by two grouped aggregates; only state rows pass from one iteration to the next, so lineage does not grow.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from stormshift.functions.scalars import responsibility, reward
from stormshift.functions.text import num
from stormshift.operators import depth as depth_
from stormshift.operators import draw, proposal
from stormshift.plans.study import SAMPLES, evaluate_depths, placed, sample_with, sampling_plan
from stormshift.sources.store import Catalog, growing, scratch, snapshot

KEYS = draw.KEYS
#: Fixed value: the clip of latent scores in the correlation step.
SCORE_CLIP = 1e-12


@dataclass(frozen=True)
class Adaptation:
    """A mixture in motion: the narrow component adapts, the wide one stays. mu None: the watershed's centroid."""

    sd_x_n: float
    sd_y_n: float
    sd_x_w: float
    sd_y_w: float
    mu_x_n: float | None = None
    mu_y_n: float | None = None
    mu_x_w: float | None = None
    mu_y_w: float | None = None
    rho_n: float = 0.0
    rho_w: float = 0.0
    mix: float = 0.3
    lambda_mix: float = 0.3
    beta_floor: float = 0.05
    beta_ceil: float = 0.95
    alpha: float = 0.25
    eps_var: float = 1e-6
    eps_floor: float = 1e-300

    def components(self) -> list[tuple]:
        return [
            ("narrow", self.mix, "copula", self.mu_x_n, self.sd_x_n, self.mu_y_n, self.sd_y_n, self.rho_n),
            ("wide", 1 - self.mix, "copula", self.mu_x_w, self.sd_x_w, self.mu_y_w, self.sd_y_w, self.rho_w),
        ]


HISTORY = "watershed string, scenario string, iter int, n long, updated int, mix double, mu_x_n double, mu_y_n double, sd_x_n double, sd_y_n double, rho_n double, beta_hat_reward double"


class DepthMemo:
    """Depths that earlier iterations evaluated, as a written table by PLACE; only shifts that are not in it are evaluated.

    evaluated: shifts evaluated in each call.
    """

    def __init__(self, catalog: Catalog):
        self.catalog, self.evaluated = catalog, []
        self.path = scratch(catalog.grid_meta.sparkSession, "depth-memo")

    def depths(self, shifts: DataFrame) -> DataFrame:
        """PLACE, precip_avg_mm for the distinct shifts(PLACE, grid_id) and those of earlier calls."""
        spark, schema = shifts.sparkSession, "watershed string, storm_path string, dy int, dx int, precip_avg_mm double"
        fresh = shifts.select(*depth_.PLACE, "grid_id").distinct()
        if self.evaluated:
            fresh = fresh.join(growing(spark.read.schema(schema).parquet(f"{self.path}/*")), depth_.PLACE, "left_anti")
        part = f"{self.path}/{len(self.evaluated)}"
        depth_.mean_depths_by_runs(fresh, self.catalog.watershed_mask, self.catalog.storm_rows).write.parquet(part)
        self.evaluated.append(spark.read.schema(schema).parquet(part).count())
        return spark.read.schema(schema).parquet(f"{self.path}/*")


class AdaptedProposals:
    """State per (watershed, scenario), the history of the iterations, and draws from the final mixtures."""

    def __init__(self, catalog: Catalog, states: dict[tuple[str, str], Adaptation]):
        self.catalog, self.memo = catalog, DepthMemo(catalog)
        centers = {r.layer: (r.x, r.y) for r in catalog.layer_stats.collect()}  # a row per layer

        def centred(key: tuple[str, str], s: Adaptation) -> Adaptation:
            if key[0] not in centers:
                raise ValueError(f"no centre for {key[0]}")
            x, y = centers[key[0]]
            return replace(s, **{f"mu_{a}_{c}": v if getattr(s, f"mu_{a}_{c}") is None else getattr(s, f"mu_{a}_{c}") for a, v in (("x", x), ("y", y)) for c in "nw"})

        self.states = {k: centred(k, s) for k, s in states.items()}
        self.rows: list[tuple] = []

    @property
    def spark(self):
        return self.catalog.grid_meta.sparkSession

    def components(self) -> DataFrame:
        rows = [(*k, *c) for k, s in self.states.items() for c in s.components()]
        return self.spark.createDataFrame(rows, proposal.COMPONENTS)

    def parameters(self) -> DataFrame:
        rows = [Row(watershed=w, scenario=c, **{k: float(v) for k, v in asdict(s).items()}) for (w, c), s in self.states.items()]
        return self.spark.createDataFrame(rows)

    def history(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, HISTORY)

    def _note(self, i: int, n: int, updated: dict, beta: dict) -> None:
        for k, s in self.states.items():
            self.rows.append((*k, i, n, int(updated.get(k, 0)), s.mix, s.mu_x_n, s.mu_y_n, s.sd_x_n, s.sd_y_n, s.rho_n, beta.get(k)))

    def adapt(self, iterations: int, samples: int, threshold: float = 0.0, seed: int = 0, uniforms: Callable[[int], Callable] | None = None) -> DataFrame:
        """HISTORY with a row for the start and one for each iteration. uniforms: iteration -> its streams; by default hashed ones of seed + iteration."""
        if not self.rows:
            self._note(0, 0, {}, {})
        for i in range(1, iterations + 1):
            u = uniforms(i) if uniforms else draw.hashed(seed + i)
            events = snapshot(self._rewarded(samples, threshold, u), "rewarded")
            moments = self._moments(events)
            before = self.states
            self.states = {k: self._moved(s, moments.get(k)) for k, s in self.states.items()}
            updated = {k: self._counts(moments.get(k)) for k in self.states}
            scores = self._correlations(events)
            self.states = {k: self._turned(s, scores.get(k), updated[k], before[k]) for k, s in self.states.items()}
            beta = {k: m.beta for k, m in moments.items()}
            self._note(i, samples, updated, beta)
        return self.history()

    def _plan(self, n: int, realizations: int) -> DataFrame:
        plan = sampling_plan(self.catalog, {s: (n, realizations) for s in {k[1] for k in self.states}})
        return plan.join(self.parameters().select(*KEYS), KEYS, "left_semi")

    def _rewarded(self, samples: int, threshold: float, uniforms: Callable) -> DataFrame:
        """Events with normalized weight, reward and the narrow component's responsibility."""
        e = sample_with(self.catalog, self._plan(samples, 1), self.components(), uniforms=uniforms, fallback=True)
        e = snapshot(placed(e, self.catalog), "drawn")  # read twice: for the shifts that are new, and with their depths
        e = e.join(growing(self.memo.depths(e)), depth_.PLACE).join(F.broadcast(self.parameters().select(*KEYS, "mix")), KEYS)
        e = e.withColumns({"r": F.expr(responsibility("mix", "q_narrow", "q_wide")), "reward": F.expr(reward("coalesce(precip_avg_mm, 0e0)", num(threshold)))})
        return e.select(*KEYS, "event_id", "newx", "newy", "row", "col", "weight", "reward", "r", "precip_avg_mm")

    def _moments(self, events: DataFrame) -> dict:
        """One job: responsibility's share of the reward, and moments about the present centre."""
        e = events.join(F.broadcast(self.parameters().select(*KEYS, "mu_x_n", "mu_y_n")), KEYS)  # a row per watershed and scenario, as in the driver
        w = F.col("weight") * F.col("reward")
        n = w * F.col("r")
        dx, dy = F.col("newx") - F.col("mu_x_n"), F.col("newy") - F.col("mu_y_n")
        sums = e.groupBy(*KEYS).agg(
            F.sum(w).alias("w"), F.sum(n).alias("n"), F.sum(n * dx).alias("x"), F.sum(n * dy).alias("y"), F.sum(n * dx * dx).alias("xx"), F.sum(n * dy * dy).alias("yy"), F.count_if(F.col("reward") != 0).alias("hits")
        )
        sums = sums.withColumn("beta", F.col("n") / (F.col("w") + 1e-6))
        return {(r.watershed, r.scenario): r for r in sums.collect()}  # a row per watershed and scenario

    @staticmethod
    def _counts(m) -> bool:
        return m is not None and m.n > 0 and m.hits > 10

    def _moved(self, s: Adaptation, m) -> Adaptation:
        if m is None:
            return s
        mix = min(max((1 - s.lambda_mix) * s.mix + s.lambda_mix * m.beta, s.beta_floor), s.beta_ceil)
        if not self._counts(m):
            return replace(s, mix=mix)
        out = {"mix": mix}
        for a, first, second in (("x", m.x, m.xx), ("y", m.y, m.yy)):
            mu, sd = getattr(s, f"mu_{a}_n"), getattr(s, f"sd_{a}_n")
            shift = first / m.n
            variance = max(second / m.n - shift * shift, 0.0) + s.eps_var
            out[f"mu_{a}_n"] = mu + s.alpha * shift
            out[f"sd_{a}_n"] = math.sqrt((1 - s.alpha) * sd * sd + s.alpha * variance)
        return replace(s, **out)

    def _correlations(self, events: DataFrame) -> dict:
        """The second job: latent scores under the moved centre and spread."""
        narrow = self.components().where("component = 'narrow'")
        e = events
        for axis, i in (("x", "col"), ("y", "row")):
            scores = proposal.axis_scores(narrow, self.catalog.domain_grid, axis, SCORE_CLIP)
            e = e.join(F.broadcast(scores.select(*KEYS, i, f"s{axis}")), [*KEYS, i])  # values of one axis of the grid
        w = F.col("weight") * F.col("reward") * F.col("r")
        sums = e.groupBy(*KEYS).agg(F.sum(w).alias("w"), *(F.sum(w * c).alias(k) for k, c in (("x", F.col("sx")), ("y", F.col("sy")), ("xx", F.col("sx") * F.col("sx")), ("yy", F.col("sy") * F.col("sy")), ("xy", F.col("sx") * F.col("sy")))))
        return {(r.watershed, r.scenario): r for r in sums.collect()}  # a row per watershed and scenario

    @staticmethod
    def _turned(s: Adaptation, m, updated: bool, before: Adaptation) -> Adaptation:
        if m is None or not updated:
            return s
        mx, my = m.x / m.w, m.y / m.w
        vx, vy = (max(v, 0.0) + s.eps_var for v in (m.xx / m.w - mx * mx, m.yy / m.w - my * my))
        rho = (m.xy / m.w - mx * my) / math.sqrt(vx * vy)
        return replace(s, rho_n=min(max((1 - s.alpha) * before.rho_n + s.alpha * rho, -0.95), 0.95))

    def sample_final(self, n: int, realizations: int = 1, with_depths: bool = True, seed: int = 0, uniforms: Callable | None = None) -> DataFrame:
        """SAMPLES from the adapted mixtures; with depths and exceedance, or with depth 0."""
        e = sample_with(self.catalog, self._plan(n, realizations), self.components(), seed, uniforms, fallback=True).select(*SAMPLES)
        if not with_depths:
            return e.withColumn("precip_avg_mm", F.lit(0.0))
        e = snapshot(e, "final")  # read twice
        d = evaluate_depths(e, self.catalog, renormalize=True, largest=n)
        found = d.select(*KEYS, "realization", "event_id", "precip_avg_mm", "exc_prb")
        return e.join(growing(found), [*KEYS, "realization", "event_id"])
