"""The study's steps as plain SQL over the same tables, for engines that read these queries' tables."""

from __future__ import annotations

from stormshift.functions.normal import CLIP, copula, truncated_sql
from stormshift.functions.scalars import short
from stormshift.sources.derived import CELL, COLS, DOMAIN_SQL, GRID_CELLS, ROWS, SHIFTED_CELLS, WATERSHEDS_SQL

_C = f"{CELL:g}e0"
#: Mass is added in whole units, so many of them for all cells of a storm if each were its densest: 2^62.
_MOST = "4611686018427387904e0"
#: Records are added in whole units of 2^-32 mm: a total that the order of rows does not change.
_TOTAL = "CAST(sum(CAST(round_even(value * 4294967296e0, 0) AS BIGINT)) AS BIGINT) / 4294967296e0"


def storms(cells: str) -> str:
    """Records, cells and centres of storms, their grids, and the domain's grid."""
    return f"""
records AS ({cells}),
storm_cells AS MATERIALIZED (SELECT storm_path, row, col, ll_x + (5e-1 + col) * {_C} AS x, ll_y + (5e-1 + row) * {_C} AS y, {_TOTAL} AS precip_mm, ll_x AS x0, ll_y AS y0 FROM records GROUP BY storm_path, row, col, ll_x, ll_y),
centers AS MATERIALIZED (SELECT storm_path, x, y, x0, y0, precip_mm AS pmax_mm FROM (SELECT *, row_number() OVER (PARTITION BY storm_path ORDER BY precip_mm DESC, row, col) AS k FROM storm_cells) WHERE k = 1),
grids AS (SELECT x0, y0, max(row) + 1 AS rows, max(col) + 1 AS cols FROM storm_cells GROUP BY x0, y0),
grid_cells AS (SELECT x0, y0, row, col, x0 + (5e-1 + col) * {_C} AS x, y0 + (5e-1 + row) * {_C} AS y FROM (SELECT x0, y0, row, unnest(range(cols)) AS col FROM (SELECT x0, y0, cols, unnest(range(rows)) AS row FROM grids))),
grid AS (SELECT CAST(i // {COLS} AS INT) AS row, CAST(i % {COLS} AS INT) AS col, (5e-1 + i % {COLS}) * {_C} AS x, (5e-1 + i // {COLS}) * {_C} AS y FROM range({ROWS * COLS}) t(i))"""


GRID = storms(GRID_CELLS)
SHIFTED = storms(SHIFTED_CELLS)


def edges(name: str, vertices: str) -> str:
    return f"{name} AS (SELECT * FROM (SELECT layer, part, ring, seq, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM {vertices} WINDOW w AS (PARTITION BY layer, part, ring ORDER BY seq)) WHERE x2 IS NOT NULL)"


def stats(name: str, vertices: str, edge: str) -> str:
    """One ring per layer."""
    return f"""{name}_area AS (SELECT e.layer, sum((x1 - minx) * (y2 - miny) - (x2 - minx) * (y1 - miny)) AS a,
  sum((x1 + x2 - 2 * minx) * ((x1 - minx) * (y2 - miny) - (x2 - minx) * (y1 - miny))) AS sx, sum((y1 + y2 - 2 * miny) * ((x1 - minx) * (y2 - miny) - (x2 - minx) * (y1 - miny))) AS sy
  FROM {edge} e JOIN (SELECT layer, min(x) AS minx, min(y) AS miny FROM {vertices} GROUP BY layer) b ON b.layer = e.layer GROUP BY e.layer),
{name} AS (SELECT v.layer, minx, miny, maxx, maxy, minx + sx / (3 * a) AS x, miny + sy / (3 * a) AS y, maxx - minx AS range_x, maxy - miny AS range_y
  FROM (SELECT layer, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM {vertices} GROUP BY layer) v JOIN {name}_area a ON a.layer = v.layer)"""


def within(name: str, points: str, keys: str, edge: str, x: str = "x", y: str = "y") -> str:
    """Points inside by crossing parity; keys name the point, e.layer the layer."""
    return f"{name} AS (SELECT e.layer, {keys} FROM {points} p, {edge} e WHERE (y1 > {y}) <> (y2 > {y}) AND {x} < (x2 - x1) * ({y} - y1) / (y2 - y1) + x1 GROUP BY e.layer, {keys} HAVING count(*) % 2 = 1)"


PLACES = f"""
domain AS ({DOMAIN_SQL}), sheds AS ({WATERSHEDS_SQL}), {edges('domain_edges', 'domain')}, {edges('shed_edges', 'sheds')}, {stats('shed_stats', 'sheds', 'shed_edges')},
{within('mask', 'grid_cells', 'p.x0, p.y0, p.row, p.col', 'shed_edges')}, {within('domain_cells', 'grid', 'p.row, p.col, p.x, p.y', 'domain_edges')},
moved AS (SELECT s.layer AS watershed, v.seq, g.row, g.col, g.x + v.x - s.x AS px, g.y + v.y - s.y AS py FROM grid g, shed_stats s, sheds v WHERE v.layer = s.layer),
{within('kept', 'moved', 'p.watershed, p.seq, p.row, p.col', 'domain_edges', 'px', 'py')},
region AS (SELECT watershed, row, col FROM kept GROUP BY watershed, row, col HAVING count(*) = (SELECT count(*) FROM sheds v WHERE v.layer = watershed)),
valid AS MATERIALIZED (SELECT r.watershed, c.storm_path, d.row, d.col, d.x, d.y FROM domain_cells d, centers c, shed_stats s, region r
  WHERE r.watershed = s.layer AND r.row = CAST(round_even((s.y + c.y - d.y) / {_C} - 5e-1, 0) AS INT) AND r.col = CAST(round_even((s.x + c.x - d.x) / {_C} - 5e-1, 0) AS INT))"""


def components(rows: list[tuple]) -> str:
    """(scenario, component, share, family, mu_x, sd_x, mu_y, sd_y, rho) with None for the centroid."""
    value = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"CAST({v!r} AS DOUBLE)"
    values = ", ".join("(" + ", ".join(map(value, r)) + ")" for r in rows)
    return f"""parts AS (SELECT s.layer AS watershed, scenario, component, share, family, CASE WHEN family = 'uniform' THEN NULL ELSE coalesce(CAST(mu_x AS DOUBLE), s.x) END AS mu_x, CAST(sd_x AS DOUBLE) AS sd_x,
  CASE WHEN family = 'uniform' THEN NULL ELSE coalesce(CAST(mu_y AS DOUBLE), s.y) END AS mu_y, CAST(sd_y AS DOUBLE) AS sd_y, CAST(rho AS DOUBLE) AS rho
  FROM (VALUES {values}) AS v(scenario, component, share, family, mu_x, sd_x, mu_y, sd_y, rho), shed_stats s)"""


def axis(parts: str, a: str, i: str, clip: float = CLIP) -> str:
    """Truncated density f and score s of each component of parts along one axis."""
    return truncated_sql(f"(SELECT p.watershed, p.scenario, p.component, g.{i}, g.{a} AS v, p.mu_{a} AS mu, p.sd_{a} AS sd, (SELECT min({a}) FROM grid) AS lo, (SELECT max({a}) FROM grid) AS hi FROM {parts} p, (SELECT DISTINCT {i}, {a} FROM grid) g WHERE p.family <> 'uniform')", clip)


def densities(rows: list[tuple] | None, k: str = "") -> str:
    """Steps for components of the given rows, or for a step parts<k> that is there; names of all steps end with k."""
    return f"""{components(rows) + ', ' if rows else ''}ax{k} AS MATERIALIZED (SELECT watershed, scenario, component, col, f AS fx, s AS sx FROM {axis(f'parts{k}', 'x', 'col')}), ay{k} AS MATERIALIZED (SELECT watershed, scenario, component, row, f AS fy, s AS sy FROM {axis(f'parts{k}', 'y', 'row')}),
dens{k} AS (SELECT p.watershed, p.scenario, p.component, g.row, g.col, p.share, CASE WHEN family = 'uniform' THEN 1e0 WHEN family = 'gaussian' THEN greatest(fx, 1e-300) * greatest(fy, 1e-300) ELSE {copula('sx', 'sy', 'rho')} * fx * fy END AS d
  FROM grid g CROSS JOIN parts{k} p LEFT JOIN ax{k} ax ON ax.watershed = p.watershed AND ax.scenario = p.scenario AND ax.component = p.component AND ax.col = g.col
  LEFT JOIN ay{k} ay ON ay.watershed = p.watershed AND ay.scenario = p.scenario AND ay.component = p.component AND ay.row = g.row),
density{k} AS MATERIALIZED (SELECT * REPLACE ({short('q')} AS q) FROM (SELECT watershed, scenario, row, col, greatest(sum(share * d), 1e-300) AS q, max(CASE WHEN component = 'narrow' THEN greatest(d, 1e-300) END) AS q_narrow, max(CASE WHEN component = 'wide' THEN greatest(d, 1e-300) END) AS q_wide FROM dens{k} GROUP BY watershed, scenario, row, col))"""


def draws(sizes: dict[str, tuple], k: str = "", part: int = 0) -> str:
    """Events with storms and cells, weights and depths; all scenarios by mass except those whose proposal is uniform, by rank.

    sizes: scenario -> (number of events, a number or SQL; realizations). part: as in draw.portable.
    """
    plan = ", ".join(f"('{s}', {n}, {r})" for s, (n, r) in sizes.items())
    at = f"(id + {50_000_017 * part} + CAST(1000003 AS BIGINT) * (131 * ascii(p.scenario) + ascii(l.layer)))"
    u = lambda a, c, m: f"CAST((({at} * {a} + {c}) % 2147483647 * {m}) % 2147483647 AS DOUBLE) / 2147483647e0"
    return f"""ids{k} AS (SELECT l.layer AS watershed, p.scenario, n, CAST(id // n AS INT) + 1 AS realization, CAST(id % n AS INT) + 1 AS event_id, {u(48271, 82166, 16807)} AS u1, {u(69621, 95028, 39373)} AS u2
  FROM (SELECT DISTINCT layer FROM sheds) l, (SELECT *, unnest(range(n * r)) AS id FROM (VALUES {plan}) AS v(scenario, n, r)) p),
storms{k} AS (SELECT v.watershed, c.storm_path, c.x, c.y, row_number() OVER (PARTITION BY v.watershed ORDER BY c.storm_path) - 1 AS idx, count(*) OVER (PARTITION BY v.watershed) AS n FROM (SELECT DISTINCT watershed, storm_path FROM valid) v JOIN centers c USING (storm_path)),
weighed0{k} AS (SELECT *, {_MOST} / cnt AS scale, CAST(floor(q / top * ({_MOST} / cnt)) AS BIGINT) AS units FROM (SELECT v.*, d.scenario, d.q, d.q_narrow, d.q_wide, max(d.q) OVER s AS top, count(*) OVER s AS cnt FROM valid v JOIN density{k} d ON d.watershed = v.watershed AND d.row = v.row AND d.col = v.col
  WINDOW s AS (PARTITION BY d.watershed, d.scenario, v.storm_path))),
weighed{k} AS MATERIALIZED (SELECT * EXCLUDE (top, scale, units, upto, total), upto / scale * top AS hi, (upto - units) / scale * top AS lo, total / scale * top AS mass
  FROM (SELECT *, CAST(sum(units) OVER w AS BIGINT) AS upto, CAST(sum(units) OVER (PARTITION BY watershed, scenario, storm_path) AS BIGINT) AS total, row_number() OVER w - 1 AS rank FROM weighed0{k}
  WINDOW w AS (PARTITION BY watershed, scenario, storm_path ORDER BY row, col ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))),
flat{k} AS (SELECT DISTINCT scenario FROM parts{k} WHERE family = 'uniform'),
e0{k} AS (SELECT i.*, s.storm_path, s.x, s.y, i.scenario IN (SELECT scenario FROM flat{k}) AS even FROM ids{k} i JOIN storms{k} s ON s.watershed = i.watershed AND s.idx = CAST(floor(i.u1 * s.n) AS BIGINT)),
e1{k} AS (SELECT e.*, w.x AS newx, w.y AS newy, w.row AS newrow, w.col AS newcol, w.q_narrow, w.q_wide, CASE WHEN e.even THEN 1e0 ELSE w.mass / (w.cnt * w.q) END AS weight_raw FROM e0{k} e JOIN weighed{k} w ON w.watershed = e.watershed AND w.scenario = e.scenario AND w.storm_path = e.storm_path
  AND CASE WHEN e.even THEN w.rank = CAST(floor(e.u2 * w.cnt) AS BIGINT) ELSE w.lo <= e.u2 * w.mass AND e.u2 * w.mass < w.hi END),
samples{k} AS MATERIALIZED (SELECT *, newx - x AS delx, newy - y AS dely, weight_raw / sum(weight_raw) OVER (PARTITION BY watershed, scenario, realization) AS weight FROM e1{k})"""


def means(k: str = "") -> str:
    """Mean depth of every distinct shift of samples<k>."""
    return f"""shifts{k} AS MATERIALIZED (SELECT DISTINCT watershed, storm_path, CAST(round_even(dely / {_C}, 0) AS INT) AS dy, CAST(round_even(delx / {_C}, 0) AS INT) AS dx FROM samples{k}),
wanted{k} AS (SELECT s.*, m.row - s.dy AS row, m.col - s.dx AS col FROM shifts{k} s JOIN centers g ON g.storm_path = s.storm_path JOIN mask m ON m.layer = s.watershed AND m.x0 = g.x0 AND m.y0 = g.y0),
means{k} AS MATERIALIZED (SELECT s.watershed, s.storm_path, s.dy, s.dx, sum(coalesce(c.precip_mm, 0e0)) / count(*) AS precip_avg_mm, CASE WHEN count(c.precip_mm) = count(*) THEN avg(c.precip_mm) END AS strict_mm FROM wanted{k} s
  LEFT JOIN storm_cells c ON c.storm_path = s.storm_path AND c.row = s.row AND c.col = s.col GROUP BY s.watershed, s.storm_path, s.dy, s.dx)"""


def depths(k: str = "") -> str:
    return f"""{means(k)},
deep{k} AS MATERIALIZED (SELECT s.*, m.precip_avg_mm FROM samples{k} s JOIN means{k} m ON m.watershed = s.watershed AND m.storm_path = s.storm_path AND m.dy = CAST(round_even(dely / {_C}, 0) AS INT) AND m.dx = CAST(round_even(delx / {_C}, 0) AS INT))"""


def exceeded(source: str = "deep", name: str = "depths") -> str:
    return f"{name} AS MATERIALIZED (SELECT *, sum(weight) OVER (PARTITION BY watershed, scenario, realization ORDER BY precip_avg_mm DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS exc_prb FROM {source})"


DEPTHS = f"{depths()}, {exceeded()}"


def nested(numbers: list[str]) -> str:
    """Samples of several sizes as the first events of one, each with weights of its own."""
    values = ", ".join(f"(CAST({n} AS BIGINT))" for n in numbers)
    return f"""smaller AS (SELECT d.* EXCLUDE (scenario, weight), concat('n', CAST(v.n AS VARCHAR)) AS scenario, weight / sum(weight) OVER (PARTITION BY watershed, v.n, realization) AS weight
  FROM deep d JOIN (VALUES {values}) AS v(n) ON d.event_id <= v.n), {exceeded('smaller')}"""


def adaptation(iterations: int, samples: int, threshold: float, a, scenario: str, final: tuple[int, int] | None = None) -> str:
    """The iterations of an adapted mixture (a: its starting state) unrolled: state<i> after i of them, and samples_final, if wanted.

    An iteration is a state's components, draws, depths, two grouped sums, and the next state.
    """
    num = lambda v: f"CAST({float(v)!r} AS DOUBLE)"
    fixed = ("sd_x_w", "sd_y_w", "rho_w", "mu_x_w", "mu_y_w")
    mu = lambda name, c: f"s.{c}" if getattr(a, name) is None else num(getattr(a, name))
    out = [f"""state0 AS (SELECT s.layer AS watershed, '{scenario}' AS scenario, 0 AS updated, {num(a.mix)} AS mix, {mu('mu_x_n', 'x')} AS mu_x_n, {mu('mu_y_n', 'y')} AS mu_y_n, {num(a.sd_x_n)} AS sd_x_n, {num(a.sd_y_n)} AS sd_y_n, {num(a.rho_n)} AS rho_n,
  {mu('mu_x_w', 'x')} AS mu_x_w, {mu('mu_y_w', 'y')} AS mu_y_w, {num(a.sd_x_w)} AS sd_x_w, {num(a.sd_y_w)} AS sd_y_w, {num(a.rho_w)} AS rho_w, CAST(NULL AS DOUBLE) AS beta FROM shed_stats s)"""]  # fmt: skip

    def drawn(state: str, k: str, size: tuple[int, int], part: int) -> None:
        side = lambda c, share: f"SELECT watershed, scenario, '{ {'n': 'narrow', 'w': 'wide'}[c] }' AS component, {share} AS share, 'copula' AS family, mu_x_{c} AS mu_x, sd_x_{c} AS sd_x, mu_y_{c} AS mu_y, sd_y_{c} AS sd_y, rho_{c} AS rho FROM {state}"
        out.append(f"parts{k} AS MATERIALIZED ({side('n', 'mix')} UNION ALL {side('w', '1e0 - mix')})")
        out.extend([densities(None, k), draws({scenario: size}, k, part), depths(k)])

    for i in range(1, iterations + 1):
        k, old = f"_{i}", f"state{i - 1}"
        drawn(old, k, (samples, 1), i)
        reward = f"CASE WHEN coalesce(precip_avg_mm, 0e0) >= {num(threshold)} THEN coalesce(precip_avg_mm, 0e0) ELSE 0e0 END"
        out.append(f"""rewarded{k} AS MATERIALIZED (SELECT e.watershed, e.scenario, e.newx, e.newy, e.newrow, e.newcol, e.newx - s.mu_x_n AS ex, e.newy - s.mu_y_n AS ey, {reward} AS reward, weight * {reward} AS w,
  weight * {reward} * (s.mix * q_narrow / greatest(s.mix * q_narrow + (1e0 - s.mix) * q_wide, 1e-300)) AS n FROM deep{k} e JOIN {old} s ON s.watershed = e.watershed)""")
        out.append(f"moments{k} AS MATERIALIZED (SELECT watershed, sum(w) AS w, sum(n) AS n, sum(n * ex) AS mx, sum(n * ey) AS my, sum(n * ex * ex) AS mxx, sum(n * ey * ey) AS myy, count(CASE WHEN reward <> 0 THEN 1 END) AS hits FROM rewarded{k} GROUP BY watershed)")
        ok = "(m.n > 0 AND m.hits > 10)"
        spread = lambda c: f"CASE WHEN {ok} THEN sqrt((1 - {num(a.alpha)}) * s.sd_{c}_n * s.sd_{c}_n + {num(a.alpha)} * (greatest(m{c}{c} / m.n - (m{c} / m.n) * (m{c} / m.n), 0e0) + {num(a.eps_var)})) ELSE s.sd_{c}_n END AS sd_{c}_n"
        out.append(f"""moved{k} AS MATERIALIZED (SELECT s.watershed, s.scenario, CASE WHEN {ok} THEN 1 ELSE 0 END AS updated, least(greatest((1 - {num(a.lambda_mix)}) * s.mix + {num(a.lambda_mix)} * (m.n / (m.w + 1e-6)), {num(a.beta_floor)}), {num(a.beta_ceil)}) AS mix,
  {', '.join(f"CASE WHEN {ok} THEN s.mu_{c}_n + {num(a.alpha)} * (m{c} / m.n) ELSE s.mu_{c}_n END AS mu_{c}_n, {spread(c)}" for c in 'xy')}, s.rho_n, {', '.join(f's.{c}' for c in fixed)}, m.n / (m.w + 1e-6) AS beta FROM {old} s JOIN moments{k} m ON m.watershed = s.watershed)""")
        out.append(f"turned{k} AS (SELECT watershed, scenario, 'narrow' AS component, 'copula' AS family, mu_x_n AS mu_x, sd_x_n AS sd_x, mu_y_n AS mu_y, sd_y_n AS sd_y FROM moved{k})")
        out.append(f"scores{k} AS (SELECT e.watershed, e.n, x.s AS sx, y.s AS sy FROM rewarded{k} e JOIN {axis(f'turned{k}', 'x', 'col', 1e-12)} x ON x.watershed = e.watershed AND x.col = e.newcol JOIN {axis(f'turned{k}', 'y', 'row', 1e-12)} y ON y.watershed = e.watershed AND y.row = e.newrow)")
        out.append(f"latent{k} AS (SELECT watershed, sum(n) AS w, sum(n * sx) / sum(n) AS x, sum(n * sy) / sum(n) AS y, sum(n * sx * sx) / sum(n) AS xx, sum(n * sy * sy) / sum(n) AS yy, sum(n * sx * sy) / sum(n) AS xy FROM scores{k} GROUP BY watershed)")
        vary = lambda c: f"(greatest(l.{c}{c} - l.{c} * l.{c}, 0e0) + {num(a.eps_var)})"
        rho = f"(l.xy - l.x * l.y) / sqrt({vary('x')} * {vary('y')})"
        out.append(f"state{i} AS MATERIALIZED (SELECT v.* EXCLUDE (rho_n), CASE WHEN v.updated = 1 THEN least(greatest((1 - {num(a.alpha)}) * v.rho_n + {num(a.alpha)} * ({rho}), -95e-2), 95e-2) ELSE v.rho_n END AS rho_n FROM moved{k} v JOIN latent{k} l ON l.watershed = v.watershed)")
    if final:
        drawn(f"state{iterations}", "_final", final, iterations + 1)
        out.append(exceeded("deep_final", "depths_final"))
    return ", ".join(out)


def curves(per_year: float = 10.0, rp_min: int = 2, cap: int = 2000) -> str:
    return f"""
census AS (SELECT watershed, scenario, count(DISTINCT realization) AS n_realizations, count(*) // count(DISTINCT realization) AS n_samples_per_realization FROM depths GROUP BY watershed, scenario),
points AS MATERIALIZED (SELECT watershed, scenario, realization, 1e0 / (1e0 - exp(-{per_year}e0 * exc_prb)) AS rp, max(precip_avg_mm / 2.54e1) AS d FROM depths WHERE exc_prb > 0 GROUP BY 1, 2, 3, 4),
tops AS (SELECT watershed, scenario, least(floor(min(m)), {cap}) AS top FROM (SELECT watershed, scenario, realization, max(rp) AS m FROM points GROUP BY ALL) GROUP BY ALL),
segments AS (SELECT p.*, lead(rp) OVER w AS rp2, lead(d) OVER w AS d2, lag(rp) OVER w AS rp0 FROM points p WINDOW w AS (PARTITION BY watershed, scenario, realization ORDER BY rp)),
whole AS (SELECT s.watershed, s.scenario, s.realization, r AS RP, CASE WHEN rp2 IS NULL OR r = rp THEN d ELSE d + (d2 - d) * (r - rp) / (rp2 - rp) END AS d
  FROM segments s JOIN tops t USING (watershed, scenario), range({rp_min}, {cap} + 1) g(r) WHERE r <= top AND r >= rp AND (r < rp2 OR (rp2 IS NULL AND r = rp))),
summary AS (SELECT watershed, scenario, CAST(RP AS INT) AS RP, avg(d) AS mean_in, quantile_cont(d, 0.5) AS median_in, quantile_cont(d, 0.05) AS ci90_low_in, quantile_cont(d, 0.95) AS ci90_high_in,
  quantile_cont(d, 0.025) AS ci95_low_in, quantile_cont(d, 0.975) AS ci95_high_in FROM whole GROUP BY watershed, scenario, RP)"""


def steps(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts)
