"""Normal distribution as SQL expressions: density, distribution and quantile, plain and truncated.

Every function takes and returns SQL text, so one formula serves Spark columns (`F.expr`) and any SQL engine.
The text repeats its argument; pass a column name and stage longer chains by `withColumn`.
"""

from __future__ import annotations

import math

from stormshift.functions.text import horner, num

# The rational approximation of the normal distribution after Hart (1968), as published by West (2005).
HART_UPPER = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
HART_LOWER = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
# Wichura (1988), algorithm AS 241, coefficients of PPND16, highest power first.
AS241_A = (2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080e0)
AS241_B = (5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0)
AS241_C = (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e0, 3.64784832476320460504e0, 5.76949722146069140550e0, 4.63033784615654529590e0, 1.42343711074968357734e0)
AS241_D = (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e0, 2.05319162663775882187e0, 1.0)
AS241_E = (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e0, 5.46378491116411436990e0, 6.65790464350110377720e0)
AS241_F = (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0)


def pdf(x: str) -> str:
    return f"(exp(-({x}) * ({x}) / 2e0) / {num(2.5066282746310002)})"


def cdf(x: str) -> str:
    a = f"abs({x})"
    near = f"(exp(-({x}) * ({x}) / 2e0) * {horner(HART_UPPER, a)} / {horner(HART_LOWER, a)})"
    far = f"(exp(-({x}) * ({x}) / 2e0) / ({a} + 1e0 / ({a} + 2e0 / ({a} + 3e0 / ({a} + 4e0 / ({a} + 6.5e-1))))) / {num(2.5066282746310002)})"
    tail = f"(CASE WHEN {a} > 3.7e1 THEN 0e0 WHEN {a} < {num(7.07106781186547)} THEN {near} ELSE {far} END)"
    return f"(CASE WHEN {x} > 0e0 THEN 1e0 - {tail} ELSE {tail} END)"


def ppf(p: str) -> str:
    """Quantile for 0 < p < 1."""
    q = f"({p} - 5e-1)"
    r = f"(1.80625e-1 - {q} * {q})"
    t = f"sqrt(-ln(least({p}, 1e0 - {p})))"
    u, v = f"({t} - 1.6e0)", f"({t} - 5e0)"
    side = f"(CASE WHEN {q} < 0e0 THEN -1e0 ELSE 1e0 END)"
    return (
        f"(CASE WHEN abs({q}) <= 4.25e-1 THEN {q} * {horner(AS241_A, r)} / {horner(AS241_B, r)}"
        f" WHEN {t} <= 5e0 THEN {side} * {horner(AS241_C, u)} / {horner(AS241_D, u)}"
        f" ELSE {side} * {horner(AS241_E, v)} / {horner(AS241_F, v)} END)"
    )


#: Below this, the tail's logarithm comes from its continued fraction: the rational form loses relative accuracy there.
FAR = 4.5
LN_ROOT_2PI = math.log(math.sqrt(2 * math.pi))


def ln_cdf(x: str) -> str:
    """Logarithm of the distribution, accurate however far out in the lower tail."""
    a, tail = f"(-({x}))", ""
    for k in range(20, 0, -1):
        tail = f"({a} + {num(k)} / {tail})" if tail else f"({a} + {num(k)} / {a})"
    return f"(CASE WHEN {x} < {num(-FAR)} THEN -({x}) * ({x}) / 2e0 - {num(LN_ROOT_2PI)} - ln({tail}) ELSE ln({cdf(x)}) END)"


def less_one(x: str) -> str:
    """exp(x) - 1, accurate near 0."""
    return f"(CASE WHEN abs({x}) < 1e-4 THEN {x} * (1e0 + {x} / 2e0 * (1e0 + {x} / 3e0 * (1e0 + {x} / 4e0))) ELSE exp({x}) - 1e0 END)"


#: Distance from 0 and 1 at which a distribution is clipped before its latent score.
CLIP = 1e-15
#: Columns that turn (v, mu, sd, lo, hi) into the truncated density f, distribution c and latent normal score s, in stages.
#: The heavier side is folded onto the lower tail, and differences of tails are taken between logarithms, so that a mean
#: many deviations outside [lo, hi], on either side, keeps its digits. One value (lo = hi): density 1.
TRUNCATED = (
    {"z": "(v - mu) / sd", "za": "(lo - mu) / sd", "zb": "(hi - mu) / sd"},
    {"fold": "CASE WHEN za + zb > 0e0 THEN -1e0 ELSE 1e0 END"},
    {"z": "fold * z", "za": "CASE WHEN fold > 0e0 THEN za ELSE -zb END", "zb": "CASE WHEN fold > 0e0 THEN zb ELSE -za END"},
    {"lz": ln_cdf("z"), "la": ln_cdf("za"), "lb": ln_cdf("zb"), "dz": f"-z * z / 2e0 - {num(LN_ROOT_2PI)}"},
    {"ab": "la - lb", "zt": "lz - lb", "az": "la - lz"},
    {"ab": less_one("ab"), "up": less_one("zt"), "low": less_one("az"), "ez": "exp(zt)", "dz": "exp(dz - lb)"},
    {
        # shares below and above v, each from its own tail
        "low": "CASE WHEN ab < 0e0 THEN ez * low / ab ELSE 0e0 END", "up": "CASE WHEN ab < 0e0 THEN up / ab ELSE 0e0 END",
        "f": "CASE WHEN v < lo OR v > hi THEN 0e0 WHEN ab < 0e0 THEN dz / (sd * -ab) ELSE 1e0 END",
    },
    {
        "c": "CASE WHEN v <= lo THEN 0e0 WHEN v >= hi THEN 1e0 WHEN fold > 0e0 THEN low ELSE up END",
        "d": "CASE WHEN v <= lo THEN 1e0 WHEN v >= hi THEN 0e0 WHEN fold > 0e0 THEN up ELSE low END",
    },
    {"u": "CASE WHEN c <= d THEN greatest({clip}, c) ELSE greatest(1e0 - (1e0 - {clip}), d) END"},
    {"s": f"CASE WHEN c <= d THEN 1e0 ELSE -1e0 END * {ppf('u')}"},
)
_STEPS = ("z", "za", "zb", "fold", "lz", "la", "lb", "dz", "ab", "zt", "az", "up", "low", "ez", "d", "u")


def truncated(df, clip: float = CLIP):
    """df(v, mu, sd, lo, hi, ...) with f, c and s."""
    from pyspark.sql import functions as F

    for stage in TRUNCATED:
        df = df.withColumns({k: F.expr(x.replace("{clip}", num(clip))) for k, x in stage.items()})
    return df.drop(*_STEPS)


def truncated_sql(source: str, clip: float = CLIP) -> str:
    """The same as nested SELECTs."""
    known: set[str] = set()
    for stage in TRUNCATED:
        again = ", ".join(k for k in stage if k in known)
        old = f"* EXCLUDE ({again})" if again else "*"
        source = f"(SELECT {old}, {', '.join(f'{x} AS {k}' for k, x in stage.items()).replace('{clip}', num(clip))} FROM {source})"
        known |= set(stage)
    return source


def copula(sx: str, sy: str, rho: str) -> str:
    """Density of the Gaussian copula at latent scores."""
    return (
        f"exp(-5e-1 * ln(1e0 - {rho} * {rho}) + 5e-1 * ({sx} * {sx} + {sy} * {sy})"
        f" - 5e-1 * ({sx} * {sx} - 2e0 * {rho} * {sx} * {sy} + {sy} * {sy}) / (1e0 - {rho} * {rho}))"
    )
