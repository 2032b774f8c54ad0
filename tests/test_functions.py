"""Formulas against the standard library and published values."""

import math
from statistics import NormalDist

from pyspark.sql import functions as F

from stormshift.functions import normal, scalars
from stormshift.functions.albers import Albers


def test_normal(spark):
    zs = [-8.5, -7.2, -3.0, -0.4, 0.0, 0.7, 2.5, 7.3]
    rows = spark.createDataFrame([(z,) for z in zs], "z double").select("z", F.expr(normal.cdf("z")), F.expr(normal.pdf("z"))).collect()
    for z, c, d in rows:
        assert abs(c - 0.5 * math.erfc(-z / math.sqrt(2))) < 1e-12
        assert abs(d - NormalDist().pdf(z)) < 1e-12
    ps = [1e-15, 1e-9, 0.01, 0.2, 0.5, 0.93, 1 - 1e-12]
    for p, q in spark.createDataFrame([(p,) for p in ps], "p double").select("p", F.expr(normal.ppf("p"))).collect():
        assert abs(q - NormalDist().inv_cdf(p)) < 1e-9


def test_truncated_normal_integrates_to_one(spark):
    n, lo, hi = 2000, -1.0, 3.0
    v = spark.range(n + 1).select((lo + (hi - lo) * F.col("id") / n).alias("v"), F.lit(0.5).alias("mu"), F.lit(0.8).alias("sd"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
    t = normal.truncated(v)
    total, low, high = t.agg(F.sum("f") * (hi - lo) / n, F.min("c"), F.max("c")).first()
    assert abs(total - 1) < 2e-3 and low == 0 and high == 1


def test_albers_worked_example(spark):
    """Snyder (1987): Clarke 1866, latitude 35, longitude -75."""
    x, y = Albers(a=6378206.4, e2=0.00676866).columns("lon", "lat")
    row = spark.createDataFrame([(-75.0, 35.0)], "lon double, lat double").select(x, y).first()
    assert abs(row[0] - 1885472.7) < 0.1 and abs(row[1] - 1535925.0) < 0.1


def test_return_period(spark):
    rows = spark.createDataFrame([(0.0,), (0.1,), (1.0,)], "e double").select(F.expr(scalars.return_period("e", 10))).collect()
    assert rows[0][0] is None and abs(rows[1][0] - 1 / (1 - math.exp(-1))) < 1e-12 and abs(rows[2][0] - 1 / (1 - math.exp(-10))) < 1e-12
