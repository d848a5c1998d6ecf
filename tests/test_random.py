import numpy as np
from pyspark.sql import functions as F

from gridwright.operators import random


def test_gamma_numbers_are_the_ones_that_were_accepted(spark):
    """A rejected try may be negative, and its mean is another."""
    n = 300_000
    for shape in (0.5, 1.0, 2.5):
        got = spark.range(n).select(random.standard_gamma(F.lit(shape), 10).alias("v")).agg(F.min("v"), F.avg("v"), F.stddev("v")).first()
        assert got[0] > 0
        assert abs(got[1] - shape) < 5 * (shape / n) ** 0.5
        assert abs(got[2] / shape**0.5 - 1) < 0.02


def test_dirichlet_slopes_of_many_shapes(spark):
    """Shape 1 of 1 + b: the distribution function is 1 - (1 - x)^b, and slopes are taken for a row's own shapes."""
    rows = [(x, b) for x in (0.02, 0.3, 0.9) for b in (1.0, 2.0)]
    df = spark.createDataFrame(rows, "x double, b double").select("x", "b", random._beta_below(F.col("x"), F.lit(1.0), F.col("b")).alias("p"), random.dirichlet_grad(F.col("x"), F.lit(1.0), 1 + F.col("b")).alias("g"))
    for r in df.collect():
        assert abs(r.p - (1 - (1 - r.x) ** r.b)) < 1e-9
        if r.b == 1:
            assert np.isclose(r.g, -r.x * np.log(r.x), atol=1e-5)
