"""The log odds of a fitted model as a Spark expression."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
from pyspark.sql import functions as F

from tagloom.llm.cotraining import _odds


def test_odds_are_one_short_expression(spark):
    """Not a term for each coefficient, and the same sum."""
    a, x = np.random.default_rng(1).normal(size=(2, 77))
    a[3] = 0
    model = SimpleNamespace(intercept=0.25, coefficients=SimpleNamespace(toArray=lambda: a))
    df = spark.createDataFrame([(x.tolist(),)], "x array<double>").select(_odds(model, "x").alias("z"))
    wanted = 0.25
    for k in range(77):
        wanted += a[k] * x[k]
    assert df.first()["z"] == wanted
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("get(") == 0 and plan.count("+") < 10
