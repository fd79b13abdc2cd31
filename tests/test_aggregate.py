"""Bootstraps over items against loops."""

import datetime
import hashlib
import re

import numpy as np
import pytest

from chronolens.operators import aggregate


def test_draws_are_not_broadcast(spark):
    """Draws outnumber items by the number of repetitions; a broadcast takes them all through the driver."""
    days = [datetime.date(2020, 1, 1), datetime.date(2020, 2, 1)]
    curve = spark.createDataFrame([(i, t, float(i * (k + 1) % 17)) for i in range(300) for k, t in enumerate(days)], "item int, T date, max double")
    truth = spark.createDataFrame([(i, i % 2) for i in range(300)], "item int, y int")
    out = aggregate.multiplicity(curve, truth, 30)
    got = {r["T"]: (r.n, r["mean"], r.lo95, r.hi95) for r in out.collect()}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"BroadcastHashJoin \[[^\]]*slot", plan)
    for k, t in enumerate(days):
        x = np.array([float(i * (k + 1) % 17) for i in range(0, 300, 2)])
        number = (t - datetime.date(1970, 1, 1)).days
        means = [np.mean([x[int(uniform(0, number, rep, j) * len(x))] for j in range(1, len(x) + 1)]) for rep in range(1, 31)]
        assert got[t] == pytest.approx((len(x), x.mean(), np.quantile(means, 0.025), np.quantile(means, 0.975)))


def uniform(*key):
    return int(hashlib.md5(":".join(map(str, key)).encode()).hexdigest()[:13], 16) / (1 << 52)
