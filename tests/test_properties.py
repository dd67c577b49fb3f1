"""Property checks of the distributed primitives against NumPy."""

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lumen.operators.ranking import quantiles, running_totals

SETTINGS = settings(max_examples=6, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(seed=st.integers(0, 10_000), n=st.integers(1, 300), groups=st.integers(1, 4),
       hot=st.floats(0.0, 0.6))
def test_quantiles_match_numpy(spark, seed, n, groups, hot):
    rng = np.random.default_rng(seed)
    vals = np.round(rng.normal(0, 3, n), 2)            # rounding makes ties
    vals[rng.random(n) < hot] = 1.25                    # a hot value of any share
    g = rng.integers(0, groups, n)
    pdf = pd.DataFrame({"g": g, "v": vals})
    got = quantiles(spark.createDataFrame(pdf), "v", {"a": 0.1, "m": 0.5, "b": 0.9}, ["g"]).toPandas().set_index("g")
    for key, sub in pdf.groupby("g"):
        for name, p in (("a", 0.1), ("m", 0.5), ("b", 0.9)):
            assert abs(got.loc[key, name] - np.percentile(sub.v, p * 100)) < 1e-9
        assert got.loc[key, "n"] == len(sub)


@SETTINGS
@given(seed=st.integers(0, 10_000), n=st.integers(1, 300), cells=st.integers(1, 30),
       descending=st.booleans())
def test_running_totals_match_cumsum(spark, seed, n, cells, descending):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"k": rng.permutation(n).astype(float) * 0.5,
                        "w": rng.integers(0, 7, n).astype("int64")})
    cum, tot = running_totals(spark.createDataFrame(pdf), ["k"], ["w"], descending=descending,
                              num_partitions=cells)
    got = cum.toPandas().sort_values("k", ascending=not descending)
    exp = pdf.sort_values("k", ascending=not descending)["w"].cumsum()
    assert got["cum_w"].tolist() == exp.tolist() and tot.first()["w"] == pdf.w.sum()
