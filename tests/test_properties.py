"""Property tests (hypothesis): exact quantiles and running totals agree with
numpy on random grouped data, for both plan choices."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from txsentinel.operators import ordered

rows_strategy = st.lists(
    st.tuples(st.integers(0, 3), st.integers(-50, 50).map(lambda v: v / 4.0)),
    min_size=1, max_size=60)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=rows_strategy, q=st.sampled_from([0.0, 0.1, 0.5, 0.95, 1.0]),
       method=st.sampled_from(["ranged", "builtin"]))
def test_exact_quantiles_property(spark, rows, q, method):
    df = spark.createDataFrame(rows, "g long, v double")
    got = {r.g: r.x for r in ordered.exact_quantiles(df, "v", {"x": q}, ["g"],
                                                     num_partitions=3, method=method).collect()}
    for g in {r[0] for r in rows}:
        vals = np.array([r[1] for r in rows if r[0] == g])
        assert got[g] == pytest.approx(np.percentile(vals, 100 * q), abs=1e-9)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=rows_strategy)
def test_running_totals_property(spark, rows):
    data = [(i, g, v) for i, (g, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, g long, v double")
    out = {r.id: r.c for r in ordered.running_totals(df, ["v", "id"], {"c": "v"}, ["g"],
                                                     num_partitions=4).collect()}
    for g in {r[1] for r in data}:
        acc = 0.0
        for i, _g, v in sorted((r for r in data if r[1] == g), key=lambda r: (r[2], r[0])):
            acc += v
            assert out[i] == pytest.approx(acc, abs=1e-9)
