import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from oxidara.functions.rounding import half_even, half_even_sql


@pytest.mark.parametrize("digits", [0, 1, 2, 3, 4])
def test_as_python_rounds(spark, digits):
    """Ties, values beside ties, negative, huge, tiny and special ones, and random ones, against exact decimal rounding of the binary value."""
    r = np.random.default_rng(digits)
    scale = 10**digits
    values = [0.125, 0.375, 2.675, -2.675, 0.5, 1.5, 2.5, -0.5, -1.5, 1.005, 1e15 + 0.5, 2.0**51 + 0.5, 1e300, -1e300, 5e-324, 0.0, -0.0, math.inf, -math.inf]
    values += ((r.integers(-(10**6), 10**6, 2000) * 2 + 1) / (2 * scale)).tolist()  # near ties of the digits
    values += np.nextafter(np.array(values[-500:]), np.inf).tolist() + np.nextafter(np.array(values[-500:]), -np.inf).tolist()
    values += ((r.integers(-4000, 4000, 500) * 2 + 1) / 2.0 ** r.integers(1, 8, 500)).tolist() + r.normal(size=1000).tolist() + (r.normal(size=300) * 1e9).tolist()
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)] + [(-1, None), (-2, math.nan)], "i int, x double")
    got = {x["i"]: (x["a"], x["b"]) for x in rows.select("i", half_even(F.col("x"), digits).alias("a"), F.expr(half_even_sql("x", digits)).alias("b")).collect()}
    assert got.pop(-1) == (None, None) and all(math.isnan(v) for v in got.pop(-2))
    for i, v in enumerate(values):
        want = v if math.isinf(v) else round(v, digits) if digits else float(round(v))
        assert got[i] == (want, want), v
    pdf = rows.where("i >= 0").toPandas()  # noqa: F841
    for i, b in duckdb.sql(f"SELECT i, {half_even_sql('x', digits)} FROM pdf").fetchall():
        assert b == got[i][0]
