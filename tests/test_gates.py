import pytest

from oxidara.plans import gates


def test_forecast_gate(spark):
    schema = "p05 double, p50 double, p95 double, pfail double"
    gates.forecasts(spark.createDataFrame([(1.0, 2.0, float("inf"), 0.5)], schema))
    for bad in ((3.0, 2.0, 4.0, 0.5), (1.0, 2.0, 3.0, 1.5), (1.0, float("nan"), 3.0, 0.5), (1.0, 2.0, 3.0, None)):
        with pytest.raises(gates.Stopped):
            gates.forecasts(spark.createDataFrame([bad], schema))


def test_flag_and_availability_gates(spark):
    flags = spark.createDataFrame([(i, 1 if i < 2 else 0) for i in range(10)], "chan int, class int")
    with pytest.raises(gates.Stopped):
        gates.flagged_share(flags)
    assert gates.flagged_share(flags, 0.5) == 0.2
    with pytest.raises(gates.Stopped):
        gates.availability(spark.createDataFrame([(1.2,)], "available double"))


def test_fit_degradations(spark):
    rows = spark.createDataFrame([(1, None, None), (2, 0.3, 0.001), (3, 0.3, 0.2)], "comp int, beta double, sigma double")
    assert gates.fit_degradations(rows) == ["fit: component 1 could not be fitted", "fit: sensor noise of component 2 hit its floor"]


def test_audit():
    gates.audit("T0001 has 1,234 rows and 0.5 risk. component 1 could not be fitted", {"rows": 1234, "risk": 0.5}, ["component 1 could not be fitted"])
    with pytest.raises(gates.Stopped):
        gates.audit("There are 7 rows.", {"rows": 8}, [])
    with pytest.raises(gates.Stopped):
        gates.audit("All is well.", {}, ["component 1 could not be fitted"])
