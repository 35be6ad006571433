"""The forecasts of the catalogue start from the channels' own posteriors and fault classes."""

import duckdb
from pyspark.sql import functions as F

from oxidara.plans import catalog

DATA = "/root/testdata/sf0.01"


def test_state_knows_faults_and_posteriors(spark):
    flags = {r["chan"]: r["class"] for r in catalog.q_fault_isolation(spark, DATA).collect()}
    rows = catalog.q_unit_state(spark, DATA).collect()
    assert any(r["basis"] == "usage_model" for r in rows)
    for r in rows:
        assert r["fault"] == flags[r["chan"]] and (r["basis"] == "usage_model") == (r["fault"] in (1, 2, 3))
        assert r["fault"] not in (1, 2, 3) or (r["n_incr"], r["shrink"]) == (0, 1)
    assert any(r["n_incr"] > 2 and r["shrink"] < 1 for r in rows)
    said = catalog.q_ledger(spark, DATA).groupBy("sensor_status").count().count()
    assert said == len(set(flags.values()))


def test_posterior_is_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{DATA}/lineitem.parquet'")
    wanted = {r[0]: r[1:] for r in con.sql(catalog.oracle_sql()["posterior"]).fetchall()}
    found = {r[0]: tuple(r)[1:] for r in catalog.q_posterior(spark, DATA).collect()}
    assert found.keys() == wanted.keys() and all(abs(x - y) < 2e-6 for k in found for x, y in zip(found[k], wanted[k], strict=True))


def test_production_replicates(spark):
    """The 0.05 quantile of 200 replicates is the tenth, not the least."""
    rows = catalog.q_mc_availability(spark, DATA).where(F.col("p05").isNotNull()).collect()
    assert catalog.REPLICATES == 200 and len(rows) == catalog.HORIZON
