"""Boosted fits use all cores, and the learned decision covers every state."""

from pyspark.ml.regression import GBTRegressor

from emberline.catalog.decisions import peak_decision_learned
from emberline.sources.adapters import thermostat_states

SF = "/root/testdata/sf0.001"


def test_fits_deal_rows_over_all_cores(spark, monkeypatch):
    seen, fit = [], GBTRegressor.fit
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, df: (seen.append(df.rdd.getNumPartitions()), fit(self, df))[1])
    got = peak_decision_learned(spark, SF).collect()
    states = {r["state_id"] for r in thermostat_states(spark, SF).select("state_id").collect()}
    assert sorted(r["state_id"] for r in got) == sorted(states)
    assert seen == [spark.sparkContext.defaultParallelism] * 2
