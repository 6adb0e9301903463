from pyspark.sql import functions as F

from emberline.catalog.decisions import supplied_minutes
from emberline.operators import decide
from emberline.sources.adapters import forecast, peak_windows, thermostat_states
from emberline.streaming.decisions import stream_peak_decision

SF = "/root/testdata/sf0.001"


def test_stream_equals_table(spark, tmp_path):
    states = thermostat_states(spark, SF)
    for i in range(2):
        states.where(F.col("state_id") % 2 == i).coalesce(1).write.parquet(f"{tmp_path}/in/p{i}")
    stream = spark.readStream.schema(states.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    w, f = peak_windows(spark, SF), forecast(spark, SF)
    q = stream_peak_decision(stream, w, f, {}, supplied_minutes, f"{tmp_path}/out", f"{tmp_path}/ck")
    assert q.awaitTermination(120)
    cols = ["state_id", "phase", "reason", "heat_setpoint_f", "cool_setpoint_f"]
    got = spark.read.parquet(f"{tmp_path}/out").select(*cols)
    want = decide.peak_decision(states, w, f, {}, supplied_minutes).select(*cols)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
