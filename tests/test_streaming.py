import datetime as dt

from panelfactor.operators import panel
from panelfactor.streaming import landing

NODES = ("a", "b", "c")


def test_stream_equals_batch(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "weekly")
    rows = [("p", dt.datetime(2024, 1, 1) + dt.timedelta(days=d, hours=h), n, float(d + h + i)) for d in range(30) for h in (1, 5) for i, n in enumerate(NODES) if (d, n) != (11, "b")]
    frame = spark.createDataFrame(rows, "panel string, ts timestamp, node string, value double")
    for k, part in enumerate((frame.where("ts < '2024-01-12'"), frame.where("ts >= '2024-01-12' and ts < '2024-01-24'"), frame.where("ts >= '2024-01-24'"))):
        part.coalesce(1).write.mode("append").parquet(source)
        stream = landing.stream_daily(spark.readStream.schema(frame.schema).parquet(source), NODES)
        stream.writeStream.foreachBatch(landing.refresh(target, NODES)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    got = {(str(r.period_end), str(r.date), r.a, r.b) for r in spark.read.parquet(target).collect()}
    # the watermark holds the last two days and the day that is not over back
    done = frame.where("ts < '2024-01-28'")
    from pyspark.sql import functions as F

    daily = panel.daily_nodes(done, F.col("panel"), F.col("ts"), F.col("node"), F.col("value"), NODES)
    want = {(str(r.period_end), str(r.date), r.a, r.b) for r in panel.weekly_curve(daily, NODES).collect()}
    assert got == want
