from pyspark.sql import functions as F

from veilstat.operators.histograms import Bins, flat
from veilstat.streaming.histograms import stream_histogram


def test_stream_adds_up_to_the_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_type", "value", "ts")
    bins = Bins(0.0, 512.0, 16)
    events.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    q = stream_histogram(stream, "value", bins, "ts", "7 days", "3650 days", ["event_type"]).writeStream.outputMode("complete").format("memory").queryName("hist").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("hist").groupBy("event_type", "bin").agg(F.sum("ct").alias("ct"))
    assert got.exceptAll(flat(events, "value", bins, ["event_type"])).count() == 0
