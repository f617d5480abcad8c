from pyspark.sql import functions as F

from gridloom.streaming import windows


def test_duplicates_within_the_watermark_go(spark, sf):
    e = windows.read_events(spark, sf)
    q = windows.deduplicated(e).writeStream.outputMode("append").format("memory").queryName("dedup").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("dedup").count() == spark.read.parquet(f"{sf}/events.parquet").select("event_id").distinct().count()


def test_session_windows_count_every_event(spark, sf):
    s = windows.run_to_end(windows.sessions(windows.read_events(spark, sf)), spark)
    assert s.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()
