from tarmac.sources.incidents import incidents
from tarmac.streaming.features import enriched, incident_stream


def test_stream_gives_what_a_batch_gives(spark, sf):
    cols = ["row_id", "weather_group", "wind_group", "temperature_c", "duration_hours", "severity_group", "anomaly"]
    q = incident_stream(spark, sf).select(*cols).writeStream.format("memory").queryName("enriched").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("enriched").collect()}
    assert got == {tuple(r) for r in enriched(incidents(spark, sf)).select(*cols).collect()} and len(got) == 1000
