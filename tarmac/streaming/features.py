"""Row-level features on streams: the same column functions, no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.functions import clean, features
from tarmac.sources.incidents import VIEW

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def enriched(df: DataFrame) -> DataFrame:
    """Feature columns of incident records, batch or stream."""
    return df.withColumns(
        {
            "weather_group": features.weather_group(F.col("weather_condition")), "wind_group": features.wind_group(F.col("wind_direction")), "temperature_c": features.f_to_c(F.col("temperature_f")), "wind_chill_c": features.f_to_c(F.col("wind_chill_f")),
            "duration_hours": features.duration_hours(F.col("start_time"), F.col("end_time")), "has_infrastructure": features.has_infrastructure(), "severity_group": features.severity_group(F.col("severity")),
        }
    ).withColumn("anomaly", clean.anomaly_rule("multistate"))


def incident_stream(spark: SparkSession, folder: str, glob: str = "events.parquet", files_per_trigger: int = 100) -> DataFrame:
    """A stream of enriched incidents from event files that arrive in a folder."""
    events = spark.readStream.schema(EVENTS).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return enriched(spark.sql(VIEW, events=events))
