"""The incident table: its schema as read from files, and a view of it over an event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarmac.session import ship

FLAGS = ["amenity", "bump", "crossing", "give_way", "junction", "no_exit", "railway", "roundabout", "station", "stop", "traffic_calming", "traffic_signal", "turning_loop"]

SCHEMA = (
    "id string, severity int, start_time timestamp_ntz, end_time timestamp_ntz, start_lat double, start_lng double, end_lat double, end_lng double, distance_mi double, "
    "description string, street string, city string, county string, state string, zipcode string, country string, timezone string, airport_code string, weather_timestamp timestamp_ntz, "
    "temperature_f double, wind_chill_f double, humidity double, pressure_in double, visibility_mi double, wind_direction string, wind_speed_mph double, precipitation_in double, weather_condition string, "
    + ", ".join(f"{f} boolean" for f in FLAGS)
    + ", sunrise_sunset string, civil_twilight string, nautical_twilight string, astronomical_twilight string"
)

#: A projection of events (event_id k, user_id u, ts, value) that both Spark and other SQL engines run.
VIEW = """
SELECT event_id AS row_id, concat('A-', cast(event_id AS string)) AS id,
  CASE WHEN event_id % 20 = 0 THEN 4 WHEN event_id % 5 = 0 THEN 3 WHEN event_id % 17 = 0 THEN 1 ELSE 2 END AS severity,
  ts AS start_time, ts + ((event_id % 97) - 2) * 36 * interval '1' minute AS end_time,
  CASE WHEN event_id % 211 = 0 THEN NULL ELSE 40 + cast(event_id * 7919 % 1000 AS double) / 1000 * (CASE WHEN user_id % 3 = 0 THEN cast(0.05 AS double) ELSE cast(1.2 AS double) END) END AS start_lat,
  -75 + cast(event_id * 104729 % 1000 AS double) / 1000 * (CASE WHEN user_id % 3 = 0 THEN cast(0.05 AS double) ELSE cast(1.2 AS double) END) AS start_lng,
  CASE WHEN user_id < 60 THEN 'S0' ELSE concat('S', cast(user_id % 20 AS string)) END AS state,
  concat('C', cast(user_id % 30 AS string)) AS county, concat('City', cast(user_id % 50 AS string)) AS city,
  CASE WHEN event_id % 29 = 0 THEN NULL ELSE 20 + cast(event_id * 37 % 800 AS double) / 10 END AS temperature_f,
  CASE WHEN event_id % 29 = 0 OR event_id % 7 = 0 THEN NULL
    WHEN event_id % 501 = 0 THEN 30 + cast(event_id * 37 % 800 AS double) / 10
    WHEN event_id % 503 = 0 THEN -20 + cast(event_id * 37 % 800 AS double) / 10
    ELSE 20 + cast(event_id * 37 % 800 AS double) / 10 - 2 * (event_id % 5) END AS wind_chill_f,
  CASE WHEN event_id % 31 = 0 THEN NULL ELSE cast(event_id * 53 % 101 AS double) END AS humidity,
  cast(28.5 AS double) + cast(event_id * 71 % 200 AS double) / 100 AS pressure_in,
  round(value / 10, 1) AS wind_speed_mph,
  CASE WHEN event_id % 997 = 0 THEN cast(6 AS double) WHEN event_id % 4 = 0 THEN round(value / 2000, 2) ELSE cast(0 AS double) END AS precipitation_in,
  cast(event_id % 60 AS double) / 10 AS distance_mi,
  CASE WHEN event_id % 50 = 0 THEN cast(2 AS double) ELSE cast(10 AS double) END AS visibility_mi,
  CASE WHEN event_id % 37 = 0 THEN NULL ELSE concat('K', cast(user_id % 40 AS string)) END AS airport_code,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE CASE event_id % 12 WHEN 0 THEN 'Clear' WHEN 1 THEN 'Fair' WHEN 2 THEN 'Mostly Cloudy' WHEN 3 THEN 'Overcast' WHEN 4 THEN 'Light Rain' WHEN 5 THEN 'Heavy Rain'
    WHEN 6 THEN 'Heavy Snow' WHEN 7 THEN 'Light Snow' WHEN 8 THEN 'Light Freezing Drizzle' WHEN 9 THEN 'Fog' WHEN 10 THEN 'Drizzle and Fog' ELSE 'Smoke' END END AS weather_condition,
  CASE WHEN event_id % 23 = 0 THEN NULL ELSE CASE event_id % 9 WHEN 0 THEN 'CALM' WHEN 1 THEN 'Calm' WHEN 2 THEN 'VAR' WHEN 3 THEN 'N' WHEN 4 THEN 'NNW' WHEN 5 THEN 'South' WHEN 6 THEN 'E' WHEN 7 THEN 'WSW' ELSE 'Unknown' END END AS wind_direction,
  CASE WHEN event_id % 41 = 0 THEN NULL WHEN hour(ts) BETWEEN 6 AND 17 THEN 'Day' ELSE 'Night' END AS sunrise_sunset,
  event_id % 8 = 0 AS junction, event_id % 5 = 1 AS traffic_signal, event_id % 9 = 0 AS amenity, event_id % 6 = 0 AS crossing, event_id % 14 = 0 AS stop,
  false AS bump, false AS give_way, false AS no_exit, false AS railway, false AS roundabout, false AS station, false AS traffic_calming, false AS turning_loop,
  concat('Accident on I-', cast(1 + event_id % 99 AS string), ' at Exit ', cast(event_id % 40 AS string), '. 1 right lane blocked due to crash.') AS description
FROM {events}
"""


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents derived from the event table of `sf_dir`, a row per event."""
    return ship(spark).sql(VIEW, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def incidents_sql() -> str:
    """The same as a common table expression named i."""
    return f"WITH i AS ({VIEW.format(events='events')})"
