"""Daily fleet telemetry derived from an event log: one row of text per (user, day)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAILURE_VALUE = 200


def fleet_from_events(events: DataFrame) -> DataFrame:
    """Treat each user as a device; a day with a value of 200 or more is its failure day."""
    cents = F.round(F.col("value") * 100).cast("bigint")

    def text(c):
        return c.cast("string")

    def of_type(kind: str):
        return F.when(F.col("event_type") == kind, cents)

    no_value = F.lit(None).cast("string")
    daily = events.groupBy(F.to_date("ts").alias("day"), "user_id").agg(
        F.max("value").alias("top"),
        F.sum(of_type("error")).alias("errors"),
        F.count(F.lit(1)).alias("n_events"),
        F.max(of_type("click")).alias("clicks"),
        F.sum(of_type("view")).alias("views"),
    )
    user = F.col("user_id")
    return daily.select(
        text(F.col("day")).alias("date"),
        F.concat(F.lit("D"), F.lpad(text(user), 6, "0")).alias("serial_number"),
        F.concat(F.lit("M"), text(user % 5)).alias("model"),
        text((1 + user % 4) * F.lit(1_000_000_000_000)).alias("capacity_bytes"),
        F.when(F.col("top") >= FAILURE_VALUE, "1").otherwise("0").alias("failure"),
        text(F.col("errors")).alias("smart_5_raw"),
        text(F.col("n_events")).alias("smart_9_raw"),
        no_value.alias("smart_187_raw"),
        text(F.col("clicks")).alias("smart_194_raw"),
        text(F.col("views")).alias("smart_197_raw"),
        no_value.alias("smart_198_raw"),
        F.lit("events.parquet").alias("filename"),
    )
