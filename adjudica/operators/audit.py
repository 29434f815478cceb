"""Audit events: flat, append-only, each with a hash over what it says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def event_hash(event: Column, details: Column, at: Column) -> Column:
    """The time counts as microseconds since 1970, so the session's time zone has no part in it."""
    return F.sha2(F.concat(event, F.coalesce(details, F.lit("")), F.unix_micros(at.cast("timestamp")).cast("string")), 256)


def events(df: DataFrame, event: str, details: Column, at: Column, key: str = "claim_id") -> DataFrame:
    """One event per row; ``details`` is JSON text."""
    own = df.select(F.col(key).alias("claim_id"), at.alias("timestamp"), F.lit(event).alias("event"), details.alias("details"))
    return own.withColumn("event_hash", event_hash(F.col("event"), F.col("details"), F.col("timestamp")))


def documents(flat: DataFrame, key: str = "claim_id", at: str = "timestamp", tie: str = "event_hash") -> DataFrame:
    """Per claim its events in order."""
    rest = [c for c in flat.columns if c not in (key, at, tie)]
    held = F.sort_array(F.collect_list(F.struct(at, tie, *rest)))
    return flat.groupBy(key).agg(held.alias("events"), F.count("*").alias("n_events"))


def broken(flat: DataFrame) -> DataFrame:
    """Events whose hash is not that of their content."""
    return flat.filter(F.col("event_hash") != event_hash(F.col("event"), F.col("details"), F.col("timestamp")))


def trail(flat: DataFrame, claim_id: str) -> DataFrame:
    return flat.filter(F.col("claim_id") == claim_id).orderBy("timestamp", "event_hash")
