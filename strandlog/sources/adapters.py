"""Relational tables read as event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.functions.scalars import encode_payload, split_time
from strandlog.operators.relations import assign_version
from strandlog.schema import EVENT_COLUMNS

USER, ORDER, CONVERSATION = "app/User", "shop/Order", "app/Conversation"


def _finish(rows: DataFrame) -> DataFrame:
    meta = F.struct(F.col("id").alias("id"), F.create_map().cast("map<string,string>").alias("meta"))
    return rows.withColumn("metadata", meta).select(*EVENT_COLUMNS)


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `events` table as one aggregate for each user, versions by time and event id; payload: amount in cents."""
    seconds, millis = split_time(F.col("ts"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.lpad(F.col("event_id").cast("string"), 26, "0").alias("id"),
        F.lit(USER).alias("aggregator_type"),
        F.col("user_id").cast("string").alias("aggregator_id"),
        F.col("event_type").alias("name"),
        F.when(F.col("user_id") % 3 == 0, "us-east-1").when(F.col("user_id") % 3 == 1, "eu-west-3").alias("routing_key"),
        encode_payload(F.round(F.col("value") * 100).cast("long").alias("amount")).alias("data"),
        seconds.alias("timestamp"),
        millis.alias("timestamp_subsec"),
        "ts",
        "event_id",
    )
    return _finish(assign_version(rows, ("ts", "event_id")))


def conversation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `conversations` table: one aggregate for each conversation, one event for each turn, named by role."""
    start = F.lit(1_704_067_200)
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.concat_ws("-", F.lpad(F.col("conv_id").cast("string"), 12, "0"), F.lpad(F.col("turn").cast("string"), 12, "0")).alias("id"),
        F.lit(CONVERSATION).alias("aggregator_type"),
        F.col("conv_id").cast("string").alias("aggregator_id"),
        (F.col("turn") + 1).cast("int").alias("version"),
        F.col("role").alias("name"),
        F.lit(None).cast("string").alias("routing_key"),
        encode_payload("text").alias("data"),
        (start + F.col("conv_id") * 60 + F.col("turn")).cast("long").alias("timestamp"),
        F.lit(0).alias("timestamp_subsec"),
    )
    return _finish(rows)
