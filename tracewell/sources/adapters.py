"""Views of the star-schema tables as recordings: traces, spike trains, hierarchies, masks, points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.traces import trace_arrays  # noqa: F401  the adapters' samples as arrays

#: First day and number of days of the event stream, and recordings that users are dealt to.
FIRST_DAY, DAYS, RECORDINGS = "2024-01-01", 30, 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording_id, roi_idx, frame, v): the sum of values a user and day, on a dense grid of DAYS frames.

    The grid comes from a sequence for each user, so nothing is cross-joined.
    """
    events = table(spark, sf_dir, "events").select("user_id", F.datediff(F.col("ts").cast("date"), F.lit(FIRST_DAY).cast("date")).alias("frame"), "value")
    summed = events.groupBy("user_id", "frame").agg(F.round(F.sum("value"), 6).alias("s"))
    by_user = summed.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("frame", "s"))).alias("m"))
    grid = by_user.select("user_id", "m", F.explode(F.sequence(F.lit(0), F.lit(DAYS - 1))).alias("frame"))
    return grid.select(
        (F.col("user_id") % RECORDINGS).alias("recording_id"), F.col("user_id").alias("roi_idx"), "frame",
        F.coalesce(F.try_element_at("m", F.col("frame")), F.lit(0.0)).alias("v"))


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording_id, roi_idx, t): times of purchases in seconds since FIRST_DAY."""
    events = table(spark, sf_dir, "events").filter("event_type = 'purchase'")
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lit(FIRST_DAY), "yyyy-MM-dd")
    return events.select((F.col("user_id") % RECORDINGS).alias("recording_id"), F.col("user_id").alias("roi_idx"), seconds.alias("t"))


def order_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region, nation, customer, w, mean, var): customers as recordings, orders as their neurons."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("w"), F.avg("o_totalprice").alias("mean"), F.var_pop("o_totalprice").alias("var"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return (
        orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("nation"), F.col("c_custkey").alias("customer"), "w", "mean", "var")
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(episode, node, x, y, onset, onset_line): coordinates and onset times from embeddings; onset_line lies near a plane."""
    e = table(spark, sf_dir, "embeddings")
    at = lambda k: F.element_at("embedding", k).cast("double")
    return e.select(
        F.col("label").cast("long").alias("episode"), F.col("vec_id").alias("node"), (at(1) * 1000).alias("x"), (at(2) * 1000).alias("y"),
        at(3).alias("onset"), (at(1) * 3 - at(2) * 2 + at(3) * 0.1).alias("onset_line"))
