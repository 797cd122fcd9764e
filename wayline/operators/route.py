"""The route of located media: distances, climbs, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geo import haversine_m
from ..plans.scan import ordered_bucket, previous_row, running_sums

_ORDER = ["timestamp_utc", "id"]


def route_legs(media: DataFrame) -> DataFrame:
    """Located media in order of time and id, with metres (distance from the one before), rise (null-safe) and the id before."""
    return _legs(media)[0]


def _legs(media: DataFrame) -> tuple[DataFrame, Column]:
    """The legs, and the ranges that their order was cut into."""
    m = media.where("latitude IS NOT NULL AND longitude IS NOT NULL AND timestamp_utc IS NOT NULL").select("id", "timestamp_utc", "latitude", "longitude", "altitude")
    value = F.struct("id", "latitude", "longitude", "altitude")
    bucket = ordered_bucket(m, _ORDER)
    m = previous_row(m, bucket, _ORDER, "before", value)
    return m.withColumns({"metres": haversine_m(F.col("before.latitude"), F.col("before.longitude"), F.col("latitude"), F.col("longitude")), "rise": F.col("altitude") - F.col("before.altitude")}), bucket


def route_gradients(media: DataFrame) -> DataFrame:
    """id, distance_m, gain_m, gradient_pct, cumul_m, cumul_gain_m of each point of the route.

    The first point has nulls and zeros; a pair without both heights has no gain and adds none; coincident points have gradient 0. Rounded
    at the end only: 2 decimals, the gradient 4.
    """
    legs, bucket = _legs(media)
    sums = running_sums(legs, bucket, _ORDER, {"_m": F.col("metres"), "_g": F.greatest(F.col("rise"), F.lit(0.0))})
    percent = F.when(F.col("metres") > 0, 100 * F.col("rise") / F.col("metres")).when(F.col("rise").isNotNull() & F.col("metres").isNotNull(), F.lit(0.0))
    return sums.select("id", F.round("metres", 2).alias("distance_m"), F.round("rise", 2).alias("gain_m"), F.round(percent, 4).alias("gradient_pct"), F.round("_m", 2).alias("cumul_m"), F.round("_g", 2).alias("cumul_gain_m"))


def route_summary(media: DataFrame) -> DataFrame:
    """One row: points, pairs, distance, gain, loss, net, pairs without height, coincident pairs."""
    pair = F.col("before").isNotNull()
    return route_legs(media).agg(
        F.count("*").alias("points"), F.count_if(pair).alias("pairs"), F.round(F.sum("metres"), 0).alias("distance_m"), F.round(F.sum(F.greatest("rise", F.lit(0.0))), 1).alias("gain_m"),
        F.round(F.sum(F.least("rise", F.lit(0.0))), 1).alias("loss_m"), F.round(F.sum("rise"), 1).alias("net_m"), F.count_if(pair & F.col("rise").isNull()).alias("pairs_without_altitude"), F.count_if(F.col("metres") == 0).alias("coincident"),
    )
