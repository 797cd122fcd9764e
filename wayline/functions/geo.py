"""Distances, slopes and places as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EARTH_M = 6_371_000


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points in degrees on a sphere."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.when(a > 1, F.lit(1.0)).otherwise(a)))


def gradient_class(percent: Column) -> Column:
    """Steep and gentle falls and climbs, and level ground; borders belong to the class above."""
    return (
        F.when(percent.isNull(), F.lit(None).cast("string"))
        .when(percent < -3, "steep_fall")
        .when(percent < -1, "gentle_fall")
        .when(percent < 1, "level")
        .when(percent < 3, "gentle_climb")
        .otherwise("steep_climb")
    )


def format_distance(m: Column) -> Column:
    return F.when(m.isNull(), "—").when(m >= 1000, F.format_string("%.2f km", m / 1000)).otherwise(F.format_string("%.0f m", m))


def format_slope(percent: Column) -> Column:
    return F.when(percent.isNull(), "—").when(F.abs(percent) < 0.01, "0 %").otherwise(F.format_string("%+.2f %%", percent))


def describe_place(municipality: Column, province: Column) -> Column:
    m, p = F.nullif(municipality, F.lit("")), F.nullif(province, F.lit(""))
    return (
        F.when(m.isNotNull() & p.isNotNull(), F.concat(F.lit("municipio: "), m, F.lit(" ("), p, F.lit(")")))
        .when(m.isNotNull(), F.concat(F.lit("municipio: "), m))
        .when(p.isNotNull(), F.concat(F.lit("provincia: "), p))
    )


def fix_sign(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """Whether both coordinates are positive and their negatives lie in ``box`` (least and greatest latitude, then longitude)."""
    return (lat > 0) & (lon > 0) & (-lat).between(box[0], box[1]) & (-lon).between(box[2], box[3])
