"""The closed column functions as functions of SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession, functions as F

from . import colour, geo, sun, text, weather

#: Name in SQL -> the column function and its parameters.
FUNCTIONS: dict[str, tuple[Callable[..., Column], str]] = {
    "haversine_m": (geo.haversine_m, "lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE"),
    "gradient_class": (geo.gradient_class, "percent DOUBLE"),
    "format_distance": (geo.format_distance, "metres DOUBLE"),
    "format_slope": (geo.format_slope, "percent DOUBLE"),
    "describe_place": (geo.describe_place, "municipality STRING, province STRING"),
    "twilight_class": (sun.twilight_class, "elevation DOUBLE"),
    "colour_red": (lambda c: colour.channel(c, 0), "hex STRING"),
    "colour_green": (lambda c: colour.channel(c, 1), "hex STRING"),
    "colour_blue": (lambda c: colour.channel(c, 2), "hex STRING"),
    "redmean": (colour.redmean, "r1 DOUBLE, g1 DOUBLE, b1 DOUBLE, r2 DOUBLE, g2 DOUBLE, b2 DOUBLE"),
    "hsv_saturation": (colour.hsv_saturation, "r DOUBLE, g DOUBLE, b DOUBLE"),
    "wmo_label": (weather.wmo_label, "code INT"),
    "wind_compass": (weather.wind_compass, "degrees DOUBLE"),
    "describe_weather": (weather.describe_weather, "label STRING, temperature DOUBLE"),
    "local_hour": (weather.local_hour, "ts TIMESTAMP_NTZ"),
    "weekday_local": (weather.weekday_local, "ts TIMESTAMP_NTZ"),
    "fold_text": (text.fold, "t STRING"),
    "slug": (text.slug, "t STRING"),
    "clean_keyword": (text.clean_keyword, "word STRING"),
    "singular_es": (text.singular, "word STRING"),
    "hamming_bits": (text.hamming, "a BIGINT, b BIGINT"),
}


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Enter FUNCTIONS in the session as temporary functions of SQL, and return their names.

    Each body is the SQL text of the column function's own expression, so both give the same values and Catalyst inlines either. What needs lambdas (lists,
    vectors) or tables (names of colours, glossaries) has no such text and stays a function of columns.
    """
    names = []
    for name, (function, parameters) in FUNCTIONS.items():
        columns = [F.col(p.split()[0]) for p in parameters.split(", ")]
        said = spark.createDataFrame([], parameters).select(function(*columns).alias("x"))
        body = said._jdf.queryExecution().analyzed().expressions().head().child().sql()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {said.schema['x'].dataType.simpleString()} RETURN {body}")
        names.append(prefix + name)
    return names
