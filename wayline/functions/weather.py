"""Weather codes, wind and local time as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

# fixed values: weather codes of the World Meteorological Organization as the catalogue names them
WMO_LABELS = {
    0: "despejado", 1: "mayormente despejado", 2: "parcialmente nublado", 3: "nublado", 45: "niebla", 48: "niebla con escarcha",
    51: "llovizna ligera", 53: "llovizna moderada", 55: "llovizna densa", 56: "llovizna helada", 57: "llovizna helada densa",
    61: "lluvia ligera", 63: "lluvia moderada", 65: "lluvia intensa", 66: "lluvia helada ligera", 67: "lluvia helada intensa",
    71: "nieve ligera", 73: "nieve moderada", 75: "nieve intensa", 80: "tormenta ligera", 81: "tormenta moderada", 82: "tormenta intensa",
    95: "tormenta eléctrica", 96: "tormenta con granizo ligero", 99: "tormenta con granizo intenso",
}
# fixed values: directions of the wind, clockwise from the north, and days of the week from Monday
COMPASS = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSO", "SO", "OSO", "O", "ONO", "NO", "NNO"]
WEEKDAYS = ["lunes", "martes", "miércoles", "jueves", "viernes", "sábado", "domingo"]


def wmo_label(code: Column) -> Column:
    names = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in WMO_LABELS.items()))
    return F.when(code.isNull(), "desconocido").otherwise(F.coalesce(F.try_element_at(names, code.cast("int")), F.concat(F.lit("codigo_"), code.cast("string"))))


def wind_compass(degrees: Column) -> Column:
    """One of sixteen directions; fractions of a degree are cut first."""
    points = F.array(*map(F.lit, COMPASS))
    at = F.pmod(F.bround(F.pmod(degrees.cast("int"), F.lit(360)) / 22.5), F.lit(16)).cast("int")
    return F.when(degrees.isNull(), "desconocida").otherwise(F.get(points, at))


def describe_weather(label: Column, temperature: Column) -> Column:
    """'clima: label', with the temperature to a tenth of a degree where it is known."""
    return F.when(temperature.isNull(), F.concat(F.lit("clima: "), label)).otherwise(F.concat(F.lit("clima: "), label, F.format_string(", %.1f°C", temperature)))


def local_time(ts: Column, offset_hours: float = -3) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(offset_hours * 3600.0))


def local_hour(ts: Column, offset_hours: float = -3) -> Column:
    """Hour of the local day with its fraction."""
    t = local_time(ts, offset_hours)
    return F.hour(t) + F.minute(t) / 60 + F.floor(F.second(t)) / 3600


def hour_band(hours: list[int]) -> tuple[int, int]:
    """Both ends of the band that chosen hours span; all day if none is chosen."""
    return (min(hours), max(hours)) if hours else (0, 23)


def weekday_local(ts: Column, offset_hours: float = -3) -> Column:
    return F.get(F.array(*map(F.lit, WEEKDAYS)), F.weekday(local_time(ts, offset_hours)))
