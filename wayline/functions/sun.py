"""The sun's place and the day's events, by the low-precision formulas of the NOAA solar calculator."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Days from the Julian epoch to 1970-01-01, and the Julian date of the year 2000's noon.
_UNIX_JD, _J2000 = 2440587.5, 2451545.0
#: Degrees of the sun's centre below the horizon at rise and set.
HORIZON = -0.833
_SIDEREAL_HOUR = 15.041068639


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp without zone, taken as UTC."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz")) / 1e6


def julian_day(seconds: Column) -> Column:
    return seconds / 86400.0 + _UNIX_JD


def _sin(x: Column) -> Column:
    return F.sin(F.radians(x))


def _cos(x: Column) -> Column:
    return F.cos(F.radians(x))


def _mod360(x: Column) -> Column:
    return F.pmod(x, F.lit(360.0))


def _geometry(jd: Column) -> dict[str, Column]:
    """Right ascension and declination in degrees, distance in AU."""
    t = (jd - _J2000) / 36525.0
    mean = _mod360(280.46646 + t * (36000.76983 + 0.0003032 * t))
    anomaly = _mod360(357.52911 + t * (35999.05029 - 0.0001537 * t))
    centre = (1.914602 - 0.004817 * t - 0.000014 * t * t) * _sin(anomaly) + (0.019993 - 0.000101 * t) * _sin(2 * anomaly) + 0.000289 * _sin(3 * anomaly)
    lon, tilt = _mod360(mean + centre), 23.439291 - 0.0130042 * t
    return {
        "ra": F.degrees(F.atan2(_cos(tilt) * _sin(lon), _cos(lon))),
        "dec": F.degrees(F.asin(_sin(tilt) * _sin(lon))),
        "au": 1 / (1.000001018 * (1 - 0.016708634 * _cos(_mod360(anomaly + centre)))),
    }


def _sidereal(jd: Column) -> Column:
    return _mod360(280.46061837 + 360.98564736629 * (jd - _J2000))


def sun_position(lat: Column, lon: Column, seconds: Column) -> Column:
    """elevation and azimuth in degrees, distance in AU."""
    jd = julian_day(seconds)
    g = _geometry(jd)
    turned = _mod360(_sidereal(jd) + lon - g["ra"])
    hour = F.when(turned > 180, turned - 360).otherwise(turned)
    high = F.asin(_sin(lat) * _sin(g["dec"]) + _cos(lat) * _cos(g["dec"]) * _cos(hour))
    round_ = F.atan2(-_cos(g["dec"]) * _sin(hour), _sin(g["dec"]) * _cos(lat) - _cos(g["dec"]) * _sin(lat) * _cos(hour))
    return F.struct(F.degrees(high).alias("elevation"), _mod360(F.degrees(round_) + 360).alias("azimuth"), g["au"].alias("distance_au"))


def twilight_class(elevation: Column) -> Column:
    """Blue hour is 0 to 6 degrees above the horizon and golden hour 6 to 12, as the catalogue has them."""
    return (
        F.when(elevation.isNull(), F.lit(None).cast("string"))
        .when(elevation >= 12, "dia")
        .when(elevation >= 6, "golden_hour")
        .when(elevation >= 0, "blue_hour")
        .when(elevation >= -6, "crepuculo_civil")
        .when(elevation >= -12, "crepuculo_nautico")
        .when(elevation >= -18, "crepuculo_astronomico")
        .otherwise("noche")
    )


def solar_events(lat: Column, lon: Column, seconds: Column) -> Column:
    """noon, sunrise, sunset in whole epoch seconds of the UTC day of ``seconds``; polar_night and polar_day.

    A cosine of the hour angle above 1 means that the sun stays down (polar night), under -1 that it stays up. The hours are
    folded into the same UTC date, so a sunset after midnight has that date's early time.
    """
    day = F.floor(seconds / 86400) * 86400
    jd = julian_day(day)
    at_zero = _geometry(jd)
    rough = F.pmod((at_zero["ra"] - lon - _sidereal(jd)) / _SIDEREAL_HOUR, F.lit(24.0))
    minute = F.floor(rough * 60) / 60
    at_noon = _geometry(jd + minute / 24)
    noon = F.pmod((at_noon["ra"] - lon - _sidereal(jd)) / _SIDEREAL_HOUR, F.lit(24.0))
    cos_h = (_sin(F.lit(HORIZON)) - _sin(lat) * _sin(at_zero["dec"])) / (_cos(lat) * _cos(at_zero["dec"]))
    half = F.when(cos_h.between(-1, 1), F.degrees(F.acos(cos_h)) / 15)
    clock = lambda h: (day + F.floor(F.pmod(h, F.lit(24.0)) * 3600)).cast("long")
    return F.struct(clock(noon).alias("noon"), clock(noon - half).alias("sunrise"), clock(noon + half).alias("sunset"), (cos_h > 1).alias("polar_night"), (cos_h < -1).alias("polar_day"))


def format_interval(seconds: Column) -> Column:
    s = F.abs(seconds)
    hours, minutes = F.floor(s / 3600).cast("int"), F.floor(F.pmod(s, F.lit(3600)) / 60).cast("int")
    return F.when(seconds.isNull(), "—").when(s >= 3600, F.format_string("%dh %dm", hours, minutes)).when(s >= 60, F.format_string("%dm", minutes)).otherwise(F.format_string("%ds", F.floor(s).cast("int")))


def solar_text(seconds: Column, sunrise: Column, sunset: Column) -> Column:
    """How long ago or ahead sunrise and sunset are, in Spanish."""
    up, left = seconds - sunrise, sunset - seconds
    rise = F.when(up > 0, F.concat(F.lit("sol salió hace "), format_interval(up))).when(up < 0, F.concat(F.lit("sol sale en "), format_interval(-up))).when(up == 0, "sol saliendo ahora")
    fall = (
        F.when(left > 300, F.concat(F.lit("se pone en "), format_interval(left)))
        .when(left > 0, "atardeciendo ahora")
        .when(left > -300, "atardecer recién")
        .when(left.isNotNull(), F.concat(F.lit("se puso hace "), format_interval(-left)))
    )
    return F.coalesce(F.nullif(F.concat_ws(" | ", rise, fall), F.lit("")), F.lit("sin datos solares"))
