"""Nearest neighbours on the map, by a pyramid of counted cells and one join."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.geo import haversine_m

#: Width of the smallest cells; each level's are twice as wide, and the last is one cell for the whole globe.
LEAST_DEGREES = 0.004
LEVELS = ceil(log2(180 / LEAST_DEGREES)) + 1
_METRES = 111_194.9


def _size(level: Column) -> Column:
    return F.lit(LEAST_DEGREES) * F.pow(F.lit(2.0), level)


def _band(lat: Column, level: Column) -> Column:
    """Bands of latitude, from the south pole."""
    return F.least(F.floor((lat + 90.0) / _size(level)), F.ceil(180.0 / _size(level)) - 1).cast("long")


def _edges(band: Column, level: Column) -> tuple[Column, Column]:
    """Cosines of the band's latitudes that are nearest to and farthest from the equator."""
    low, high = band * _size(level) - 90.0, F.least((band + 1) * _size(level) - 90.0, F.lit(90.0))
    near = F.when((low <= 0) & (high >= 0), 0.0).otherwise(F.least(F.abs(low), F.abs(high)))
    return F.cos(F.radians(near)), F.cos(F.radians(F.greatest(F.abs(low), F.abs(high))))


def _cells(band: Column, level: Column) -> Column:
    """How many cells a band has: so many that each is nowhere narrower than it is high, one at the poles."""
    return F.greatest(F.lit(1), F.floor(360.0 * _edges(band, level)[1] / _size(level))).cast("long")


def _turned(lon: Column) -> Column:
    return F.pmod(lon + 180.0, F.lit(360.0))


def placed(df: DataFrame, lat: str, lon: str, levels: list[int]) -> DataFrame:
    """``df`` with a row for each level and the cell there: _level, _band, _cell."""
    at = df.withColumn("_level", F.explode(F.array(*map(F.lit, levels)))).withColumn("_band", _band(F.col(lat), F.col("_level")))
    n = _cells(F.col("_band"), F.col("_level"))
    return at.withColumn("_cell", F.least(n - 1, F.floor(_turned(F.col(lon)) / 360.0 * n)).cast("long"))


def cells_within(lat: Column, lon: Column, degrees: Column, level: Column) -> Column:
    """Cells (band, cell) of ``level`` that points within ``degrees`` of a place can lie in; some more at most."""
    lo, hi = F.greatest(lat - degrees, F.lit(-90.0)), F.least(lat + degrees, F.lit(90.0))
    # the meridians that a circle touches; all of them if a pole is inside
    polar = (F.abs(lat) + degrees >= 89.999) | (degrees >= 90)
    wide = F.when(polar, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(degrees)) / F.cos(F.radians(lat))))) + 1e-9)

    def of_band(band: Column) -> Column:
        n = _cells(band, level)
        first, last = F.floor((_turned(lon) - wide) / 360.0 * n), F.floor((_turned(lon) + wide) / 360.0 * n)
        return F.transform(F.sequence(first, F.least(last, first + n - 1)), lambda c: F.struct(band.alias("band"), F.pmod(c, n).cast("long").alias("cell")))

    return F.flatten(F.transform(F.sequence(_band(lo, level), _band(hi, level)), of_band))


def nearest(left: DataFrame, right: DataFrame, k: int, left_id: str, right_id: str) -> DataFrame:
    """For each row of ``left`` its ``k`` nearest of ``right``: left_id, right_id, metres, rank. Both have lat and lon; ties go to the lesser right_id.

    The cells of each level are counted. The smallest cell around a row that holds ``k`` of ``right`` is a circle in which they must lie: one join with the cells that this circle
    touches, of a level that is as wide as it, finds them, anywhere on the globe. Of rows of ``right`` at the very same place ``k`` take part, those of the least ids.
    """
    left = left.select(F.col(left_id).alias("_l"), F.col("lat").alias("_la"), F.col("lon").alias("_lo")).where("_la IS NOT NULL AND _lo IS NOT NULL")
    right = right.select(F.col(right_id).alias("_r"), F.col("lat").alias("_ra"), F.col("lon").alias("_ro")).where("_ra IS NOT NULL AND _ro IS NOT NULL")
    right = right.withColumn("_n", F.row_number().over(W.partitionBy("_ra", "_ro").orderBy("_r"))).where(F.col("_n") <= k).drop("_n")
    every, cell = list(range(LEVELS)), ["_level", "_band", "_cell"]
    full = placed(right, "_ra", "_ro", every).groupBy(*cell).agg(F.count("*").alias("_n")).where((F.col("_n") >= k) | (F.col("_level") == LEVELS - 1))
    around = placed(left, "_la", "_lo", every).join(full, cell).groupBy("_l", "_la", "_lo").agg(F.min("_level").alias("_at"))
    level = F.col("_at")
    band = _band(F.col("_la"), level)
    across = 360.0 / _cells(band, level) * _edges(band, level)[0]  # along the cell's longer parallel
    reach = F.least(F.lit(180.0), (_size(level) + across) * 1.001)
    wider = F.least(F.lit(LEVELS - 1), level + F.ceil(F.log2(F.greatest(F.lit(1.0), reach / _size(level))))).cast("int")
    asked = around.withColumn("_reach", reach).withColumn("_level", wider)
    asked = asked.withColumn("_c", F.explode(cells_within(F.col("_la"), F.col("_lo"), F.col("_reach"), F.col("_level")))).withColumns({"_band": F.col("_c.band"), "_cell": F.col("_c.cell")})
    pairs = asked.select("_l", "_la", "_lo", "_reach", *cell).join(placed(right, "_ra", "_ro", every), cell).withColumn("metres", haversine_m(F.col("_la"), F.col("_lo"), F.col("_ra"), F.col("_ro")))
    pairs = pairs.where(F.col("metres") <= F.col("_reach") * _METRES * 1.001)
    ranked = pairs.withColumn("rank", F.row_number().over(W.partitionBy("_l").orderBy("metres", "_r"))).where(F.col("rank") <= k)
    return ranked.select(F.col("_l").alias(left_id), F.col("_r").alias(right_id), "metres", "rank")


def cell_key(lat: Column, lon: Column, per_degree: int) -> list[Column]:
    """Whole numbers of the cell whose centre is nearest, ``per_degree`` cells a degree."""
    return [F.floor(x * per_degree + 0.5).cast("int") for x in (lat, lon)]
