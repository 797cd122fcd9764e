"""Colours as column expressions, and their names by the nearest of a palette."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Under this saturation a colour counts as neutral.
NEUTRAL = 0.15
NEUTRAL_NAMES = ("gris", "negro", "blanco")


def channel(hex_: Column, k: int) -> Column:
    """Red, green or blue (0, 1, 2) of '#rrggbb' or 'rrggbb'; null for anything else."""
    bare = F.regexp_replace(hex_, "^#", "")
    return F.when(bare.rlike("^[0-9A-Fa-f]{6}$"), F.conv(F.substring(bare, 2 * k + 1, 2), 16, 10).cast("int"))


def to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02x%02x%02x", r, g, b)


def redmean(r1, g1, b1, r2, g2, b2) -> Column:
    """A perceptual distance: green weighs most, red and blue by how bright the reds are."""
    r = (r1 + r2) / 2
    return F.sqrt((2 + r / 256) * (r1 - r2) * (r1 - r2) + 4 * (g1 - g2) * (g1 - g2) + (2 + (255 - r) / 256) * (b1 - b2) * (b1 - b2))


def hsv_saturation(r: Column, g: Column, b: Column) -> Column:
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    return F.when(top == 0, F.lit(0.0)).otherwise((top - low) / top)


def colour_names(colours: DataFrame, palette: DataFrame, hex_col: str = "hex") -> DataFrame:
    """``colours`` with css and basic: names from ``palette`` (css, basic, hex; at most a few hundred rows, so it goes with each task).

    A neutral colour is black, white or the nearest grey. Any other takes the nearest colour; if that is a neutral one, a real
    colour within 1.5 times its distance is preferred. Ties go to the name that comes first. Malformed colours get nulls.
    """
    entries = palette.select("css", "basic", *[channel(F.col("hex"), k).alias(c) for k, c in enumerate(("pr", "pg", "pb"))]).where("pr IS NOT NULL").collect()
    entries = sorted(entries, key=lambda e: (e["css"], e["basic"]))  # the first of the least distances is that of the first name
    css, basic = np.array([e["css"] for e in entries], object), np.array([e["basic"] for e in entries], object)
    pr, pg, pb = (np.array([e[c] for e in entries], float) for c in ("pr", "pg", "pb"))
    kept = {"any": np.full(len(entries), True), "grey": basic == "gris", "real": ~np.isin(basic, NEUTRAL_NAMES)}

    @F.pandas_udf(", ".join(f"{k} struct<d:double,css:string,basic:string>" for k in kept))
    def nearest(r: pd.Series, g: pd.Series, b: pd.Series) -> pd.DataFrame:
        r, g, b = (c.to_numpy(float)[:, None] for c in (r, g, b))
        m = (r + pr) / 2
        far = np.sqrt((2 + m / 256) * (r - pr) * (r - pr) + 4 * (g - pg) * (g - pg) + (2 + (255 - m) / 256) * (b - pb) * (b - pb))
        out = {}
        for name, which in kept.items():
            at = np.flatnonzero(which)
            if len(at):
                best = at[far[:, at].argmin(1)]
                out[name] = [{"d": d, "css": c, "basic": x} for d, c, x in zip(far[np.arange(len(far)), best].tolist(), css[best], basic[best], strict=True)]
            else:
                out[name] = [None] * len(far)
        return pd.DataFrame(out)

    base = colours.withColumns({f"_{c}": channel(F.col(hex_col), k) for k, c in enumerate("rgb")}).withColumn("_near", nearest("_r", "_g", "_b"))
    r, g, b = F.col("_r"), F.col("_g"), F.col("_b")
    neutral = hsv_saturation(r, g, b) < NEUTRAL
    real = F.col("_near.any.basic").isin(*NEUTRAL_NAMES) & (F.col("_near.real.d") < F.col("_near.any.d") * 1.5)

    def pick(field: str, grey: Column) -> Column:
        return (
            F.when(r.isNull(), F.lit(None).cast("string"))
            .when(neutral & (F.greatest(r, g, b) < 45), "negro")
            .when(neutral & (F.least(r, g, b) > 200), "blanco")
            .when(neutral, grey)
            .when(real, F.col(f"_near.real.{field}"))
            .otherwise(F.col(f"_near.any.{field}"))
        )

    out = base.withColumns({"css": pick("css", F.col("_near.grey.css")), "basic": pick("basic", F.lit("gris"))})
    return out.drop("_r", "_g", "_b", "_near")
