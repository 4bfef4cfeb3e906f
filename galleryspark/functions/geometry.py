"""Box and page arithmetic on columns. Boxes are (x, y, w, h) unless a name says x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def aspect_ratio(w: Column, h: Column, when_zero: float = 1.0) -> Column:
    return F.when(h > 0, w / h).otherwise(F.lit(when_zero))


def out_of_range(value: Column, low: float, high: float) -> Column:
    """Strictly outside [low, high]."""
    return (value < low) | (value > high)


def pad_box(x: Column, y: Column, w: Column, h: Column, page_w: Column, page_h: Column, pad: int) -> Column:
    """Struct x1, y1, x2, y2 of the padded box, clamped to the page."""
    return F.struct(
        F.greatest(F.lit(0), x - pad).alias("x1"),
        F.greatest(F.lit(0), y - pad).alias("y1"),
        F.least(page_w, x + w + pad).alias("x2"),
        F.least(page_h, y + h + pad).alias("y2"),
    )


def letterbox_plan(w: Column, h: Column, size: int, square_special: bool = False) -> Column:
    """Struct nw, nh, dx, dy: the scaled size (floor) and the centred offsets (floor)."""
    scale = F.lit(float(size)) / F.greatest(w, h)
    fit = lambda side: F.floor(side * scale).cast("int")
    if square_special:
        square = w == h
        nw, nh = F.when(square, F.lit(size)).otherwise(fit(w)), F.when(square, F.lit(size)).otherwise(fit(h))
    else:
        nw, nh = fit(w), fit(h)
    half = lambda side: F.floor((F.lit(size) - side) / 2).cast("int")
    return F.struct(nw.alias("nw"), nh.alias("nh"), half(nw).alias("dx"), half(nh).alias("dy"))


# Fixed values of the training normalisation.
NORM_MEAN, NORM_STD = 0.0394, 0.1752


def normalize_intensity(v: Column, mean: float = NORM_MEAN, std: float = NORM_STD, invert: bool = False) -> Column:
    unit = v / F.lit(255.0)
    return ((F.lit(1.0) - unit if invert else unit) - F.lit(mean)) / F.lit(std)
