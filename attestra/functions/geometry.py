"""Page transforms, boxes and pixels: column expressions only. Boxes are half open, `x0 <= x < x1`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Degrees by EXIF orientation; all others are 0.
EXIF_DEGREES = {3: 180, 6: 90, 8: 270}
# Weights of blue, green and red in gray, in thousandths.
GRAY_WEIGHTS = (114, 587, 299)


def orientation_degrees(exif: Column) -> Column:
    out = F.when(exif.isNull(), 0)
    for k, v in EXIF_DEGREES.items():
        out = out.when(exif == k, v)
    return out.otherwise(0)


def page_transform(width: Column, height: Column, kind: Column, max_dim: int, exif: Column | None = None) -> Column:
    """Original and normalized size, scales and orientation. PDF pages always scale to max_dim, images only shrink."""
    degrees = orientation_degrees(exif if exif is not None else F.lit(1))
    turned = degrees.isin(90, 270)
    w, h = F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)
    ratio = F.lit(float(max_dim)) / F.greatest(w, h)
    scale = F.when(kind == "pdf", ratio).otherwise(F.least(F.lit(1.0), ratio))
    nw, nh = F.greatest(F.lit(1), F.round(w * scale)).cast("int"), F.greatest(F.lit(1), F.round(h * scale)).cast("int")
    return F.struct(
        F.greatest(F.lit(1), F.round(width)).cast("int").alias("original_width"),
        F.greatest(F.lit(1), F.round(height)).cast("int").alias("original_height"),
        nw.alias("normalized_width"),
        nh.alias("normalized_height"),
        (nw / w).alias("scale_x"),
        (nh / h).alias("scale_y"),
        degrees.alias("orientation_degrees"),
    )


def turned_cell(x: Column, y: Column, width: Column, height: Column, degrees: Column) -> Column:
    """Where the cell of an unturned raster goes when it is turned clockwise by degrees."""
    nx = F.when(degrees == 90, height - 1 - y).when(degrees == 180, width - 1 - x).when(degrees == 270, y).otherwise(x)
    ny = F.when(degrees == 90, x).when(degrees == 180, height - 1 - y).when(degrees == 270, width - 1 - x).otherwise(y)
    return F.struct(nx.alias("x"), ny.alias("y"))


def normalized_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """Pixel box to x, y, width, height in 0..1: six digits, inside the page, extents of 0.000001 at least."""
    x, y = F.round(x0 / width, 6), F.round(y0 / height, 6)
    w = F.least(F.round((x1 - x0) / width, 6), F.round(1.0 - x, 6))
    h = F.least(F.round((y1 - y0) / height, 6), F.round(1.0 - y, 6))
    least = F.lit(0.000001)
    return F.struct(x.alias("x"), y.alias("y"), F.greatest(w, least).alias("width"), F.greatest(h, least).alias("height"))


def padded_pixel_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """Text box in 0..1 to a padded pixel box inside the page."""
    pad_x = F.greatest(F.lit(7), F.round(width * 0.008)).cast("int")
    pad_y = F.greatest(F.lit(5), F.round(height * 0.005)).cast("int")
    return F.struct(
        F.greatest(F.lit(0), F.round(x0 * width).cast("int") - pad_x).alias("x0"),
        F.greatest(F.lit(0), F.round(y0 * height).cast("int") - pad_y).alias("y0"),
        F.least(width, F.round(x1 * width).cast("int") + pad_x).alias("x1"),
        F.least(height, F.round(y1 * height).cast("int") + pad_y).alias("y1"),
    )


def unit(value: Column) -> Column:
    return F.least(F.greatest(value.cast("double"), F.lit(0.0)), F.lit(1.0))


def byte_value(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0)), F.lit(255)).cast("int")


def gray(blue: Column, green: Column, red: Column) -> Column:
    """Whole numbers weighted in whole numbers: a half is a half, and goes up."""
    b, g, r = GRAY_WEIGHTS
    return F.floor((blue * b + green * g + red * r + 500) / 1000).cast("int")


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of two boxes (x, y, width, height); 0 when the union is empty."""
    wide = F.greatest(F.lit(0.0), F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0]))
    high = F.greatest(F.lit(0.0), F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1]))
    both = wide * high
    union = a[2] * a[3] + b[2] * b[3] - both
    return F.when(union > 0, both / union).otherwise(0.0)


def project(x: Column, y: Column, m: Column) -> Column:
    """A point through a 3x3 matrix given as an array of nine, row by row; null where it goes to infinity."""
    at = lambda i: F.get(m, F.lit(i))
    w = at(6) * x + at(7) * y + at(8)
    return F.struct(F.try_divide(at(0) * x + at(1) * y + at(2), w).alias("x"), F.try_divide(at(3) * x + at(4) * y + at(5), w).alias("y"))
