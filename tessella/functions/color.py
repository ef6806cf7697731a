"""Colour conversion as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of sRGB and CIE Lab (D65, 2 degrees).
TO_XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
WHITE = (0.95047, 1.0, 1.08883)


def rgb2lab(r: Column, g: Column, b: Column) -> list[Column]:
    """L, a, b of sRGB values from 0 to 1."""
    lin = [F.when(v > 0.04045, F.pow((v + 0.055) / 1.055, F.lit(2.4))).otherwise(v / 12.92) for v in (r, g, b)]
    xyz = [(m[0] * lin[0] + m[1] * lin[1] + m[2] * lin[2]) / w for m, w in zip(TO_XYZ, WHITE)]
    fx, fy, fz = (F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16.0 / 116.0) for t in xyz)
    return [116.0 * fy - 16.0, 500.0 * (fx - fy), 200.0 * (fy - fz)]
