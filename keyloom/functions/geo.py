"""Column functions on longitudes and latitudes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Earth radius in metres, base-32 digits of cells, metres of each unit (fixed values).
RADIUS = 6372797.560856
DIGITS = "0123456789bcdefghjkmnpqrstuvwxyz"
UNITS = {"m": 1.0, "km": 1000.0, "mi": 1609.34, "ft": 0.3048}


def distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres (haversine)."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.asin(F.sqrt(F.least(a, F.lit(1.0)))) * (2 * RADIUS)


def axis_cell(value: Column, least: float, width: float, bits: int) -> Column:
    """Number of the equal part of an axis that holds the value."""
    n = 1 << bits
    return F.least(F.floor((value - least) / width * float(n)), F.lit(n - 1)).cast("long")


def lon_cell(lon: Column, bits: int = 32) -> Column:
    return axis_cell(lon, -180.0, 360.0, bits)


def lat_cell(lat: Column, bits: int = 32) -> Column:
    return axis_cell(lat, -90.0, 180.0, bits)


def centre(cell: Column, least: float, width: float, bits: int = 32) -> Column:
    """Middle of a part of an axis."""
    return (cell + 0.5) * (width / float(1 << bits)) + least


def interleaved(lon: Column, lat: Column, bits: int = 26) -> Column:
    """Cell number: bits of longitude and latitude in turn, longitude first."""
    x, y = lon_cell(lon, bits), lat_cell(lat, bits)

    def bit(v: Column, i: int) -> Column:
        return F.shiftright(v, bits - 1 - i).bitwiseAND(F.lit(1))

    out: Column = F.lit(0).cast("long")
    for i in range(bits):
        out = out * 4 + bit(x, i) * 2 + bit(y, i)
    return out


def geohash(lon: Column, lat: Column) -> Column:
    """Base-32 text of the 64 bits of the cell, kept as a double: 13 digits, the last with a zero bit at its end."""
    half = float(1 << 32)

    def binary(cell: Column) -> Column:
        return F.lpad(F.conv(cell.cast("string"), 10, 2), 32, "0")

    def number(bits: Column, at: int) -> Column:
        return F.conv(F.substring(bits, F.lit(at), F.lit(32)), 2, 10).cast("double")

    def mixed(xy: Column) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: F.concat(F.substring(xy["x"], i, F.lit(1)), F.substring(xy["y"], i, F.lit(1)))), "")

    def halves(score: Column) -> Column:
        high = F.floor(score / half)
        return F.concat(binary(high), binary((score - high.cast("double") * half).cast("long")), F.lit("0"))

    def digits(bits: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.lit(12)), lambda k: F.substring(F.lit(DIGITS), F.conv(F.substring(bits, k * 5 + 1, F.lit(5)), 2, 10).cast("int") + 1, F.lit(1)))
        return F.array_join(each, "")

    cells = F.struct(binary(lon_cell(lon)).alias("x"), binary(lat_cell(lat)).alias("y"))
    score = _once(_once(cells, mixed), lambda bits: F.least(number(bits, 1) * half + number(bits, 33), F.lit(float((1 << 64) - (1 << 11)))))
    return _once(_once(score, halves), digits)


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` uses it."""
    return F.transform(F.array(value), lambda x: f(x))[0]


def near_box(lon: Column, lat: Column, at_lon: float, at_lat: float, metres: float) -> Column:
    """Plain comparisons that hold for every point within a distance, to prune before the exact test."""
    import math

    dlat = math.degrees(metres / RADIUS) * 1.000001
    good = (lat >= at_lat - dlat) & (lat <= at_lat + dlat)
    if abs(at_lat) + dlat < 89.9:
        dlon = math.degrees(math.asin(min(1.0, math.sin(min(metres / RADIUS, math.pi / 2)) / math.cos(math.radians(at_lat))))) * 1.000001
        if at_lon - dlon >= -180 and at_lon + dlon <= 180:
            good = good & (lon >= at_lon - dlon) & (lon <= at_lon + dlon)
    return good
