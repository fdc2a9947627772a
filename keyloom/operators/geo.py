"""Operators on places: table ``kv_geo (key, member, lon, lat)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo as g


def geoadd(rows: DataFrame) -> DataFrame:
    """Rows with a valid place, with their cell number of 52 bits."""
    good = rows.where(F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90))
    return good.withColumn("cell", g.interleaved(F.col("lon"), F.col("lat")))


def geopos(table: DataFrame) -> DataFrame:
    """Middle of the cell of each member."""
    lon = g.centre(g.lon_cell(F.col("lon")), -180.0, 360.0)
    lat = g.centre(g.lat_cell(F.col("lat")), -90.0, 180.0)
    return table.select("key", "member", lon.alias("lon"), lat.alias("lat"))


def geohash(table: DataFrame) -> DataFrame:
    return table.select("key", "member", g.geohash(F.col("lon"), F.col("lat")).alias("hash"))


def geodist(table: DataFrame, a: str, b: str, unit: str = "m") -> DataFrame:
    """Distance of two members in every key that has both."""
    x = table.where(F.col("member") == a).select("key", F.col("lon").alias("x1"), F.col("lat").alias("y1"))
    y = table.where(F.col("member") == b).select("key", F.col("lon").alias("x2"), F.col("lat").alias("y2"))
    d = g.distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")) / g.UNITS[unit]
    return x.join(y, "key").select("key", d.alias("distance"))


def search(table: DataFrame, lon: float, lat: float, radius: float | None = None, box: tuple[float, float] | None = None, unit: str = "m", count: int | None = None, descending: bool = False, without: str | None = None) -> DataFrame:
    """Members within a radius, or a box of width and height, of a place, by distance.

    A plain comparison of longitude and latitude prunes first, down to the
    scan; the distance is exact. ``without`` leaves out the member itself.
    """
    scale = g.UNITS[unit]
    reach = radius * scale if radius is not None else (box[0] ** 2 + box[1] ** 2) ** 0.5 * scale / 2
    rows = table.where(g.near_box(F.col("lon"), F.col("lat"), lon, lat, reach))
    if without is not None:
        rows = rows.where(F.col("member") != without)
    rows = rows.withColumn("distance", g.distance(F.lit(lon), F.lit(lat), F.col("lon"), F.col("lat")) / scale)
    if radius is not None:
        rows = rows.where(F.col("distance") <= radius)
    else:
        dx = g.distance(F.lit(lon), F.col("lat"), F.col("lon"), F.col("lat")) / scale
        dy = g.distance(F.lit(lon), F.lit(lat), F.lit(lon), F.col("lat")) / scale
        rows = rows.where((dx <= box[0] / 2) & (dy <= box[1] / 2))
    rows = rows.select("key", "member", "lon", "lat", "distance")
    return rows if count is None else rows.orderBy(F.col("distance").desc() if descending else F.col("distance"), "key", "member").limit(count)


def search_by_member(table: DataFrame, member: str, radius: float | None = None, box: tuple[float, float] | None = None, unit: str = "m", count: int | None = None) -> DataFrame:
    """In every key that has the member, the members within a radius or box of it, by distance (FROMMEMBER, GEORADIUSBYMEMBER).

    The member itself is found too. ``count`` holds for each key.
    """
    scale = g.UNITS[unit]
    centre = table.where(F.col("member") == member).groupBy("key").agg(F.min(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"))).alias("_c"))
    rows = table.select("key", "member", "lon", "lat").join(centre, "key")
    x, y = F.col("_c.x"), F.col("_c.y")
    rows = rows.withColumn("distance", g.distance(x, y, F.col("lon"), F.col("lat")) / scale)
    if radius is not None:
        rows = rows.where(F.col("distance") <= radius)
    else:
        wide, high = g.distance(x, F.col("lat"), F.col("lon"), F.col("lat")) / scale, g.distance(x, y, x, F.col("lat")) / scale
        rows = rows.where((wide <= box[0] / 2) & (high <= box[1] / 2))
    rows = rows.drop("_c")
    if count is None:
        return rows
    order = Window.partitionBy("key").orderBy("distance", "member")
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= count).drop("_n")


def stored(table: DataFrame, target: str, found: DataFrame) -> DataFrame:
    """The table with the found members under one key, whose own members go (GEOSEARCHSTORE); a member found twice is kept once."""
    new = found.groupBy("member").agg(F.min(F.struct("lon", "lat")).alias("_p")).select(F.lit(target).alias("key"), "member", "_p.lon", "_p.lat")
    return table.where(F.col("key") != target).select("key", "member", "lon", "lat").unionByName(new)


def near(points: DataFrame, centres: DataFrame, metres: float) -> DataFrame:
    """Pairs of a centre (``id``, ``lon``, ``lat``) and a member within a distance.

    An equi-join on grid cells at least as wide as the distance, each centre
    put into the cells around it, then the exact test: no comparison of all
    with all. A row of cells from which a pole may be reached is one cell, as
    meridians meet there.
    """
    import math

    step = max(math.degrees(metres / g.RADIUS), 1e-6) * 1.01

    def width(row: Column) -> Column:
        edge = F.greatest(F.abs(row), F.abs(row + 1)) * step + step
        return F.when(edge >= 85, 400.0).otherwise(2 * step / F.cos(F.radians(F.least(edge, F.lit(85.0)))))

    cells = points.withColumn("_y", F.floor(F.col("lat") / step))
    cells = cells.withColumn("_x", F.floor((F.col("lon") + 180) / width(F.col("_y"))))
    rows = centres.select(F.col("id"), F.col("lon").alias("_lon"), F.col("lat").alias("_lat"), F.explode(F.sequence(F.floor(F.col("lat") / step) - 1, F.floor(F.col("lat") / step) + 1)).alias("_y"))
    row_wide = width(F.col("_y"))
    last = F.floor(F.lit(360.0) / row_wide)
    at = F.floor((F.col("_lon") + 180) / row_wide)
    rows = rows.withColumn("_around", F.array(at - 1, at, at + 1, F.when(at <= 1, last), F.when(at <= 1, last - 1), F.when(at >= last - 1, F.lit(0).cast("long")), F.when(at >= last - 1, F.lit(1).cast("long"))))
    rows = rows.withColumn("_x", F.explode(F.array_distinct(F.filter("_around", lambda c: c.isNotNull())))).drop("_around")
    d = g.distance(F.col("_lon"), F.col("_lat"), F.col("lon"), F.col("lat"))
    return cells.join(rows, ["_y", "_x"]).withColumn("distance", d).where(F.col("distance") <= metres).select("id", "key", "member", "distance")
