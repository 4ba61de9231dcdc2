"""Maps and places: Mercator clusters, nearest towns and path prefixes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM, DEGREE_KM = 6371.0, 111.0


def map_clusters(points: DataFrame, key: str, lat: str, lon: str, zoom: int, pixels: int = 60) -> DataFrame:
    """cell_x, cell_y, n, latitude, longitude, newest: points in squares of `pixels` on the map of a zoom level."""
    scale = 256 * 2**zoom / pixels
    sine = F.sin(F.radians(lat))
    x = F.floor((F.col(lon) + 180) / 360 * scale)
    y = F.floor((F.lit(0.5) - F.log((1 + sine) / (1 - sine)) / (4 * math.pi)) * scale)
    cell = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).withColumns({"cell_x": x, "cell_y": y})
    return cell.groupBy("cell_x", "cell_y").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(lat), 6).alias("latitude"), F.round(F.avg(lon), 6).alias("longitude"), F.max(key).alias("newest"))


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def nearest_town(points: DataFrame, key: str, towns: DataFrame, town: str, km: float) -> DataFrame:
    """key, town, km: the nearest town within `km` of each point; both sides have lat and lon. An equi-join on squares of a
    degree: a point looks in as many squares as the radius reaches at its latitude. Radii up to a degree of latitude. Points that
    share a place ask once, and of the towns that share one the smallest takes part."""
    if km > DEGREE_KM:
        raise ValueError("the radius is at most a degree of latitude")
    known = "lat is not null and lon is not null"
    reach = F.least(F.lit(180), F.ceil(km / (DEGREE_KM * F.greatest(F.cos(F.radians(F.least(F.lit(90.0), F.abs("lat") + 1))), F.lit(1e-3)))).cast("int"))
    looks = points.where(known).select("lat", "lon").distinct().select("lat", "lon", F.explode(F.array(*(F.floor("lat") + i for i in (-1, 0, 1)))).alias("row"), reach.alias("reach"))
    step = F.explode(F.sequence(-F.col("reach"), F.least("reach", F.lit(359) - F.col("reach"))))  # once around at most
    looks = looks.withColumn("step", step).select("lat", "lon", "row", F.pmod(F.floor("lon") + F.col("step"), F.lit(360)).alias("col"))
    at = towns.where(known).groupBy(F.col("lat").alias("tlat"), F.col("lon").alias("tlon")).agg(F.min(town).alias(town))
    at = at.select(town, "tlat", "tlon", F.floor("tlat").alias("row"), F.pmod(F.floor("tlon"), F.lit(360)).alias("col"))
    far = F.round(distance_km(F.col("lat"), F.col("lon"), F.col("tlat"), F.col("tlon")), 6)
    near = looks.join(at, ["row", "col"]).select("lat", "lon", town, far.alias("km")).where(F.col("km") <= km)
    found = near.groupBy("lat", "lon").agg(F.min(F.struct("km", town)).alias("b"))
    best = points.select(key, "lat", "lon").join(found, ["lat", "lon"]).groupBy(key).agg(F.min("b").alias("b"))
    return best.select(key, F.col(f"b.{town}").alias(town), F.col("b.km").alias("km"))


def path_prefixes(path: Column) -> Column:
    """A path's folders, from the top to itself."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def subtree_counts(rows: DataFrame, path: str) -> DataFrame:
    """folder, n: rows in or below each folder; counted by path first, so a full folder is expanded once."""
    each = rows.where(F.col(path).isNotNull()).groupBy(path).agg(F.count(F.lit(1)).alias("_n"))
    return each.select(F.explode(path_prefixes(F.col(path))).alias("folder"), "_n").groupBy("folder").agg(F.sum("_n").alias("n"))


def longest_prefix(rows: DataFrame, key: str, path: str, owners: DataFrame, folder: str, value: str) -> DataFrame:
    """key, value: what the deepest folder above a row says."""
    up = rows.select(key, F.explode(path_prefixes(F.col(path))).alias(folder))
    hit = up.join(owners.select(folder, value), folder)
    return hit.groupBy(key).agg(F.max_by(value, F.length(folder)).alias(value))


def placed_anew(media: DataFrame, towns: DataFrame, owners: DataFrame, version: int, km: float) -> DataFrame:
    """media with place, estimated and version as a gazetteer's version gives them, where theirs is older or missing; others stay.

    A medium with a position takes the nearest town within km; one without takes the place that the deepest folder above it has
    (owners: folder, town), which is an estimate; without either it has none, but is of this version. media: key, lat, lon, path,
    place, estimated, version (keys are unique); towns: town, lat, lon. Only media that are due meet the towns."""
    due = F.coalesce(F.col("version") < version, F.lit(True))
    open_ = media.where(due)
    near = nearest_town(open_.select("key", "lat", "lon"), "key", towns, "town", km).select("key", F.col("town").alias("_near"))
    lent = longest_prefix(open_.where("(lat is null or lon is null) and path is not null"), "key", "path", owners, "folder", "town").select("key", F.col("town").alias("_lent"))
    new = media.join(near, "key", "left").join(lent, "key", "left")
    kind = dict(media.dtypes)["place"]
    out = {"place": F.coalesce("_near", "_lent").cast(kind), "estimated": F.col("_near").isNull() & F.col("_lent").isNotNull(), "version": F.lit(version).cast(dict(media.dtypes)["version"])}
    return new.select(*(F.when(due, out[c]).otherwise(F.col(c)).alias(c) if c in out else F.col(c) for c in media.columns))
