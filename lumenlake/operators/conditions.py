"""Small conditions and lists that several views share.

A condition is false, never null, where what it asks about is null. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.operators.filters import under

# The latitude at which a Mercator map ends, the least a face must be, what tells a date for certain.
MAP_EDGE, FACE_PIXELS, FACE_SCORE = 85.05, 40, 0.6
CERTAIN = ("exif", "gps", "filename")


def on_map(latitude: Column) -> Column:
    """Whether a latitude is on a Mercator map."""
    return F.coalesce(latitude.between(-MAP_EDGE, MAP_EDGE), F.lit(False))


def certain(source: Column, sources: tuple[str, ...] = CERTAIN) -> Column:
    """Whether a capture date comes from a source that is no guess."""
    return F.coalesce(source.isin(*sources), F.lit(False))


def unless(flag: Column) -> Column:
    """Whether a flag is not set; null is not set."""
    return ~F.coalesce(flag, F.lit(False))


def admitted(pixels: Column, score: Column) -> Column:
    """Whether a detected face is large and sure enough to be kept at all."""
    return F.coalesce((pixels >= FACE_PIXELS) & (score >= FACE_SCORE), F.lit(False))


def open_groups(members: DataFrame, hidden: DataFrame) -> DataFrame:
    """group_id, size of the duplicate groups of which no member is hidden. members: group_id, medium; hidden: medium."""
    gone = members.join(hidden.select("medium").distinct(), "medium", "left_semi").select("group_id").distinct()
    return members.where("group_id is not null").join(gone, "group_id", "left_anti").groupBy("group_id").agg(F.count(F.lit(1)).alias("size"))


def caption_text(caption: Column, tags: Column) -> Column:
    """What a text model reads of a picture: the caption, and its tags in a sentence if there are any; a null caption is empty."""
    some = F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: t.isNotNull())
    told = F.coalesce(caption, F.lit(""))
    return F.when(F.size(some) > 0, F.concat(told, F.lit(" Stichwörter: "), F.array_join(some, ", "), F.lit("."))).otherwise(told)


def still_waiting(pending: DataFrame, folders: DataFrame, listed: DataFrame) -> DataFrame:
    """Of pending (path) what a read of all folders leaves waiting: a path in a folder that was read whole must be in listed (path);
    one in a folder that was not come across is forgotten, unless that lies in or below a folder that could not be read.
    folders: folder, readable. A path without a slash lies in the root, which is ''."""
    folder = F.when(F.instr("path", "/") > 0, F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).otherwise("")
    each = pending.where("path is not null").withColumn("_folder", folder)
    there = listed.select("path", F.lit(True).alias("_there")).distinct()
    read = folders.where("readable").select(F.col("folder").alias("_folder"), F.lit(True).alias("_read")).distinct()
    # The folders above a path meet those that could not be read on equal names.
    parts = F.split("_folder", "/")
    above = F.array_union(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    broken = folders.where("not readable").select(F.col("folder").alias("_above")).distinct()
    lost = each.select("path", F.explode(above).alias("_above")).join(broken, "_above", "left_semi").select("path", F.lit(True).alias("_lost")).distinct()
    known = each.join(there, "path", "left").join(read, "_folder", "left").join(lost, "path", "left")
    keep = F.when(F.col("_read"), F.coalesce("_there", F.lit(False))).otherwise(F.coalesce("_lost", F.lit(False)))
    return known.where(keep).select(pending.columns)


def newest_lines(log: DataFrame, most: int, album: str | None = None) -> DataFrame:
    """The newest lines of a change log (at, line), of one album and what lies below it if asked for; ties by the larger line."""
    rows = log if album is None else log.where(under(F.col("album"), album))
    return rows.where("at is not null").orderBy(F.desc("at"), F.desc("line")).limit(most)


def invalidated(results: DataFrame, changed: DataFrame, needs: dict[str, str]) -> DataFrame:
    """results (medium, stage) without those that rest on something new: changed (medium, stage) are results that were replaced, or
    whose source was; needs names for each stage the one it rests on. The replaced results themselves stay. Stages are few; a
    ring among them ends where it began. Null keys rest on nothing."""
    rests: dict[str, list[str]] = {}
    for stage in needs:
        below, at = [], needs.get(stage)
        while at is not None and at not in below and at != stage:
            below.append(at)
            at = needs.get(at)
        for b in below:
            rests.setdefault(b, []).append(stage)
    if not rests:
        return results
    lost = F.coalesce(*(F.when(F.col("stage") == b, F.array(*map(F.lit, stages))) for b, stages in rests.items()))
    gone = changed.select("medium", F.explode(lost).alias("stage")).distinct()
    return results.join(gone, ["medium", "stage"], "left_anti").select(results.columns)
