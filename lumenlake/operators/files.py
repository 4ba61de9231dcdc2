"""Files of a library: kinds, listings, which files make one medium, what changed, moved or vanished, dates in names.

A listing is a table of folder, name, size, mtime and one row a file. Rows without a folder or name are left out; an empty
table gives no rows. Names are compared without regard to case where a share would.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The endings of each kind, and the order in which the picture to show is chosen.
IMAGES = ["jpg", "jpeg", "heic", "heif", "png", "webp", "tif", "tiff", "gif"]
RAWS = ["cr2", "cr3", "nef", "arw", "dng", "orf", "rw2"]
VIDEOS = ["mp4", "mov", "avi", "mts", "m2ts", "3gp", "mpg", "mpeg", "wmv", "mkv"]
LIVE = ["heic", "heif"]
# The years that a name may tell.
FIRST_YEAR, LAST_YEAR = 1970, 2049
# Fixed value: names that messengers give to the copies they send, after the forms these publish.
MESSENGER = r"(?i)(^IMG-\d{8}-WA\d+|^signal-|^PHOTO-\d{4}-\d{2}-\d{2})"


def ending(name: Column) -> Column:
    """What follows the last dot in lower case; empty where there is no dot."""
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def kind(name: Column) -> Column:
    """'image', 'raw', 'video' or null."""
    e = ending(name)
    return F.when(e.isin(IMAGES), "image").when(e.isin(RAWS), "raw").when(e.isin(VIDEOS), "video")


def ignored(name: Column, names: list[str]) -> Column:
    """Whether a name is hidden or among those left out."""
    return F.startswith(name, F.lit(".")) | F.lower(name).isin([n.lower() for n in names])


def signatures(listing: DataFrame) -> DataFrame:
    """folder, files, signature: equal for two listings of a folder only where names, sizes and times are. Lines are summed up
    by folder in sorted order; a folder's listing is held in one task as its reader holds it."""
    line = F.concat_ws("|", "name", "size", "mtime")
    each = listing.where("folder is not null and name is not null").groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.sort_array(F.collect_list(line)).alias("l"))
    return each.select("folder", "files", F.md5(F.concat_ws("/", F.col("files").cast("string"), F.array_join("l", "/")).cast("binary")).alias("signature"))


def grouped(listing: DataFrame) -> DataFrame:
    """folder, name, medium, role, medium_kind: which medium each file belongs to (named by its first file).

    Files of one stem: raw files go with the best picture (or the first raw), the first .mov goes with a HEIC as its motion,
    other films and pictures are media of their own. Files of no kind are left out. One shuffle by folder and stem."""
    w = W.partitionBy("folder", "_stem")
    f = listing.where("folder is not null").withColumn("_kind", kind(F.col("name"))).where("_kind is not null").withColumn("_stem", F.lower(F.regexp_replace("name", r"\.[^.]*$", "")))
    rank = F.array_position(F.array(*map(F.lit, IMAGES)), ending(F.col("name")))
    image = F.min(F.when(F.col("_kind") == "image", F.struct(rank, "name"))).over(w)["name"]
    raw = F.min(F.when(F.col("_kind") == "raw", F.col("name"))).over(w)
    motion = F.min(F.when(ending(F.col("name")) == "mov", F.col("name"))).over(w)
    f = f.withColumn("_first", F.coalesce(image, raw)).withColumn("_motion", F.when(ending(F.col("_first")).isin(LIVE), motion))
    with_first = (F.col("name") == F.col("_first")) | ((F.col("_kind") == "raw") & F.col("_first").isNotNull()) | (F.col("name") == F.col("_motion"))
    f = f.withColumn("medium", F.when(F.coalesce(with_first, F.lit(False)), F.col("_first")).otherwise(F.col("name")))
    role = F.when(F.col("name") == F.col("medium"), "primary").when(F.col("_kind") == "raw", "raw").otherwise("motion")
    of = F.when((F.col("_kind") == "video") & (F.col("name") == F.col("medium")), "video").otherwise("image")
    return f.select("folder", "name", "medium", role.alias("role"), of.alias("medium_kind"))


def changed(known: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """key, state of the files seen, in three steps: 'unchanged' where size and mtime are as known, 'touched' where the quick
    hash still is, else 'changed'; 'new' where unknown. Nulls equal nulls."""
    old = known.select(key, *(F.col(c).alias("_" + c) for c in ("size", "mtime", "quick")), F.lit(True).alias("_known"))
    same = lambda c: F.col(c).eqNullSafe(F.col("_" + c))
    state = F.when(F.col("_known").isNull(), "new").when(same("size") & same("mtime"), "unchanged").when(same("size") & same("quick"), "touched").otherwise("changed")
    return seen.join(old, key, "left").select(key, state.alias("state"))


def moved(known: DataFrame, seen: DataFrame, key: str, marks: list[str]) -> DataFrame:
    """old, new: files that vanished from one path and turned up, equal in all marks, at another. Each vanished file goes to
    one new path at most: both sides are numbered by path among files of equal marks."""
    number = lambda df, name: df.dropna(subset=marks).select(*marks, F.col(key).alias(name), F.row_number().over(W.partitionBy(*marks).orderBy(key)).alias("_n"))
    gone, fresh = known.join(seen.select(key), key, "left_anti"), seen.join(known.select(key), key, "left_anti")
    return number(gone, "old").join(number(fresh, "new"), [*marks, "_n"]).select("old", "new")


def vanished(known: DataFrame, seen: DataFrame, judged: DataFrame, folder: str, key: str, share: float, most: int) -> DataFrame:
    """key, folder, paused of the known files no longer seen in folders that were read whole. paused: whether they are so many
    (share of the known there, or `most`; 0 turns a rule off) that it looks like an outage."""
    there = known.join(judged.select(folder).distinct(), folder, "left_semi")
    gone = there.join(seen.select(key), key, "left_anti").select(key, folder)
    tally = there.join(seen.select(key, F.lit(1).alias("_seen")).distinct(), key, "left").agg(F.count(F.lit(1)).alias("_known"), F.count_if(F.col("_seen").isNull()).alias("_gone"))  # one row
    paused = ((F.lit(most) > 0) & (F.col("_gone") >= most)) | ((F.lit(share) > 0) & (F.col("_gone") / F.col("_known") > share))
    return gone.crossJoin(F.broadcast(tally)).select(key, folder, paused.alias("paused"))


def grace(files: DataFrame, missing_since: str, now: Column, days: int, back: Column) -> DataFrame:
    """files with state: 'restored' where a missing file is back, 'purge' past its days of grace, 'missing', or 'present'."""
    since = F.col(missing_since)
    state = F.when(since.isNull(), "present").when(F.coalesce(back, F.lit(False)), "restored").when(since < now - F.make_dt_interval(F.lit(days)), "purge").otherwise("missing")
    return files.withColumn("state", state)


def _runs(text: Column, digits: str) -> Column:
    """Every place where digits (a pattern with groups for year and what follows) begin, overlapping ones too: [year, ...] as numbers,
    those whose year a name may tell."""
    n = re.compile(digits).groups
    each = [F.regexp_extract_all(text, F.lit(f"(?s)(?={digits})"), F.lit(i + 1)) for i in range(n)]
    rows = F.arrays_zip(*(e.alias(f"g{i}") for i, e in enumerate(each)))
    return F.filter(rows, lambda r: r["g0"].cast("int").between(FIRST_YEAR, LAST_YEAR))


def day_in(text: Column) -> Column:
    """The first day in a name (four, two and two digits with or without a mark between), with the clock that follows it if one
    does; null where there is none, or where the calendar has no such day."""
    days = F.filter(_runs(text, r"(\d{4})[-_.]?(\d\d)[-_.]?(\d\d)(.{0,12})"), lambda r: r["g1"].cast("int").between(1, 12) & r["g2"].cast("int").between(1, 31))
    d = F.get(days, F.lit(0))
    part = lambda i: F.regexp_extract(d["g3"], r"^[-_. tT]?(\d\d)[-_.:]?(\d\d)[-_.:]?(\d\d)", i)
    fits = (part(1) != "") & (part(1) < "24") & (part(2) < "60") & (part(3) < "60")
    clock = F.when(fits, F.concat_ws(":", part(1), part(2), part(3))).otherwise("00:00:00")
    return F.try_to_timestamp(F.when(d.isNotNull(), F.concat_ws(" ", F.concat_ws("-", d["g0"], d["g1"], d["g2"]), clock)))


def date_in(text: Column) -> Column:
    """The time in a name or folder: a day with its clock where there is one, else the first of a month, else of a year; null
    where there is none. A day that no calendar has, as 20110231, is no day, and its digits are no month either."""
    month = F.get(F.filter(_runs(text, r"(\d{4})[-_.]?(\d\d)(?!\d)"), lambda r: r["g1"].cast("int").between(1, 12)), F.lit(0))
    year = F.get(_runs(text, r"(?<!\d)(\d{4})(?!\d)"), F.lit(0))
    first = lambda *x: F.try_to_timestamp(F.concat_ws("-", *x))
    return F.coalesce(day_in(text), F.when(month.isNotNull(), first(month["g0"], month["g1"], F.lit("01"))), F.when(year.isNotNull(), first(year["g0"], F.lit("01-01"))))


def date_in_folders(path: Column) -> Column:
    """The time in the deepest folder of a path that has one."""
    times = F.transform(F.reverse(F.split(path, "/")), date_in)
    return F.get(F.filter(times, lambda t: t.isNotNull()), F.lit(0))


def captured(exif: list[Column], gps: Column, name: Column, path: Column, modified: Column) -> Column:
    """at, source: when a picture was taken and what tells it: the first EXIF time, the GPS time, the day in the file's name, the
    deepest dated folder of its path (of folders and name), the file's own time. The last two are guesses."""
    folder = F.when(F.instr(path, "/") > 0, F.regexp_extract(path, r"^(.*)/[^/]*$", 1))
    told = [(F.coalesce(*map(exif_time, exif)), "exif"), (exif_time(gps), "gps"), (day_in(name), "filename"), (date_in_folders(folder), "folder_name"), (modified.cast("timestamp"), "file_mtime")]
    at, source = F.coalesce(*(t for t, _ in told)), F.coalesce(*(F.when(t.isNotNull(), s) for t, s in told))
    return F.struct(at.alias("at"), source.alias("source"))


def exif_time(text: Column) -> Column:
    """'YYYY:MM:DD hh:mm:ss' with or without a fraction and an offset, as a timestamp (no offset: UTC); null where it is not one,
    or opens with zeros."""
    t = F.trim(text)
    date = F.regexp_replace(F.regexp_extract(t, r"^(\d{4}:\d{2}:\d{2})", 1), ":", "-")
    clock = F.regexp_extract(t, r"^\S+ (\d{2}:\d{2}:\d{2}(?:\.\d+)?)", 1)
    zone = F.regexp_extract(t, r"(Z|[+-]\d{2}:\d{2})$", 1)
    zone = F.when(zone == "", "Z").otherwise(zone)
    return F.when(~F.startswith(t, F.lit("0000")), F.try_to_timestamp(F.concat(date, F.lit(" "), clock, zone)))


def best_first() -> list[Column]:
    """The order in which copies are kept, over columns pixels, metadata, name, size, key: most pixels, fullest metadata, no
    messenger's copy, the larger file, the smallest key."""
    return [F.desc("pixels"), F.desc("metadata"), F.rlike(F.col("name"), F.lit(MESSENGER)).asc(), F.desc("size"), F.col("key")]


def copies(rows: DataFrame, group: str) -> DataFrame:
    """copy, copy_of: of each group all files but the one best_first keeps; what a CSV of hidden copies lists. Groups are ordered
    within one window by group."""
    w = W.partitionBy(group).orderBy(*best_first())
    placed = rows.where(F.col(group).isNotNull()).select(F.col("key").alias("copy"), F.row_number().over(w).alias("_place"), F.first("key").over(w).alias("copy_of"))
    return placed.where("_place > 1").drop("_place")


def upright(width: Column, height: Column, orientation: Column) -> Column:
    """Width and height as shown: quarter turns (5 to 8) swap them."""
    turned = F.coalesce(orientation.between(5, 8), F.lit(False))
    return F.struct(F.when(turned, height).otherwise(width).alias("width"), F.when(turned, width).otherwise(height).alias("height"))
