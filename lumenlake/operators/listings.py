"""Pages of what a library shows: groups of unknown faces, questions, a person's faces and media, notifications, and cursors.

Only faces on shown media (shown: medium, at) are listed; null keys are not listed; ties go to the smallest key unless said
otherwise; an empty table gives no rows. A page is a top-k of its order; more tells whether another follows.
"""

from __future__ import annotations

import base64
import binascii
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlake.operators.picks import first_of

#: Faces that a group shows.
FACES = 6


def _page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """The rows of a page with place (from 1 over all) and more (whether a row follows the page)."""
    some = rows.orderBy(*order).limit(offset + limit + 1)
    placed = some.withColumn("place", F.row_number().over(W.orderBy(*order)))  # over the bounded list alone
    more = placed.agg((F.max("place") > offset + limit).alias("more"))
    return placed.where((F.col("place") > offset) & (F.col("place") <= offset + limit)).crossJoin(F.broadcast(more))  # one row


def groups(faces: DataFrame, shown: DataFrame, offset: int, limit: int, most: int = FACES) -> DataFrame:
    """cluster, size, faces, place, more: groups of two faces or more without a person, the largest first, each with its clearest
    faces. faces: face, medium, person, cluster, pixels, score."""
    seen = faces.where("person is null and cluster is not null").join(shown.select("medium").distinct(), "medium", "left_semi")
    page = _page(seen.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).where("size >= 2"), [F.desc("size"), F.col("cluster")], offset, limit)
    clear = F.coalesce(F.col("pixels") * F.col("score"), F.lit(0.0))
    best = first_of(seen.join(F.broadcast(page.select("cluster")), "cluster").select("cluster", "face", clear.alias("_c")), ["cluster"], [F.desc("_c"), F.col("face")], most)
    lists = best.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "face"))), lambda x: x["face"]).alias("faces"))
    return page.join(lists, "cluster").select("cluster", "size", "faces", "place", "more")


def questions(faces: DataFrame, people: DataFrame, shown: DataFrame, offset: int, limit: int) -> DataFrame:
    """face, person, name, distance, place, more: open questions about persons that are not hidden, the nearest first (those without
    a distance last), then the newest face. faces: face, medium, person, suggested, distance, created; people: person, name,
    hidden."""
    who = people.where(~F.coalesce(F.col("hidden"), F.lit(False))).select(F.col("person").alias("suggested"), "name")
    open_ = faces.where("person is null").join(shown.select("medium").distinct(), "medium", "left_semi").join(who, "suggested")
    return _page(open_.select("face", F.col("suggested").alias("person"), "name", "distance", "created"), [F.asc_nulls_last("distance"), F.desc_nulls_last("created"), F.col("face")], offset, limit).drop("created")


def faces_of(faces: DataFrame, shown: DataFrame, person: int, offset: int, limit: int, only: str | None = None) -> DataFrame:
    """face, medium, at, place, more of a person's faces, the newest medium first. only 'auto': those that nobody confirmed, a year
    at a time (the first of each year, then the second, in the order of md5), so one page covers all years; only 'twice': those
    on a medium with another face of the person, where they are not a video's (second is not null)."""
    own = faces.where(F.col("person") == person).join(shown.dropDuplicates(["medium"]), "medium")
    order = [F.desc_nulls_last("at"), F.col("medium"), F.col("face")]
    if only == "auto":
        own = own.where("assigned_by = 'auto'").withColumn("_y", F.year("at"))
        turn = F.row_number().over(W.partitionBy("_y").orderBy(F.md5(F.col("face").cast("string").cast("binary")), "face"))
        own, order = own.withColumn("_t", turn), [F.col("_t"), F.asc_nulls_last("_y"), F.col("face")]
    elif only == "twice":
        several = faces.where(F.col("person") == person).groupBy("medium").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("medium")
        own = own.where("second is null").join(several, "medium", "left_semi")
    return _page(own, order, offset, limit).select("face", "medium", "at", "place", "more")


def media_of(faces: DataFrame, shown: DataFrame, person: int, after: tuple | None, limit: int) -> DataFrame:
    """medium, at of the media a person is in, the newest first (then the largest key), beyond (at, medium) of the last one seen."""
    own = shown.where("at is not null").dropDuplicates(["medium"]).join(faces.where(F.col("person") == person).select("medium").distinct(), "medium", "left_semi").select("medium", "at")
    if after is not None:
        at, key = F.lit(after[0]).cast("timestamp"), F.lit(after[1])
        own = own.where((F.col("at") < at) | ((F.col("at") == at) & (F.col("medium") < key)))
    return own.orderBy(F.desc("at"), F.desc("medium")).limit(limit)


def faces_in(faces: DataFrame, people: DataFrame, medium: int) -> DataFrame:
    """face, person, name, second, left, place of one medium's faces, stills first, from left to right; hidden persons too."""
    own = faces.where(F.col("medium") == medium).join(people.select("person", "name"), "person", "left")
    return own.select("face", "person", "name", "second", "left", F.row_number().over(W.orderBy(F.asc_nulls_first("second"), F.asc_nulls_last("left"), "face")).alias("place"))  # one medium's faces


def notifications(notes: DataFrame, user: int, people: DataFrame, media: DataFrame, albums: DataFrame, comments: DataFrame, before: object = None, limit: int = 30) -> DataFrame:
    """note, kind, updated, n, unread, actors, medium, album, path, excerpt, place, more: a user's notifications, the newest first.

    actors are names, the last one first, of those who exist; the album is the note's own or its medium's; a comment is told
    unless it was deleted. notes: note, user, kind, medium, album, comment, actors, n, updated, read_at; people: person, name;
    media: medium, album; albums: album, path; comments: comment, body, deleted. Only the page meets the other tables."""
    own = notes.where(F.col("user") == user)
    own = own if before is None else own.where(F.col("updated") < F.lit(before).cast("timestamp"))
    page = _page(own, [F.desc_nulls_last("updated"), F.col("note")], 0, limit)
    each = page.select("note", F.posexplode("actors").alias("_i", "person")).join(people.select("person", "name"), "person")
    names = each.groupBy("note").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_i")).alias("i"), "name"))), lambda x: x["name"]).alias("_names"))  # a note's actors
    of_media = media.select("medium", F.col("album").alias("_album")).dropDuplicates(["medium"])
    full = page.join(names, "note", "left").join(of_media, "medium", "left").withColumn("album", F.coalesce("album", "_album")).join(albums.select("album", "path"), "album", "left")
    full = full.join(comments.select("comment", F.when(~F.coalesce("deleted", F.lit(False)), F.col("body")).alias("excerpt")), "comment", "left")
    return full.select("note", "kind", "updated", "n", F.col("read_at").isNull().alias("unread"), F.coalesce("_names", F.array().cast("array<string>")).alias("actors"), "medium", "album", "path", "excerpt", "place", "more")


def read(notes: DataFrame, user: int, at: object, only: list[int] | None = None) -> DataFrame:
    """notes with those of a user that are unread (of `only`, or all) marked as read at a time."""
    mine = (F.col("user") == user) & F.col("read_at").isNull()
    mine = mine if only is None else mine & F.col("note").isin(only)
    return notes.withColumn("read_at", F.when(F.coalesce(mine, F.lit(False)), F.lit(at).cast("timestamp")).otherwise(F.col("read_at")))


def cursor(at: datetime, key: int) -> str:
    """Where a list goes on, as one word: the time and key of its last row."""
    return base64.urlsafe_b64encode(f"{at.isoformat()}|{key}".encode()).decode().rstrip("=")


def cursor_of(text: str) -> tuple[datetime, int]:
    """The time and key of a cursor; an error for anything that cursor did not give."""
    try:
        at, key = base64.urlsafe_b64decode(text.encode("ascii") + b"=" * (-len(text) % 4)).decode().split("|", 1)
        return datetime.fromisoformat(at), int(key)
    except (binascii.Error, UnicodeError, ValueError) as e:
        raise ValueError("not a cursor") from e
