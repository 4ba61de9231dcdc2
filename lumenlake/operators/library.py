"""Albums, comments, chapters' members, memories, shelves, the report, stages of work and replacing of results.

Unless a function says otherwise, null keys form no group, ties go to the smallest key and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlake.operators.filters import closure
from lumenlake.operators.groups import written
from lumenlake.operators.picks import first_of, most_common


def album_tree(albums: DataFrame, media: DataFrame, most: int = 4) -> DataFrame:
    """album, media, children, collage of every album. albums: album, parent, path; media: medium, album, at. The collage is the
    newest medium of the album itself, else those of the albums below, nearest first, then by path, `most` at most."""
    own = media.groupBy("album").agg(F.count(F.lit(1)).alias("media"), F.max_by("medium", F.struct("at", "medium")).alias("cover"))
    below = albums.where("parent is not null").groupBy(F.col("parent").alias("album")).agg(F.count(F.lit(1)).alias("children"))
    lent = closure(albums, "album", "parent").join(own.select(F.col("album").alias("node"), "cover"), "node").join(albums.select(F.col("album").alias("node"), "path"), "node")
    nearest = first_of(lent, ["ancestor"], [F.col("depth"), F.col("path"), F.col("node")], most)
    collage = nearest.groupBy(F.col("ancestor").alias("album")).agg(F.array_sort(F.collect_list(F.struct("place", "depth", "cover"))).alias("l"))
    mine = F.col("l")[0]["depth"] == 0
    covers = F.when(mine, F.slice(F.transform("l", lambda x: x["cover"]), 1, 1)).otherwise(F.transform("l", lambda x: x["cover"]))
    each = albums.select("album").join(own.select("album", "media"), "album", "left").join(below, "album", "left").join(collage.select("album", covers.alias("collage")), "album", "left")
    return each.select("album", F.coalesce("media", F.lit(0)).alias("media"), F.coalesce("children", F.lit(0)).alias("children"), F.coalesce("collage", F.array().cast("array<bigint>")).alias("collage"))


def ways(paths: DataFrame, path: str, known: DataFrame) -> DataFrame:
    """path: folders above the paths (and these) that known has not yet, each once."""
    parts = F.split(F.col(path), "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return paths.where(F.col(path) != "").select(F.explode(up).alias("path")).distinct().join(known.select("path"), "path", "left_anti")


def threads(comments: DataFrame) -> DataFrame:
    """comment, parent, deleted of the comments to show, at most one level deep: every answer goes to the comment that began its
    thread, however deep it was (found by doubling, each round a written table; a ring raises an error). A deleted comment
    stays as a mark only while an answer to it is shown. comments: comment, parent, deleted."""
    ties = comments.where("comment is not null and parent is not null").select("comment", "parent")
    over = written(ties.join(ties.select(F.col("comment").alias("parent")).distinct(), "parent", "left_semi"))  # answers to answers
    tops, rounds = written(ties), 0
    while not over.isEmpty():
        up = tops.select(F.col("comment").alias("parent"), F.col("parent").alias("_up"))
        tops = written(tops.join(up, "parent", "left").select("comment", F.coalesce("_up", "parent").alias("parent")))
        over, rounds = tops.join(ties.select(F.col("comment").alias("parent")).distinct(), "parent", "left_semi"), rounds + 1
        if rounds > 40:  # 2 ** 40 answers above one another
            raise ValueError("comments answer one another in a ring")
    first = tops.select("comment", F.col("parent").alias("_top")).distinct()
    flat = comments.join(first, "comment", "left").select("comment", F.coalesce("_top", "parent").alias("parent"), F.coalesce("deleted", F.lit(False)).alias("deleted"))
    answered = flat.where(~F.col("deleted") & F.col("parent").isNotNull()).select(F.col("parent").alias("comment"), F.lit(True).alias("_answered")).distinct()
    return flat.join(answered, "comment", "left").where(~F.col("deleted") | F.col("_answered")).select("comment", "parent", "deleted")


def reactions(rows: DataFrame, on: str, reaction: str, time: str, who: str, me: int) -> DataFrame:
    """on, reaction, n, mine, place: the reactions to each thing, the most frequent first, then the latest."""
    each = rows.where(F.col(reaction).isNotNull()).groupBy(on, reaction).agg(F.count(F.lit(1)).alias("n"), F.max(time).alias("_last"), F.bool_or(F.col(who) == me).alias("mine"))
    return first_of(each, [on], [F.desc("n"), F.desc("_last"), F.col(reaction)], 1 << 30).drop("_last")


def shelves(rows: DataFrame, traits: dict[str, Column]) -> DataFrame:
    """trait, n of the traits that some row has, in one pass."""
    names = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in traits.items())), lambda x: x.isNotNull())
    return rows.select(F.explode(names).alias("trait")).groupBy("trait").agg(F.count(F.lit(1)).alias("n"))


def homes(rows: DataFrame, owner: str, place: str) -> DataFrame:
    """owner, home: the place of most of an owner's rows; null where the owner has fewer than two places."""
    n = rows.groupBy(owner).agg(F.count_distinct(place).alias("_n"))
    best = most_common(rows, owner, place).select(owner, F.col(place).alias("_best"))
    return n.join(best, owner, "left").select(owner, F.when(F.col("_n") >= 2, F.col("_best")).alias("home"))


def away(rows: DataFrame, owner: str, place: str, time: str, key: str, gap: int = 2, least_days: int = 2, least: int = 15) -> tuple[DataFrame, DataFrame]:
    """(trips, members). trips: owner, trip (its first day), last_day, days, n, place (of most away rows); runs of days away from
    home no more than `gap` days apart, with enough days and rows. members: owner, trip, key: all rows of the trip's days."""
    day = F.col(time).cast("date")
    gone = rows.join(homes(rows, owner, place), owner).where(F.col("home").isNotNull() & (F.col(place) != F.col("home")) & day.isNotNull()).select(owner, place, day.alias("day"))
    days = gone.select(owner, "day").distinct()
    w = W.partitionBy(owner).orderBy("day")
    days = days.withColumn("_new", (F.coalesce(F.datediff("day", F.lag("day").over(w)), F.lit(0)) > gap).cast("int")).withColumn("_i", F.sum("_new").over(w))
    days = days.withColumn("trip", F.min("day").over(W.partitionBy(owner, "_i"))).select(owner, "day", "trip")
    of = gone.join(days, [owner, "day"])
    town = most_common(of.withColumn("_key", F.struct(owner, "trip")), "_key", place).select(F.col("_key." + owner).alias(owner), F.col("_key.trip").alias("trip"), place)
    found = of.groupBy(owner, "trip").agg(F.max("day").alias("last_day"), F.count_distinct("day").alias("days"), F.count(F.lit(1)).alias("n")).where((F.col("days") >= least_days) & (F.col("n") >= least))
    trips = found.join(town, [owner, "trip"])
    members = rows.select(owner, key, day.alias("day")).join(days.join(found.select(owner, "trip"), [owner, "trip"], "left_semi"), [owner, "day"]).select(owner, "trip", key)
    return trips, members


def on_this_day(rows: DataFrame, key: str, time: str, album: str, score: Column, year: int, month: int, day: int, reach: int = 3, most: int = 12) -> DataFrame:
    """year, key, place, from_week, album: of each earlier year the `most` best rows of this calendar day, or where no year has
    any of the days within `reach`; in the order they were taken, with the album most of them are in. Equal scores are
    ordered by the MD5 of the key and the day."""
    at = F.col(time).cast("date")
    near = F.array_min(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda y: F.abs(F.datediff(at, F.try_to_date(F.concat_ws("-", (F.year(at) + y).cast("string"), F.lit(f"{month:02d}"), F.lit(f"{day:02d}")))))))
    found = rows.where(F.year(at) < year).select(F.year(at).alias("year"), key, album, F.col(time).alias("_at"), score.alias("_score"), near.alias("_off")).where(F.col("_off") <= reach)
    exact = found.agg(F.coalesce(F.bool_or(F.col("_off") == 0), F.lit(False)).alias("_exact"))  # one row
    found = found.crossJoin(F.broadcast(exact)).where(~F.col("_exact") | (F.col("_off") == 0))
    shuffle = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{year:04d}-{month:02d}-{day:02d}")).cast("binary"))
    best = first_of(found, ["year"], [F.desc("_score"), shuffle, F.col(key)], most).drop("place")
    town = most_common(best, "year", album).select("year", F.col(album).alias("_album"))
    placed = first_of(best, ["year"], [F.col("_at"), F.col(key)], most)
    return placed.join(town, "year", "left").select("year", key, "place", (~F.col("_exact")).alias("from_week"), F.col("_album").alias("album"))


def sampled_chapters(rows: DataFrame, chapter: str, key: str, order: Sequence[Column], seed: str, most: int) -> DataFrame:
    """chapter, key, place: `most` rows of each chapter chosen by MD5 of key and seed, kept in the chapter's own order."""
    w = W.partitionBy(chapter).orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)).cast("binary")), key)
    some = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")
    return first_of(some, [chapter], list(order), most).select(chapter, key, "place")


def batches_by_year(rows: DataFrame, year: Column, order: Sequence[Column], size: int = 12) -> DataFrame:
    """rows with batch and year: rows dealt in batches of `size` a year; read by (batch, year descending, order)."""
    w = W.partitionBy("_year").orderBy(*order)
    return rows.withColumn("_year", year).withColumn("batch", F.floor((F.row_number().over(w) - 1) / size)).withColumnRenamed("_year", "year")


def report(rows: DataFrame, sections: dict[str, tuple[Column, Column]], tops: dict[str, int]) -> DataFrame:
    """section, key, n, total: for each section (key, value) the rows and the sum of the value by key, in one pass over the rows;
    null keys count nowhere. tops: sections of which only so many keys are told, the fullest first."""
    parts = F.array(*(F.struct(F.lit(name).alias("section"), k.cast("string").alias("key"), v.cast("double").alias("v")) for name, (k, v) in sections.items()))
    each = rows.select(F.explode(parts).alias("p")).select("p.*").where("key is not null").groupBy("section", "key").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 2).alias("total"))
    if not tops:
        return each
    each, limit = written(each), F.lit(0)
    for name, most in tops.items():
        limit = F.when(F.col("section") == name, most).otherwise(limit)
    cut = each.where(F.col("section").isin(*tops)).withColumn("_r", F.row_number().over(W.partitionBy("section").orderBy(F.desc("n"), "key")))
    cut = cut.where(F.col("_r") <= max(tops.values())).where(F.col("_r") <= limit).drop("_r")  # by the first, tasks drop rows before the shuffle
    return each.where(~F.col("section").isin(*tops)).unionByName(cut)


def backlog(media: DataFrame, done: DataFrame, key: str, time: str, model: str, version: int, most: int, failed: DataFrame | None = None) -> DataFrame:
    """key, time of the newest media without a result of this model and version, those left out that failed three times."""
    open_ = media.join(done.where((F.col("model") == model) & (F.col("version") == version)).select(key), key, "left_anti")
    if failed is not None:
        open_ = open_.join(failed.where("attempts >= 3").select(key), key, "left_anti")
    return open_.select(key, time).orderBy(F.desc_nulls_last(time), key).limit(most)


def stage_states(media: DataFrame, key: str, stages: Sequence[tuple[str, Column, DataFrame, str | None]]) -> DataFrame:
    """key, stage, state: 'not-for-this', 'done', 'given-up', 'waiting' (an earlier stage is not done) or 'open'. A stage is (name,
    which media it is for, table of key, ok, attempts, the stage it needs); each table has at most one row a key."""
    wide = media
    state: dict[str, Column] = {}
    for name, fits, results, needs in stages:
        wide = wide.join(results.select(key, F.col("ok").alias(f"_ok_{name}"), F.col("attempts").alias(f"_n_{name}")), key, "left")
        state[name] = (
            F.when(~F.coalesce(fits, F.lit(False)), "not-for-this").when(F.col(f"_ok_{name}"), "done").when(F.col(f"_n_{name}") >= 3, "given-up")
            .when(state[needs].isin("open", "waiting", "given-up") if needs else F.lit(False), "waiting").otherwise("open")
        )
    return wide.select(key, F.explode(F.array(*(F.struct(F.lit(n).alias("stage"), c.alias("state")) for n, c in state.items()))).alias("s")).select(key, "s.*")


def _one_a_key(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of rows with the same keys (nulls are alike) the least in the order of all columns."""
    return first_of(rows, list(keys), [F.col(c) for c in rows.columns]).select(*rows.columns)


def _without(rows: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows whose keys other has not; a null key equals a null."""
    there = other.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).distinct()
    same = [rows[k].eqNullSafe(there[f"_k{i}"]) for i, k in enumerate(keys)]
    return rows.join(there, same, "left_anti")


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old with new's rows in place of those with their keys. Of repeated keys in new the least row counts; null keys are alike."""
    return _without(old, new, keys).select(*old.columns).unionByName(_one_a_key(new, keys))


def replaced(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old with all of new's rows in place of those with their keys: a key may have several rows, before and after."""
    return _without(old, new, keys).select(*old.columns).unionByName(new.select(*old.columns))


def written_once(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old and, for keys that it has not, new's row (the least of several): what was written first stays. Null keys are alike."""
    return old.unionByName(_one_a_key(_without(new, old, keys), keys).select(*old.columns))


def in_box(lat: Column, lon: Column, place_lat: Column, place_lon: Column, box: tuple[float, float, float, float]) -> Column:
    """Whether a point, or its place's where it has none, lies in (south, west, north, east), across the date line where west > east."""
    y, x = F.coalesce(lat, place_lat), F.coalesce(lon, place_lon)
    south, west, north, east = box
    across = x.between(west, east) if west <= east else (x >= west) | (x <= east)
    return F.coalesce(y.between(south, north) & across, F.lit(False))


def suggested(places: DataFrame, key: str, name: str, keys: str, size: str, text: str, most: int) -> DataFrame:
    """key of the largest places whose name begins with a text (taken literally) or that have it as a key."""
    t = text.lower()
    return places.where(F.startswith(F.lower(F.col(name)), F.lit(t)) | F.array_contains(keys, t)).orderBy(F.desc(size), key).limit(most).select(key)


def combined(frames: DataFrame, medium: str, second: str, tags: str, text: str, people: str, scene: str, most: int = 15) -> DataFrame:
    """medium, tags, text, people, scene of all frames of a medium: the `most` frequent tags (ties: seen first), each text once in
    the order of time, the most people on one frame, the scene of most frames (ties: smallest)."""
    tag = frames.select(medium, second, F.posexplode(tags).alias("_p", "tag")).groupBy(medium, "tag").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(second, "_p")).alias("_first"))
    best = first_of(tag, [medium], [F.desc("_n"), F.col("_first"), F.col("tag")], most).groupBy(medium).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "tag"))), lambda x: x["tag"]).alias("tags"))
    line = frames.where(F.col(text) != "").groupBy(medium, F.col(text).alias("_t")).agg(F.min(second).alias("_s")).groupBy(medium).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_s", "_t"))), lambda x: x["_t"]), "\n").alias("text"))
    each = frames.groupBy(medium).agg(F.max(people).alias("people"))
    return each.join(best, medium, "left").join(line, medium, "left").join(most_common(frames, medium, scene).select(medium, F.col(scene).alias("scene")), medium, "left").select(medium, "tags", "text", "people", "scene")


def thinned(rows: DataFrame, book: str, key: str, prints: str, score: str, bits: int = 12) -> DataFrame:
    """book, key of the rows that stay: best score first, each unless its print is within `bits` of one that stayed. Rows without a
    print stay. The rows of one book are folded in one row of it."""
    one = F.struct((-F.coalesce(F.col(score), F.lit(0.0)).cast("double")).alias("c"), F.col(key).cast("long").alias("k"), F.col(prints).cast("long").alias("p"))
    none = F.array().cast("array<struct<c:double,k:bigint,p:bigint>>")
    close = lambda a, b: F.coalesce(F.bit_count(a["p"].bitwiseXOR(b["p"])) <= bits, F.lit(False))
    each = rows.groupBy(book).agg(F.array_sort(F.collect_list(one)).alias("l"))
    kept = F.aggregate(F.col("l").cast("array<struct<c:double,k:bigint,p:bigint>>"), none, lambda a, x: F.when(F.exists(a, lambda y: close(x, y)), a).otherwise(F.concat(a, F.array(x))))
    return each.select(book, F.explode(kept).alias("x")).select(book, F.col("x.k").alias(key))


def first_sentence(text: Column) -> Column:
    """What stands before the first full stop and blank, with a full stop at its end."""
    s = F.trim(F.split_part(text, F.lit(". "), F.lit(1)))
    return F.when(F.endswith(s, F.lit(".")), s).otherwise(F.concat(s, F.lit(".")))


def part_of_day(time: Column) -> Column:
    """'night' before 6, 'morning' before 11, 'noon' before 14, 'afternoon' before 18, 'evening' before 22, 'night' after."""
    h = F.hour(time)
    return F.when(h < 6, "night").when(h < 11, "morning").when(h < 14, "noon").when(h < 18, "afternoon").when(h < 22, "evening").when(h >= 22, "night")


def chance(key: Column, seed: str) -> Column:
    """A number in [0, 1) that follows from a key and a seed."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(seed)).cast("binary")), 1, 8), 16, 10).cast("long") / float(1 << 32)
