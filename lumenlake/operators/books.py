"""Books of an album's pictures: where undated ones belong, whole moments spread over the album, and the pages they become.

A shot is a row of book, id (a whole number), taken_at, guessed (its time is that of a folder), people, caption, width, height,
tags, and for pages ocr and latitude. All books are worked on at once, by windows within a book; of a book only its moments and
counts meet. Shots without a book, an id or a time are left out, repeats of an id count once. Ties go to the earlier shot or
moment, then to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlake.operators.groups import written

# Minutes that part moments, pictures of a moment, the least a book holds, how often the best is taken, pictures on a
# page, letters of a text worth showing, pictures of a moment worth a map.
GAP, PER_MOMENT, FEWEST, BEST, ON_PAGE, LEGIBLE, MAPPED = 45, 3, 8, 0.6, 3, 25, 5
OPENING, DAY, FIND, MAP, DOUBLE, STRIP, TWO, CLOSING = "auftakt", "tag", "fundstueck", "karte", "doppelseite", "streifen", "zwei", "schluss"


def clean(shots: DataFrame) -> DataFrame:
    """Shots that have what every step asks for, each once."""
    return shots.where("book is not null and id is not null and taken_at is not null").dropDuplicates(["book", "id"])


def moments(shots: DataFrame, gap: int = GAP) -> DataFrame:
    """Shots with moment: 0, 1, ... within a book; a moment goes on while no more than `gap` minutes pass between two shots."""
    w = W.partitionBy("book").orderBy("taken_at", "id")
    apart = F.unix_micros("taken_at") - F.unix_micros(F.lag("taken_at").over(w)) > gap * 60_000_000
    return shots.withColumn("_cut", F.coalesce(apart, F.lit(False)).cast("int")).withColumn("moment", F.sum("_cut").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("_cut")


def placed(shots: DataFrame, gap: int = GAP) -> DataFrame:
    """Shots with a guessed time at the end of the moment of dated ones that has the shot most like theirs (Jaccard of tags, 0
    without any), the earliest of equals. A book without dated shots stays as it is.

    A set of tags is looked at once a book, on either side: of its shots only the first moment can be the answer. Where a book has
    a dated shot with the same set, that is the home; only other sets meet, those that share a tag."""
    shots = written(clean(shots).withColumn("guessed", F.coalesce("guessed", F.lit(False))))
    some = F.array_sort(F.array_distinct(F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: t.isNotNull() & (t != ""))))
    own, loose = shots.where("not guessed"), shots.where("guessed").withColumn("_t", some)
    dated = written(moments(own, gap).select("book", "moment", "taken_at", some.alias("_t")))
    ends = dated.groupBy("book", "moment").agg(F.max("taken_at").alias("_end"))
    first = ends.where("moment = 0").select("book", F.col("_end").alias("_first"))
    number = F.monotonically_increasing_id()
    sets = written(dated.where(F.size("_t") > 0).groupBy("book", "_t").agg(F.min("moment").alias("moment")).withColumn("_s", number))
    same = sets.select("book", "_t", "moment")
    asks = written(loose.where(F.size("_t") > 0).select("book", "_t").distinct().join(same, ["book", "_t"], "left_anti").withColumn("_a", number))
    of = lambda df, n, *names: df.select("book", *names, F.size("_t").alias(n), F.explode("_t").alias("tag"))
    met = of(asks, "_m", "_a").join(of(sets, "_n", "_s"), ["book", "tag"])
    like = met.groupBy("_a", "_s", "_n", "_m").agg(F.count(F.lit(1)).alias("_c")).select("_a", "_s", (F.col("_c") / (F.col("_m") + F.col("_n") - F.col("_c"))).alias("_like"))
    near = like.join(sets.select("_s", "moment"), "_s").groupBy("_a").agg(F.min_by("moment", F.struct(-F.col("_like"), F.col("moment"))).alias("moment"))
    home = same.unionByName(asks.join(near, "_a").select("book", "_t", "moment")).join(ends, ["book", "moment"]).select("book", "_t", "_end")
    found = loose.join(home, ["book", "_t"], "left").join(first, "book", "left").withColumn("taken_at", F.coalesce("_end", "_first", "taken_at"))
    return own.unionByName(found.select(own.columns))


def worth() -> Column:
    """The more the better: people, letters of the caption, size; then the larger id."""
    return F.struct(F.coalesce("people", F.lit(0)).alias("p"), F.length(F.coalesce("caption", F.lit(""))).alias("c"), F.coalesce(F.col("width") * F.col("height"), F.lit(0)).alias("s"), F.col("id").alias("i"))


def drawn(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) that follows from the seed and the parts."""
    text = F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def _step(at: Column, count: Column, of: Column) -> tuple[Column, Column]:
    """(the stretch that place `at` of count lies in when count is cut into `of` stretches, whose bounds are rounded half to even;
    the number of stretches)."""
    near = F.floor(at * of / count)
    start = lambda k: F.bround((k * count / of).cast("double"), 0).cast("bigint")
    within = lambda k: (start(k) <= at) & (at < F.greatest(start(k + 1), start(k) + 1))
    return F.when(within(near), near).when(within(near - 1), near - 1).otherwise(near + 1).cast("int"), of


def how_many(size: Column, share: float, most: int) -> Column:
    """Pictures of a book: a share of the album, no more than `most`; FEWEST at least where there are as many."""
    return F.greatest(F.least(F.bround(size * F.lit(float(share)), 0).cast("bigint"), F.lit(most), size), F.least(F.lit(FEWEST), size))


def shares(sizes: DataFrame) -> DataFrame:
    """book, moment, share of sizes: book, moment, n, wanted (the same for a book): each moment's part of what is wanted, one at
    least. What rounding leaves over goes, one by one, to the moment with the most left to give; what is too much is taken from
    the one with the most; of equals the first."""
    w = W.partitionBy("book")
    s = sizes.withColumn("_g", F.greatest(F.lit(1), F.floor(F.col("n") * F.col("wanted") / F.sum("n").over(w)).cast("bigint"))).withColumn("_sum", F.sum("_g").over(w))
    unit = F.explode(F.when((F.col("_sum") < F.col("wanted")) & (F.col("_g") < F.col("n")), F.sequence(F.lit(1).cast("bigint"), F.col("n") - F.col("_g"))).when((F.col("_sum") > F.col("wanted")) & (F.col("_g") > 1), F.sequence(F.lit(2).cast("bigint"), F.col("_g"))))
    turns = s.select("book", "moment", (F.col("wanted") - F.col("_sum")).alias("_off"), unit.alias("_u"))  # no more than a moment has shots
    rank = F.row_number().over(w.orderBy(F.desc("_u"), "moment"))
    moved = turns.withColumn("_r", rank).where(F.col("_r") <= F.abs("_off")).groupBy("book", "moment").agg(F.sum(F.signum("_off")).cast("bigint").alias("_d"))
    return s.join(moved, ["book", "moment"], "left").select("book", "moment", (F.col("_g") + F.coalesce("_d", F.lit(0))).alias("share"))


def chosen(shots: DataFrame, share: float = 0.5, most: int = 120, seed: int = 0, gap: int = GAP) -> DataFrame:
    """The shots of each book that go into it, in whole moments over the album: first so many moments (the fullest of each stretch,
    or by the seed another), then of each its share of pictures (the best of each stretch of it, or another). The first and the
    last picture of the album are always in. Shots come placed, and thinned if they should be (library.thinned)."""
    at = moments(clean(shots), gap)
    b = W.partitionBy("book")
    at = at.withColumn("_size", F.count(F.lit(1)).over(b)).withColumn("_wanted", how_many(F.col("_size"), share, most))
    at = written(at.withColumn("_first", F.row_number().over(b.orderBy("taken_at", "id")) == 1).withColumn("_last", F.row_number().over(b.orderBy(F.desc("taken_at"), F.desc("id"))) == 1))
    whole, at = at.where("_wanted >= _size"), at.where("_wanted < _size")
    runs = at.groupBy("book", "moment").agg(F.count(F.lit(1)).alias("n"), F.max("_wanted").alias("wanted"), F.max("_size").alias("size"))
    runs = runs.withColumn("runs", F.count(F.lit(1)).over(b))
    typical = F.greatest(F.lit(1), F.least(F.lit(PER_MOMENT), F.bround(F.col("size") / F.col("runs"), 0).cast("int")))
    runs = runs.withColumn("of", F.greatest(F.lit(1), F.least(F.ceil(F.col("wanted") / typical).cast("int"), F.col("runs"))))
    step = _step(F.col("moment"), F.col("runs"), F.col("of"))[0]
    runs = runs.withColumn("step", F.when(F.col("of") >= F.col("runs"), F.col("moment")).otherwise(step))
    s = W.partitionBy("book", "step")
    full = F.row_number().over(s.orderBy(F.desc("n"), "moment"))
    other = F.row_number().over(s.orderBy(drawn(seed, F.col("book"), F.col("moment")), "moment"))
    edge = F.when(F.col("step") == 0, F.col("moment") == F.min("moment").over(s)).when(F.col("step") == F.col("of") - 1, F.col("moment") == F.max("moment").over(s))
    best = drawn(seed, F.col("book"), F.lit("m"), F.col("step")) < BEST
    picked = written(runs.withColumn("_in", F.coalesce(edge, F.when(best, full == 1).otherwise(other == 1))).where("_in").select("book", "moment", "n", "wanted"))
    given = at.join(picked.join(shares(picked), ["book", "moment"]).select("book", "moment", "n", "share"), ["book", "moment"])
    m = W.partitionBy("book", "moment")
    given = given.withColumn("_at", F.row_number().over(m.orderBy("taken_at", "id")) - 1)
    given = given.withColumn("_step", F.when(F.col("share") >= F.col("n"), F.col("_at")).otherwise(_step(F.col("_at"), F.col("n"), F.col("share"))[0]))
    t = W.partitionBy("book", "moment", "_step")
    top = F.row_number().over(t.orderBy(worth().desc()))
    any_ = F.row_number().over(t.orderBy(drawn(seed, F.col("book"), F.col("id")), "id"))
    edge = F.when(F.col("_step") == 0, F.col("_at") == F.min("_at").over(t)).when(F.col("_step") == F.col("share") - 1, F.col("_at") == F.max("_at").over(t))
    best = drawn(seed, F.col("book"), F.col("moment"), F.col("_step")) < BEST
    out = given.withColumn("_in", F.coalesce(edge, F.when(best, top == 1).otherwise(any_ == 1))).where("_in")
    # A book begins and ends where the album does: those two take the places of the first and the last that were picked.
    out = out.withColumn("_f", F.row_number().over(b.orderBy("taken_at", "id")) == 1).withColumn("_l", F.row_number().over(b.orderBy(F.desc("taken_at"), F.desc("id"))) == 1).where(~((F.col("_f") & ~F.col("_first")) | (F.col("_l") & ~F.col("_last") & ~F.col("_first"))))
    names = shots.columns
    ends = at.where("_first or _last")
    return out.select(names).unionByName(ends.join(out.select("book", "id"), ["book", "id"], "left_anti").select(names)).unionByName(whole.select(names))


def pages(shots: DataFrame, gap: int = GAP) -> DataFrame:
    """book, page (from 1), kind, day, moment, shots (ids in order) of the pages of each book: an opening; for each day a page and
    those of its moments; a closing. A moment gives its longest legible text a page of its own; where enough is left and a shot
    has a latitude, its first shots go on a map; the others ON_PAGE to a page: a wide one alone, a strip, or one or two as they
    are. Moments are those of the shots that are handed in; a moment belongs to the day on which it begins (in the session's zone)."""
    at = moments(clean(shots), gap)
    m = W.partitionBy("book", "moment")
    order = m.orderBy("taken_at", "id")
    letters = F.length(F.coalesce("ocr", F.lit("")))
    at = at.withColumn("day", F.to_date(F.min("taken_at").over(m))).withColumn("_find", (letters > LEGIBLE) & (F.row_number().over(m.orderBy(F.desc(letters), "taken_at", "id")) == 1))
    at = at.withColumn("_i", F.sum((~F.col("_find")).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)) - 1)
    left = F.sum((~F.col("_find")).cast("int")).over(m)
    mapped = (left >= MAPPED) & F.max(F.when(~F.col("_find"), F.coalesce("latitude", F.lit(0.0)) != 0).otherwise(False)).over(m)
    at = at.withColumn("_page", F.when(F.col("_find"), -1).otherwise(F.floor(F.col("_i") / ON_PAGE))).withColumn("_map", ~F.col("_find") & mapped & (F.col("_page") == 0))
    one = F.array_sort(F.collect_list(F.struct("taken_at", "id", (F.col("width") > F.col("height")).alias("wide"))))  # ON_PAGE rows at most
    each = at.groupBy("book", "day", "moment", "_page").agg(one.alias("l"), F.max("_map").alias("_map"))
    wide = (F.size("l") == 1) & F.coalesce(F.element_at("l", 1)["wide"], F.lit(False))
    kind = F.when(F.col("_page") == -1, FIND).when(F.col("_map"), MAP).when(wide, DOUBLE).when(F.size("l") >= ON_PAGE, STRIP).otherwise(TWO)
    of_moments = each.select("book", "day", "moment", F.col("_page").cast("int").alias("_page"), kind.alias("kind"), F.transform("l", lambda x: x["id"]).alias("shots"))
    none = F.array().cast(dict(of_moments.dtypes)["shots"])
    days = each.groupBy("book", "day").agg(F.min("moment").alias("moment")).select("book", "day", "moment", F.lit(-2).alias("_page"), F.lit(DAY).alias("kind"), none.alias("shots"))
    ends = each.groupBy("book").agg(F.max("moment").alias("_m")).select("book", F.explode(F.array(F.struct(F.lit(-1).alias("moment"), F.lit(OPENING).alias("kind")), F.struct((F.col("_m") + 1).alias("moment"), F.lit(CLOSING).alias("kind")))).alias("e"))
    ends = ends.select("book", F.lit(None).cast("date").alias("day"), "e.moment", F.lit(0).alias("_page"), "e.kind", none.alias("shots"))
    all_ = of_moments.unionByName(days).unionByName(ends)
    page = F.row_number().over(W.partitionBy("book").orderBy("moment", "_page"))
    inner = F.col("kind").isin(OPENING, CLOSING, DAY)
    return all_.select("book", page.alias("page"), "kind", "day", F.when(~inner, F.col("moment")).alias("moment"), "shots")
