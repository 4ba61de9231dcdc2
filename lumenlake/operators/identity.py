"""Who is on a picture: faces kept once, people's middles, assignment, questions, listings.

A face is a row of face, medium, vector, pixels, score; person, assigned_by ('user', 'auto' or null), trusted and suggested
tell what is known of it. Faces without a vector, or with one of no length, are near to nothing. Ties go to the smallest
face; rows that repeat count as faces of their own; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlake.operators import vectors
from lumenlake.operators.groups import written
from lumenlake.operators.picks import _cosine, first_of

# Distances and bars.
SURE, SAFE, MIDDLE, LIKELY = 0.45, 0.30, 0.40, 0.62
PIXELS, SCORE = 80, 0.75
SAME = 0.6


def good(pixels: Column, score: Column, a: float = PIXELS, b: float = SCORE) -> Column:
    """Whether a face is large and clear; nulls are neither."""
    return F.coalesce((pixels >= a) & (score >= b), F.lit(False))


def vouching(rows: DataFrame) -> DataFrame:
    """Faces whose person is certain: named by a user, or trusted and good."""
    trusted = F.coalesce("trusted", F.lit(False)) & good(F.col("pixels"), F.col("score"))
    return rows.where(F.col("person").isNotNull() & (F.coalesce(F.col("assigned_by") == "user", F.lit(False)) | trusted))


def once_each(faces: DataFrame, medium: str, same: float = SAME) -> DataFrame:
    """medium, face of the faces that stay: clearest first (pixels times score), each unless its cosine with one that stayed is
    `same` or more. The faces of one medium are folded in one row of it."""
    clear = F.coalesce(F.col("pixels") * F.col("score"), F.lit(0.0)).cast("double")
    one = F.struct((-clear).alias("c"), F.col("face"), F.col("vector"))
    none = F.array().cast("array<struct<c:double,face:bigint,vector:array<float>>>")
    each = faces.where(F.col("vector").isNotNull()).groupBy(medium).agg(F.array_sort(F.collect_list(one)).cast("array<struct<c:double,face:bigint,vector:array<float>>>").alias("l"))
    kept = F.aggregate("l", none, lambda k, x: F.when(F.exists(k, lambda y: 1 - _cosine(y["vector"], x["vector"]) >= same), k).otherwise(F.concat(k, F.array(x))))
    return each.select(medium, F.explode(kept).alias("x")).select(medium, F.col("x.face").alias("face"))


def middles(faces: DataFrame, person: str, most: int = 600) -> DataFrame:
    """person, number, middle: spherical k-means of a person's faces, k = min(5, max(1, n / 8)), started from the face nearest to
    the mean and then the farthest, 8 rounds at most. At most `most` faces a person (those of the smallest hash) are read."""
    w = W.partitionBy(person).orderBy(F.xxhash64("face"), "face")
    some = faces.where(F.col(person).isNotNull() & F.col("vector").isNotNull()).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("face")
        x = np.stack(rows["vector"].to_list()).astype(float)
        size = np.sqrt((x * x).sum(1))
        x = x[size > 0] / size[size > 0, None]
        if not len(x):
            return pd.DataFrame({person: [], "number": [], "middle": []})
        chosen = [int(np.argmax(x @ x.mean(0)))]
        for _ in range(min(5, max(1, len(x) // 8)) - 1):
            chosen.append(int(np.argmin((x @ x[chosen].T).max(1))))
        c = x[chosen]
        for _ in range(8):
            of = np.argmax(x @ c.T, 1)
            fresh = np.stack([x[of == i].sum(0) if (of == i).any() else c[i] for i in range(len(c))])
            fresh /= np.maximum(np.sqrt((fresh * fresh).sum(1, keepdims=True)), 1e-12)
            if np.allclose(fresh, c):
                break
            c = fresh
        return pd.DataFrame({person: [key[0]] * len(c), "number": range(len(c)), "middle": [v.tolist() for v in c]})

    kind = faces.schema[person].dataType.simpleString()
    return some.select(person, "face", "vector").groupBy(person).applyInPandas(fold, f"{person} {kind}, number int, middle array<double>")


def assigned(faces: DataFrame, prototypes: DataFrame, rejected: DataFrame) -> DataFrame:
    """face, person, distance, outcome for faces without a person: 'trusted' (within SAFE and good), 'auto' (within SURE, or
    MIDDLE where the face is not good), 'suggested' (within LIKELY) of the nearest person that is not ruled out.

    Ruled out are those of rejected (face, person) and those already in the medium. prototypes: person, middle; a few for each
    person. Faces meet an index of them, so only persons within LIKELY come up. One pass; faces named in it do not rule each
    other out."""
    free = faces.where(F.col("person").isNull()).select("face", "medium", "vector", "pixels", "score")
    numbered = written(prototypes.select("person", "middle").withColumn("_id", F.monotonically_increasing_id()))
    met = vectors.neighbours(vectors.build(numbered, "_id", "middle"), free, "face", "vector", LIKELY)
    d = met.join(numbered.select(F.col("_id").alias("found"), "person"), "found").groupBy(F.col("question").alias("face"), "person").agg(F.min("distance").alias("distance"))
    d = d.join(free.drop("vector"), "face")
    open_ = _not_ruled_out(d, faces, rejected)
    best = first_of(open_, ["face"], [F.col("distance"), F.col("person")])
    fine = good(F.col("pixels"), F.col("score"))
    outcome = F.when((F.col("distance") <= SAFE) & fine, "trusted").when(F.col("distance") <= F.when(fine, SURE).otherwise(MIDDLE), "auto").otherwise("suggested")
    return best.select("face", "person", "distance", outcome.alias("outcome"))


def _not_ruled_out(met: DataFrame, faces: DataFrame, rejected: DataFrame) -> DataFrame:
    there = faces.where(F.col("person").isNotNull()).select("medium", "person").distinct()
    return met.join(there, ["medium", "person"], "left_anti").join(rejected.select("face", "person").distinct(), ["face", "person"], "left_anti")


def named(faces: DataFrame, prototypes: DataFrame, rejected: DataFrame, sure: float = SURE, safe: float = SAFE, middle: float = MIDDLE, likely: float = LIKELY, asked: int = 10) -> DataFrame:
    """face, person, distance, outcome of faces that no user named, where a person comes up: first asked are the vouching faces
    (within `sure`: 'trusted' if within `safe` and the face is good, else 'auto'), then the middles (within `middle`: 'auto'),
    then all named faces (within `likely`: 'suggested').

    Each list holds the `asked` nearest (of the middles 5), of which those ruled out fall away: rejected (face, person), and
    persons on another face of the medium. A face does not speak for itself. faces: face, medium, vector, pixels, score, person,
    assigned_by, trusted. One pass: all faces see the names as they were before it. Null vectors come up with nothing."""
    f = faces.select("face", "medium", "vector", "pixels", "score", "person", "assigned_by", "trusted")
    asking = f.where(~F.coalesce(F.col("assigned_by") == "user", F.lit(False)))
    index = vectors.build(f.where("person is not null"), "face", "vector", keep=["person", "pixels", "score", "assigned_by", "trusted"])
    vouches = F.coalesce(F.col("assigned_by") == "user", F.lit(False)) | (F.coalesce("trusted", F.lit(False)) & good(F.col("pixels"), F.col("score")))
    of = index.table.select(F.col("face").alias("found"), "person").distinct()
    lists = []
    for place, condition, radius in ((0, vouches, sure), (2, None, likely)):
        lists.append(vectors.neighbours(index, asking, "face", "vector", radius, asked, itself=False, where=condition).join(of, "found").select(F.col("question").alias("face"), "person", "distance", F.lit(place).alias("list")))
    numbered = written(prototypes.select("person", "middle").withColumn("_id", F.monotonically_increasing_id()))
    near = vectors.neighbours(vectors.build(numbered, "_id", "middle"), asking, "face", "vector", middle, 5)
    lists.append(near.join(numbered.select(F.col("_id").alias("found"), "person"), "found").select(F.col("question").alias("face"), "person", "distance", F.lit(1).alias("list")))
    met = lists[0].unionByName(lists[1]).unionByName(lists[2]).join(asking.select("face", "medium", "pixels", "score"), "face")
    others = f.where("person is not null").select("medium", "person", F.col("face").alias("_other")).groupBy("medium", "person").agg(F.min("_other").alias("_lo"), F.max("_other").alias("_hi"))
    met = met.join(others, ["medium", "person"], "left").where("_lo is null or (_lo = face and _hi = face)")
    met = met.join(rejected.select("face", "person").distinct(), ["face", "person"], "left_anti")
    best = first_of(met, ["face"], [F.col("list"), F.col("distance"), F.col("person")])
    trusted = (F.col("distance") <= safe) & good(F.col("pixels"), F.col("score"))
    outcome = F.when(F.col("list") == 2, "suggested").when((F.col("list") == 0) & trusted, "trusted").otherwise("auto")
    return best.select("face", "person", "distance", outcome.alias("outcome"))


def collapsed(faces: DataFrame) -> DataFrame:
    """The faces, each person left on one face of a medium (a user's first, then the clearest), guesses dropped that the medium
    has answered, and one open question for each person and medium (the nearest, then the clearest)."""
    clear = F.desc(F.coalesce(F.col("pixels") * F.col("score"), F.lit(0)))
    keep = F.row_number().over(W.partitionBy("medium", "person").orderBy(F.coalesce(F.col("assigned_by") == "user", F.lit(False)).desc(), clear, "face")) == 1
    f = faces.withColumn("person", F.when(F.col("person").isNotNull() & keep, F.col("person")))
    known = f.where("person is not null").select("medium", F.col("person").alias("suggested"), F.lit(True).alias("_answered"))
    f = f.join(known, ["medium", "suggested"], "left")
    f = f.withColumn("suggested", F.when(F.col("_answered").isNull() & F.col("person").isNull(), F.col("suggested"))).drop("_answered")
    first = F.row_number().over(W.partitionBy("medium", "suggested").orderBy(F.asc_nulls_last("distance"), clear, "face")) == 1
    return f.withColumn("suggested", F.when(F.col("suggested").isNotNull() & first, F.col("suggested")))


def persons(people: DataFrame, faces: DataFrame, shown: DataFrame) -> DataFrame:
    """person, faces, media, cover of every person, those without a shown face too. shown: medium; cover: the clearest face."""
    seen = faces.join(shown.select("medium").distinct(), "medium", "left_semi").where("person is not null")
    each = seen.groupBy("person").agg(F.count(F.lit(1)).alias("faces"), F.count_distinct("medium").alias("media"), F.max_by("face", F.struct(F.col("pixels") * F.col("score"), -F.col("face"))).alias("cover"))
    return people.join(each, "person", "left").select("person", F.coalesce("faces", F.lit(0)).alias("faces"), F.coalesce("media", F.lit(0)).alias("media"), "cover")


def twice(faces: DataFrame) -> DataFrame:
    """Faces whose medium holds another face of the same person."""
    n = F.count(F.lit(1)).over(W.partitionBy("medium", "person"))
    return faces.where("person is not null").withColumn("_n", n).where("_n > 1").drop("_n")


def alike(faces: DataFrame, face: int, person: int, radius: float, most: int) -> DataFrame:
    """face, distance: the open questions of one person nearest to a face: first the `most` nearest, then those within radius."""
    own = faces.where(F.col("face") == face).select(F.col("vector").alias("_own")).limit(1)  # one row
    others = faces.where((F.col("suggested") == person) & F.col("person").isNull() & (F.col("face") != face))
    d = others.crossJoin(F.broadcast(own)).select("face", F.round(_cosine(F.col("vector"), F.col("_own")), 6).alias("distance"))
    return d.orderBy("distance", "face").limit(most).where(F.col("distance") <= radius)


def near_pairs(rows: DataFrame, by: str, key: str, vector: str, radius: float) -> DataFrame:
    """by, a, b, distance: pairs of one owner whose vectors lie within radius. The result is all pairs of an owner, as albums
    are small; for owners without a bound use blocking on prints (groups.near_ties)."""
    side = lambda k, v: rows.where(F.col(by).isNotNull()).select(by, F.col(key).alias(k), F.col(vector).alias(v))
    pairs = side("a", "_a").join(side("b", "_b"), by).where("a < b")
    return pairs.select(by, "a", "b", F.round(_cosine(F.col("_a"), F.col("_b")), 6).alias("distance")).where(F.col("distance") <= radius)
