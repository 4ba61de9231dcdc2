"""Groups of unknown faces, as they come about when faces are taken one after the other in the order of their numbers.

A face joins the group whose middle is nearest (within JOIN) among the groups of its neighbours, else stays in the group that
took it, else opens one; groups of its neighbours whose middles lie within MERGE of its own group's become one with it;
neighbours without a group are taken along. Groups never reach beyond the faces that neighbours tie together, so each such
component is walked by itself; a component of more than `batch` faces is walked in batches, one round each, which hand on the
groups' sums and the faces' groups by written tables. A task holds a batch, its neighbours and the groups that these are in.

Faces that are small or unclear, have a person, or no neighbour within NEAR are in no group. Vectors without a direction are
near to nothing. Faces are whole numbers and taken to be unique (of rows that repeat one counts); ties go to the older group.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlake.operators import groups, identity, vectors
from lumenlake.operators.groups import written

# How near neighbours are, a face to a middle that it joins, and two middles that become one.
NEAR, JOIN, MERGE = 0.50, 0.45, 0.35
ASKED, BATCH = 10, 50_000


def ranks(rows: DataFrame, group: str, order: str, stretches: int = 64) -> DataFrame:
    """rows with rank, from 0, in the order of a number within each group. A group's rows are counted in stretches of the order,
    so that no task sorts a whole group; rows that agree in the order have any order among them."""
    cuts = sorted(set(rows.approxQuantile(order, [i / stretches for i in range(1, stretches)], 0.001)))
    at = sum((F.when(F.col(order) > c, 1).otherwise(0) for c in cuts), F.lit(0))
    cut = rows.withColumn("_s", at)
    before = cut.groupBy(group, "_s").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy(group).orderBy("_s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(W.partitionBy(group, "_s").orderBy(order)) - 1
    return cut.withColumn("_own", own).join(before.drop("_n"), [group, "_s"]).withColumn("rank", F.col("_own") + F.col("_before")).drop("_s", "_own", "_before")


class Walk:
    """Groups as a walk over faces leaves them: of each face, the sum and size of each, and which became part of which."""

    def __init__(self, join: float, merge: float) -> None:
        self.join, self.merge = join, merge
        self.of: dict[int, int] = {}
        self.sums: dict[int, tuple[np.ndarray, int]] = {}
        self.into: dict[int, int] = {}
        self.vectors: dict[int, np.ndarray] = {}
        self.changed: set[int] = set()

    def whole(self, g: int | None) -> int | None:
        """The group that g has become part of."""
        while g in self.into:
            g = self.into[g]
        return g

    def group(self, face: int) -> int | None:
        return self.whole(self.of.get(face))

    def gap(self, a: np.ndarray, b: np.ndarray) -> float:
        size = float(np.sqrt(a @ a) * np.sqrt(b @ b))
        return round(1 - float(a @ b) / size, 6) if size else 2.0

    def put(self, face: int, g: int) -> None:
        old = self.group(face)
        if old == g:
            return
        x = self.vectors[face]
        if old is not None:
            s, n = self.sums[old]
            self.sums[old] = (s - x, n - 1)
        s, n = self.sums.get(g, (np.zeros_like(x), 0))
        self.sums[g] = (s + x, n + 1)
        self.of[face] = g
        self.changed.add(face)

    def step(self, face: int, near: Iterable[int]) -> None:
        """One face with its neighbours."""
        near = list(near)
        if not near:
            return
        before = {n: self.group(n) for n in near}
        around = sorted({g for g in before.values() if g is not None})
        gaps = [(self.gap(self.vectors[face], self.sums[g][0]), g) for g in around]
        best = min((x for x in gaps if x[0] <= self.join), default=None)
        target = best[1] if best else self.group(face)
        target = face if target is None else target
        self.put(face, target)
        for other in around:
            if other != target and self.sums[other][1] and self.gap(self.sums[target][0], self.sums[other][0]) <= self.merge:
                (s, n), (t, m) = self.sums[target], self.sums.pop(other)
                self.sums[target], self.into[other] = (s + t, n + m), target
        for n in near:
            if before[n] is None:
                self.put(n, target)


_OUT = "component bigint, kind string, id bigint, other bigint, sum array<double>"


def _walked(work: DataFrame, join: float, merge: float) -> DataFrame:
    """One batch of each component. work: component, kind, id, other, rank, near, vector, with the kinds 'face' (rank, near and
    vector of a face of the batch), 'near' (a neighbour's vector), 'of' (the group other of face id), 'sum' (sum and size of
    group id). The result has 'of' and 'sum' anew, and 'into' for a group id that became part of group other."""

    def walk(key: tuple, rows: pa.Table) -> pa.Table:
        w, order = Walk(join, merge), []
        for r in rows.to_pylist():
            kind, i = r["kind"], r["id"]
            if kind == "of":
                w.of[i] = r["other"]
            elif kind == "sum":
                w.sums[i] = (np.array(r["vector"]), r["other"])
            else:
                w.vectors[i] = np.array(r["vector"], float)
                if kind == "face":
                    order.append((r["rank"], i, r["near"]))
        for _, face, near in sorted(order):
            w.step(face, near)
        out = [("of", f, w.group(f), None) for f in sorted(w.changed)]
        out += [("sum", g, n, s.tolist()) for g, (s, n) in sorted(w.sums.items())]
        out += [("into", g, w.whole(g), None) for g in sorted(w.into)]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.float64())]
        cols = list(zip(*((key[0].as_py(), *x) for x in out), strict=True)) or [()] * 5
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["component", "kind", "id", "other", "sum"])

    return work.groupBy("component").applyInArrow(walk, _OUT)


def grouped(faces: DataFrame, near: float = NEAR, join: float = JOIN, merge: float = MERGE, asked: int = ASKED, batch: int = BATCH, bar: Column | None = None) -> DataFrame:
    """face, group_id (the smallest face of the group) of the faces in groups. faces: face, vector, pixels, score, person; bar: a
    condition in place of identity.good on pixels and score."""
    clear = identity.good(F.col("pixels"), F.col("score")) if bar is None else bar
    loose = written(faces.where(F.col("person").isNull() & F.col("face").isNotNull() & clear).select(F.col("face").cast("bigint").alias("face"), "vector").dropDuplicates(["face"]))
    pairs = written(vectors.neighbours(vectors.build(loose, "face", "vector"), loose, "face", "vector", near, asked, itself=False))
    part = groups.components(pairs.select(F.col("question").alias("a"), F.col("found").alias("b"))).select(F.col("node").alias("face"), F.col("group_id").alias("component"))
    lists = pairs.groupBy("question").agg(F.transform(F.array_sort(F.collect_list(F.struct("distance", "found"))), lambda x: x["found"]).alias("near")).withColumnRenamed("question", "face")
    plan = ranks(part.join(loose, "face").join(lists, "face"), "component", "face").withColumn("round", F.floor(F.col("rank") / batch).cast("int"))
    plan = written(plan)
    rounds = plan.agg(F.max("round")).first()[0]
    blank = {"other": "bigint", "rank": "bigint", "near": "array<bigint>", "vector": "array<double>"}
    shape = lambda df, kind: df.select("component", F.lit(kind).alias("kind"), "id", *(F.col(c).cast(k).alias(c) if c in df.columns else F.lit(None).cast(k).alias(c) for c, k in blank.items()))
    of = sums = None
    for r in range(0 if rounds is None else rounds + 1):
        now = plan.where(F.col("round") == r)
        ties = now.select("component", F.explode("near").alias("face")).distinct()
        outside = ties.join(now.select("face"), "face", "left_anti").join(loose, "face")
        work = shape(now.withColumnRenamed("face", "id"), "face").unionByName(shape(outside.withColumnRenamed("face", "id"), "near"))
        if of is not None:
            known = of.join(ties.unionByName(now.select("component", "face")).distinct().withColumnRenamed("face", "id"), ["component", "id"], "left_semi")
            held = sums.join(known.select("component", F.col("other").alias("id")).distinct(), ["component", "id"], "left_semi")
            work = work.unionByName(shape(known, "of")).unionByName(shape(held.withColumnRenamed("sum", "vector"), "sum"))
        done = written(_walked(work, join, merge))
        new, into, fresh = (done.where(F.col("kind") == k).drop("kind") for k in ("of", "into", "sum"))
        if of is None:
            of, sums = new.select("component", "id", "other"), fresh
            continue
        moved = of.join(into.select("component", F.col("id").alias("other"), F.col("other").alias("_to")), ["component", "other"], "left").select("component", "id", F.coalesce("_to", "other").alias("other"))
        of = written(moved.join(new.select("component", "id"), ["component", "id"], "left_anti").unionByName(new.select("component", "id", "other")))
        gone = fresh.select("component", "id").unionByName(into.select("component", "id"))
        sums = written(sums.join(gone, ["component", "id"], "left_anti").unionByName(fresh))
    if of is None:
        return loose.select("face", F.col("face").alias("group_id")).where(F.lit(False))
    least = of.groupBy("component", "other").agg(F.min("id").alias("group_id"))
    return of.join(least, ["component", "other"]).select(F.col("id").alias("face"), "group_id")


def summary(grouped_: DataFrame, faces: DataFrame) -> DataFrame:
    """One row: groups, faces in them, the largest, and the faces without a person that are in none."""
    sizes = grouped_.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("faces"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))
    left = faces.where("person is null").join(grouped_.select("face"), "face", "left_anti").agg(F.count(F.lit(1)).alias("ungrouped"))
    return sizes.crossJoin(left)  # one row each


def reassessed(faces: DataFrame, prototypes: DataFrame, rejected: DataFrame, near: float = NEAR, join: float = JOIN, merge: float = MERGE, **bounds: float) -> DataFrame:
    """face, person, suggested, assigned_by, trusted, group_id of all faces after those that no user named asked again.

    Who comes up is what identity.named says; the faces that are left without a person are put in groups anew. Faces that a
    user named stay as they are. bounds go to identity.named."""
    said = identity.named(faces, prototypes, rejected, **bounds).select("face", F.col("person").alias("_p"), F.col("outcome").alias("_o"))
    by_user = F.coalesce(F.col("assigned_by") == "user", F.lit(False))
    gets = F.col("_o").isin("trusted", "auto")
    after = written(faces.join(said, "face", "left").select(
        "face", "vector", "pixels", "score", F.when(by_user, F.col("person")).when(gets, F.col("_p")).alias("person"), F.when(~by_user & (F.col("_o") == "suggested"), F.col("_p")).alias("suggested"),
        F.when(by_user, "user").when(gets, "auto").alias("assigned_by"), F.when(by_user, F.coalesce("trusted", F.lit(False))).otherwise(F.coalesce(F.col("_o") == "trusted", F.lit(False))).alias("trusted"),
    ))
    return after.drop("vector", "pixels", "score").join(grouped(after, near, join, merge), "face", "left")
