"""The vector index, names and groups of faces, and motifs against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.operators import groups, identity, motifs, picks, unknown, vectors
from lumenlake.operators import vector_queries as Q


def unit(v):
    """A vector's direction, or None."""
    if v is None or any(x is None for x in v):
        return None
    v = np.asarray(v, float)
    size = math.sqrt(float(v @ v))
    return v / size if math.isfinite(size) and size > 0 else None


def gap(a, b):
    return round(1 - float(a @ b), 6) + 0.0


def awkward(n=260, dims=8, seed=1):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.3) for x in rng.choice(middles)]) for i in range(n)]
    rows += [(n + i, [2.0 * x for x in middles[0]]) for i in range(120)]  # copies
    rows += [(900, None), (901, []), (902, [0.0] * dims), (903, [1.0] * (dims - 1)), (904, [1.0, None] + [0.0] * (dims - 2)), (905, [float("nan")] * dims), (906, [float("inf")] + [0.0] * (dims - 1)), (None, middles[1])]
    return rows + [rows[3]]


@pytest.fixture(scope="module")
def found(spark):
    rows = awkward()
    df = spark.createDataFrame(rows, "id long, v array<double>")
    return rows, df, vectors.build(df.withColumn("even", F.col("id") % 2 == 0), "id", "v", cells=5, piece=16, keep=["even"])


def asked(rows, radius):
    usable = [(k, unit(v)) for k, v in rows if k is not None and v is not None and len(v) == 8 and unit(v) is not None]
    out = []
    for k, u in usable:
        near = sorted((gap(u, w), o) for o, w in usable if gap(u, w) <= radius)
        out += [(k, o, d) for d, o in near]
    return out


def same(got, want):
    """Equal rows, and distances that differ by rounding alone."""
    a, b = sorted(got), sorted(want)
    assert [x[:2] for x in a] == [x[:2] for x in b] and all(abs(x[2] - y[2]) < 2e-6 for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("radius", [0.05, 0.4, 2.0])
def test_index_loses_nothing(found, radius):
    rows, df, index = found
    same([tuple(r) for r in vectors.neighbours(index, df, "id", "v", radius).collect()], asked(rows, radius))


def test_index_nearest_with_a_condition(found):
    rows, df, index = found
    got = [tuple(r) for r in vectors.neighbours(index, df.dropDuplicates(["id"]), "id", "v", 0.5, 4, itself=False, where=F.col("even")).collect()]
    one = {k: v for k, v in rows}
    want = []
    for k, v in one.items():
        if k is None or v is None or len(v) != 8 or unit(v) is None:
            continue
        near = sorted((gap(unit(v), unit(w)), o) for o, w in rows if o is not None and o % 2 == 0 and o != k and w is not None and len(w) == 8 and unit(w) is not None and gap(unit(v), unit(w)) <= 0.5)
        want += [(k, o, d) for d, o in near[:4]]
    same(got, want)


def test_one_question_reads_few_rings(found):
    rows, _, index = found
    probe = [float(x) for x in rows[0][1]]
    hits, read = vectors.near(index, probe, 0.05)
    want = [(k, gap(unit(probe), unit(v))) for k, v in rows if k is not None and v is not None and len(v) == 8 and unit(v) is not None and gap(unit(probe), unit(v)) <= 0.05]
    assert sorted(tuple(r) for r in hits.collect()) == sorted(want) and 0 < read < len(index.rings) / 2
    assert vectors.near(index, [0.0] * 8, 1.0)[1] == 0 and vectors.near(index, probe, 0.05, 3)[0].count() == 3
    assert "PushedFilters: [In(cell" in hits._jdf.queryExecution().toString() or "IsNotNull(cell)" in hits._jdf.queryExecution().toString()


def test_empty_index(spark):
    df = spark.createDataFrame([], "id long, v array<double>")
    index = vectors.build(df, "id", "v")
    some = spark.createDataFrame([(1, [1.0, 2.0])], "id long, v array<double>")
    assert vectors.neighbours(index, some, "id", "v", 1.0).count() == 0 and vectors.near(index, [1.0, 2.0], 1.0)[0].count() == 0
    assert vectors.neighbours(vectors.build(some, "id", "v"), df, "id", "v", 1.0).count() == 0


def test_no_cartesian_product(spark, sf):
    f = Q._faces(spark, sf)
    protos = spark.createDataFrame([(1, [1.0] * 64)], "person long, middle array<double>")
    for df in (identity.assigned(f, protos, f.where("1 = 0").select("face", "person")), picks.prototype_neighbours(f, "face", "vector", protos, "person", "middle", 1.0, 2)):
        plan = df._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def walk(faces, near, join, merge):
    """Groups of (face, vector) by the rules, one face after the other, with nothing but lists."""
    group, opened = {}, []
    x = {f: np.array(v, float) for f, v in faces}
    d = lambda a, b: round(1 - float(a @ b) / math.sqrt(float(a @ a) * float(b @ b)), 6)
    middle = lambda g: np.mean([x[f] for f in group if group[f] == g], axis=0)
    for f in sorted(x):
        around = sorted((gap(unit(x[f]), unit(x[o])), o) for o in x if o != f and gap(unit(x[f]), unit(x[o])) <= near)[:10]
        if not around:
            continue
        loose = [o for _, o in around if o not in group]
        ids = sorted({group[o] for _, o in around if o in group})
        fit = [(d(x[f], middle(g)), g) for g in ids if d(x[f], middle(g)) <= join]
        group[f] = min(fit)[1] if fit else group.get(f, f)
        own = group[f]
        for g in ids:
            if g != own and g in group.values() and d(middle(own), middle(g)) <= merge:
                for o in group:
                    if group[o] == g:
                        group[o] = own
        for o in loose:
            group[o] = own
    return {f: min(o for o in group if group[o] == g) for f, g in group.items()}


def people(seed, n=150, dims=6):
    rng = random.Random(seed)
    centers = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(7)]
    faces = []
    for i in range(n):
        a, b = rng.sample(centers, 2)
        t = rng.choice([0, 0, 0, 0.3, 0.5])  # some lie between two
        faces.append((i * 3, [(1 - t) * p + t * q + rng.gauss(0, 0.45) for p, q in zip(a, b, strict=True)]))
    return faces


@pytest.mark.parametrize("seed,batch,n", [(1, 50_000, 150), (2, 30, 120)])
def test_unknown_faces_group_as_one_by_one(spark, seed, batch, n):
    faces = people(seed, n)
    rows = [(f, v, 100, 0.9, None) for f, v in faces] + [(1000, faces[0][1], 10, 0.9, None), (1001, faces[0][1], 100, 0.9, 5), (1002, None, 100, 0.9, None), (1003, [0.0] * 6, 100, 0.9, None)]
    df = spark.createDataFrame([*rows, rows[0]], "face long, vector array<double>, pixels int, score double, person long")
    got = {r["face"]: r["group_id"] for r in unknown.grouped(df, batch=batch).collect()}
    want = walk(faces, 0.50, 0.45, 0.35)
    assert got == want and 3 < len(set(want.values())) < len(want)


def test_a_face_between_two_groups_does_not_tie_them(spark):
    at = [[1.0, 0, 0], [0.97, 0.24, 0], [0, 0, 1.0], [0, 0.24, 0.97], [0.75, 0, 0.661]]
    df = spark.createDataFrame([(i, [float(x) for x in v], 100, 0.9, None) for i, v in enumerate(at)], "face long, vector array<double>, pixels int, score double, person long")
    assert {r["face"]: r["group_id"] for r in unknown.grouped(df).collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 0}
    assert unknown.grouped(df.limit(0)).count() == 0
    assert [tuple(r) for r in unknown.summary(unknown.grouped(df), df).collect()] == [(2, 5, 3, 0)]


def test_ranks(spark):
    rows = [(i % 3 if i < 200 else 9, i * i % 977) for i in range(400)]
    got = unknown.ranks(spark.createDataFrame(rows, "g int, o long").distinct(), "g", "o", 8).collect()
    want = {(g, o): i for g in {r[0] for r in rows} for i, o in enumerate(sorted({o for h, o in rows if h == g}))}
    assert {(r["g"], r["o"]): r["rank"] for r in got} == want


def test_reassess(spark, sf):
    f = Q._looks(spark, sf)
    before = {r["face"]: r for r in f.collect()}
    got = {r["face"]: r for r in Q.reassess_faces(spark, sf).collect()}
    said = {r["face"]: r for r in Q.name_faces(spark, sf).collect()}
    assert set(got) == set(before)
    for face, r in got.items():
        if before[face]["assigned_by"] == "user":
            assert (r["person"], r["assigned_by"], r["group_id"]) == (before[face]["person"], "user", None)
        elif face in said and said[face]["outcome"] != "suggested":
            assert (r["person"], r["assigned_by"], r["trusted"], r["group_id"]) == (said[face]["person"], "auto", said[face]["outcome"] == "trusted", None)
        else:
            assert r["person"] is None and r["suggested"] == (said[face]["person"] if face in said else None)
    left = [(k, before[k]["vector"]) for k, r in got.items() if r["person"] is None and before[k]["pixels"] >= 80 and before[k]["score"] >= 0.75]
    assert {k: r["group_id"] for k, r in got.items() if r["group_id"] is not None} == walk(left, 0.50, 0.45, 0.35)


def led(near, order, least, wanted, attempts):
    """Motifs one leader after the other."""
    taken, out, tried = set(), [], 0
    for leader in order:
        if len(out) >= wanted or tried >= attempts:
            break
        if leader in taken:
            continue
        tried += 1
        group = [m for m in near[leader] if m not in taken]
        if len(group) >= least:
            taken.update(group)
            out.append((leader, group))
    return out


@pytest.mark.parametrize("seed,wanted,attempts", [("a", 5, 400), ("b", 100, 9)])
def test_motifs_equal_the_loop(spark, seed, wanted, attempts):
    rows = [(k, v) for k, v in awkward(400, seed=4) if k is not None and v is not None and len(v) == 8 and unit(v) is not None]
    one = dict(rows)
    near = {k: [o for d, o in sorted((gap(unit(v), unit(w)), o) for o, w in one.items() if gap(unit(v), unit(w)) <= 0.1)[:30]] for k, v in one.items()}
    order = sorted(one, key=lambda k: hashlib.md5(f"{k}{seed}".encode()).hexdigest())
    want = led(near, order, 5, wanted, attempts)
    df = spark.createDataFrame(list(one.items()), "id long, v array<double>")
    got = motifs.motifs(df, "id", "v", wanted, attempts, seed, alike=0.1, least=5, asked=30).collect()
    assert sorted((r["leader"], r["number"], r["member"]) for r in got) == sorted((k, i + 1, m) for i, (k, g) in enumerate(want) for m in g) and want


@pytest.mark.parametrize("seed", range(4))
def test_rounds_settle_as_the_loop(spark, seed):
    rng = random.Random(seed)
    near = {k: sorted({k, *(rng.randrange(60) for _ in range(rng.randrange(9)))}) for k in range(60)}
    won, all_ = motifs.settled(spark.createDataFrame([(k, k, m) for k, g in near.items() for m in g], "leader long, first long, member long"), 4)
    want = led(near, range(60), 4, 99, 99)
    assert sorted((r["leader"], r["member"]) for r in won.collect()) == sorted((k, m) for k, g in want for m in g)
    by = {m: k for k, g in want for m in g}
    assert {r["leader"] for r in all_.where("tried").collect()} == {k for k in near if k not in by or by[k] >= k}


def test_motif_tags(spark):
    g = spark.createDataFrame([(1, m) for m in (1, 2, 3, 4)] + [(9, 9)], "leader long, member long")
    tags = spark.createDataFrame([(1, "sea"), (1, "sea"), (2, "sea"), (3, "sky"), (9, "sky"), (5, "sky"), (4, None), (None, "sea"), (1, "sky")], "key long, tag string")
    got = [tuple(r) for r in motifs.tags_of(g, tags).collect()]
    assert sorted(got) == [(1, "sea", 2, round(0.5 * math.log(5 / 2), 6), 1), (1, "sky", 2, round(0.5 * math.log(5 / 4), 6), 2), (9, "sky", 1, round(math.log(5 / 4), 6), 1)]


def test_motifs_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, [0.0, 0.0])], "id long, v array<double>")
    assert motifs.motifs(df, "id", "v", 3).count() == 0
    assert groups.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_question_is_sent_once_to_each_share(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(3000)] + [(3000 + i, [1.0] * 8) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    index = vectors.build(df, "id", "v")
    first, pieces, shares = index.dealt()
    assert len(index.rings) > 100 and shares <= 10 and pieces.max() == 2 and first.max() + 1 == shares
    asks = vectors.neighbours(index, df, "id", "v", 2.0, 3)
    got = {}
    for r in asks.collect():
        got.setdefault(r["question"], []).append((r["distance"], r["found"]))
    some = [rows[i] for i in (0, 77, 2999, 3000, 3699)]
    units = {k: unit(v) for k, v in rows}
    for k, _ in some:
        want = sorted((gap(units[k], u), o) for o, u in units.items())[:3]
        assert [x[1] for x in sorted(got[k])] == [x[1] for x in want] and all(abs(a[0] - b[0]) < 2e-6 for a, b in zip(sorted(got[k]), want, strict=True))
