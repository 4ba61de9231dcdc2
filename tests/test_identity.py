"""Faces against plain Python."""

import numpy as np

from lumenlake.operators import identity
from lumenlake.operators import identity_queries as Q


def _unit(v):
    v = np.asarray(v, float)
    return v / np.sqrt(v @ v)


def test_once_each(spark, sf):
    want = set()
    groups = {}
    for r in Q._faces(spark, sf).collect():
        groups.setdefault(r["face"] // 20, []).append(r)
    for medium, rows in groups.items():
        kept = []
        for r in sorted(rows, key=lambda r: (-r["pixels"] * r["score"], r["face"])):
            if all(_unit(k["vector"]) @ _unit(r["vector"]) < 0.1 for k in kept):
                kept.append(r)
        want |= {(medium, r["face"]) for r in kept}
    assert {tuple(r) for r in Q.faces_once(spark, sf).collect()} == want and len(want) < sum(map(len, groups.values()))


def test_middles(spark, sf):
    rows = identity.vouching(Q._faces(spark, sf)).collect()
    got = {}
    for r in Q.person_middles(spark, sf).collect():
        got.setdefault(r["person"], {})[r["number"]] = np.array(r["middle"])
    assert set(got) == {r["person"] for r in rows}
    for person, middles in got.items():
        x = np.stack([_unit(r["vector"]) for r in sorted(rows, key=lambda r: r["face"]) if r["person"] == person])
        assert len(middles) == min(5, max(1, len(x) // 8))
        c = np.stack([middles[i] for i in sorted(middles)])
        assert np.allclose((c * c).sum(1), 1)
        if len(c) == 1:
            assert np.allclose(c[0], _unit(x.sum(0)))


def test_edges(spark):
    schema = "face long, medium long, vector array<float>, pixels long, score double, person long, assigned_by string, trusted boolean, suggested long, distance double"
    rows = spark.createDataFrame([(1, 1, None, None, None, None, None, None, None, None), (2, 1, [0.0, 0.0], 90, 0.9, 7, "user", None, None, None), (3, 1, [1.0, 0.0], 90, 0.9, None, None, None, 7, 0.1), (4, None, [1.0, 0.0], 90, 0.9, 7, None, True, None, None)], schema)
    assert {r["face"] for r in identity.vouching(rows).collect()} == {2, 4}
    assert {r["face"]: r["suggested"] for r in identity.collapsed(rows).collect()} == {1: None, 2: None, 3: None, 4: None}  # answered by face 2
    middle = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.9, 0.1])], "person long, middle array<double>")
    got = identity.assigned(rows, middle, rows.where("false").select("face", "person")).collect()
    assert [(r["face"], r["person"], r["outcome"]) for r in got] == [(3, 8, "trusted")]  # 7 is already in the medium
    empty = rows.limit(0)
    for df in (identity.once_each(empty, "medium"), identity.middles(empty, "person"), identity.collapsed(empty), identity.twice(empty)):
        assert df.count() == 0
