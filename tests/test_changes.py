"""Folders, versions of tables and decisions about faces."""

import os

import pytest
from pyspark.sql import functions as F

from lumenlake.operators import decisions, refresh
from lumenlake.operators.groups import shared_path
from lumenlake.sources import folders


def tree(root):
    for path, data in {
        "a.jpg": "x", "b.TXT": "x", "empty.png": "", ".hidden.jpg": "x", "2020/c.MP4": "xyz", "2020/d.jpg": "x", "2020/trip/e.heic": "x", "@eaDir/f.jpg": "x", "off/g.jpg": "x", "off/deep/h.jpg": "x", ".git/i.jpg": "x", "none/readme": "x", "2020/üß/j.jpg": "x",
    }.items():
        os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
        with open(f"{root}/{path}", "w") as f:
            f.write(data)
    os.symlink(f"{root}/a.jpg", f"{root}/link.jpg")
    os.symlink(str(root), f"{root}/2020/loop")


@pytest.mark.parametrize("parts", [1, 3, 64])
def test_folders(spark, tmp_path, parts):
    root = tmp_path / "media"
    tree(root)
    spark.dataSource.register(folders.FolderSource)
    load = lambda **o: spark.read.format("folders").options(path=str(root), ignored="@EADIR", excluded="off", parts=parts, **o).load()
    df = load()
    rows = df.collect()
    heads = {r["folder"]: r for r in rows if r["file"] is None}
    assert {f: (r["name"], r["parent"], r["files"], r["readable"]) for f, r in heads.items()} == {"": ("media", None, 1, True), "2020": ("2020", "", 2, True), "2020/trip": ("trip", "2020", 1, True), "2020/üß": ("üß", "2020", 1, True), "none": ("none", "", 0, True)}
    assert sorted(r["path"] for r in rows if r["file"]) == ["2020/c.MP4", "2020/d.jpg", "2020/trip/e.heic", "2020/üß/j.jpg", "a.jpg"]
    c = next(r for r in rows if r["file"] == "c.MP4")
    assert (c["bytes"], c["folder"], c["signature"]) == (3, "2020", heads["2020"]["signature"]) and c["modified"].timestamp() == pytest.approx(os.stat(f"{root}/2020/c.MP4").st_mtime, abs=1e-5)
    assert [r["folder"] for r in load(base="2020", children="false").where("file is null").collect()] == ["2020"]
    os.utime(f"{root}/2020/d.jpg", (1, 1))
    after = {r["folder"]: r["signature"] for r in load().where("file is null").collect()}
    assert {f for f in after if after[f] != heads[f]["signature"]} == {"2020"}


def test_a_folder_that_cannot_be_read_proves_nothing(spark, tmp_path):
    spark.dataSource.register(folders.FolderSource)
    [r] = spark.read.format("folders").option("path", str(tmp_path / "gone")).load().collect()
    assert (r["folder"], r["readable"], r["signature"], r["files"], r["file"]) == ("", False, None, None, None)

    class Broken(folders.FolderReader):
        def listing(self, folder):
            return (None, []) if folder == "bad" else super().listing(folder)

    os.makedirs(tmp_path / "m" / "bad")
    reader = Broken({"path": str(tmp_path / "m")})
    got = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert {(r["folder"], r["readable"]) for r in got} == {("", True), ("bad", False)}


def test_versions_change_as_a_whole(spark):
    base = shared_path(spark)
    df = lambda *x: spark.createDataFrame([(i,) for i in x], "v long")
    rows = lambda t: sorted(r[0] for r in refresh.current(spark, base, t).collect())
    with pytest.raises(ValueError):
        refresh.current(spark, base, "a")
    assert refresh.unused(spark, base) == []
    refresh.refreshed(spark, base, {"a": df(1, 2), "b": df(9)})
    refresh.appended(spark, base, {"a": df(3), "c": df()})
    assert rows("a") == [1, 2, 3] and rows("b") == [9] and rows("c") == []
    broken = df(5).select(F.raise_error(F.lit("no")).cast("long").alias("v"))
    with pytest.raises(Exception, match="no"):
        refresh.refreshed(spark, base, {"b": df(8), "a": broken})
    assert rows("a") == [1, 2, 3] and rows("b") == [9]  # the run failed after it had written b aside
    held = refresh.current(spark, base, "a")
    refresh.refreshed(spark, base, {"a": held.where("v > 1"), "b": df(7)})
    assert rows("a") == [2, 3] and rows("b") == [7] and held.count() == 3
    assert [dict(r["rows"]) for r in refresh.versions(spark, base).orderBy("version").collect()] == [{"a": 2, "b": 1}, {"a": 1, "c": 0}, {"a": 2, "b": 1}]
    assert len(refresh.unused(spark, base, 1)) == 3 and refresh.unused(spark, base, 3) == []


FACES = "face long, person long, assigned_by string, trusted boolean, suggested long, distance double, cluster long, extra string"


def faces(spark):
    return spark.createDataFrame([(1, None, None, False, 7, 0.5, 3, "x"), (2, 7, "auto", True, None, None, None, "x"), (3, 8, "user", False, None, None, None, "x"), (4, None, None, False, None, None, 3, "x"), (5, None, None, None, 7, 0.6, None, "x")], FACES)


def state(df):
    return {r["face"]: (r["person"], r["assigned_by"], r["trusted"], r["suggested"], r["cluster"]) for r in df.collect()}


def test_decisions(spark):
    f, none = faces(spark), spark.createDataFrame([(1, 7), (9, 9)], "face long, person long")
    says = spark.createDataFrame([(1, 7), (1, 7), (4, 9), (4, 8), (77, 7), (None, 1), (5, None)], "face long, person long")
    after, rejected = decisions.assigned(f, none, says)
    assert state(after) == {**state(f), 1: (7, "user", False, None, None), 4: (8, "user", False, None, None)} and [tuple(r) for r in rejected.collect()] == [(9, 9)]
    assert after.columns == f.columns
    assert state(decisions.group_named(f, 3, 6)) == {**state(f), 1: (6, "user", False, None, None), 4: (6, "user", False, None, None)}
    after, rejected = decisions.refused(f, none, spark.createDataFrame([(2,), (2,), (5,), (4,), (None,)], "face long"))
    assert state(after) == {**state(f), 2: (None, None, False, None, None), 5: (None, None, False, None, None), 4: (None, None, False, None, None)}
    assert {tuple(r) for r in rejected.collect()} == {(1, 7), (9, 9), (2, 7), (5, 7)}
    answers = spark.createDataFrame([(1, 7, True), (5, 7, True), (5, 7, False), (2, 7, False), (4, 7, True), (1, 8, False), (5, 7, None)], "face long, person long, yes boolean")
    after, rejected = decisions.answered(f, none, answers)
    assert state(after) == {**state(f), 1: (7, "user", False, None, None), 5: (None, None, False, None, None)} and {tuple(r) for r in rejected.collect()} == {(9, 9), (5, 7)}
    assert state(decisions.confirmed(f, spark.createDataFrame([(1,), (2,), (3,)], "face long"))) == {**state(f), 2: (7, "user", True, None, None)}


def test_persons_become_one(spark):
    people = spark.createDataFrame([(i, f"P{i}") for i in range(1, 10)], "person long, name string")
    pairs = lambda *x: spark.createDataFrame(x, "source long, target long")
    after, left = decisions.merged(faces(spark), people, pairs((7, 6), (6, 5), (5, 4), (4, 3), (3, 2), (7, 9), (8, 8), (None, 1)))
    assert state(after) == {**state(faces(spark)), 1: (None, None, False, 2, 3), 2: (2, "auto", True, None, None), 5: (None, None, None, 2, None)}
    assert {r[0] for r in left.collect()} == {1, 2, 8, 9} and after.columns == faces(spark).columns
    for bad in (((1, 2), (2, 1)), ((1, 2), (2, 3), (3, 1)), ((1, 2), (2, 3), (3, 4), (4, 5), (5, 1), (6, 1)), ((1, 77),)):
        with pytest.raises(ValueError):
            decisions.merged(faces(spark), people, pairs(*bad))
    assert {r["name"] for r in decisions.renamed(people, 2, "  New  Name ").where("person = 2").collect()} == {"New Name"}
    for name in (" ", "p3"):
        with pytest.raises(ValueError):
            decisions.renamed(people, 2, name)
