"""What a query means, and the edge cases of files and words."""

from datetime import datetime

from pyspark.sql import functions as F

from lumenlake.operators import files, fulltext


def test_understood(spark):
    people = spark.createDataFrame([("Anna Maria",), ("Anna",), ("Rom",), (None,)], "name string")
    said = fulltext.understood("Fotos Anna Maria und Anna Sommer 2019 Strand mit", people)
    assert (said.kind, said.names, said.since, said.until, said.rest) == ("image", ["anna maria", "anna"], "2019-06-01", "2019-09-01", "Strand")
    assert (fulltext.understood("Dezember 2020").since, fulltext.understood("Dezember 2020").until) == ("2020-12-01", "2021-01-01")
    assert (fulltext.understood("2018-2020 hund").since, fulltext.understood("2018-2020 hund").until) == ("2018-01-01", "2021-01-01")
    assert fulltext.understood("").rest == ""


def test_matches(spark):
    rows = spark.createDataFrame([(1, "red red rose"), (2, "a red-hot day"), (3, "blue"), (4, None), (5, ""), (6, "rose red")], "k long, text string")
    ask = lambda q: sorted(r[0] for r in rows.where(fulltext.matches(F.col("text"), q)[0]).collect())
    assert ask("red rose") == [1, 6] and ask('"red rose"') == [1] and ask("red -rose") == [2] and ask("blue OR hot") == [2, 3]
    assert ask("") == ask("OR") == ask('""') == [] and ask("-red") == [3, 5]
    assert rows.select(fulltext.matches(F.col("text"), "red")[1].alias("n")).collect()[0]["n"] == 2
    assert fulltext.found_in([(1.0, rows.limit(0).select(F.col("k").alias("key"), F.lit(None).alias("moment"), "text"))], "red").count() == 0


def test_names_and_dates(spark):
    want = {"IMG_20120814_153012.jpg": datetime(2012, 8, 14, 15, 30, 12), "2009-07 Italien": datetime(2009, 7, 1), "Sommer 2009": datetime(2009, 1, 1), "x": None, "20110231": None, "120093": None, "PXL_20230101235959999.mp4": datetime(2023, 1, 1, 23, 59, 59), "a2012.08.14t24:00:00": datetime(2012, 8, 14), "x12012-07-1": datetime(2012, 7, 1), "1969 2050": None, "12011 2012": datetime(2012, 1, 1), None: None}
    got = spark.createDataFrame([(k,) for k in want], "n string").select("n", files.date_in(F.col("n")).alias("d")).collect()
    assert {r["n"]: r["d"] for r in got} == want
    paths = {"2001/Juli 2002/x": datetime(2002, 1, 1), "2001-05/Rom/20110231": datetime(2001, 5, 1), "a/b": None, "": None, None: None}
    assert {r[0]: r[1] for r in spark.createDataFrame([(k,) for k in paths], "p string").select("p", files.date_in_folders(F.col("p"))).collect()} == paths
    rows = [("2012:08:14 15:30:12", None, None, "IMG_20100101.jpg", "2009/x.jpg", None), (None, "2011:01:01 00:00:00", None, "n", "x", None), ("0000:00:00 00:00:00", None, "2010:02:03 04:05:06", "20090101", "x", None), (None, None, None, "IMG_20090102.jpg", "2001/y", datetime(2024, 1, 1)), (None, None, None, "2009.jpg", "2001-03/y/2009.jpg", datetime(2024, 1, 1)), (None, None, None, "2009.jpg", "2009.jpg", datetime(2024, 1, 1)), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "a string, b string, gps string, name string, path string, m timestamp")
    got = [tuple(r[0]) for r in df.select(files.captured([F.col("a"), F.col("b")], F.col("gps"), F.col("name"), F.col("path"), F.col("m"))).collect()]
    assert got == [(datetime(2012, 8, 14, 15, 30, 12), "exif"), (datetime(2011, 1, 1), "exif"), (datetime(2010, 2, 3, 4, 5, 6), "gps"), (datetime(2009, 1, 2), "filename"), (datetime(2001, 3, 1), "folder_name"), (datetime(2024, 1, 1), "file_mtime"), (None, None)]
    exif = spark.createDataFrame([("2012:08:14 15:30:12",), ("2012:08:14 15:30:12.25+02:00",), ("0000:00:00 00:00:00",), ("junk",), (None,)], "t string")
    assert [r[0] for r in exif.select(files.exif_time(F.col("t"))).collect()] == [datetime(2012, 8, 14, 15, 30, 12), datetime(2012, 8, 14, 13, 30, 12, 250000), None, None, None]


def test_groups_of_files(spark):
    rows = spark.createDataFrame([("f", n, 1, 1) for n in ("a.HEIC", "a.mov", "a.dng", "b.jpg", "b.mov", "b.png", "c.cr2", "c.dng", "d.mp4", "e.txt", None)], "folder string, name string, size int, mtime int")
    got = {r["name"]: (r["medium"], r["role"], r["medium_kind"]) for r in files.grouped(rows).collect()}
    assert got == {
        "a.HEIC": ("a.HEIC", "primary", "image"), "a.mov": ("a.HEIC", "motion", "image"), "a.dng": ("a.HEIC", "raw", "image"), "b.jpg": ("b.jpg", "primary", "image"), "b.mov": ("b.mov", "primary", "video"),
        "b.png": ("b.png", "primary", "image"), "c.cr2": ("c.cr2", "primary", "image"), "c.dng": ("c.cr2", "raw", "image"), "d.mp4": ("d.mp4", "primary", "video"),
    }
    assert files.grouped(rows.limit(0)).count() == 0 and files.signatures(rows.limit(0)).count() == 0
