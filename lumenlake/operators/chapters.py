"""Chapters, rituals, memories and shares drawn from a library's times and traits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlake.operators.timeline import sessions


def trips(rows: DataFrame, by: str, time: str, gap_seconds: int, least: int, least_days: int) -> DataFrame:
    """by, start_at, end_at, n: islands of at least `least` rows that begin and end at least least_days - 1 days apart."""
    found = sessions(rows, by, time, gap_seconds)
    days = F.datediff(F.col("end_at").cast("date"), F.col("start_at").cast("date")) + 1
    return found.where((F.col("n") >= least) & (days >= least_days))


def full_days(rows: DataFrame, by: str, time: str, least: int, spans: DataFrame | None = None) -> DataFrame:
    """by, day, n: days of at least `least` rows, those inside an owner's spans (by, start_at, end_at) left out."""
    days = rows.groupBy(by, F.col(time).cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    if spans is None:
        return days
    covered = spans.select(by, F.explode(F.sequence(F.col("start_at").cast("date"), F.col("end_at").cast("date"))).alias("day")).distinct()
    return days.join(covered, [by, "day"], "left_anti")


def place_chapters(rows: DataFrame, place: str, time: str, least: int, least_days: int) -> DataFrame:
    """place, n, days, first_year, last_year of the places with enough rows on enough days."""
    found = rows.groupBy(place).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.col(time).cast("date")).alias("days"), F.year(F.min(time)).alias("first_year"), F.year(F.max(time)).alias("last_year"))
    return found.where((F.col("n") >= least) & (F.col("days") >= least_days))


def rituals(rows: DataFrame, time: str, dates: dict[str, Sequence[tuple[int, int]]], least: int, least_years: int) -> DataFrame:
    """ritual, n, years: named sets of (month, day) with enough rows in enough years."""
    name = F.lit(None).cast("string")
    for ritual, days in dates.items():
        on = F.lit(False)
        for month, day in days:
            on = on | ((F.month(time) == month) & (F.day(time) == day))
        name = F.when(on, F.lit(ritual)).otherwise(name)
    found = rows.select(name.alias("ritual"), F.year(time).alias("y")).where("ritual is not null").groupBy("ritual").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("y").alias("years"))
    return found.where((F.col("n") >= least) & (F.col("years") >= least_years))


def person_years(rows: DataFrame, person: str, time: str, least: int, persons: int, years: int) -> DataFrame:
    """person, year, n: the fullest years of the fullest persons, at most `years` each."""
    each = rows.groupBy(person, F.year(time).alias("year")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    few = each.withColumn("_r", F.row_number().over(W.partitionBy(person).orderBy(F.desc("n"), "year"))).where(F.col("_r") <= years).drop("_r")
    top = few.groupBy(person).agg(F.max("n").alias("_best")).orderBy(F.desc("_best"), person).limit(persons).select(person)
    return few.join(top, person)


def themes(rows: DataFrame, key: str, text: str, lists: dict[str, Sequence[str]], least: int) -> DataFrame:
    """theme, n: rows that hold a word of a theme's list, for themes with at least `least` rows; one scan."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z0-9]+"), F.lit(0))
    hit = F.filter(F.array(*(F.when(F.arrays_overlap(words, F.array(*map(F.lit, w))), F.lit(t)) for t, w in lists.items())), lambda t: t.isNotNull())
    return rows.select(key, F.explode(hit).alias("theme")).groupBy("theme").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def dealt(rows: DataFrame, by: Sequence[Column | str], order: Sequence[Column | str], most: int) -> DataFrame:
    """The first `most` rows of each share, with their turn: taking turns 1, 2, ... is a round robin over the shares."""
    turn = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return rows.withColumn("turn", turn).where(F.col("turn") <= most)


def memories(rows: DataFrame, key: str, time: str, score: str, month: int, day: int, before: int, most: int) -> DataFrame:
    """year, key, rank: the best rows of this calendar day in each earlier year."""
    on = rows.where((F.month(time) == month) & (F.day(time) == day) & (F.year(time) < before)).select(F.year(time).alias("year"), key, score)
    rank = F.row_number().over(W.partitionBy("year").orderBy(F.desc(score), key))
    return on.withColumn("rank", rank).where(F.col("rank") <= most).select("year", key, "rank")
