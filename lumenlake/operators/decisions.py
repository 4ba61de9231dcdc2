"""What people decide about faces, as tables of decisions applied to tables of faces and persons.

faces: face, person, assigned_by ('user', 'auto' or null), trusted, suggested, distance, cluster. Decisions about faces that do
not exist, with a null face, or that the face no longer asks for change nothing. Each function returns new tables; columns not
named stay. Repeated decisions count once; where two contradict, what each function states comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.operators.groups import written


def _set(faces: DataFrame, when: Column, person: Column, by: str | None) -> DataFrame:
    """Faces where a condition holds with a person given by someone, and no open question or group; trusted goes with a no."""
    new = {"person": person, "assigned_by": F.lit(by).cast("string"), "suggested": F.lit(None), "distance": F.lit(None), "cluster": F.lit(None)}
    if by is None:
        new["trusted"] = F.lit(False)
    kinds = dict(faces.dtypes)
    return faces.withColumns({c: F.when(when, v.cast(kinds[c])).otherwise(F.col(c)) for c, v in new.items() if c in kinds})


def assigned(faces: DataFrame, rejected: DataFrame, says: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(faces, rejected) after says (face, person): the face is that person now, and a rejection of the pair is gone. Of several
    persons for a face the smallest counts."""
    said = says.where("face is not null and person is not null").groupBy("face").agg(F.min("person").alias("_p"))
    after = _set(faces.join(said, "face", "left"), F.col("_p").isNotNull(), F.col("_p"), "user").drop("_p")
    real = said.join(faces.select("face").distinct(), "face", "left_semi").select("face", F.col("_p").alias("person"))
    return after, rejected.join(real, ["face", "person"], "left_anti")


def group_named(faces: DataFrame, cluster: int, person: int) -> DataFrame:
    """Everybody of a group without a person is that person now."""
    return _set(faces, F.coalesce((F.col("cluster") == cluster) & F.col("person").isNull(), F.lit(False)), F.lit(person), "user")


def refused(faces: DataFrame, rejected: DataFrame, no: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(faces, rejected) after a no to faces: the person it had, else the one it asked about, is ruled out for it, and it has none."""
    said = no.where("face is not null").select("face").distinct()
    wrong = faces.join(said, "face", "left_semi").select("face", F.coalesce("person", "suggested").alias("person")).where("person is not null")
    after = _set(faces.join(said.withColumn("_no", F.lit(True)), "face", "left"), F.coalesce("_no", F.lit(False)), F.lit(None), None).drop("_no")
    return after, rejected.select("face", "person").union(wrong.select("face", "person")).distinct()


def answered(faces: DataFrame, rejected: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(faces, rejected) after answers (face, person, yes) to open questions: only faces without a person that ask about just that
    one. A no comes before a yes to the same face."""
    open_ = faces.where("person is null and suggested is not null").select("face", F.col("suggested").alias("person")).distinct()
    each = written(answers.join(open_, ["face", "person"]).groupBy("face", "person").agg(F.min(F.coalesce("yes", F.lit(False))).alias("yes")))
    faces, rejected = assigned(faces, rejected, each.where("yes"))
    return refused(faces, rejected, each.where("not yes"))


def confirmed(faces: DataFrame, says: DataFrame) -> DataFrame:
    """Faces that were given their person by the machine and are now stood by; others are left as they are."""
    said = says.where("face is not null").select("face").distinct().withColumn("_yes", F.lit(True))
    sure = F.coalesce(F.col("_yes") & (F.col("assigned_by") == "auto") & F.col("person").isNotNull(), F.lit(False))
    return _set(faces.join(said, "face", "left"), sure, F.col("person"), "user").drop("_yes")


def merged(faces: DataFrame, people: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(faces, people) after persons became others (source, target): faces and open questions follow, also along several steps, and
    the sources are gone. Of several targets the smallest counts; a person that would become itself, a ring and a target that is
    nobody raise an error before anything is changed. pairs has a row a decision."""
    to = written(pairs.where("source is not null and target is not null and source <> target").groupBy("source").agg(F.min("target").alias("target")))
    steps = to.count()
    lost = to.join(people.select(F.col("person").alias("target")), "target", "left_anti")
    if not lost.isEmpty():
        raise ValueError("a target is nobody")
    while True:  # each round doubles the steps that are followed
        nxt = to.select(F.col("source").alias("target"), F.col("target").alias("_next"))
        if not to.where("source = target").isEmpty() or steps < 0:
            raise ValueError("persons would become one another in a ring")
        if to.join(nxt, "target", "left_semi").isEmpty():
            break
        to = written(to.join(nxt, "target", "left").select("source", F.coalesce("_next", "target").alias("target")))
        steps = steps // 2 if steps else -1
    move = lambda df, c: df.join(to.select(F.col("source").alias(c), F.col("target").alias("_to")), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
    return move(move(faces, "person"), "suggested").select(faces.columns), people.join(to.select(F.col("source").alias("person")), "person", "left_anti")


def renamed(people: DataFrame, person: int, name: str) -> DataFrame:
    """A person with another name (blanks put in order); an error for an empty one and for one that somebody else has in any case."""
    name = " ".join(name.split())
    if not name or not people.where((F.lower("name") == name.lower()) & (F.col("person") != person)).isEmpty():
        raise ValueError("no name, or that of somebody else: merge the two instead")
    return people.withColumn("name", F.when(F.col("person") == person, name).otherwise(F.col("name")))
