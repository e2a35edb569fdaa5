"""Views over the observation log: effective rows, funnel, discussion, dwell, transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RUNGS = {4: "prelim", 5: "deep", 6: "negotiate", 7: "legal"}


def effective(obs: DataFrame, overrides: DataFrame) -> DataFrame:
    """Overrides shadow the evidence: one pivot and one join (PRJ1, CND1). A value that is no number changes nothing."""
    new = overrides.groupBy("observation_id").agg(*(F.max(F.when(F.col("field") == f, F.col("new_value"))).alias(f"_{f}") for f in ("stage_id", "is_bold")))
    out = obs.join(new, "observation_id", "left")
    for f in ("stage_id", "is_bold"):
        out = out.withColumn(f, F.coalesce(F.col(f"_{f}").try_cast("int"), F.col(f))).drop(f"_{f}")
    return out


def resolved(entities: DataFrame) -> DataFrame:
    """One hop of the soft-merge pointer (PRJ3)."""
    return entities.withColumn("resolved_id", F.coalesce("merged_into", "entity_id"))


def live(entities: DataFrame, phantoms: bool = True) -> DataFrame:
    """Entities that are not merged away, with or without phantoms (FLT1, AGG13)."""
    out = entities.filter("merged_into is null")
    return out if phantoms else out.filter("not is_phantom")


def entity_funnel(obs: DataFrame) -> DataFrame:
    """Per entity: appearances, dates, furthest stage, observed and reached flags, first date at each rung (AGG1)."""
    at = lambda k: F.max(F.when(F.col("stage_id") == k, 1).otherwise(0)).cast("long").alias(f"observed_{RUNGS[k]}")
    past = lambda k: F.max(F.when(F.col("stage_id") >= k, 1).otherwise(0)).cast("long").alias(f"reached_{RUNGS[k]}")
    first = lambda k: F.min(F.when(F.col("stage_id") >= k, F.col("meeting_date"))).cast("string").alias(f"first_{RUNGS[k]}")
    return obs.groupBy("entity_id").agg(F.count("*").alias("appearances"), F.min("meeting_date").cast("string").alias("first_seen"), F.max("meeting_date").cast("string").alias("last_seen"), F.max("stage_id").cast("long").alias("furthest"), F.sum("is_bold").alias("bold"), *(f(k) for f in (at, past, first) for k in RUNGS))


def entity_discussion(obs: DataFrame) -> DataFrame:
    """Per entity: discussed, how often, and when (AGG2)."""
    when = F.when(F.col("is_bold") == 1, F.col("meeting_date"))
    return obs.groupBy("entity_id").agg(F.max("is_bold").cast("long").alias("discussed"), F.sum("is_bold").alias("times"), F.min(when).cast("string").alias("first_discussed"), F.max(when).cast("string").alias("last_discussed"))


def dwell(obs: DataFrame) -> DataFrame:
    """Rows of an entity at a stage (AGG3)."""
    return obs.groupBy("entity_id", "stage_id").agg(F.count("*").alias("meetings"))


def transitions(obs: DataFrame) -> DataFrame:
    """Changes of stage in order of date and id (WIN1)."""
    w = Window.partitionBy("entity_id").orderBy("meeting_date", "observation_id")
    prev = obs.withColumn("from_stage", F.lag("stage_id").over(w)).withColumn("from_date", F.lag("meeting_date").over(w))
    return prev.filter("from_stage is not null and from_stage <> stage_id").withColumn("delta", F.col("stage_id") - F.col("from_stage"))


def jumps(changes: DataFrame) -> DataFrame:
    """Changes that ask for a review (DET6, VAL7)."""
    return changes.filter("delta > 2 or delta < 0").withColumn("kind", F.when(F.col("delta") > 0, "stage_jump").otherwise("stage_regression"))


def per_date(obs: DataFrame) -> DataFrame:
    """The highest stage of an entity on a date (ARR2)."""
    return obs.groupBy("entity_id", "meeting_date").agg(F.max("stage_id").alias("stage_id"))


def date_transitions(obs: DataFrame) -> DataFrame:
    """Changes between consecutive dates of the collapsed series (WIN3)."""
    w = Window.partitionBy("entity_id").orderBy("meeting_date")
    prev = per_date(obs).withColumn("from_stage", F.lag("stage_id").over(w)).withColumn("from_date", F.lag("meeting_date").over(w))
    return prev.filter("from_stage is not null").withColumn("delta", F.col("stage_id") - F.col("from_stage"))


def latest(obs: DataFrame) -> DataFrame:
    """The last row of each entity (WIN2)."""
    w = Window.partitionBy("entity_id").orderBy(F.desc("meeting_date"), F.desc("observation_id"))
    return obs.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def trailing_run(series: DataFrame) -> DataFrame:
    """Since when each entity has stood at its last stage (WIN4): the first date after the last other stage."""
    last = series.groupBy("entity_id").agg(F.max(F.struct("meeting_date", "stage_id")).alias("l"), F.count("*").alias("n")).selectExpr("entity_id", "l.meeting_date last_date", "l.stage_id last_stage")
    both = series.join(last, "entity_id")
    other = both.groupBy("entity_id").agg(F.max(F.when(F.col("stage_id") != F.col("last_stage"), F.col("meeting_date"))).alias("other"))
    return both.join(other, "entity_id").filter("other is null or meeting_date > other").groupBy("entity_id", "last_stage", "last_date").agg(F.min("meeting_date").alias("since"))
