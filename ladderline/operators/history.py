"""Append-only values, the calendar and three-state cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_GAP = 8


def value_history(values: DataFrame) -> DataFrame:
    """Each value with when the next one took its place (WIN5); ties by id."""
    w = Window.partitionBy("entity_id", "field").orderBy("created_at", "value_id")
    return values.withColumn("superseded_at", F.lead("created_at").over(w)).withColumn("superseded_by", F.lead("value_id").over(w))


def current_values(values: DataFrame) -> DataFrame:
    """The values that nothing has taken the place of (PRJ2, T22)."""
    return value_history(values).filter("superseded_by is null").drop("superseded_at", "superseded_by")


def shown(text, number, is_zero):
    """What a cell shows: its text, 0 for a genuine zero, else its number (FLT6)."""
    return F.coalesce(text, F.when(is_zero, F.lit("0")).otherwise(number.cast("string")))


def fill_calendar(dates: DataFrame, by: str, max_gap: int = MAX_GAP) -> DataFrame:
    """Weekly dates missing in gaps of over max_gap days (WIN6, T14). dates: (by, meeting_date); repeated ones are gaps of 0 days.

    The last date filled is over three days before the next one held, so none of them is held already.
    """
    w = Window.partitionBy(by).orderBy("meeting_date")
    gaps = dates.withColumn("next", F.lead("meeting_date").over(w)).withColumn("gap", F.datediff("next", "meeting_date"))
    gaps = gaps.withColumn("upper", (F.bround(F.col("gap") / 7, 0) - 1).cast("int")).filter((F.col("gap") > max_gap) & (F.col("upper") >= 1))
    rows = gaps.select(by, "meeting_date", F.explode(F.sequence(F.lit(1), "upper")).alias("k"))
    return rows.select(by, F.expr("date_add(meeting_date, 7 * k)").alias("meeting_date"))


def calendar_index(obs: DataFrame) -> DataFrame:
    """Every date with its first page and its place in the calendar (WIN8, AGG18, T20). One row a date: a bounded table."""
    dates = obs.groupBy("meeting_date").agg(F.min("slide_page").alias("first_page"))
    return dates.withColumn("place", F.row_number().over(Window.orderBy("meeting_date")) - 1)


def cell_state(value, is_zero, gap_state):
    """Value first, then the gap's state (T25, MAP2)."""
    return F.when(is_zero, "zero").when(value.isNotNull(), "known").otherwise(F.coalesce(gap_state, F.lit("untracked")))
