"""Metrics with explicit denominators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import funnel as V


def funnel_totals(funnel: DataFrame) -> DataFrame:
    """Totals of the eight flags, 0 on no rows (AGG4)."""
    return funnel.agg(*(F.coalesce(F.sum(f"{k}_{r}"), F.lit(0)).alias(f"{k}_{r}") for k in ("observed", "reached") for r in V.RUNGS.values()))


def furthest_distribution(funnel: DataFrame, stages: DataFrame) -> DataFrame:
    """Entities by furthest stage; stages without any are absent (AGG6, JN2)."""
    return funnel.groupBy(F.col("furthest").alias("stage_id")).agg(F.count("*").alias("entities")).join(F.broadcast(stages), "stage_id").select(F.col("stage_id").cast("long").alias("stage_id"), "stage_name", "entities")


def current_and_reached(obs: DataFrame, stages: DataFrame) -> DataFrame:
    """Entities at a stage now, and that ever reached it (AGG23)."""
    now = V.latest(obs).groupBy("stage_id").agg(F.count("*").alias("current"))
    top = obs.groupBy("entity_id").agg(F.max("stage_id").alias("top")).groupBy("top").agg(F.count("*").alias("n"))
    # stages are seven rows: cumulative counts from the top
    ever = F.broadcast(stages).join(top, F.col("top") >= F.col("stage_id"), "left").groupBy("stage_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("reached"))
    return ever.join(now, "stage_id", "left").select(F.col("stage_id").cast("long").alias("stage_id"), F.coalesce("current", F.lit(0)).alias("current"), "reached")


def conversion(reached: DataFrame) -> DataFrame:
    """Each stage's share of the one before it (AGG22)."""
    w = Window.orderBy("stage_id")  # seven rows
    return reached.withColumn("before", F.lag("reached").over(w)).filter("before is not null").select("stage_id", "reached", "before", X.percent(F.col("reached"), F.col("before")).alias("pct"))


def dwell_medians(dwell: DataFrame, stages: DataFrame) -> DataFrame:
    """Median rows at a stage: the mean of the middle two (AGG7, JN3, T7)."""
    return dwell.groupBy("stage_id").agg(F.median("meetings").alias("median_meetings")).join(F.broadcast(stages), "stage_id").select(F.col("stage_id").cast("long").alias("stage_id"), "stage_name", "median_meetings")


def gap_statistics(changes: DataFrame) -> DataFrame:
    """Days between changes by pair of stages, with the upper median (AGG17, T7). A pair's days are aggregated to counts first."""
    days = changes.filter("delta <> 0").select("from_stage", "stage_id", F.datediff("meeting_date", "from_date").alias("days"))
    counts = days.groupBy("from_stage", "stage_id", "days").agg(F.count("*").alias("c"))
    w = Window.partitionBy("from_stage", "stage_id").orderBy("days")
    ranked = counts.withColumn("upto", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(Window.partitionBy("from_stage", "stage_id")))
    upper = F.min(F.when(F.expr("upto > floor(n / 2)"), F.col("days")))
    return ranked.groupBy(F.col("from_stage").cast("long").alias("from_stage"), F.col("stage_id").cast("long").alias("to_stage")).agg(F.sum("c").alias("changes"), F.round(F.sum(F.col("days") * F.col("c")) / F.sum("c"), 4).alias("mean_days"), upper.cast("long").alias("upper_median"), F.min("days").cast("long").alias("min_days"), F.max("days").cast("long").alias("max_days"))


def discussion_totals(discussion: DataFrame) -> DataFrame:
    """(AGG5)"""
    return discussion.agg(F.count_if(F.col("discussed") == 1).alias("entities_discussed"), F.coalesce(F.sum("times"), F.lit(0)).alias("bold_appearances"))


def discussion_buckets(discussion: DataFrame) -> DataFrame:
    """Entities by how often they were discussed (AGG26)."""
    bucket = F.when(F.col("times") == 0, "0").when(F.col("times") <= 2, "1-2").otherwise("3+")
    return discussion.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("entities"))


def monthly_intake(obs: DataFrame, floor: int = 4) -> DataFrame:
    """Entities by the month in which they first stood at the floor or above; null for never (AGG24, WIN7, DT5)."""
    first = obs.groupBy("entity_id").agg(F.min(F.when(F.col("stage_id") >= floor, F.col("meeting_date"))).alias("first"))
    return first.groupBy(F.date_format("first", "yyyy-MM").alias("month")).agg(F.count("*").alias("entities"))


def monthly_volume(obs: DataFrame, floor: int = 4) -> DataFrame:
    """Distinct (entity, date) discussed a month, beside the intake, for every month of either (AGG25, SET2)."""
    bold = obs.filter("is_bold = 1").select("entity_id", "meeting_date").distinct().groupBy(F.date_format("meeting_date", "yyyy-MM").alias("month")).agg(F.count("*").alias("discussed"))
    return bold.join(monthly_intake(obs, floor).filter("month is not null"), "month", "full").select("month", F.coalesce("discussed", F.lit(0)).alias("discussed"), F.coalesce("entities", F.lit(0)).alias("intake"))


def field_coverage(entities: DataFrame, values: DataFrame, by: list[str], fields: list[str] | None = None) -> DataFrame:
    """Entities with a value for each field, of all in the group (AGG8-AGG10, JN1, FLT2). entities: (entity_id, by...). Without a list, the fields are those that any entity has."""
    have = values.filter("value_text is not null or value_num is not null").select("entity_id", "field").distinct()
    total = entities.groupBy(*by).agg(F.count("*").alias("total"))
    got = entities.join(have, "entity_id").groupBy(*by, "field").agg(F.count("*").alias("present"))
    if fields is not None:
        every = total.withColumn("field", F.explode(F.array(*map(F.lit, fields))))
    else:
        seen = have.agg(F.collect_set("field").alias("fields"))  # one row
        every = total.crossJoin(F.broadcast(seen)).withColumn("field", F.explode("fields")).drop("fields")
    return every.join(got, [*by, "field"], "left").withColumn("present", F.coalesce("present", F.lit(0)))


def coverage_report(entities: DataFrame, values: DataFrame, fields: list[str], cohorts: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """Every field over all entities, and one field in each cohort, as (name, present, total, missing, coverage) (AGG8, AGG10, FLT4).

    cohorts: a label to the field and the entity ids. An entity has a flag for each field and cohort, so all lines come from one aggregation.
    """
    have = values.filter(F.col("field").isin(fields) & (F.col("value_text").isNotNull() | F.col("value_num").isNotNull())).groupBy("entity_id").agg(F.collect_set("field").alias("have"))
    rows = entities.select("entity_id").join(have, "entity_id", "left").withColumn("have", F.coalesce("have", F.array().cast("array<string>")))
    for k, (_, ids) in enumerate(cohorts.values()):
        rows = rows.join(ids.select("entity_id").distinct().withColumn(f"in{k}", F.lit(True)), "entity_id", "left")
    has = lambda f: F.array_contains("have", f)
    line = lambda name, member, f: F.struct(F.lit(name).alias("name"), F.count_if(member & has(f)).alias("present"), F.count_if(member).alias("total"))
    inside = lambda k: F.coalesce(F.col(f"in{k}"), F.lit(False))
    lines = [line(f, F.lit(True), f) for f in fields] + [line(f"{f} @ {label} cohort", inside(k), f) for k, (label, (f, _)) in enumerate(cohorts.items())]
    out = rows.agg(*(x.alias(f"x{i}") for i, x in enumerate(lines))).select(F.inline(F.array(*(f"x{i}" for i in range(len(lines))))))
    return out.select("name", "present", "total", (F.col("total") - F.col("present")).alias("missing"), X.coverage_text(F.col("present"), F.col("total")).alias("coverage"))


def gap_counts(entities: DataFrame, values: DataFrame, fields: list[str]) -> DataFrame:
    """How many of the fields each entity lacks, also those with none (AGG11, FLT3)."""
    have = values.filter(F.col("field").isin(fields)).filter("value_text is not null or value_num is not null").groupBy("entity_id").agg(F.count_distinct("field").alias("n"))
    return entities.select("entity_id").join(have, "entity_id", "left").select("entity_id", (F.lit(len(fields)) - F.coalesce("n", F.lit(0))).alias("gaps"))


def priority(gaps: DataFrame, funnel: DataFrame, discussion: DataFrame) -> DataFrame:
    """The worklist's rank; the order of the rules matters (AGG12)."""
    rows = gaps.join(funnel.select("entity_id", "furthest"), "entity_id", "left").join(discussion.select("entity_id", "discussed"), "entity_id", "left")
    stage, discussed = F.coalesce("furthest", F.lit(0)), F.coalesce("discussed", F.lit(0)) == 1
    rank = F.when(F.col("gaps") == 0, "P4").when(stage >= 5, "P1 advanced").when(discussed, "P1 discussed").when((stage == 4) & (F.col("gaps") >= 3), "P2").when(F.col("gaps") >= 4, "P3").otherwise("P4")
    return rows.select("entity_id", "gaps", rank.alias("priority"))


def reconciliation(obs: DataFrame, entities: DataFrame, meetings: DataFrame) -> DataFrame:
    """Checks that must hold; a row for each that doesn't, with how far it is off (AGG30, JN6, JN7)."""
    f = V.entity_funnel(obs)
    sizes = f.agg(F.count("*").alias("funnel"), F.sum("reached_deep").alias("r"), F.sum("observed_deep").alias("o"), F.count("furthest").alias("placed")).crossJoin(F.broadcast(entities.agg(F.count("*").alias("entities"))))
    checks = sizes.selectExpr("stack(3, 'distribution', abs(funnel - placed), 'more in the funnel than entities', greatest(funnel - entities, 0), 'observed over reached', greatest(o - r, 0)) as (check, n)")
    kept = entities.filter("merged_into is null") if "merged_into" in entities.columns else entities
    orphans = f.join(kept, "entity_id", "left_anti").agg(F.lit("funnel rows without an entity").alias("check"), F.count("*").alias("n"))
    ghosts = obs.join(meetings.filter("status <> 'held'"), "meeting_date").agg(F.lit("observations at meetings not held").alias("check"), F.count("*").alias("n"))
    return checks.unionByName(orphans).unionByName(ghosts).filter("n > 0")
