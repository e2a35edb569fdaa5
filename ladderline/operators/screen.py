"""Cohort screening: a cohort absorbs entities named among its variants, and everything is derived anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import funnel as V

MIN_STAGE = 4
#: Ids of a block when rows are numbered.
BLOCK_IDS = 1 << 16


def absorbed(entities: DataFrame, cohort: DataFrame, variants: DataFrame) -> DataFrame:
    """Entities outside the cohort that a cohort row names: the first of their names decides (JN13, JN14). entities: (entity_id, pos, key); cohort: (entity_id); variants: (key, target_id)."""
    outside = entities.join(cohort.select("entity_id"), "entity_id", "left_anti")
    target = variants.join(cohort.selectExpr("entity_id target_id"), "target_id", "left_semi").groupBy("key").agg(F.min("target_id").alias("target_id"))
    return outside.join(target, "key").groupBy("entity_id").agg(F.min_by("target_id", "pos").alias("target_id"))


def screened(obs: DataFrame, cohort: DataFrame, taken: DataFrame, floor: int = MIN_STAGE) -> DataFrame:
    """The cohort's observations at the floor or above, with those of absorbed entities (FLT7, SRT10)."""
    own = obs.join(cohort.select("entity_id"), "entity_id", "left_semi")
    more = obs.join(taken, "entity_id").drop("entity_id").withColumnRenamed("target_id", "entity_id")
    return own.unionByName(more.select(*own.columns)).filter(F.col("stage_id") >= floor)


def counters(obs: DataFrame, cohort: DataFrame) -> DataFrame:
    """Counters over weekly maxima, for every cohort row (FLW3, T8)."""
    weekly = obs.groupBy("entity_id", "meeting_date").agg(F.max("stage_id").alias("s"), F.max("is_bold").alias("b"))
    last = F.max(F.struct("meeting_date", "s"))
    got = weekly.groupBy("entity_id").agg(F.count("*").alias("appearances"), F.min("meeting_date").cast("string").alias("first"), F.max("meeting_date").cast("string").alias("last"), last["s"].cast("long").alias("latest"), F.max("s").cast("long").alias("furthest"), F.sum("b").alias("times"), F.max((F.col("s") == 5).cast("int")).alias("od"), F.max((F.col("s") == 7).cast("int")).alias("ol"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return cohort.select("entity_id").join(got, "entity_id", "left").select("entity_id", zero("appearances").alias("appearances"), "first", "last", "latest", "furthest", zero("times").alias("times"), zero("od").alias("observed_deep"), zero("ol").alias("observed_legal"), (zero("furthest") >= 5).cast("long").alias("reached_deep"))


def rollups(obs: DataFrame, counted: DataFrame) -> DataFrame:
    """Totals of the screened cohort: observed by raw rows, reached by furthest stage (AGG28, T8)."""
    seen = obs.groupBy("entity_id").agg(*(F.max((F.col("stage_id") == k).cast("int")).alias(f"o{k}") for k in V.RUNGS), F.sum("is_bold").alias("bold"))
    rows = counted.select("entity_id", "furthest", "times").join(seen, "entity_id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return rows.agg(*(total(F.col(f"o{k}")).alias(f"observed_{r}") for k, r in V.RUNGS.items()), *(F.count_if(F.coalesce("furthest", F.lit(0)) >= k).alias(f"reached_{r}") for k, r in V.RUNGS.items()), F.count_if(F.col("times") > 0).alias("discussed"), total(F.col("bold")).alias("bold_rows"), F.count("*").alias("companies"))


def reviews(changes: DataFrame, first_id: int = 0) -> DataFrame:
    """Jumps and regressions of the screened series, numbered on from the queue's ids (DET10, WIN9).

    Numbers come from counts per entity, so that no task holds all rows.
    """
    bad = V.jumps(changes).select("entity_id", "kind", "meeting_date", "from_date", "delta")
    n = bad.groupBy("entity_id").agg(F.count("*").alias("c"))
    n = n.withColumn("_b", F.floor(F.col("entity_id") / BLOCK_IDS))
    blocks = n.groupBy("_b").agg(F.sum("c").alias("_c"))  # a row for BLOCK_IDS ids
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    within = F.coalesce(F.sum("c").over(Window.partitionBy("_b").orderBy("entity_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = n.withColumn("_in", within).join(blocks, "_b").select("entity_id", (F.col("_in") + F.col("_before")).alias("start"))
    inside = F.row_number().over(Window.partitionBy("entity_id").orderBy("meeting_date"))
    detail = F.format_string("stage moved %+d levels between %s and %s", "delta", F.col("from_date").cast("string"), F.col("meeting_date").cast("string"))
    return bad.withColumn("k", inside).join(before, "entity_id").select((F.lit(first_id) + F.col("start") + F.col("k")).alias("review_id"), "entity_id", "kind", detail.alias("detail"))


def screen(obs: DataFrame, entities: DataFrame, cohort: DataFrame, variants: DataFrame, aliases: DataFrame, review: DataFrame, judged: DataFrame, floor: int = MIN_STAGE) -> dict[str, DataFrame]:
    """The whole screening of a cohort (FLW3): absorbed entities give it their observations and aliases, and counters, reviews and totals are derived anew.

    entities: (entity_id, pos, key); cohort: (entity_id); variants: (key, target_id); aliases: (entity_id, alias_text);
    review: (review_id, kind, entity_id, target_id); judged: (entity_id) of phantoms settled by hand. Screening its own result changes nothing.
    """
    taken = absorbed(entities, cohort, variants)
    rows = screened(obs, cohort, taken, floor)
    counted = counters(rows, cohort)
    moved = aliases.join(taken, "entity_id").select(F.col("target_id").alias("entity_id"), "alias_text")
    own = aliases.join(cohort, "entity_id", "left_semi").select("entity_id", "alias_text").unionByName(moved).distinct()
    kept = pruned(review, cohort, judged)
    first = kept.agg(F.coalesce(F.max("review_id"), F.lit(0)).alias("first"))
    found = reviews(V.date_transitions(rows)).crossJoin(F.broadcast(first)).withColumn("review_id", F.col("review_id") + F.col("first")).drop("first")
    queue = kept.select("review_id", "kind", "entity_id", "target_id").unionByName(found.select("review_id", "kind", "entity_id", F.lit(None).cast("long").alias("target_id")))
    totals = rollups(rows, counted)
    report = totals.crossJoin(F.broadcast(taken.agg(F.count("*").alias("absorbed")))).crossJoin(F.broadcast(queue.agg(F.count("*").alias("review_open")))).crossJoin(F.broadcast(rows.agg(F.count("*").alias("observations"))))
    return {"observations": rows, "companies": counted, "aliases": own, "review": queue, "absorbed": taken, "totals": totals, "report": report}


def pruned(review: DataFrame, cohort: DataFrame, judged: DataFrame) -> DataFrame:
    """Reviews whose two sides are in the cohort, without phantoms judged by hand (judged: entity_id) and derived kinds (DET11, DET12)."""
    out = review.filter("kind not in ('stage_jump', 'stage_regression')").join(cohort.select("entity_id"), "entity_id", "left_semi")
    ids = cohort.selectExpr("entity_id target_id")
    out = out.filter("target_id is null").unionByName(out.filter("target_id is not null").join(ids, "target_id", "left_semi").select(*out.columns))
    settled = judged.select("entity_id", F.lit("line_wrap_candidate").alias("kind")).distinct()
    return out.join(settled, ["entity_id", "kind"], "left_anti").select(*review.columns)
