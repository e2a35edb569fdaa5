"""Report sections as small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import stored as D
from . import funnel as V

RECENT_DAYS, SMALL_SAMPLE, LOW_COVERAGE = 56, 20, 0.3


def frequency(rows: DataFrame, column: str, entity: str = "entity_id") -> DataFrame:
    """Values by count, with shares of all and of those that have one; ties by the first entity (AGG19, SRT5, T9)."""
    sizes = rows.agg(F.count("*").alias("every"), F.count(column).alias("covered"))
    counts = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"), F.min(entity).alias("first_entity"))
    return counts.crossJoin(F.broadcast(sizes)).select("value", "n", "first_entity", X.percent(F.col("n"), F.col("every")).alias("pct_of_all"), X.percent(F.col("n"), F.col("covered")).alias("pct_of_covered"))


def by_frequency(counts: DataFrame, n: str = "n", first: str = "first_entity") -> DataFrame:
    """Most frequent first, ties by who came first (SRT5, SRT6, T9)."""
    return counts.orderBy(F.desc(n), first)


def domain_order(rows: DataFrame, column: str, known: list[str]) -> DataFrame:
    """Known categories in their own order, then the others by name, null last (SRT7)."""
    place = F.nullif(F.array_position(F.array(*map(F.lit, known)), F.col(column)), F.lit(0))
    return rows.orderBy(F.asc_nulls_last(place), F.asc_nulls_last(column))


def nocase(name: Column) -> Column:
    """The order of names without regard to case, which folds ASCII only (SRT2)."""
    return F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crosstab(rows: DataFrame, row: str, stage: str, stages: list[int], high: int = 5) -> DataFrame:
    """Rows by stage with a total, the count at Deep or beyond and its share, and who came first if there is an entity_id (AGG20)."""
    first = [F.min("entity_id").alias("first_entity")] if "entity_id" in rows.columns else []
    out = rows.groupBy(row).agg(*(F.count_if(F.col(stage) == s).alias(f"s{s}") for s in stages), *first)
    out = out.withColumn("total", sum((F.col(f"s{s}") for s in stages[1:]), F.col(f"s{stages[0]}")))
    deep = sum((F.col(f"s{s}") for s in stages if s >= high), F.lit(0))
    return out.withColumn("deep", deep.cast("long")).withColumn("deep_share", X.percent(F.col("deep"), F.col("total")))


def membership_table(rows: DataFrame, groups: str, thesis: str, theses: list[str], total: str = "_total_") -> DataFrame:
    """Members of a list by another attribute, with a total for each group and a last row in which every company stands once (RPTD, AGG20). Rows by size, ties by the first company, the total last (SRT5, SRT6).

    groups: a list in one text, parted by ';', of which repeats count once. Companies that lack either are left out.
    """
    members = F.array_distinct(F.filter(F.transform(F.split(groups, ";"), lambda g: F.trim(g)), lambda g: g != ""))
    both = rows.filter(F.col(thesis).isNotNull()).withColumn("_m", members).filter(F.size("_m") > 0)
    each = both.select("entity_id", thesis, F.explode(F.concat(F.col("_m"), F.array(F.lit(total)))).alias("group"))
    out = each.groupBy("group").agg(*(F.count_if(F.col(thesis) == t).alias(t) for t in theses), F.count("*").alias("total"), F.min("entity_id").alias("_f"))
    w = Window.orderBy((F.col("group") == total).cast("int"), F.desc("total"), "_f")  # a row for each group
    return out.withColumn("place", F.row_number().over(w).cast("long")).drop("_f")


def status_table(rows: DataFrame, status: str, stage: str, stages: list[int], none: str = "_no value_") -> DataFrame:
    """Statuses by stage, the largest first, ties by the first company, those without a status last (RPTC, AGG20, SRT5). rows: (entity_id, ...)."""
    out = crosstab(rows.withColumn(status, F.coalesce(status, F.lit(none))), status, stage, stages)
    w = Window.orderBy((F.col(status) == none).cast("int"), F.desc("total"), "first_entity")  # a row for each status
    return out.withColumn("place", F.row_number().over(w).cast("long")).drop("first_entity", "deep", "deep_share")


def split_table(rows: DataFrame, value: str, furthest: str, high: int = 5) -> DataFrame:
    """A value's counts in two groups, explicit zeros, `_no value_` for none, with each group's size and a note on small ones (AGG21, DET15)."""
    r = rows.select(F.coalesce(value, F.lit("_no value_")).alias("value"), (F.col(furthest) >= high).alias("deep"))
    size = r.agg(F.count_if("deep").alias("deep_total"), F.count_if(~F.col("deep")).alias("rest_total"))
    out = r.groupBy("value").agg(F.count_if("deep").alias("deep"), F.count_if(~F.col("deep")).alias("rest")).crossJoin(F.broadcast(size))
    small = (F.least("deep_total", "rest_total") < SMALL_SAMPLE).cast("int")
    covered = F.sum(F.when(F.col("value") != "_no value_", F.col("deep") + F.col("rest")).otherwise(0)).over(Window.partitionBy("deep_total", "rest_total"))  # a row for each value
    return out.withColumn("small_sample", small).withColumn("low_coverage", (covered < LOW_COVERAGE * (F.col("deep_total") + F.col("rest_total"))).cast("int"))


def advancement(rows: DataFrame, values: list[str], furthest: str) -> DataFrame:
    """The split tables of several values in one, each with its name (RPTA, RPTB)."""
    parts = [split_table(rows, v, furthest).withColumn("split", F.lit(v)) for v in values]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def early_status(rows: DataFrame, early: list[str], high: int = 5) -> DataFrame:
    """Companies whose status is an early one although they went deep (DET14). rows: (entity_id, status, furthest)."""
    return rows.filter(F.col("status").isin(early) & (F.coalesce("furthest", F.lit(0)) >= high))


def in_places(rows: DataFrame, order: list[Column]) -> DataFrame:
    """The rows with their place in this order, from 1. Ranges of the order are sorted apart and written once; what stands before a range follows from the counts. The order should end in an id: equal rows are one range's work."""
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    spark, path = rows.sparkSession, D.scratch(rows.sparkSession, "places")
    sorted_rows.withColumn("_at", F.monotonically_increasing_id()).write.parquet(f"{path}/rows")
    held = spark.read.parquet(f"{path}/rows").withColumn("_p", F.shiftright("_at", 33))
    n = held.groupBy(F.col("_p").alias("_np")).agg(F.count("*").alias("_n"))
    before = n.withColumn("_before", F.sum("_n").over(Window.orderBy("_np")) - F.col("_n")).drop("_n")  # a row for each range
    at = F.col("_at") - F.shiftleft(F.col("_p"), 33)
    return held.join(F.broadcast(before), F.col("_p") == F.col("_np")).withColumn("place", F.col("_before") + at + 1).drop("_at", "_p", "_np", "_before")


def contradiction_keys() -> list[Column]:
    """Consistent ones last, the furthest first, of those the longest unseen first (SRT8)."""
    return [(F.col("why") == "consistent").cast("int"), F.desc_nulls_last("furthest"), F.asc_nulls_last("last"), F.col("entity_id")]


def contradiction_order(rows: DataFrame) -> DataFrame:
    """rows: (entity_id, why, furthest, last)."""
    return rows.orderBy(*contradiction_keys())


def folder_keys() -> list[Column]:
    """The furthest first, then by name (SRT11)."""
    return [F.desc_nulls_last("furthest"), F.col("name"), F.col("entity_id")]


def folderless(rows: DataFrame) -> DataFrame:
    """Companies no folder was found for. rows: (entity_id, name, furthest, tier)."""
    return rows.filter(F.coalesce("tier", F.lit("none")).isin("none", "ambiguous"))


def without_folder(rows: DataFrame) -> DataFrame:
    """These in their order (SRT11)."""
    return folderless(rows).orderBy(*folder_keys())


def tags_in_use(current: DataFrame) -> DataFrame:
    """(tag, companies): every tag that a current list holds, in one spelling, and who carries it (STR10). current: (entity_id, value_text).

    Of a folded form the spelling of the smallest entity_id counts, and in its list the first. A tag that nobody carries any more isn't there.
    """
    each = current.select("entity_id", F.posexplode(X.tags(F.col("value_text"))).alias("pos", "tag"))
    found = each.groupBy(X.fold(F.col("tag")).alias("k")).agg(F.min(F.struct("entity_id", "pos", "tag")).alias("first"), F.count_distinct("entity_id").alias("companies"))
    return found.select(F.col("first.tag").alias("tag"), "companies", F.col("k").alias("folded"))


#: What a whole report leaves out whatever is recorded, and why (RPTN); sections.report counts the fields that it doesn't split by.
EXCLUSIONS = [("round size", "too few values to split by"), ("score fields", "free text marks, not a scale"), ("region", "follows from the country"), ("causes", "counts show what went together, not why")]


def contradictions(rows: DataFrame, end: str, days: int = RECENT_DAYS) -> DataFrame:
    """Closed companies that the log says are not (DET13, DET14, SRT8). rows: (entity_id, furthest, last)."""
    deep, recent = F.coalesce("furthest", F.lit(0)) >= 5, F.datediff(F.lit(end).cast("date"), F.col("last").cast("date")) <= days
    why = F.when(deep & recent, "active and past prelim").when(deep, "deep after closing").when(recent, "still seen").otherwise("consistent")
    return rows.withColumn("why", why)


def agreement(rows: DataFrame, groups: str, thesis: str, spelled: dict[str, str]) -> DataFrame:
    """Whether any of a row's groups, spelled as theses, is its thesis (JN18)."""
    mapped = F.create_map(*(F.lit(x) for kv in spelled.items() for x in kv))
    parts = F.transform(F.filter(F.transform(F.split(groups, ";"), lambda g: F.trim(g)), lambda g: g != ""), lambda g: F.coalesce(F.try_element_at(mapped, g), g))
    return rows.withColumn("agrees", F.array_contains(parts, F.col(thesis)).cast("int"))


def missing_and_extra(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Ids on one side only (JN19, SET1, SET3)."""
    a = left.select(key).distinct().join(right.select(key), key, "left_anti").withColumn("side", F.lit("missing"))
    return a.unionByName(right.select(key).distinct().join(left.select(key), key, "left_anti").withColumn("side", F.lit("extra")))


def queue_places(rows: DataFrame, block_ids: int = 1 << 16) -> DataFrame:
    """The whole review queue with each item's place: surest first, nulls last, ties by id (SRT1). rows: (review_id, confidence).

    Ranks are taken inside a block of ids of one confidence; what stands before a block follows from the counts of blocks.
    """
    r = rows.withColumn("_b", F.floor(F.col("review_id") / block_ids))
    counts = r.groupBy(F.col("confidence").alias("_c"), F.col("_b").alias("_cb")).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy(F.desc_nulls_last("_c"), "_cb")) - F.col("_n"))
    inside = r.withColumn("_r", F.row_number().over(Window.partitionBy("confidence", "_b").orderBy("review_id")))
    out = inside.join(before, F.col("confidence").eqNullSafe(F.col("_c")) & (F.col("_b") == F.col("_cb")))
    return out.withColumn("place", F.col("_before") + F.col("_r")).drop("_b", "_c", "_cb", "_n", "_before", "_r")


#: Names that cut all of them into blocks for numbering.
CUTS = 64


def name_places(rows: DataFrame, name: str, key: str) -> DataFrame:
    """The rows with their place in the order of names without regard to case, ties by key (SRT2).

    A bounded number of names cuts the rest into blocks; ranks are taken inside a block, and what stands before it follows from counts.
    """
    r = rows.withColumn("_k", nocase(F.col(name)))
    cuts = sorted(x[0] for x in r.filter("_k is not null").select("_k").distinct().orderBy(F.xxhash64("_k"), "_k").limit(CUTS).collect())
    r = r.withColumn("_b", F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<string>"), lambda c: c <= F.col("_k"))), F.lit(-1)))
    n = r.groupBy("_b").agg(F.count("*").alias("_n")).withColumnRenamed("_b", "_nb")
    before = n.withColumn("_before", F.sum("_n").over(Window.orderBy("_nb")) - F.col("_n")).drop("_n")  # a row for each block
    inside = r.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(F.asc_nulls_first("_k"), key)))
    return inside.join(F.broadcast(before), F.col("_b") == F.col("_nb")).withColumn("place", F.col("_r") + F.col("_before")).drop("_k", "_b", "_nb", "_r", "_before")


def field_map(fields: DataFrame) -> DataFrame:
    """(entity_id, values): each company's fields as a map; the last one of a field wins (MAP1). fields: (entity_id, field, value, value_id)."""
    last = fields.groupBy("entity_id", "field").agg(F.max_by("value", "value_id").alias("value"))
    return last.groupBy("entity_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("values"))


def payload(entities: DataFrame, obs: DataFrame, calendar: DataFrame, fields: DataFrame, gap_states: DataFrame, worklist: DataFrame, aliases: DataFrame, gap_fields: list[str]) -> DataFrame:
    """(entity_id, name, payload): a JSON text per company with all that a page shows of it (FLW2, ARR1, JSN1, MAP1).

    entities: (entity_id, name, domain, is_phantom); fields: current values (entity_id, field, value, source, citation, user);
    gap_states: (entity_id, field, state); worklist: (entity_id, gaps, priority); aliases: (entity_id, alias_text).
    Everything is aggregated to a row per company before it is joined.
    """
    seen = V.entity_funnel(obs).select("entity_id", "furthest", "appearances", "first_seen", "last_seen", "observed_deep", "observed_legal", "reached_deep")
    talk = V.entity_discussion(obs).select("entity_id", "discussed", "times")
    latest = V.latest(obs).select("entity_id", F.col("stage_id").alias("latest"))
    entry = F.array(F.col("place"), F.col("stage_id"), F.col("is_bold"), F.col("slide_page"))
    rows = obs.join(F.broadcast(calendar.select("meeting_date", "place")), "meeting_date")
    lists = rows.groupBy("entity_id").agg(F.array_sort(F.collect_list(entry)).alias("obs"))
    own = fields.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("field", "value", "source", "citation", "user"))).alias("fields"), F.collect_set(F.when(F.col("value").isNotNull(), F.col("field"))).alias("have"))
    states = gap_states.groupBy("entity_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "state")))).alias("gapState"))
    called = aliases.groupBy("entity_id").agg(F.array_sort(F.collect_list("alias_text")).alias("aliases"))
    out = entities
    for part in (seen, talk, latest, lists, own, states, called, worklist.select("entity_id", "gaps", "priority")):
        out = out.join(part, "entity_id", "left")
    flag = lambda c: F.coalesce(F.col(c) == 1, F.lit(False))
    empty = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind))
    missing = F.array_except(F.array(*map(F.lit, gap_fields)), empty("have", "array<string>"))
    company = F.struct(
        F.col("entity_id").alias("id"), "name", "domain", F.col("is_phantom").alias("phantom"), "furthest", "latest", F.coalesce("appearances", F.lit(0)).alias("appearances"),
        F.col("first_seen").alias("first"), F.col("last_seen").alias("last"), flag("observed_deep").alias("observedDeep"), flag("observed_legal").alias("observedLegal"), flag("reached_deep").alias("reachedDeep"),
        flag("discussed").alias("discussed"), F.coalesce("times", F.lit(0)).alias("times"), "priority", F.coalesce("gaps", F.lit(0)).alias("gaps"), missing.alias("missing"),
        F.coalesce("gapState", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("gapState"),
        F.coalesce("obs", F.array().cast(lists.schema["obs"].dataType)).alias("obs"), F.coalesce("fields", F.array().cast(own.schema["fields"].dataType)).alias("fields"), empty("aliases", "array<string>").alias("aliases"),
    )
    return out.select("entity_id", "name", F.to_json(company, {"ignoreNullFields": "false"}).alias("payload"))


def payload_totals(entities: DataFrame, obs: DataFrame, meetings: DataFrame, review: DataFrame, aliases: DataFrame) -> DataFrame:
    """The payload's totals in one row (AGG32)."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    held = meetings.agg(F.count_if(F.col("status") == "held").alias("meetings_held"), F.count_if(F.col("status") != "held").alias("meetings_missing"))
    out = count(entities, "entities")
    for part in (count(obs, "observations"), held, count(review.filter("state = 'open'"), "review_open"), count(aliases, "aliases")):
        out = out.crossJoin(F.broadcast(part))  # one row each
    return out
