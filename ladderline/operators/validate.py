"""Rules as violation queries, and batch writes that validate everything before anything is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import tables as S
from . import resolve as R


def not_iso(x: Column) -> Column:
    """A value that is no ISO date (VAL1, FLT5)."""
    return x.isNotNull() & ~x.rlike(r"^\d{4}-\d{2}-\d{2}$")


def enum_violations(rows: DataFrame, column: str, allowed: DataFrame) -> DataFrame:
    """Rows whose value is not in the vocabulary; null passes (VAL2)."""
    return rows.filter(F.col(column).isNotNull()).join(allowed.select(F.col(allowed.columns[0]).alias(column)), column, "left_anti")


def zero_violations(rows: DataFrame) -> DataFrame:
    """A zero not marked, or a mark without a zero (VAL3, VAL9)."""
    return rows.filter("(value_num = 0 and not is_zero) or (is_zero and (value_num is null or value_num <> 0))")


def provenance_violations(rows: DataFrame) -> DataFrame:
    """Public values need a citation, local amounts a currency (VAL4, VAL9). Columns that rows lack are not checked."""
    have = set(rows.columns)
    rules = [("citation", "source = 'Public' and citation is null"), ("amount_local", "amount_local is not null and currency is null")]
    found = [rows.filter(rule).withColumn("rule", F.lit(c)) for c, rule in rules if c in have]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def unique_violations(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that stand more than once (VAL10); a null is never equal."""
    return rows.filter(" and ".join(f"{k} is not null" for k in key)).groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def dangling(rows: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """References without a parent (VAL10, T13, T29)."""
    return rows.filter(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def early_meetings(meetings: DataFrame, funnel: DataFrame, flagged: DataFrame | None = None) -> DataFrame:
    """First meetings before the first observation, unless flagged (JN5, VAL6, DET8)."""
    out = meetings.join(funnel.select("entity_id", "first_seen"), "entity_id").filter("first_meeting < first_seen")
    return out if flagged is None else out.join(flagged.select("entity_id").distinct(), "entity_id", "left_anti")


def written_unknowns(values: DataFrame) -> DataFrame:
    """'Unknown' stored as if it were a value (VAL8)."""
    return values.filter("upper(trim(value_text)) = 'UNKNOWN'").groupBy("field").agg(F.count("*").alias("n"))


def warnings(changes: DataFrame, values: DataFrame) -> DataFrame:
    """All warnings as (kind, entity_id, detail) (VAL11, VAL7, VAL8, SET5). changes: the result of funnel.transitions."""
    moved = F.format_string("stage %d -> %d between %s and %s (%+d)", "from_stage", "stage_id", F.col("from_date").cast("string"), F.col("meeting_date").cast("string"), "delta")
    back = changes.filter("delta < 0").select(F.lit("stage_regression").alias("kind"), "entity_id", moved.alias("detail"))
    n = values.filter("value_text = 'UNKNOWN'").agg(F.count("*").alias("n")).filter("n > 0")
    return back.unionByName(n.select(F.lit("unknown_as_category").alias("kind"), F.lit(None).cast("long").alias("entity_id"), F.format_string("%d field values literally 'UNKNOWN'", "n").alias("detail")))


#: Fields with a vocabulary.
ENUMS = {"affinity_status": "affinity_status", "working_group": "working_group", "stage": "round_stage"}


def field_write_faults(asked: DataFrame, first_seen: DataFrame | None = None) -> DataFrame:
    """The rows with the first rule that each breaks in `fault`, or null (WRT2, VAL1-VAL6). asked: (entity_id, field, value_text, value_num, is_zero, source, citation); first_seen: (entity_id, first_seen)."""
    rows = asked if first_seen is None else asked.join(first_seen.select("entity_id", "first_seen"), "entity_id", "left")
    early = F.lit(False) if first_seen is None else (F.col("field") == "first_meeting") & (F.col("value_text") < F.col("first_seen").cast("string"))
    zero = F.coalesce((F.col("value_num") == 0) & ~F.col("is_zero"), F.lit(False)) | (F.col("is_zero") & (F.col("value_num").isNull() | (F.col("value_num") != 0)))
    fault = F.when(F.col("field").isin(S.DATE_FIELDS) & not_iso(F.col("value_text")), "not an ISO date").when(zero, "zero without its mark")
    for field, name in ENUMS.items():
        known = [row[0] for row in S.VOCABULARIES[name][1]]
        fault = fault.when((F.col("field") == field) & F.col("value_text").isNotNull() & ~F.col("value_text").isin(known), f"not in {name}")
    fault = fault.when(F.coalesce(early, F.lit(False)), "before the first observation").when((F.col("source") == "Public") & F.col("citation").isNull(), "public without a citation")
    return rows.select(*asked.columns, fault.alias("fault"))


def write_fields(asked: DataFrame, first_seen: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows to append, rows refused with their fault): values are appended only, and history.current_values tells which one holds (WRT1)."""
    judged = field_write_faults(asked, first_seen)
    return judged.filter("fault is null").drop("fault"), judged.filter("fault is not null")


def resolve_gaps(held: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the states afterwards, rows refused): the last one asked for of each field wins, unknown states are refused (WRT3, SNK3). Both: (entity_id, field, state, seq)."""
    good = F.col("state").isin(S.GAP_STATES)
    every = held.unionByName(asked.filter(good).select(*held.columns))
    return S.last_wins(every, ["entity_id", "field"], [F.desc("seq")]), asked.filter(~F.coalesce(good, F.lit(False)))


def add_companies(asked: DataFrame, entities: DataFrame, aliases: DataFrame, allow: bool = False) -> dict[str, DataFrame]:
    """A batch of new companies (WRT4, WRT7, WRT8): (accepted, rejected, values, gaps, aliases, proposals).

    asked: (ask_id, name, website, source, round_size, tags). All rules are tried before a row is
    accepted. A row that may double a live entity, or an earlier row of the batch that breaks no other
    rule (by name or domain, even if that one is itself refused as a double), is refused; with allow it
    is accepted, and a proposal filed for each double. A new name becomes an alias unless that spelling
    is already taken.
    """
    money = X.amount(F.col("round_size"))
    rows = asked.select("ask_id", X.squeeze(F.col("name")).alias("name"), X.domain_of(F.col("website")).alias("domain"), "website", "source", money.alias("m"), "round_size", "tags")
    fault = (
        F.when(F.coalesce(F.col("name"), F.lit("")) == "", "no name")
        .when(F.coalesce(F.instr("domain", "."), F.lit(0)) == 0, "no domain")
        .when(~F.coalesce(F.col("source").isin("Manual", "Public"), F.lit(False)), "source not allowed")
        .when(F.col("m.fault").isNotNull(), F.col("m.fault"))
        .when(X.tag_faults(F.col("tags")).isNotNull(), X.tag_faults(F.col("tags")))
    )
    rows = rows.withColumn("fault", fault).withColumn("k", F.lower("name"))
    sound = rows.filter("fault is null")
    held = R.find_duplicates(sound.select("ask_id", "name", "domain"), entities, aliases).select("ask_id", F.col("entity_id").alias("target_id"), F.lit(None).cast("long").alias("target_ask"), "matched_on")
    firsts = lambda c: sound.groupBy(c).agg(F.min("ask_id").alias("target_ask"))
    met = [sound.join(firsts(c), c).filter("ask_id > target_ask").select("ask_id", F.lit(None).cast("long").alias("target_id"), F.col("target_ask").cast("long").alias("target_ask"), F.lit(on).alias("matched_on")) for c, on in (("k", "name"), ("domain", "domain"))]
    twins = held.unionByName(met[0]).unionByName(met[1]).groupBy("ask_id", "target_id", "target_ask").agg(F.max("matched_on").alias("matched_on"))
    judged = rows
    if not allow:
        judged = rows.join(twins.select("ask_id").distinct().withColumn("twin", F.lit(True)), "ask_id", "left")
        judged = judged.withColumn("fault", F.coalesce("fault", F.when(F.col("twin"), "duplicate")))
    good = judged.filter("fault is null")
    # doubles are of sound rows, all of which are accepted where doubles are allowed, and none otherwise
    filed = twins.filter("ask_id is not null") if allow else twins.limit(0)
    cells = good.select("ask_id", "source", F.col("website"), F.col("m.value").cast("string").alias("round_size_usd"), F.array_join(X.tags(F.col("tags")), ", ").alias("tags")).unpivot(["ask_id", "source"], ["website", "round_size_usd", "tags"], "field", "value_text").filter("value_text is not null and (field <> 'tags' or value_text <> '')")
    spelled = S.first_wins(good.selectExpr("ask_id", "name alias_text"), ["alias_text"], ["ask_id"], aliases)
    return {
        "accepted": good.select("ask_id", "name", "domain"),
        "rejected": judged.filter("fault is not null").select("ask_id", "name", "fault"),
        "values": cells,
        "gaps": good.select("ask_id", F.explode(F.array(*map(F.lit, S.GAP_FIELDS))).alias("field")).join(cells.select("ask_id", "field"), ["ask_id", "field"], "left_anti").withColumn("state", F.lit("not_checked")),
        "aliases": spelled.select("ask_id", "alias_text", X.norm_name(F.col("alias_text")).alias("alias_norm"), F.lit("manual").alias("match_method"), F.lit(1.0).alias("confidence")),
        "proposals": filed.select("ask_id", "target_id", "target_ask", "matched_on", F.lit("merge_proposal").alias("kind")),
    }


def set_tags(current: DataFrame, asked: DataFrame) -> DataFrame:
    """Tag rows to append: those whose canonical list changes; clearing writes '' (WRT5, T23)."""
    new = asked.select("entity_id", F.array_join(X.tags(F.col("tags")), ", ").alias("value_text"))
    old = current.select("entity_id", F.array_join(X.tags(F.col("value_text")), ", ").alias("old"))
    return new.join(old, "entity_id", "left").filter("coalesce(old, '') <> value_text").drop("old")


def accepted_sources(rows: DataFrame) -> DataFrame:
    """Suggestions taken over as public: known fields with a data-item citation (WRT6)."""
    return rows.filter(F.col("field").isin("website", "hq_country") & F.col("citation").rlike(r"wikidata.*Q\d+")).withColumn("source", F.lit("Public"))
