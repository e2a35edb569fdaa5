"""Declared schemas, vocabularies, readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The stage ladder, where the id is the rank.
STAGES = [(1, "Meetings This Week"), (2, "Hold / Nurture"), (3, "NewCo / Fellows"), (4, "Preliminary Diligence"), (5, "Deep Diligence"), (6, "Negotiate / Offer"), (7, "Legal Diligence / Def Docs")]
#: Precedence of sources.
SOURCES = [("Slides", 1), ("Affinity", 2), ("Public", 3), ("Manual", 4)]
#: Groups, round stages, gap states and the fields with gaps.
WORKING_GROUPS = ["Health", "Systems", "Climate", "Scale-Up", "AI for Science"]
ROUND_STAGES = [("Preseed", 1), ("Seed", 2), ("Series A", 3), ("Series B", 4), ("Series C", 5)]
GAP_STATES = ["not_checked", "confirmed_unavailable", "filled"]
GAP_FIELDS = ["website", "hq_country", "stage", "round_size_usd", "owner_name"]
#: Fields that hold dates.
DATE_FIELDS = ["affinity_date_added", "first_meeting", "last_meeting", "outcome_date"]
#: Thesis areas, and the stage and thesis of each section's heading.
THESIS_AREAS = [("HH", "Human Health"), ("AS", "Autonomous Systems"), ("E&C", "Energy & Climate"), ("AIFS", "AI for Science")]
SECTIONS = [("Meetings this week", "Meetings This Week", None), ("Hold / Nurture", "Hold / Nurture", None), ("Deep Diligence", "Deep Diligence", None), ("Negotiate / Offer", "Negotiate / Offer", None), ("Legal diligence / Def Docs", "Legal Diligence / Def Docs", None), ("HH", "Preliminary Diligence", "HH"), ("AS", "Preliminary Diligence", "AS"), ("E&C", "Preliminary Diligence", "E&C"), ("C", "Preliminary Diligence", "E&C"), ("AIFS", "Preliminary Diligence", "AIFS"), ("Frontier Fellows / NewCo:", "NewCo / Fellows", None), ("FF / TF / EF NewCo:", "NewCo / Fellows", None), ("NewCo:", "NewCo / Fellows", None)]
#: CRM statuses with their stage, worklist ranks, reasons to pass, outcomes (1: final), channels and regions.
CRM_STATUSES = [("Sourcing - No Outreach", 1), ("Pre-Screen", 2), ("Initial Evaluation", 3), ("Preliminary Diligence", 4), ("Deep Diligence", 5), ("Wait", None), ("Potential Pathways", None), ("Protocompany", None), ("Pass", None), ("Loss", None), ("Invested", None)]
PRIORITIES = [("P1 - advanced stage, incomplete", 1), ("P1 - discussed, incomplete", 1), ("P2 - prelim dil, mostly empty", 2), ("P3 - sparse record", 3), ("P4 - acceptable", 4)]
PASS_REASONS = [("Team", 1), ("Technology / technical risk", 2), ("Market size", 3), ("Timing - too early", 4), ("Timing - too late", 5), ("Valuation / terms", 6), ("Round dynamics / no allocation", 7), ("Thesis fit", 8), ("Competitive position", 9), ("Regulatory / reimbursement", 10), ("Capital intensity", 11), ("Founder unresponsive", 12), ("Company died / wound down", 13), ("Other", 99)]
OUTCOMES = [("Active", 0), ("Invested", 1), ("Passed", 1), ("Lost - competitive", 1), ("Lost - company died", 1), ("Dormant - no contact", 0), ("Tracking", 0)]
CHANNELS = ["Warm intro", "Inbound", "Conference", "Portfolio referral", "Lab spinout", "Fellows programme", "Outbound", "Unknown"]
REGIONS = ["United States", "International", "UNKNOWN"]
MEETING_STATES = ["held", "not_held", "not_extracted", "unknown"]

#: The storage model (SRC4).
SCHEMAS = {
    "entity": "entity_id long, canonical_name string, domain string, created_at timestamp, merged_into long, is_phantom boolean, phantom_reason string",
    "alias": "alias_text string, alias_norm string, entity_id long, match_method string, confidence double",
    "entity_group": "group_id long, component_id long",
    "meeting": "meeting_date date, status string, slide_page int",
    "observation": "observation_id long, entity_id long, meeting_date date, stage_id int, is_bold int, name_on_slide string, raw_section string, slide_page int",
    "override": "override_id long, observation_id long, field string, new_value string",
    "field_value": "value_id long, entity_id long, field string, value_text string, value_num double, is_zero boolean, source string, citation string, user string, created_at timestamp",
    "money": "value_id long, amount_usd double, amount_local double, currency string, fx_date date",
    "gap": "entity_id long, field string, state string, checked_at timestamp, seq long",
    "review_item": "review_id long, kind string, entity_id long, target_id long, detail string, confidence double, proposed_by string, state string",
    "ingest_run": "run_id long, started_at timestamp, source_sha256 string, row_counts string",
    "outcome": "entity_id long, outcome string, decided_on date",
    "sourcing": "entity_id long, channel string",
    "founder": "entity_id long, name string",
    "funding_round": "entity_id long, round_stage string, amount_usd double, announced_on date",
    "attendee": "meeting_date date, name string",
}


_ONE = lambda names: [(n,) for n in names]
#: Columns and rows of each vocabulary; the first column is the value.
VOCABULARIES = {
    "stage": ("stage_id, stage_name", STAGES), "source": ("source, precedence", SOURCES), "working_group": ("name", _ONE(WORKING_GROUPS)), "round_stage": ("name, rank", ROUND_STAGES),
    "gap_state": ("name", _ONE(GAP_STATES)), "meeting_state": ("name", _ONE(MEETING_STATES)), "thesis_area": ("code, name", THESIS_AREAS), "section": ("raw_section, stage_name, thesis", SECTIONS),
    "affinity_status": ("name, stage_id", CRM_STATUSES), "enrichment_priority": ("name, rank", PRIORITIES), "pass_reason": ("name, rank", PASS_REASONS), "outcome_type": ("name, final", OUTCOMES),
    "source_channel": ("name", _ONE(CHANNELS)), "region": ("name", _ONE(REGIONS)),
}


def literal(value: str | int | None) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def values_sql(name: str) -> str:
    """The rows of a vocabulary as a VALUES list."""
    return ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in VOCABULARIES[name][1])


def vocabulary(spark: SparkSession, name: str) -> DataFrame:
    """A controlled vocabulary as a small relation (SRC5)."""
    return spark.sql(f"SELECT * FROM VALUES {values_sql(name)} AS v({VOCABULARIES[name][0]})")


def placed(rows: DataFrame, sections: DataFrame) -> DataFrame:
    """Rows with the stage and the thesis that their raw_section stands for; null where it is unknown (SRC5, JN4)."""
    return rows.join(F.broadcast(sections), "raw_section", "left")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header and a declared schema; rows blank in every column go (SRC1, SRC2)."""
    return spark.read.schema(schema).csv(path, header=True).dropna(how="all")


def read_payload(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The JSON that a page embeds, parsed (SRC6, JSN2)."""
    text = spark.read.text(path, wholetext=True)
    found = F.regexp_extract("value", r'(?s)<script id="payload"[^>]*>(.*?)</script>', 1)
    return text.select(F.from_json(found, schema).alias("p")).select("p.*")


def version_of(text: F.Column) -> F.Column:
    """The version that a text states, or '' (SRC7)."""
    return F.coalesce(F.regexp_extract(text, r"Version:\s*(\S+)", 1), F.lit(""))


def append(df: DataFrame, path: str) -> None:
    """Adds files to a folder; stored.Log is the table with commits."""
    df.write.mode("append").parquet(path)


def conform(df: DataFrame, schema: str) -> DataFrame:
    """The rows in a declared schema: its columns, cast and in its order; missing ones are null (SRC4)."""
    declared = df.sparkSession.createDataFrame([], schema).schema
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in declared))


def first_wins(df: DataFrame, key: list[str], order: list[str], held: DataFrame | None = None) -> DataFrame:
    """Rows to insert: the first of each key that is not held yet; keys with a null are never equal (SNK2, T4)."""
    whole = df.filter(" and ".join(f"{k} is not null" for k in key))
    if held is not None:
        whole = whole.join(held.select(*key).distinct(), key, "left_anti")
    whole = whole.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")
    return whole.unionByName(df.filter(" or ".join(f"{k} is null" for k in key)))


def last_wins(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The state after upserts in this order (SNK3)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def page_with(payload: str, template: str, mark: str = "__PAYLOAD__") -> str:
    """A page with the payload inlined; refuses text that would end the script (SNK4, SNK5)."""
    if "</script" in payload:
        raise ValueError("the payload would end its script element")
    return template.replace(mark, payload)


def markdown(title: str, df: DataFrame) -> str:
    """A small report table as Markdown (SNK6)."""
    rows = [tuple("" if v is None else str(v) for v in r) for r in df.collect()]
    lines = [f"### {title}", "", "| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]
    return "\n".join(lines + ["| " + " | ".join(r) + " |" for r in rows])


def run_log(spark: SparkSession, run_id: int, source: str, counts: DataFrame, started: str) -> DataFrame:
    """One row for a load: digest of its source and counts as JSON (SNK7, SNK8, JSN1)."""
    digest = spark.read.format("binaryFile").load(source).groupBy().agg(F.sha2(F.max("content"), 256).alias("source_sha256"))
    body = counts.select(F.to_json(F.struct("*")).alias("row_counts"))
    return digest.crossJoin(F.broadcast(body.limit(1))).select(F.lit(run_id).cast("long").alias("run_id"), F.lit(started).cast("timestamp").alias("started_at"), "source_sha256", "row_counts")
