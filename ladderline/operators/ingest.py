"""Loading rules: attribution of wide cells, gap rows, wrapped listings, groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import stored as D
from ..sources import tables as S
from . import funnel as V
from . import history as H
from . import resolve as R
from . import validate as L

#: Columns of two sources, where the written 'UNKNOWN' is a gap.
DUAL_SOURCE = ["website", "hq_city", "hq_state_province", "hq_country", "hq_region"]


def attributed(cells: DataFrame) -> DataFrame:
    """Cells with their source (FLT8, FLT9, FLT10). cells: (entity_id, field, value_text, enriched, citation, group_source).

    A dual-source field is public if it was enriched and has a citation; a working group comes from
    the slides if its source says so, and is left out if its source is missing.
    """
    dual = F.col("field").isin(DUAL_SOURCE)
    kept = cells.filter(F.col("value_text").isNotNull() & ~(dual & (F.col("value_text") == "UNKNOWN")))
    kept = kept.filter((F.col("field") != "working_group") | F.coalesce(F.col("group_source") != "MISSING", F.lit(False)))
    public = dual & F.coalesce("enriched", F.lit(False)) & F.col("citation").isNotNull()
    slides = (F.col("field") == "working_group") & (F.col("group_source") == "Slide section")
    source = F.when(public, "Public").when(slides, "Slides").otherwise("Affinity")
    return kept.select("entity_id", "field", "value_text", source.alias("source"), F.when(public, F.col("citation")).alias("citation"))


def gap_rows(flags: DataFrame, entity: str, columns: dict[str, str]) -> DataFrame:
    """A not_checked row for each flag that is set (DET9). columns: flag column to field."""
    wide = flags.select(F.col(entity).alias("entity_id"), *(F.coalesce(F.col(c).cast("boolean"), F.lit(False)).alias(f) for c, f in columns.items()))
    return wide.unpivot("entity_id", list(columns.values()), "field", "needed").filter("needed").select("entity_id", "field", F.lit("not_checked").alias("state"))


def line_wraps(rows: DataFrame) -> DataFrame:
    """Proposals from listings that look torn (DET2): a leading slash marks a phantom; else a beginning or end of a fuller name. rows: (entity_id, name)."""
    phantom = rows.filter(F.col("name").startswith("/")).select("entity_id", F.lit(None).cast("long").alias("target_id"), F.lit("line_wrap_candidate").alias("kind"), F.lit(0.9).alias("confidence"))
    whole = rows.groupBy("name").agg(F.min("entity_id").alias("target_id")).withColumnRenamed("name", "full_name")
    pairs = R.fragment_pairs(rows.select("name").distinct()).join(whole, "full_name")
    merge = rows.filter(~F.col("name").startswith("/")).join(pairs, "name").select("entity_id", "target_id", F.lit("merge_proposal").alias("kind"), "confidence")
    return phantom.unionByName(merge)


def groups(rows: DataFrame) -> DataFrame:
    """Listings that may name several companies (DET3). rows: (entity_id, name)."""
    return rows.filter(X.is_grouped(F.col("name"))).select("entity_id", F.lit("group_split").alias("kind"), F.lit(0.7).alias("confidence"), F.size(X.group_parts(F.col("name"))).alias("parts"))


def first_appearances(resolved: DataFrame) -> DataFrame:
    """Unresolved names with how often they stand (DET7). resolved: the result of resolve_aliases."""
    return resolved.filter("method = 'unresolved'").groupBy("name").agg(F.count("*").alias("n"))


def round_groups(rows: DataFrame, column: str) -> DataFrame:
    """Round stages gathered to Seed, A and later ones (RPT5)."""
    s = F.col(column)
    group = F.when(s.isNull(), "_no value_").when(s.isin("Preseed", "Seed"), "Seed").when(s == "Series A", "A").when(s.rlike("^Series [BCD]"), "B+").otherwise("other")
    return rows.groupBy(group.alias("round_group")).agg(F.count("*").alias("n"))


def gap_split(rows: DataFrame, value: str, state: str) -> DataFrame:
    """Blank cells by their gap's state, untracked where there is none (RPT6, MAP2)."""
    label = F.coalesce(F.col(value), F.concat(F.lit("blank: "), F.coalesce(F.col(state), F.lit("untracked"))))
    return rows.groupBy(label.alias("value")).agg(F.count("*").alias("n"))


def folder_coverage(rows: DataFrame, stage: str, tier: str) -> DataFrame:
    """Companies with a folder by stage, ambiguous ones apart (RPTF, AGG29)."""
    hit = F.col(tier).isin("exact", "alias", "suffix", "prefix")
    return rows.groupBy(F.col(stage).alias("stage")).agg(F.count("*").alias("companies"), F.count_if(hit).alias("with_folder"), F.count_if(F.col(tier) == "ambiguous").alias("ambiguous"))


def dual_listings(rows: DataFrame) -> DataFrame:
    """Entities that stand twice on a date in several spellings (DET4). rows: (entity_id, meeting_date, name)."""
    g = rows.groupBy("entity_id", "meeting_date").agg(F.count("*").alias("n"), F.count_distinct("name").alias("k"))
    return g.filter("n > 1 and k > 1").select("entity_id", F.lit("dual_listing").alias("kind"), F.lit(None).cast("double").alias("confidence"))


def load(companies: DataFrame, history: DataFrame, cells: DataFrame, external: DataFrame | None = None) -> dict[str, DataFrame]:
    """The full load in its fixed order: entities, aliases, meetings, observations, values, flags, gaps, detectors, report (FLW1, AGG31).

    companies: (entity_id, name, website, variants, first_meeting, needs_<gap field>...); history:
    (observation_id, meeting_date, name, stage_id, is_bold, slide_page); cells: the input of attributed();
    external: (name) of an outside list, whose missing names propose removals. Rows of history whose
    name resolves to no entity are counted and left out. Each table is written when it is made, and what follows
    reads it: a table is derived once, and the counts come from the written ones.
    """
    spark, place = companies.sparkSession, D.scratch(companies.sparkSession, "load")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{place}/{name}")
        return spark.read.schema(df.schema).parquet(f"{place}/{name}")

    entities = companies.select("entity_id", X.squeeze(F.col("name")).alias("canonical_name"), X.domain_of(F.col("website")).alias("domain"))
    entities = kept(entities, "entity")
    spelled = companies.select("entity_id", F.posexplode(F.concat(F.array(X.squeeze(F.col("name"))), F.filter(F.transform(F.split(F.coalesce("variants", F.lit("")), "[|]"), X.squeeze), lambda t: t != ""))).alias("pos", "alias_text"))
    aliases = kept(S.first_wins(spelled, ["alias_text"], ["pos", "entity_id"]).select("alias_text", X.norm_name(F.col("alias_text")).alias("alias_norm"), "entity_id"), "alias")
    dates = history.select(F.lit(1).alias("one"), "meeting_date").distinct()
    meetings = kept(dates.select("meeting_date", F.lit("held").alias("status")).unionByName(H.fill_calendar(dates, "one").select("meeting_date", F.lit("not_held").alias("status"))), "meeting")
    seen = kept(history.groupBy("name").agg(F.count("*").alias("n")), "spelling")
    names = kept(R.resolve_aliases(seen.selectExpr("name row_id", "name"), aliases).select("name", "entity_id", "method"), "resolution")
    methods = kept(names.join(seen, "name").groupBy("method").agg(F.sum("n").alias("n")), "methods")
    found = history.join(names, "name")
    obs = kept(S.first_wins(found.filter("method <> 'unresolved'").drop("method"), ["meeting_date", "entity_id", "name", "stage_id"], ["observation_id"]), "observation")
    values = attributed(cells)
    funnel = obs.groupBy("entity_id").agg(F.min("meeting_date").alias("first_seen"))
    early = L.early_meetings(companies.select("entity_id", X.us_date(F.col("first_meeting")).alias("first_meeting")), funnel).select("entity_id").distinct()
    flags = early.select("entity_id", F.lit("relationship_predates_crm").alias("field"), F.lit("1").alias("value_text"), F.lit("Affinity").alias("source"), F.lit(None).cast("string").alias("citation"))
    flags = kept(flags, "flags")
    values = kept(values.unionByName(flags.select(*values.columns)), "field_value")
    gaps = gap_rows(companies, "entity_id", {c: c.removeprefix("needs_") for c in companies.columns if c.startswith("needs_")})
    gaps = kept(gaps, "gap")
    named = entities.selectExpr("entity_id", "canonical_name name")
    part = lambda df: df.select("entity_id", "kind", F.col("confidence").cast("double").alias("confidence"))
    review = part(R.domain_pairs(entities.selectExpr("entity_id", "canonical_name name", "domain")).withColumn("kind", F.lit("merge_proposal")))
    for more in (line_wraps(named), groups(named), dual_listings(obs), V.jumps(V.transitions(obs)).withColumn("confidence", F.lit(None))):
        review = review.unionByName(part(more))
    if external is not None:
        review = review.unionByName(part(named.join(external.select("name").distinct(), "name", "left_anti").select("entity_id", F.lit("removal_proposal").alias("kind"), F.lit(0.5).alias("confidence"))))
    review = kept(review, "review_item")
    tables = {"entity": entities, "alias": aliases, "meeting": meetings, "observation": obs, "field_value": values, "gap": gaps, "review_item": review}
    n = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    lines = [
        n("entities", entities), n("aliases", aliases), n("meetings_held", meetings.filter("status = 'held'")), n("meetings_missing", meetings.filter("status <> 'held'")), n("observations", obs), n("field_values", values),
        n("gap_rows", gaps), n("review_open", review), n("v2_removal_proposals", review.filter("kind = 'removal_proposal'")), n("predating_relationships_flagged", flags),
        *(methods.agg(F.coalesce(F.sum(F.when(F.col("method") == method, F.col("n"))), F.lit(0)).alias("n")).select(F.lit(label).alias("name"), "n") for label, method in (("resolved_exact", "exact"), ("resolved_normalised", "normalised"))),
        n("unresolved_slide_names", names.filter("method = 'unresolved'")),
    ]
    report = lines[0]
    for line in lines[1:]:
        report = report.unionByName(line)
    return tables | {"report": kept(report.coalesce(1), "report")}
