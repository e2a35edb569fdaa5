"""The model's frames over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from .tables import table

_TIER = "CASE WHEN event_type = 'purchase' THEN CASE WHEN value >= 250 THEN 7 WHEN value >= 200 THEN 6 WHEN value >= 120 THEN 5 ELSE 4 END WHEN event_type = 'signup' THEN 3 WHEN event_type = 'click' THEN 2 ELSE 1 END"


def observations(spark: SparkSession, d: str) -> DataFrame:
    """The observation log over events."""
    return table(spark, d, "events").selectExpr("event_id observation_id", "user_id entity_id", "cast(ts as date) meeting_date", f"{_TIER} stage_id", "CASE WHEN value >= 100 THEN 1 ELSE 0 END is_bold", "cast(get_json_object(props, '$.k') as int) slide_page", "event_type name_on_slide")


def orders_log(spark: SparkSession, d: str) -> DataFrame:
    """A second log over orders, with five rungs."""
    return table(spark, d, "orders").selectExpr("o_orderkey observation_id", "o_custkey entity_id", "cast(o_orderdate as date) meeting_date", "6 - cast(substring(o_orderpriority, 1, 1) as int) stage_id", "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END is_bold")


def overrides(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    stage = e.filter("event_id % 50 = 0").selectExpr("event_id observation_id", "'stage_id' field", "'5' new_value")
    return stage.unionByName(e.filter("event_id % 70 = 0").selectExpr("event_id observation_id", "'is_bold' field", "'1' new_value"))


def field_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr("o_orderkey value_id", "o_custkey entity_id", "'priority' field", "o_orderpriority value_text", "cast(o_orderdate as date) created_at")


def customer_fields(spark: SparkSession, d: str) -> DataFrame:
    """Wide columns as (entity_id, field, value_text) (FLT11)."""
    wide = table(spark, d, "customer").selectExpr("c_custkey entity_id", "c_name name", "c_mktsegment segment", "cast(c_nationkey as string) nation")
    return wide.unpivot("entity_id", ["name", "segment", "nation"], "field", "value_text").filter("value_text is not null")


def quality_cells(spark: SparkSession, d: str) -> DataFrame:
    """Three-state cells over documents and labels: value, genuine zero, or no row."""
    return table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")


def names(spark: SparkSession, d: str) -> DataFrame:
    """(name) over distinct part names and their words."""
    full = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    return full.union(full.select(F.explode(F.split("name", " ")))).distinct()


def ladder_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A query side (qid, pos, name) and a target side (rid, name, canonical, seq) for the match ladder."""
    p = table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))
    query = p.selectExpr("id qid", "0 pos", "CASE WHEN id % 4 = 0 THEN concat(name, ' labs') WHEN id % 4 = 1 THEN split_part(name, ' ', 1) ELSE name END name").unionByName(p.filter("id % 5 = 0").selectExpr("id qid", "1 pos", "name"))
    main = p.selectExpr("id rid", "CASE WHEN id % 3 = 0 THEN concat('old ', name) WHEN id % 2 = 0 THEN concat(name, ' Inc') ELSE name END name", "true canonical", "id seq")
    return query, main.unionByName(p.filter("id % 7 = 0").selectExpr("id rid", "concat(name, ' holdings') name", "false canonical", "id + 1000000 seq"))


def page_domains(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", "url", X.domain_of(F.col("url")).alias("domain"))


#: The cohort's attributes as SQL that Spark and DuckDB read alike.
COHORT = {
    "region": "CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN concat('R', CAST(n_regionkey AS VARCHAR(9))) END", "country": "CASE WHEN c_acctbal >= 0 THEN n_name END",
    "country_gap": "CASE WHEN c_acctbal < -500 THEN 'not_checked' WHEN c_acctbal < -200 THEN 'confirmed_unavailable' END",
    "round": "CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal < 2000 THEN 'Preseed' WHEN c_acctbal < 4000 THEN 'Seed' WHEN c_acctbal < 6000 THEN 'Series A' WHEN c_acctbal < 8000 THEN 'Series B' WHEN c_acctbal < 9000 THEN 'Series C' ELSE 'Bridge' END",
    "thesis": "CASE c_mktsegment WHEN 'BUILDING' THEN 'Human Health' WHEN 'MACHINERY' THEN 'Autonomous Systems' WHEN 'AUTOMOBILE' THEN 'Energy & Climate' WHEN 'FURNITURE' THEN 'AI for Science' END",
    "groups": "CASE WHEN c_acctbal < 1000 THEN NULL WHEN c_mktsegment = 'BUILDING' THEN 'Health; Systems;' WHEN c_acctbal < 5000 THEN 'Climate' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'Climate;AI for Science; Climate' ELSE 'Systems' END",
    "interest": "CASE WHEN c_acctbal > 7000 THEN '1. Very High' WHEN c_acctbal > 5000 THEN '3. Moderate' WHEN c_acctbal > 4000 THEN 'ask again' END",
    "score_team": "CASE WHEN n_regionkey = 1 THEN '+++' WHEN n_regionkey = 2 THEN '+' END", "score_tech": "CASE WHEN c_acctbal > 9500 THEN '++' END", "score_oppt": "CASE WHEN c_mktsegment = 'BUILDING' THEN '+' WHEN n_regionkey > 2 THEN '++' END",
    "status": "CASE WHEN c_acctbal < 500 THEN NULL WHEN c_acctbal < 2500 THEN 'Pass' WHEN c_acctbal < 3500 THEN 'Loss' WHEN c_acctbal < 5000 THEN 'Pre-Screen' ELSE 'Active' END",
    "tier": "CASE WHEN n_regionkey = 0 THEN 'exact' WHEN n_regionkey = 1 THEN 'ambiguous' WHEN n_regionkey = 2 THEN 'suffix' END", "channel": "CAST(NULL AS VARCHAR(9))", "owner": "CASE WHEN c_acctbal > 3000 THEN c_name END",
}


def cohort(spark: SparkSession, d: str) -> DataFrame:
    """The facts of the report's companies over orders and customers; stages 3 to 7."""
    from ..operators import sections

    log = orders_log(spark, d).withColumn("stage_id", F.col("stage_id") + 2)
    nations = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    companies = table(spark, d, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    return sections.facts(log, companies.selectExpr("c_custkey entity_id", "c_name name", *(f"{e} {n}" for n, e in COHORT.items())))
