"""Queries over tables that are written and read back: workbooks, the commit log, keyed tables, checks, runs, the load; each with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import bindings as B
from ..sources import stored as D
from ..sources import tables as S
from ..sources import workbook as W
from . import catalogue
from .catalogue import query


@query("SELECT 'Companies' AS sheet, c_custkey AS id, c_name AS name, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS amount, CAST(NULL AS VARCHAR) AS day FROM customer UNION ALL SELECT 'Stage History', o_orderkey, o_orderpriority, o_totalprice, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) FROM orders")
def q_workbook_sheets(s, d):
    """Two sheets of every workbook in a folder, with blank rows between, read with the columns asked for."""
    path = D.scratch(s, "workbooks")
    customers = S.table(s, d, "customer")
    blank = customers.filter("c_acctbal < 0").selectExpr("c_custkey + 0.5D _place", "cast(null as long) id", "cast(null as string) name", "cast(null as double) amount", "cast(null as string) note")
    companies = customers.selectExpr("cast(c_custkey as double) _place", "c_custkey id", "c_name name", "CASE WHEN c_acctbal > 0 THEN c_acctbal END amount", "'not read' note").unionByName(blank)
    history = S.table(s, d, "orders").selectExpr("o_orderkey id", "o_orderpriority name", "'not read' note", "o_totalprice amount", "cast(o_orderdate as date) day")
    W.write_workbooks({"Companies": (companies, "_place"), "Stage History": (history, "id")}, path)
    sheet = lambda name: W.read_sheet(s, path, "_sheet string, id long, name string, amount double, day date", name)
    return sheet("Companies").unionByName(sheet("Stage History")).select(F.col("_sheet").alias("sheet"), "id", "name", "amount", F.col("day").cast("string").alias("day"))


_LOG = "observation_id long, entity_id long, meeting_date date, stage_id int"
_OBS = "SELECT observation_id, entity_id, CAST(meeting_date AS VARCHAR) AS meeting_date, stage_id FROM obs"


@query(_OBS)
def q_append_log(s, d):
    """A run a month: one killed half-way, one tried again, one repeated after its commit."""
    rows = B.observations(s, d).withColumn("run", F.date_format("meeting_date", "yyyy-MM-dd"))
    log = D.Log(s, D.scratch(s, "log"), _LOG)
    for n, half in enumerate(("day(meeting_date) <= 10", "day(meeting_date) between 11 and 20", "day(meeting_date) > 20")):
        part = rows.filter(half)
        if n == 1:  # a write that dies before its commit
            S.conform(part.filter("stage_id > 3"), _LOG).write.parquet(f"{log.files.root}/data/part-{n}-killed")
        log.append(part, f"part-{n}")
        log.append(part, f"part-{n}")
    return log.read().withColumn("meeting_date", F.col("meeting_date").cast("string"))


_KEYED = "entity_id long, field string, value_text string, seq long"


@query("SELECT user_id AS entity_id, event_type AS field, arg_max(props, event_id) AS value_text, max(event_id) AS seq FROM events GROUP BY 1, 2")
def q_stored_upsert(s, d):
    """Batches by day merged one after another: the last value of each key."""
    rows = S.table(s, d, "events").selectExpr("user_id entity_id", "event_type field", "props value_text", "event_id seq", "day(ts) day")
    table = D.Keyed(s, D.scratch(s, "keyed"), _KEYED, ["entity_id", "field"], buckets=8)
    for low, high in ((1, 12), (13, 25), (26, 31)):
        table.merge(rows.filter(F.col("day").between(low, high)), [F.desc("seq")])
    return table.read()


@query("SELECT user_id AS entity_id, event_type AS field, arg_min(props, event_id) AS value_text, min(event_id) AS seq FROM events GROUP BY 1, 2")
def q_stored_insert(s, d):
    """The same batches inserted where nothing is held: the first value of each key."""
    rows = S.table(s, d, "events").selectExpr("user_id entity_id", "event_type field", "props value_text", "event_id seq", "day(ts) day")
    table = D.Keyed(s, D.scratch(s, "keyed"), _KEYED, ["entity_id", "field"], buckets=8)
    for low, high in ((1, 12), (13, 25), (26, 31)):
        table.insert(rows.filter(F.col("day").between(low, high)), [F.asc("seq")])
    return table.read()


@query("SELECT 'held key' AS rule, CAST(o_orderkey AS VARCHAR) AS value, 1 AS n FROM orders WHERE o_totalprice > 150000 AND o_orderstatus = 'F' UNION ALL SELECT 'no o_custkey', CAST(o_custkey AS VARCHAR), count(*) FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY o_custkey UNION ALL SELECT 'rows', 'stored', count(*) FROM orders WHERE o_totalprice > 150000")
def q_checked_append(s, d):
    """A batch with keys that are held and references without a parent is refused whole; what it breaks, and the rows stored afterwards."""
    orders = S.table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    parents = S.table(s, d, "customer").filter("c_acctbal > 0")
    log = D.Log(s, D.scratch(s, "log"), "o_orderkey long, o_custkey long, o_totalprice double")
    log.append(orders.filter("o_totalprice > 150000"), "first", key=["o_orderkey"])
    batch = S.table(s, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_totalprice")
    stored = log.read().agg(F.lit("rows").alias("rule"), F.lit("stored").alias("value"), F.count("*").alias("n"))
    try:
        log.append(batch, "second", key=["o_orderkey"], references={"o_custkey": (parents, "c_custkey")})
    except D.Refused:
        pass
    after = log.read().agg(F.lit("rows").alias("rule"), F.lit("stored").alias("value"), F.count("*").alias("n"))
    return D.batch_faults(batch, ["o_orderkey"], log.read(), {"o_custkey": (parents, "c_custkey")}).unionByName(after.join(stored, ["rule", "value", "n"]))


@query("SELECT 1 AS run_id, 0 AS finished, CAST(NULL AS BIGINT) AS entities UNION ALL SELECT 2, 1, count(*) FROM customer")
def q_run_states(s, d):
    """A load that fails leaves its row unfinished; the next one closes only its own."""
    runs = D.Runs(s, D.scratch(s, "runs"))
    source = f"{d}/customer.parquet"

    def fails():
        raise OSError("the source went away")

    try:
        D.recorded(runs, source, fails)
    except OSError:
        pass
    D.recorded(runs, source, lambda: catalogue.load_tables(s, d))
    return runs.read().select("run_id", F.col("finished_at").isNotNull().cast("int").alias("finished"), F.get_json_object("row_counts", "$.entities").cast("long").alias("entities"))


@query(
    "SELECT 'entity' AS name, c_custkey AS id, c_name || '|' || c_custkey || '.com' AS row FROM customer UNION ALL SELECT 'alias', c_custkey, alias || '|' || trim(regexp_replace(lower(alias), '[^a-z0-9_]+', ' ', 'g')) FROM (SELECT c_custkey, unnest([c_name, c_name || ' one']) AS alias FROM customer)"
    " UNION ALL SELECT 'observation', observation_id, entity_id || '|' || CAST(meeting_date AS VARCHAR) || '|' || name || '|' || stage_id FROM kept"
    " UNION ALL SELECT 'review_item', entity_id, 'dual_listing' FROM kept GROUP BY entity_id, meeting_date HAVING count(*) > 1 AND count(DISTINCT name) > 1 UNION ALL SELECT 'review_item', entity_id, CASE WHEN stage_id > f THEN 'stage_jump' ELSE 'stage_regression' END FROM lchanges WHERE stage_id - f > 2 OR stage_id < f UNION ALL SELECT 'review_item', c_custkey, 'removal_proposal' FROM customer WHERE c_custkey % 100 = 0"
)
def q_load_tables(s, d):
    """The rows of the load's tables."""
    t = catalogue.load_tables(s, d)
    line = lambda name, key, *cells: t[name].select(F.lit(name).alias("name"), F.col(key).alias("id"), F.concat_ws("|", *(F.col(c).cast("string") for c in cells)).alias("row"))
    parts = [line("entity", "entity_id", "canonical_name", "domain"), line("alias", "entity_id", "alias_text", "alias_norm"), line("observation", "observation_id", "entity_id", "meeting_date", "name", "stage_id"), line("review_item", "entity_id", "kind")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
