"""Named queries over the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import funnel as V
from ..operators import history as H
from ..operators import ingest as I
from ..operators import metrics as M
from ..operators import report as P
from ..operators import resolve as R
from ..operators import screen as C
from ..operators import validate as L
from ..sources import bindings as B
from ..sources import tables as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The bindings of sources.bindings in SQL.
CTE = {
    "obs": "SELECT event_id AS observation_id, user_id AS entity_id, CAST(ts AS DATE) AS meeting_date, CASE WHEN event_type = 'purchase' THEN CASE WHEN value >= 250 THEN 7 WHEN value >= 200 THEN 6 WHEN value >= 120 THEN 5 ELSE 4 END WHEN event_type = 'signup' THEN 3 WHEN event_type = 'click' THEN 2 ELSE 1 END AS stage_id, CASE WHEN value >= 100 THEN 1 ELSE 0 END AS is_bold, CAST(json_extract_string(props, '$.k') AS INT) AS slide_page, event_type AS name_on_slide FROM events",
    "obs_o": "SELECT o_orderkey AS observation_id, o_custkey AS entity_id, CAST(o_orderdate AS DATE) AS meeting_date, 6 - CAST(substr(o_orderpriority, 1, 1) AS INT) AS stage_id FROM orders",
    "stages": "SELECT * FROM (VALUES (1, 'Meetings This Week'), (2, 'Hold / Nurture'), (3, 'NewCo / Fellows'), (4, 'Preliminary Diligence'), (5, 'Deep Diligence'), (6, 'Negotiate / Offer'), (7, 'Legal Diligence / Def Docs')) s(stage_id, stage_name)",
    "funnel": "SELECT entity_id, count(*) AS appearances, min(meeting_date) AS first_seen, max(meeting_date) AS last_seen, max(stage_id) AS furthest, sum(is_bold) AS bold FROM obs GROUP BY 1",
    "fv": "SELECT o_orderkey AS value_id, o_custkey AS entity_id, 'priority' AS field, o_orderpriority AS value_text, CAST(o_orderdate AS DATE) AS created_at FROM orders",
    "perday": "SELECT entity_id, meeting_date, max(stage_id) AS stage_id, max(is_bold) AS bold FROM obs GROUP BY 1, 2",
    "changes": "SELECT * FROM (SELECT *, lag(stage_id) OVER w AS from_stage, lag(meeting_date) OVER w AS from_date FROM obs WINDOW w AS (PARTITION BY entity_id ORDER BY meeting_date, observation_id)) WHERE from_stage IS NOT NULL AND from_stage <> stage_id",
    "daily": "SELECT * FROM (SELECT *, lag(stage_id) OVER w AS from_stage, lag(meeting_date) OVER w AS from_date FROM perday WINDOW w AS (PARTITION BY entity_id ORDER BY meeting_date)) WHERE from_stage IS NOT NULL",
    "disc": "SELECT entity_id, max(is_bold) AS discussed, sum(is_bold) AS times, min(CASE WHEN is_bold = 1 THEN meeting_date END) AS first_discussed, max(CASE WHEN is_bold = 1 THEN meeting_date END) AS last_discussed FROM obs GROUP BY 1",
    "dom": "SELECT page_id, url, nullif(split_part(lower(regexp_replace(regexp_replace(regexp_replace(trim(url), '^https?://', '', 'i'), '^www\\.', '', 'i'), '/+$', '')), '/', 1), '') AS domain FROM pages",
    "names": "SELECT DISTINCT name FROM (SELECT p_name AS name FROM part UNION ALL SELECT unnest(string_split(p_name, ' ')) FROM part)",
    "pk": "SELECT p_name AS name, min(p_partkey) AS id FROM part GROUP BY 1",
    "query_side": "SELECT id AS qid, 0 AS pos, CASE WHEN id % 4 = 0 THEN name || ' labs' WHEN id % 4 = 1 THEN split_part(name, ' ', 1) ELSE name END AS name FROM pk UNION ALL SELECT id, 1, name FROM pk WHERE id % 5 = 0",
    "target_side": "SELECT id AS rid, CASE WHEN id % 3 = 0 THEN 'old ' || name WHEN id % 2 = 0 THEN name || ' Inc' ELSE name END AS name, true AS canonical, id AS seq FROM pk UNION ALL SELECT id, name || ' holdings', false, id + 1000000 FROM pk WHERE id % 7 = 0",
}
_STEM = "CASE WHEN len(list_filter(string_split({k}, ' '), lambda t: NOT list_contains([" + ", ".join(f"'{t}'" for t in X.SUFFIX_TOKENS) + "], t))) = 0 THEN {k} ELSE array_to_string(list_filter(string_split({k}, ' '), lambda t: NOT list_contains([" + ", ".join(f"'{t}'" for t in X.SUFFIX_TOKENS) + "], t)), ' ') END"
#: A decomposed accent is a gap, as it is no letter or digit.
_NORM = "trim(regexp_replace(strip_accents(regexp_replace(lower({x}), '([àâäáãåçèéêëìíîïñòóôöõùúûüýÿ])', '\\1 ', 'g')), '[^a-z0-9]+', ' ', 'g'))"
CTE |= {
    "tk": "SELECT rid, name, canonical, key, " + _STEM.format(k="key") + " AS stem FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY canonical DESC, seq) AS n FROM (SELECT *, " + _NORM.format(x="name") + " AS key FROM target_side)) WHERE n = 1 AND key <> ''",
    "qk": "SELECT qid, pos, " + _NORM.format(x="name") + " AS key FROM query_side",
    "t_exact": "SELECT q.qid, 'exact' AS tier, t.rid, CAST(NULL AS VARCHAR) AS candidates FROM (SELECT qid, arg_min(key, pos) AS key FROM qk GROUP BY 1) q JOIN tk t ON t.key = q.key AND t.canonical",
    "q1": "SELECT * FROM qk WHERE qid NOT IN (SELECT qid FROM t_exact)",
    "t_alias": "SELECT q.qid, 'alias' AS tier, arg_min(t.rid, q.pos) AS rid, CAST(NULL AS VARCHAR) AS candidates FROM q1 q JOIN tk t USING (key) GROUP BY 1",
    "q2": "SELECT * FROM q1 WHERE qid NOT IN (SELECT qid FROM t_alias)",
    "t_suffix": "SELECT qid, CASE WHEN count(DISTINCT other) = 1 THEN 'suffix' ELSE 'ambiguous' END AS tier, CASE WHEN count(DISTINCT other) = 1 THEN min(rid) END AS rid, CASE WHEN count(DISTINCT other) > 1 THEN array_to_string(list_sort(list_distinct(list(name))), '|') END AS candidates FROM (SELECT q.qid, t.key AS other, t.rid, t.name FROM (SELECT qid, " + _STEM.format(k="key") + " AS stem FROM q2) q JOIN tk t USING (stem)) GROUP BY 1",
    "q3": "SELECT * FROM q2 WHERE qid NOT IN (SELECT qid FROM t_suffix)",
    "near": "SELECT q.qid, t.key AS other, t.rid, t.name FROM (SELECT qid, left(key, CAST(n AS INT)) AS begun FROM (SELECT qid, key, unnest(range(8, length(key) + 1)) AS n FROM q3 WHERE length(key) >= 8)) q JOIN tk t ON t.key = q.begun UNION SELECT q.qid, t.key, t.rid, t.name FROM q3 q JOIN (SELECT key, rid, name, left(key, CAST(n AS INT)) AS begun FROM (SELECT *, unnest(range(8, length(key) + 1)) AS n FROM tk WHERE length(key) >= 8)) t ON q.key = t.begun",
    "t_prefix": "SELECT qid, CASE WHEN count(DISTINCT other) = 1 THEN 'prefix' ELSE 'ambiguous' END AS tier, CASE WHEN count(DISTINCT other) = 1 THEN min(rid) END AS rid, CASE WHEN count(DISTINCT other) > 1 THEN array_to_string(list_sort(list_distinct(list(name))), '|') END AS candidates FROM near GROUP BY 1",
    "ladder": "SELECT * FROM t_exact UNION ALL SELECT * FROM t_alias UNION ALL SELECT * FROM t_suffix UNION ALL SELECT * FROM t_prefix",
    "matched": "SELECT * FROM ladder UNION ALL SELECT DISTINCT qid, 'none', CAST(NULL AS BIGINT), NULL FROM qk WHERE qid NOT IN (SELECT qid FROM ladder)",
    "cohort": "SELECT DISTINCT entity_id FROM obs WHERE stage_id = 7",
    "taken": "SELECT entity_id, entity_id - 1 AS target_id FROM (SELECT DISTINCT entity_id FROM obs) WHERE entity_id % 2 = 1 AND entity_id NOT IN (SELECT entity_id FROM cohort) AND entity_id - 1 IN (SELECT entity_id FROM cohort)",
    "scr": "SELECT meeting_date, stage_id, is_bold, entity_id, observation_id FROM obs WHERE stage_id >= 4 AND entity_id IN (SELECT entity_id FROM cohort) UNION ALL SELECT o.meeting_date, o.stage_id, o.is_bold, t.target_id, o.observation_id FROM obs o JOIN taken t USING (entity_id) WHERE o.stage_id >= 4",
    "counted": "SELECT c.entity_id, coalesce(n, 0) AS appearances, CAST(first AS VARCHAR) AS first, CAST(last AS VARCHAR) AS last, latest, furthest, coalesce(times, 0) AS times, coalesce(od, 0) AS observed_deep, coalesce(ol, 0) AS observed_legal, CASE WHEN coalesce(furthest, 0) >= 5 THEN 1 ELSE 0 END AS reached_deep FROM cohort c LEFT JOIN (SELECT entity_id, count(*) AS n, min(meeting_date) AS first, max(meeting_date) AS last, arg_max(s, meeting_date) AS latest, max(s) AS furthest, sum(b) AS times, max(CASE WHEN s = 5 THEN 1 ELSE 0 END) AS od, max(CASE WHEN s = 7 THEN 1 ELSE 0 END) AS ol FROM (SELECT entity_id, meeting_date, max(stage_id) AS s, max(is_bold) AS b FROM scr GROUP BY 1, 2) GROUP BY 1) USING (entity_id)",
}


def _with(sql: str) -> str:
    """The SQL with the bindings it names, and those they name, before it."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in CTE:
            if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text) and name not in needed:
                need(CTE[name])
                if name not in needed:
                    needed.append(name)

    need(sql)
    return ("WITH " + ", ".join(f"{n} AS ({CTE[n]})" for n in needed) + " " if needed else "") + sql


def query(sql: str | None = None):
    def keep(f):
        name = f.__name__.removeprefix("q_")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = _with(sql)
        return f

    return keep


_RUNGS = list(V.RUNGS.items())
_OBSERVED = ", ".join(f"max(CASE WHEN stage_id = {k} THEN 1 ELSE 0 END) AS observed_{r}, max(CASE WHEN stage_id >= {k} THEN 1 ELSE 0 END) AS reached_{r}" for k, r in _RUNGS)


@query(f"SELECT entity_id, count(*) AS appearances, CAST(min(meeting_date) AS VARCHAR) AS first_seen, CAST(max(meeting_date) AS VARCHAR) AS last_seen, max(stage_id) AS furthest, sum(is_bold) AS bold, {_OBSERVED}, " + ", ".join(f"CAST(min(CASE WHEN stage_id >= {k} THEN meeting_date END) AS VARCHAR) AS first_{r}" for k, r in _RUNGS) + " FROM obs GROUP BY 1")
def q_funnel_by_entity(s, d):
    return V.entity_funnel(B.observations(s, d))


@query("SELECT " + ", ".join(f"sum({k}_{r}) AS {k}_{r}" for k in ("observed", "reached") for _, r in _RUNGS) + f" FROM (SELECT entity_id, {_OBSERVED} FROM obs GROUP BY 1)")
def q_funnel_totals(s, d):
    return M.funnel_totals(V.entity_funnel(B.observations(s, d)))


@query("SELECT f.furthest AS stage_id, stage_name, count(*) AS entities FROM funnel f JOIN stages s ON s.stage_id = f.furthest GROUP BY 1, 2")
def q_furthest_distribution(s, d):
    return M.furthest_distribution(V.entity_funnel(B.observations(s, d)), S.vocabulary(s, "stage"))


_REACH = "SELECT s.stage_id, (SELECT count(*) FROM (SELECT stage_id, row_number() OVER (PARTITION BY entity_id ORDER BY meeting_date DESC, observation_id DESC) AS n FROM obs) l WHERE n = 1 AND l.stage_id = s.stage_id) AS current, (SELECT count(*) FROM funnel f WHERE f.furthest >= s.stage_id) AS reached FROM stages s"


@query(_REACH)
def q_current_vs_reached(s, d):
    return M.current_and_reached(B.observations(s, d), S.vocabulary(s, "stage"))


@query(f"SELECT stage_id, reached, before, CASE WHEN before = 0 THEN NULL ELSE CAST(round_even(reached / before * 100, 0) AS BIGINT) END AS pct FROM (SELECT stage_id, reached, lag(reached) OVER (ORDER BY stage_id) AS before FROM ({_REACH})) WHERE before IS NOT NULL")
def q_stage_conversion(s, d):
    return M.conversion(q_current_vs_reached(s, d))


@query("SELECT observation_id, entity_id, CASE WHEN observation_id % 50 = 0 THEN 5 ELSE stage_id END AS stage_id, CASE WHEN observation_id % 70 = 0 THEN 1 ELSE is_bold END AS is_bold FROM obs")
def q_effective_observations(s, d):
    return V.effective(B.observations(s, d), B.overrides(s, d)).select("observation_id", "entity_id", "stage_id", "is_bold")


@query("SELECT observation_id, entity_id, f.stage_name AS from_name, t.stage_name AS to_name, c.stage_id - from_stage AS delta, CAST(meeting_date AS VARCHAR) AS meeting_date FROM changes c JOIN stages f ON f.stage_id = c.from_stage JOIN stages t ON t.stage_id = c.stage_id")
def q_stage_transitions(s, d):
    st = F.broadcast(S.vocabulary(s, "stage"))
    c = V.transitions(B.observations(s, d)).join(st.selectExpr("stage_id from_stage", "stage_name from_name"), "from_stage").join(st.withColumnRenamed("stage_name", "to_name"), "stage_id")
    return c.select("observation_id", "entity_id", "from_name", "to_name", "delta", F.col("meeting_date").cast("string").alias("meeting_date"))


@query("SELECT observation_id, entity_id, CASE WHEN stage_id > from_stage THEN 'stage_jump' ELSE 'stage_regression' END AS kind, stage_id - from_stage AS delta FROM changes WHERE stage_id - from_stage > 2 OR stage_id < from_stage")
def q_stage_jumps(s, d):
    return V.jumps(V.transitions(B.observations(s, d))).select("observation_id", "entity_id", "kind", "delta")


@query("SELECT entity_id, CAST(from_date AS VARCHAR) AS from_date, CAST(meeting_date AS VARCHAR) AS meeting_date, stage_id - from_stage AS delta FROM daily")
def q_date_transitions(s, d):
    return V.date_transitions(B.observations(s, d)).select("entity_id", F.col("from_date").cast("string").alias("from_date"), F.col("meeting_date").cast("string").alias("meeting_date"), "delta")


@query("SELECT entity_id, observation_id, stage_id FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY meeting_date DESC, observation_id DESC) AS n FROM obs) WHERE n = 1")
def q_latest_stage(s, d):
    return V.latest(B.observations(s, d)).select("entity_id", "observation_id", "stage_id")


@query("SELECT entity_id, stage_id, count(*) AS meetings FROM obs GROUP BY 1, 2")
def q_dwell(s, d):
    return V.dwell(B.observations(s, d))


@query("SELECT stage_id, stage_name, median(meetings) AS median_meetings FROM (SELECT entity_id, stage_id, count(*) AS meetings FROM obs GROUP BY 1, 2) JOIN stages USING (stage_id) GROUP BY 1, 2")
def q_dwell_median(s, d):
    return M.dwell_medians(V.dwell(B.observations(s, d)), S.vocabulary(s, "stage"))


@query("SELECT from_stage, stage_id AS to_stage, count(*) AS changes, round(avg(date_diff('day', from_date, meeting_date)), 4) AS mean_days, list_sort(list(date_diff('day', from_date, meeting_date)))[count(*) // 2 + 1] AS upper_median, min(date_diff('day', from_date, meeting_date)) AS min_days, max(date_diff('day', from_date, meeting_date)) AS max_days FROM daily WHERE stage_id <> from_stage GROUP BY 1, 2")
def q_transition_gap_stats(s, d):
    return M.gap_statistics(V.date_transitions(B.observations(s, d)))


@query("SELECT entity_id, discussed, times, CAST(first_discussed AS VARCHAR) AS first_discussed, CAST(last_discussed AS VARCHAR) AS last_discussed FROM disc")
def q_discussion_summary(s, d):
    return V.entity_discussion(B.observations(s, d))


@query("SELECT count(*) FILTER (WHERE discussed = 1) AS entities_discussed, sum(times) AS bold_appearances FROM disc")
def q_discussion_totals(s, d):
    return M.discussion_totals(V.entity_discussion(B.observations(s, d)))


@query("SELECT CASE WHEN times = 0 THEN '0' WHEN times <= 2 THEN '1-2' ELSE '3+' END AS bucket, count(*) AS entities FROM disc GROUP BY 1")
def q_discussion_buckets(s, d):
    return M.discussion_buckets(V.entity_discussion(B.observations(s, d)))


@query("SELECT strftime(first, '%Y-%m') AS month, count(*) AS entities FROM (SELECT entity_id, min(CASE WHEN stage_id >= 4 THEN meeting_date END) AS first FROM obs_o GROUP BY 1) GROUP BY 1")
def q_monthly_intake(s, d):
    return M.monthly_intake(B.orders_log(s, d))


@query("SELECT coalesce(a.month, b.month) AS month, coalesce(a.n, 0) AS discussed, coalesce(b.n, 0) AS intake FROM (SELECT strftime(meeting_date, '%Y-%m') AS month, count(*) AS n FROM (SELECT DISTINCT entity_id, meeting_date FROM obs WHERE is_bold = 1) GROUP BY 1) a FULL JOIN (SELECT strftime(first, '%Y-%m') AS month, count(*) AS n FROM (SELECT entity_id, min(CASE WHEN stage_id >= 4 THEN meeting_date END) AS first FROM obs GROUP BY 1) WHERE first IS NOT NULL GROUP BY 1) b ON a.month = b.month")
def q_monthly_volume(s, d):
    return M.monthly_volume(B.observations(s, d))


@query("SELECT entity_id, last_stage, date_diff('day', last_date, DATE '2024-02-15') AS days, CAST(since AS VARCHAR) AS since FROM (SELECT p.entity_id, l.last_stage, l.last_date, min(p.meeting_date) AS since FROM perday p JOIN (SELECT entity_id, max(meeting_date) AS last_date, arg_max(stage_id, meeting_date) AS last_stage FROM perday GROUP BY 1) l USING (entity_id) WHERE p.meeting_date > coalesce((SELECT max(x.meeting_date) FROM perday x WHERE x.entity_id = p.entity_id AND x.stage_id <> l.last_stage), DATE '1900-01-01') GROUP BY 1, 2, 3) ORDER BY days DESC, entity_id LIMIT 10")
def q_stalled_top10(s, d):
    run = V.trailing_run(V.per_date(B.observations(s, d)))
    return run.select("entity_id", "last_stage", F.datediff(F.lit("2024-02-15").cast("date"), "last_date").alias("days"), F.col("since").cast("string").alias("since")).orderBy(F.desc("days"), "entity_id").limit(10)


@query("SELECT entity_id, times FROM disc ORDER BY times DESC, entity_id LIMIT 10")
def q_discussed_top10(s, d):
    return V.entity_discussion(B.observations(s, d)).select("entity_id", "times").orderBy(F.desc("times"), "entity_id").limit(10)


@query("SELECT entity_id, value_id, value_text FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, field ORDER BY created_at DESC, value_id DESC) AS n FROM fv) WHERE n = 1")
def q_current_values(s, d):
    return H.current_values(B.field_values(s, d)).select("entity_id", "value_id", "value_text")


@query("SELECT value_id, CAST(lead(created_at) OVER w AS VARCHAR) AS superseded_at, lead(value_id) OVER w AS superseded_by FROM fv WINDOW w AS (PARTITION BY entity_id, field ORDER BY created_at, value_id)")
def q_value_history(s, d):
    return H.value_history(B.field_values(s, d)).select("value_id", F.col("superseded_at").cast("string").alias("superseded_at"), "superseded_by")


@query("SELECT user_id AS entity_id, arg_max(event_type, event_id) AS state, max(event_id) AS seq FROM events GROUP BY 1")
def q_gap_upsert(s, d):
    rows = S.table(s, d, "events").selectExpr("user_id entity_id", "event_type state", "event_id seq")
    return S.last_wins(rows, ["entity_id"], [F.desc("seq")])


@query("SELECT min(event_id) AS event_id, user_id, CAST(ts AS DATE)::VARCHAR AS day, event_type FROM events GROUP BY 2, 3, 4")
def q_first_wins_dedupe(s, d):
    rows = S.table(s, d, "events").selectExpr("event_id", "user_id", "cast(cast(ts as date) as string) day", "event_type")
    return S.first_wins(rows, ["user_id", "day", "event_type"], ["event_id"])


@query("SELECT c_custkey AS entity_id, 'name' AS field, c_name AS value_text FROM customer UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer UNION ALL SELECT c_custkey, 'nation', CAST(c_nationkey AS VARCHAR) FROM customer")
def q_wide_to_eav(s, d):
    return B.customer_fields(s, d)


_CELLS = "SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)"


@query(f"SELECT doc_id, CASE WHEN quality IS NULL THEN NULL WHEN quality = 0 THEN '0' ELSE CAST(quality AS VARCHAR) END AS shown, CASE WHEN quality = 0 THEN 'zero' WHEN quality IS NOT NULL THEN 'known' ELSE 'untracked' END AS state FROM ({_CELLS})")
def q_zero_or_value(s, d):
    c = B.quality_cells(s, d)
    zero = F.coalesce(F.col("quality") == 0, F.lit(False))
    return c.select("doc_id", H.shown(F.lit(None).cast("string"), F.col("quality"), zero).alias("shown"), H.cell_state(F.col("quality"), zero, F.lit(None).cast("string")).alias("state"))


@query(f"SELECT lang, count(*) FILTER (WHERE quality = 0) AS zero, count(*) FILTER (WHERE quality <> 0) AS known, count(*) FILTER (WHERE quality IS NULL) AS unchecked FROM ({_CELLS}) GROUP BY 1")
def q_three_state(s, d):
    c = B.quality_cells(s, d)
    return c.groupBy("lang").agg(F.count_if(F.col("quality") == 0).alias("zero"), F.count_if(F.col("quality") != 0).alias("known"), F.count_if(F.col("quality").isNull()).alias("unchecked"))


_VALUES = "SELECT doc_id AS entity_id, 'quality' AS field, CAST(quality AS DOUBLE) AS value_num FROM labels UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS DOUBLE) FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 'long', CAST(n_chars AS DOUBLE) FROM documents WHERE n_chars > 2000"


def _values(s, d):
    lab, docs = S.table(s, d, "labels"), S.table(s, d, "documents")
    rows = lab.selectExpr("doc_id entity_id", "'quality' field", "double(quality) value_num").unionByName(lab.filter("toxic = 1").selectExpr("doc_id entity_id", "'toxic' field", "double(toxic) value_num"))
    return rows.unionByName(docs.filter("n_chars > 2000").selectExpr("doc_id entity_id", "'long' field", "double(n_chars) value_num")).withColumn("value_text", F.lit(None).cast("string"))


@query(f"SELECT t.lang, f.field, t.total, coalesce(g.present, 0) AS present, CASE WHEN t.total = 0 THEN NULL ELSE CAST(round_even(coalesce(g.present, 0) / t.total * 100, 0) AS BIGINT) END AS pct FROM (SELECT lang, count(*) AS total FROM documents GROUP BY 1) t CROSS JOIN (SELECT unnest(['quality', 'toxic', 'long', 'owner']) AS field) f LEFT JOIN (SELECT lang, field, count(DISTINCT entity_id) AS present FROM ({_VALUES}) v JOIN documents d ON d.doc_id = v.entity_id GROUP BY 1, 2) g ON g.lang = t.lang AND g.field = f.field")
def q_coverage_by_cohort(s, d):
    docs = S.table(s, d, "documents").selectExpr("doc_id entity_id", "lang")
    return M.field_coverage(docs, _values(s, d), ["lang"], ["quality", "toxic", "long", "owner"]).withColumn("pct", X.percent(F.col("present"), F.col("total"))).select("lang", "field", "total", "present", "pct")


_GAPS = f"SELECT d.doc_id AS entity_id, 3 - count(DISTINCT v.field) AS gaps FROM documents d LEFT JOIN ({_VALUES}) v ON v.entity_id = d.doc_id GROUP BY 1"


@query(_GAPS)
def q_gap_counts(s, d):
    return M.gap_counts(S.table(s, d, "documents").selectExpr("doc_id entity_id"), _values(s, d), ["quality", "toxic", "long"])


@query(f"SELECT g.entity_id, gaps, CASE WHEN gaps = 0 THEN 'P4' WHEN coalesce(furthest, 0) >= 5 THEN 'P1 advanced' WHEN coalesce(discussed, 0) = 1 THEN 'P1 discussed' WHEN coalesce(furthest, 0) = 4 AND gaps >= 3 THEN 'P2' WHEN gaps >= 4 THEN 'P3' ELSE 'P4' END AS priority FROM ({_GAPS}) g LEFT JOIN funnel f USING (entity_id) LEFT JOIN disc x USING (entity_id)")
def q_enrichment_priority(s, d):
    o = B.observations(s, d)
    return M.priority(q_gap_counts(s, d), V.entity_funnel(o), V.entity_discussion(o))


@query("SELECT entity_id, CAST(meeting_date AS VARCHAR) AS meeting_date FROM (SELECT entity_id, CAST(prev + CAST(7 * k AS INT) AS DATE) AS meeting_date FROM (SELECT entity_id, prev, unnest(range(1, CAST(round_even(gap / 7, 0) AS BIGINT))) AS k FROM (SELECT entity_id, meeting_date AS prev, date_diff('day', meeting_date, lead(meeting_date) OVER (PARTITION BY entity_id ORDER BY meeting_date)) AS gap FROM (SELECT DISTINCT entity_id, meeting_date FROM obs_o)) WHERE gap > 8)) a WHERE NOT EXISTS (SELECT 1 FROM obs_o o WHERE o.entity_id = a.entity_id AND o.meeting_date = a.meeting_date)")
def q_calendar_gap_fill(s, d):
    dates = B.orders_log(s, d).select("entity_id", "meeting_date")
    return H.fill_calendar(dates, "entity_id").select("entity_id", F.col("meeting_date").cast("string").alias("meeting_date"))


@query("SELECT CAST(meeting_date AS VARCHAR) AS meeting_date, min(slide_page) AS first_page, row_number() OVER (ORDER BY meeting_date) - 1 AS place FROM obs GROUP BY obs.meeting_date")
def q_calendar_index(s, d):
    return H.calendar_index(B.observations(s, d)).select(F.col("meeting_date").cast("string").alias("meeting_date"), "first_page", F.col("place").cast("long").alias("place"))


@query("SELECT page_id, domain FROM dom")
def q_domains(s, d):
    return B.page_domains(s, d).select("page_id", "domain")


@query("SELECT domain, count(*) AS n, array_to_string(list_sort(list(page_id)), ',') AS members FROM dom WHERE domain IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def q_domain_families(s, d):
    return R.domain_families(B.page_domains(s, d).selectExpr("page_id entity_id", "domain"))


_SCORE = "CASE WHEN length({n}) - length(replace({n}, '(', '')) <> length({n}) - length(replace({n}, ')', '')) OR length({n}) - length(replace({n}, '[', '')) <> length({n}) - length(replace({n}, ']', '')) OR regexp_matches(rtrim({n}), '[/:,-]$') OR regexp_matches({n}, '[A-Za-z]\\s*[/,:]\\s*[A-Za-z]') THEN 0 ELSE 1 END AS clean, len(regexp_split_to_array(trim({n}), '\\s+')) AS words, length({n}) AS chars"
@query("SELECT p.page_id AS entity_id, k.target_id, p.domain, 0.95::DOUBLE AS confidence FROM dom p JOIN (SELECT domain, arg_max(page_id, (clean, words, chars, -page_id)) AS target_id FROM (SELECT page_id, domain, " + _SCORE.format(n="url") + " FROM dom) WHERE domain IS NOT NULL GROUP BY 1 HAVING count(*) > 1) k USING (domain) WHERE p.page_id <> k.target_id")
def q_domain_merge_pairs(s, d):
    return R.domain_pairs(B.page_domains(s, d).selectExpr("page_id entity_id", "url name", "domain"))


@query("SELECT a.name, b.name AS full_name, CASE WHEN starts_with(b.name, a.name || ' ') THEN 'prefix' ELSE 'suffix' END AS rule, CASE WHEN contains(a.name, ' ') THEN 0.6::DOUBLE ELSE 0.75::DOUBLE END AS confidence FROM names a JOIN names b ON length(b.name) > length(a.name) AND (starts_with(b.name, a.name || ' ') OR ends_with(b.name, ' ' || a.name))")
def q_word_fragment_merges(s, d):
    return R.fragment_pairs(B.names(s, d))


#: Every line of every text, whole and as it stands.
_WHOLE = "SELECT doc_id, unnest(range(len(parts))) AS line, unnest(parts) AS name FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)"


def _whole(s, d):
    return S.table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "name"))


@query("SELECT doc_id, line, CASE WHEN trim(name) = '' THEN 0 ELSE words END AS words, clean, chars FROM (SELECT doc_id, line, name, " + _SCORE.format(n="name") + f" FROM ({_WHOLE}))")
def q_canonical_scores(s, d):
    return _whole(s, d).select("doc_id", "line", X.canonical_score(F.col("name")).alias("c")).selectExpr("doc_id", "line", "c.words", "c.clean", "c.chars")


@query(f"SELECT doc_id, line, trim(regexp_replace(regexp_replace(replace(lower(trim(name)), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS norm FROM ({_WHOLE})")
def q_name_norm(s, d):
    return _whole(s, d).select("doc_id", "line", X.norm_name(F.col("name")).alias("norm"))


@query(f"SELECT doc_id, line, array_to_string(list_transform(list_sort(list_distinct(list_transform(parts, lambda t: replace(lower(t), 'ß', 'ss')))), lambda k: parts[list_position(list_transform(parts, lambda t: replace(lower(t), 'ß', 'ss')), k)]), ', ') AS tags FROM (SELECT doc_id, line, list_filter(list_transform(string_split(replace(name, ',', ' '), ' '), lambda t: trim(regexp_replace(t, '\\s+', ' ', 'g'))), lambda t: t <> '') AS parts FROM ({_WHOLE}))")
def q_tag_canonical(s, d):
    return _whole(s, d).select("doc_id", "line", F.array_join(X.tags(F.translate("name", " ", ",")), ", ").alias("tags"))


@query(f"SELECT doc_id, line, array_to_string(parts, '|') AS parts FROM (SELECT doc_id, line, name, list_filter(list_transform(regexp_split_to_array(name, '[/,]'), lambda p: trim(p, ' /,:')), lambda p: p <> '') AS parts FROM ({_WHOLE})) WHERE regexp_matches(name, '[A-Za-z]\\s*[/,]\\s*[A-Za-z]') AND len(parts) >= 2")
def q_group_split(s, d):
    return _whole(s, d).filter(X.is_grouped(F.col("name"))).select("doc_id", "line", F.array_join(X.group_parts(F.col("name")), "|").alias("parts"))


_ALIASES = "SELECT p_name AS alias_text, min(p_partkey) AS entity_id FROM part GROUP BY 1 UNION ALL SELECT upper(p_name), min(p_partkey) + 1 FROM part GROUP BY p_name HAVING min(p_partkey) % 3 = 0"
_SEEN = "SELECT p_partkey AS row_id, CASE WHEN p_partkey % 4 = 0 THEN upper(p_name) WHEN p_partkey % 4 = 1 THEN p_name || '!' WHEN p_partkey % 4 = 2 THEN p_name ELSE p_name || ' x' END AS name FROM part"
_LOW = "trim(regexp_replace(regexp_replace(lower(trim({x})), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _aliases(s, d):
    p = S.table(s, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("entity_id"))
    return p.selectExpr("p_name alias_text", "entity_id").unionByName(p.filter("entity_id % 3 = 0").selectExpr("upper(p_name) alias_text", "entity_id + 1 entity_id"))


@query(f"WITH al AS ({_ALIASES}), seen AS ({_SEEN}) SELECT s.row_id, s.name, coalesce(e.id, n.id) AS entity_id, CASE WHEN e.id IS NOT NULL THEN 'exact' WHEN n.id IS NOT NULL THEN 'normalised' ELSE 'unresolved' END AS method FROM seen s LEFT JOIN (SELECT alias_text, min(entity_id) AS id FROM al GROUP BY 1) e ON e.alias_text = s.name LEFT JOIN (SELECT {_LOW.format(x='alias_text')} AS k, min(entity_id) AS id FROM al GROUP BY 1 HAVING count(DISTINCT entity_id) = 1) n ON n.k = {_LOW.format(x='s.name')}")
def q_alias_resolution(s, d):
    seen = S.table(s, d, "part").selectExpr("p_partkey row_id", "CASE WHEN p_partkey % 4 = 0 THEN upper(p_name) WHEN p_partkey % 4 = 1 THEN concat(p_name, '!') WHEN p_partkey % 4 = 2 THEN p_name ELSE concat(p_name, ' x') END name")
    return R.resolve_aliases(seen, _aliases(s, d))


_DOUBLES = f"WITH al AS ({_ALIASES}), en AS (SELECT p_partkey AS entity_id, p_name AS canonical_name, lower(p_brand) || '.com' AS domain FROM part WHERE p_size <> 50), asked AS (SELECT s_suppkey AS ask_id, CASE WHEN s_suppkey % 5 = 0 THEN 'new ' || p_name ELSE p_name END AS name, CASE WHEN s_suppkey % 5 = 0 THEN 'new.com' ELSE lower(p_brand) || '.com' END AS domain FROM supplier JOIN part ON p_partkey = s_suppkey), hits AS (SELECT ask_id, entity_id, 1 AS prio FROM asked JOIN en ON lower(trim(canonical_name)) = lower(trim(name)) UNION ALL SELECT ask_id, al.entity_id, 2 FROM asked JOIN al ON lower(trim(alias_text)) = lower(trim(name)) JOIN en USING (entity_id) UNION ALL SELECT ask_id, entity_id, 3 FROM asked JOIN en USING (domain)) SELECT ask_id, entity_id, CASE min(prio) WHEN 1 THEN 'name' WHEN 2 THEN 'alias' ELSE 'domain' END AS matched_on FROM hits GROUP BY 1, 2"


@query(_DOUBLES)
def q_duplicate_finder(s, d):
    part = S.table(s, d, "part")
    entities = part.selectExpr("p_partkey entity_id", "p_name canonical_name", "concat(lower(p_brand), '.com') domain", "CASE WHEN p_size = 50 THEN 1L END merged_into")
    asked = S.table(s, d, "supplier").join(part, F.col("p_partkey") == F.col("s_suppkey")).selectExpr("s_suppkey ask_id", "CASE WHEN s_suppkey % 5 = 0 THEN concat('new ', p_name) ELSE p_name END name", "CASE WHEN s_suppkey % 5 = 0 THEN 'new.com' ELSE concat(lower(p_brand), '.com') END domain")
    return R.find_duplicates(asked, entities, _aliases(s, d))


@query("SELECT qid, tier, rid, candidates FROM matched")
def q_match_ladder(s, d):
    return R.match_ladder(*B.ladder_sides(s, d))


#: Names with accents, one for every two neighbouring words of any text.
CTE["pairs"] = "SELECT name, min(id) AS id FROM (SELECT doc_id * 1000000 + i AS id, w[i] || ' ' || w[i + 1] AS name FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents))) GROUP BY 1"
CTE["query_side_w"] = "SELECT id AS qid, 0 AS pos, CASE WHEN id % 4 = 0 THEN '(' || name || ')' WHEN id % 4 = 1 THEN name || ' labs' WHEN id % 4 = 2 THEN name || 'ing' ELSE 'new ' || name END AS name FROM pairs"
CTE["target_side_w"] = "SELECT id AS rid, CASE WHEN id % 5 = 0 THEN name || ' Inc' WHEN id % 5 = 1 THEN name || ' Group' ELSE name END AS name, true AS canonical, id AS seq FROM pairs"
for _c in ("tk", "qk", "t_exact", "q1", "t_alias", "q2", "t_suffix", "q3", "near", "t_prefix", "ladder", "matched"):
    _sql = CTE[_c]
    for _n in ("target_side", "query_side", "tk", "qk", "t_exact", "q1", "t_alias", "q2", "t_suffix", "q3", "near", "t_prefix", "ladder", "matched"):
        _sql = re.sub(rf"\b(FROM|JOIN) {_n}\b", rf"\1 {_n}_w", _sql)
    CTE[f"{_c}_w"] = _sql


@query("SELECT qid, tier, rid, candidates FROM matched_w")
def q_match_ladder_wide(s, d):
    w = S.table(s, d, "documents").select("doc_id", F.split("text", " ").alias("w")).filter("size(w) > 1")
    pairs = w.select("doc_id", F.posexplode(F.expr("transform(sequence(1, size(w) - 1), i -> concat(w[i - 1], ' ', w[i]))")).alias("i", "name"))
    pairs = pairs.groupBy("name").agg(F.min(F.expr("doc_id * 1000000 + i + 1")).alias("id"))
    query = pairs.selectExpr("id qid", "0 pos", "CASE WHEN id % 4 = 0 THEN concat('(', name, ')') WHEN id % 4 = 1 THEN concat(name, ' labs') WHEN id % 4 = 2 THEN concat(name, 'ing') ELSE concat('new ', name) END name")
    target = pairs.selectExpr("id rid", "CASE WHEN id % 5 = 0 THEN concat(name, ' Inc') WHEN id % 5 = 1 THEN concat(name, ' Group') ELSE name END name", "true canonical", "id seq")
    return R.match_ladder(query, target)


@query("SELECT tier, count(*) AS n, count(rid) AS with_record FROM matched GROUP BY 1")
def q_match_tiers(s, d):
    return q_match_ladder(s, d).groupBy("tier").agg(F.count("*").alias("n"), F.count("rid").alias("with_record"))


@query("SELECT CASE WHEN a AND b THEN 'both' WHEN b THEN 'affinity' WHEN a THEN 'slides' ELSE 'neither' END AS segment, count(*) AS n FROM (SELECT qid, tier IN ('exact', 'alias', 'suffix', 'prefix') AS a, qid % 2 = 0 AS b FROM matched) GROUP BY 1")
def q_match_segments(s, d):
    one = q_match_ladder(s, d).select("qid", "tier")
    other = one.select("qid", F.when(F.col("qid") % 2 == 0, "exact").otherwise("none").alias("tier"))
    return R.segments(one.select("qid"), one, other).groupBy("segment").agg(F.count("*").alias("n"))


@query("SELECT rid AS company, min(qid) AS folder, count(*) AS folders FROM matched WHERE rid IS NOT NULL GROUP BY 1")
def q_folder_annotation(s, d):
    return q_match_ladder(s, d).filter("rid is not null").groupBy(F.col("rid").alias("company")).agg(F.min("qid").alias("folder"), F.count("*").alias("folders"))


@query("SELECT entity_id, CAST(meeting_date AS VARCHAR) AS meeting_date, count(*) AS n, array_to_string(list_sort(list_distinct(list(name_on_slide))), '|') AS spellings, min(slide_page) AS slide_page FROM obs GROUP BY 1, obs.meeting_date HAVING count(*) > 1 AND count(DISTINCT name_on_slide) > 1")
def q_dual_listing(s, d):
    g = B.observations(s, d).groupBy("entity_id", "meeting_date").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("name_on_slide")), "|").alias("spellings"), F.min("slide_page").alias("slide_page"), F.count_distinct("name_on_slide").alias("k"))
    return g.filter("n > 1 and k > 1").select("entity_id", F.col("meeting_date").cast("string").alias("meeting_date"), "n", "spellings", "slide_page")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')")
def q_enum_violations(s, d):
    allowed = s.sql("SELECT * FROM VALUES ('BUILDING'), ('MACHINERY'), ('HOUSEHOLD') AS v(name)")
    return L.enum_violations(S.table(s, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", allowed).select("c_custkey", "c_mktsegment")


@query("SELECT doc_id, quality FROM labels WHERE (quality = 0 AND doc_id % 2 = 0) OR (doc_id % 2 = 1 AND quality <> 0)")
def q_zero_violations(s, d):
    rows = S.table(s, d, "labels").selectExpr("doc_id", "quality", "double(quality) value_num", "doc_id % 2 = 1 is_zero")
    return L.zero_violations(rows).select("doc_id", "quality")


@query("SELECT o_custkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def q_unique_violations(s, d):
    return L.unique_violations(S.table(s, d, "orders").selectExpr("o_custkey", "cast(cast(o_orderdate as date) as string) day"), ["o_custkey", "day"])


@query("SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25)")
def q_dangling_references(s, d):
    return L.dangling(S.table(s, d, "lineitem").select("l_partkey"), "l_partkey", S.table(s, d, "part").filter("p_size <= 25"), "p_partkey").distinct()


@query("SELECT m.entity_id, CAST(first_meeting AS VARCHAR) AS first_meeting FROM (SELECT entity_id, min(meeting_date) - CAST(entity_id % 3 - 1 AS INT) AS first_meeting, min(meeting_date) AS first_seen FROM obs GROUP BY 1) m WHERE first_meeting < first_seen AND entity_id % 5 <> 0")
def q_date_order_violations(s, d):
    f = B.observations(s, d).groupBy("entity_id").agg(F.min("meeting_date").alias("first_seen"))
    met = f.selectExpr("entity_id", "date_sub(first_seen, cast(entity_id % 3 - 1 as int)) first_meeting")
    return L.early_meetings(met, f, f.filter("entity_id % 5 = 0")).select("entity_id", F.col("first_meeting").cast("string").alias("first_meeting"))


_RAW_DATE = "CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'n/a' END"


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso, CASE WHEN o_orderkey % 3 = 1 THEN 0 ELSE 1 END AS bad FROM (SELECT o_orderkey, o_orderdate, {_RAW_DATE} AS raw FROM orders)")
def q_date_parsing(s, d):
    raw = F.expr("CASE WHEN o_orderkey % 3 = 0 THEN date_format(o_orderdate, 'MM/dd/yyyy') WHEN o_orderkey % 3 = 1 THEN date_format(o_orderdate, 'yyyy-MM-dd') ELSE 'n/a' END")
    rows = S.table(s, d, "orders").select("o_orderkey", raw.alias("raw"))
    return rows.select("o_orderkey", F.coalesce(X.loose_iso(F.col("raw")), X.us_date(F.col("raw")).cast("string")).alias("iso"), L.not_iso(F.col("raw")).cast("int").alias("bad"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 1) THEN NULL WHEN o_orderkey % 5 = 2 THEN 0 ELSE o_totalprice END AS value, CASE WHEN o_orderkey % 5 = 2 THEN 1 ELSE 0 END AS is_zero, CASE o_orderkey % 5 WHEN 0 THEN 'not a number' WHEN 1 THEN 'negative' END AS fault FROM orders")
def q_amount_parsing(s, d):
    raw = F.expr("CASE o_orderkey % 5 WHEN 0 THEN 'soon' WHEN 1 THEN concat('-', cast(o_totalprice as string)) WHEN 2 THEN ' $0 ' ELSE concat('$ ', cast(o_totalprice as string)) END")
    return S.table(s, d, "orders").select("o_orderkey", X.amount(raw).alias("m")).selectExpr("o_orderkey", "m.value", "cast(m.is_zero as int) is_zero", "m.fault")


@query("SELECT c_mktsegment AS segment, " + ", ".join(f"count(*) FILTER (WHERE top = {k}) AS s{k}" for k in range(1, 6)) + ", count(*) AS total, min(c_custkey) AS first_entity, count(*) FILTER (WHERE top = 5) AS deep, CAST(round_even(count(*) FILTER (WHERE top = 5) / count(*) * 100, 0) AS BIGINT) AS deep_share FROM customer JOIN (SELECT entity_id, max(stage_id) AS top FROM obs_o GROUP BY 1) ON entity_id = c_custkey GROUP BY 1")
def q_crosstab(s, d):
    return P.crosstab(_placed(s, d).withColumnRenamed("c_mktsegment", "segment"), "segment", "furthest", [1, 2, 3, 4, 5])


def _placed(s, d):
    top = B.orders_log(s, d).groupBy("entity_id").agg(F.max("stage_id").alias("furthest"), F.max("meeting_date").alias("last"))
    return S.table(s, d, "customer").join(top, F.col("c_custkey") == F.col("entity_id"))


_PLACED = "SELECT c.*, f.* FROM customer c JOIN (SELECT entity_id, max(stage_id) AS furthest, max(meeting_date) AS last FROM obs_o GROUP BY 1) f ON f.entity_id = c.c_custkey"


@query(f"SELECT coalesce(CASE WHEN c_nationkey % 4 = 0 THEN NULL ELSE c_mktsegment END, '_no value_') AS value, count(*) FILTER (WHERE furthest >= 5) AS deep, count(*) FILTER (WHERE furthest < 5) AS rest, (SELECT count(*) FROM ({_PLACED}) WHERE furthest >= 5) AS deep_total, (SELECT count(*) FROM ({_PLACED}) WHERE furthest < 5) AS rest_total, CASE WHEN least((SELECT count(*) FROM ({_PLACED}) WHERE furthest >= 5), (SELECT count(*) FROM ({_PLACED}) WHERE furthest < 5)) < 20 THEN 1 ELSE 0 END AS small_sample, CASE WHEN (SELECT count(*) FROM ({_PLACED}) WHERE c_nationkey % 4 <> 0) < 0.3 * (SELECT count(*) FROM ({_PLACED})) THEN 1 ELSE 0 END AS low_coverage FROM ({_PLACED}) GROUP BY 1")
def q_split_table(s, d):
    return P.split_table(_placed(s, d).withColumn("v", F.expr("CASE WHEN c_nationkey % 4 = 0 THEN NULL ELSE c_mktsegment END")), "v", "furthest")


@query("SELECT value, n, first_entity, CAST(round_even(n / every * 100, 0) AS BIGINT) AS pct_of_all, CAST(round_even(n / covered * 100, 0) AS BIGINT) AS pct_of_covered FROM (SELECT c_mktsegment AS value, count(*) AS n, min(c_custkey) AS first_entity FROM customer WHERE c_nationkey % 4 <> 0 GROUP BY 1), (SELECT count(*) AS every, count(*) FILTER (WHERE c_nationkey % 4 <> 0) AS covered FROM customer)")
def q_frequency_share(s, d):
    rows = S.table(s, d, "customer").selectExpr("c_custkey entity_id", "CASE WHEN c_nationkey % 4 <> 0 THEN c_mktsegment END v")
    return P.frequency(rows, "v")


@query(f"SELECT c_custkey, CASE WHEN furthest >= 5 AND date_diff('day', last, DATE '2001-08-01') <= 56 THEN 'active and past prelim' WHEN furthest >= 5 THEN 'deep after closing' WHEN date_diff('day', last, DATE '2001-08-01') <= 56 THEN 'still seen' ELSE 'consistent' END AS why FROM ({_PLACED}) WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def q_status_contradictions(s, d):
    return P.contradictions(_placed(s, d).filter("c_mktsegment in ('BUILDING', 'MACHINERY')"), "2001-08-01").select("c_custkey", "why")


@query("SELECT c_custkey, CASE WHEN (c_mktsegment = 'BUILDING' AND n_regionkey = 0) OR (c_mktsegment = 'MACHINERY' AND n_regionkey = 1) OR n_regionkey = 4 THEN 1 ELSE 0 END AS agrees FROM customer JOIN nation ON n_nationkey = c_nationkey")
def q_group_thesis_agreement(s, d):
    rows = S.table(s, d, "customer").join(S.table(s, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    rows = rows.withColumn("groups", F.concat(F.col("c_mktsegment"), F.lit("; r4;"))).withColumn("thesis", F.concat(F.lit("r"), F.col("n_regionkey").cast("string")))
    return P.agreement(rows, "groups", "thesis", {"BUILDING": "r0", "MACHINERY": "r1"}).select("c_custkey", "agrees")


def _cohort(s, d):
    o = B.observations(s, d)
    cohort = o.filter("stage_id = 7").select("entity_id").distinct()
    entities = o.select("entity_id").distinct().filter("entity_id % 2 = 1").selectExpr("entity_id", "0 pos", "cast(entity_id - 1 as string) key")
    return o, cohort, C.absorbed(entities, cohort, cohort.selectExpr("cast(entity_id as string) key", "entity_id target_id"))


@query("SELECT entity_id, target_id FROM taken")
def q_absorbed_cohort(s, d):
    return _cohort(s, d)[2]


@query("SELECT * FROM counted")
def q_screened_counters(s, d):
    o, cohort, taken = _cohort(s, d)
    return C.counters(C.screened(o, cohort, taken), cohort)


@query("SELECT " + ", ".join(f"(SELECT count(DISTINCT entity_id) FROM scr WHERE stage_id = {k}) AS observed_{r}, (SELECT count(*) FROM counted WHERE coalesce(furthest, 0) >= {k}) AS reached_{r}" for k, r in _RUNGS) + ", (SELECT count(*) FROM counted WHERE times > 0) AS discussed, (SELECT coalesce(sum(is_bold), 0) FROM scr) AS bold_rows, (SELECT count(*) FROM cohort) AS companies")
def q_screened_rollups(s, d):
    o, cohort, taken = _cohort(s, d)
    rows = C.screened(o, cohort, taken)
    return C.rollups(rows, C.counters(rows, cohort))


@query("SELECT row_number() OVER (ORDER BY entity_id, meeting_date) AS review_id, entity_id, CASE WHEN stage_id > from_stage THEN 'stage_jump' ELSE 'stage_regression' END AS kind, printf('stage moved %+d levels between %s and %s', stage_id - from_stage, CAST(from_date AS VARCHAR), CAST(meeting_date AS VARCHAR)) AS detail FROM (SELECT *, lag(stage_id) OVER w AS from_stage, lag(meeting_date) OVER w AS from_date FROM (SELECT entity_id, meeting_date, max(stage_id) AS stage_id FROM scr GROUP BY 1, 2) WINDOW w AS (PARTITION BY entity_id ORDER BY meeting_date)) WHERE stage_id - from_stage > 2 OR stage_id < from_stage")
def q_screened_reviews(s, d):
    o, cohort, taken = _cohort(s, d)
    return C.reviews(V.date_transitions(C.screened(o, cohort, taken)))


@query("SELECT 'observations at meetings not held' AS \"check\", count(*) AS n FROM obs WHERE day(meeting_date) % 10 = 0 UNION ALL SELECT 'funnel rows without an entity', count(DISTINCT entity_id) FROM obs WHERE entity_id % 7 = 0 UNION ALL SELECT 'more in the funnel than entities', count(DISTINCT entity_id) FILTER (WHERE entity_id % 7 = 0) FROM obs")
def q_reconciliation(s, d):
    o = B.observations(s, d)
    entities = o.select("entity_id").distinct().filter("entity_id % 7 <> 0")
    meetings = o.select("meeting_date").distinct().selectExpr("meeting_date", "CASE WHEN day(meeting_date) % 10 = 0 THEN 'not_held' ELSE 'held' END status")
    return M.reconciliation(o, entities, meetings)


@query("SELECT name FROM (SELECT DISTINCT p_name AS name FROM part) WHERE name NOT IN (SELECT p_name FROM part WHERE p_size > 45)")
def q_external_removals(s, d):
    p = S.table(s, d, "part")
    return p.selectExpr("p_name name").distinct().join(p.filter("p_size > 45").selectExpr("p_name name"), "name", "left_anti")


@query("SELECT c_custkey, 'missing' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, 'extra' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def q_population_check(s, d):
    return P.missing_and_extra(S.table(s, d, "customer"), S.table(s, d, "orders").selectExpr("o_custkey c_custkey"), "c_custkey")


@query("SELECT o.o_orderkey AS review_id, c.c_name AS entity_name, s.s_name AS target_name FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN supplier s ON s.s_suppkey = o.o_orderkey % 200")
def q_review_queue_names(s, d):
    o, c, t = S.table(s, d, "orders"), S.table(s, d, "customer"), S.table(s, d, "supplier")
    return o.join(c, F.col("c_custkey") == F.col("o_custkey"), "left").join(t, F.col("s_suppkey") == F.expr("o_orderkey % 200"), "left").selectExpr("o_orderkey review_id", "c_name entity_name", "s_name target_name")


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN '0' END AS value FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 0) l USING (doc_id)")
def q_zero_recovery(s, d):
    zero = S.table(s, d, "labels").filter("quality = 0").select("doc_id").distinct().withColumn("value", F.lit("0"))
    return S.table(s, d, "documents").select("doc_id").join(zero, "doc_id", "left")


@query("SELECT (SELECT count(DISTINCT entity_id) FROM obs) AS entities, count(*) AS observations, count(DISTINCT meeting_date) AS meetings, sum(is_bold) AS bold, (SELECT count(*) FROM changes WHERE stage_id - from_stage > 2) AS jumps, (SELECT count(*) FROM changes WHERE stage_id < from_stage) AS regressions FROM obs")
def q_load_report(s, d):
    o = B.observations(s, d)
    a = o.agg(F.count_distinct("entity_id").alias("entities"), F.count("*").alias("observations"), F.count_distinct("meeting_date").alias("meetings"), F.sum("is_bold").alias("bold"))
    j = V.jumps(V.transitions(o)).agg(F.count_if(F.col("delta") > 2).alias("jumps"), F.count_if(F.col("delta") < 0).alias("regressions"))
    return a.crossJoin(F.broadcast(j))  # one row each


@query("SELECT s_suppkey, printf('EV%04d', s_suppkey) AS public_id, s_suppkey AS parsed, s_name AS owner, repeat('█', CAST(s_suppkey % 5 AS BIGINT)) AS bar, printf('%d of %d firms (%d%%)', s_suppkey % 8, 16, CAST(round_even(s_suppkey % 8 / 16 * 100, 0) AS BIGINT)) AS share FROM supplier")
def q_text_formats(s, d):
    n = F.col("s_suppkey")
    return S.table(s, d, "supplier").select("s_suppkey", X.public_id(n).alias("public_id"), X.entity_of(X.public_id(n)).alias("parsed"), X.owner(F.concat("s_name", F.lit(" <mail>"))).alias("owner"), X.bar(n % 5).alias("bar"), X.share_text(n % 8, F.lit(16).cast("long"), "firms").alias("share"))


@query("SELECT o_orderkey AS review_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_orderkey % 7) / 10.0::DOUBLE END AS confidence, row_number() OVER (ORDER BY CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_orderkey % 7) / 10.0::DOUBLE END DESC NULLS LAST, o_orderkey) AS place FROM orders")
def q_review_order(s, d):
    rows = S.table(s, d, "orders").selectExpr("o_orderkey review_id", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 7 / 10D END confidence")
    return P.queue_places(rows)


@query(f"SELECT doc_id, {_NORM.format(x='text')} AS norm FROM documents")
def q_name_norm_nfkd(s, d):
    return S.table(s, d, "documents").select("doc_id", X.norm_nfkd(F.col("text")).alias("norm"))


def _field_rows(s, d):
    c = S.table(s, d, "customer")
    web = c.filter("c_custkey % 2 = 0").selectExpr("c_custkey entity_id", "'website' field", "concat('www.', c_custkey, '.com') value", "'Public' source", "concat('c', c_custkey) citation", "cast(null as string) user")
    return web.unionByName(c.filter("c_custkey % 3 = 0").selectExpr("c_custkey entity_id", "'stage' field", "c_mktsegment value", "'Manual' source", "cast(null as string) citation", "'me' user"))


CTE["cfields"] = "SELECT c_custkey AS entity_id, 'website' AS field, 'www.' || c_custkey || '.com' AS value, 'Public' AS source, 'c' || c_custkey AS citation, CAST(NULL AS VARCHAR) AS user FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'stage', c_mktsegment, 'Manual', NULL, 'me' FROM customer WHERE c_custkey % 3 = 0"
CTE["cgaps"] = "SELECT c_custkey AS entity_id, 'website' AS field, 'not_checked' AS state FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'owner_name', 'not_checked' FROM customer WHERE c_custkey % 3 = 0"
CTE["ocal"] = "SELECT meeting_date, row_number() OVER (ORDER BY meeting_date) - 1 AS place FROM (SELECT DISTINCT meeting_date FROM obs_o)"
CTE["obold"] = "SELECT o_orderkey AS observation_id, o_custkey AS entity_id, CAST(o_orderdate AS DATE) AS meeting_date, 6 - CAST(substr(o_orderpriority, 1, 1) AS INT) AS stage_id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS is_bold FROM orders"
_COMPANY = (
    "SELECT c.c_custkey AS entity_id, c.c_name AS name, to_json(struct_pack(id := c.c_custkey, name := c.c_name, domain := CASE WHEN c.c_custkey % 5 = 0 THEN NULL ELSE 'd' || c.c_nationkey || '.com' END, phantom := c.c_custkey % 50 = 0, "
    "furthest := f.furthest, latest := l.stage_id, appearances := coalesce(f.n, 0), first := f.first, last := f.last, observedDeep := coalesce(f.od = 1, false), observedLegal := coalesce(f.ol = 1, false), reachedDeep := coalesce(f.rd = 1, false), discussed := coalesce(f.b = 1, false), times := coalesce(f.t, 0), "
    "priority := CASE WHEN c.c_custkey % 3 = 0 THEN 'P2' ELSE 'P4' END, gaps := 5 - coalesce(len(v.have), 0), missing := list_filter(['website', 'hq_country', 'stage', 'round_size_usd', 'owner_name'], lambda x: NOT list_contains(coalesce(v.have, []), x)), "
    "gapState := coalesce(g.m, MAP {}), obs := coalesce(o.x, []), fields := coalesce(v.x, []), aliases := coalesce(a.x, []))) AS payload FROM customer c "
    "LEFT JOIN (SELECT entity_id, max(stage_id) AS furthest, count(*) AS n, CAST(min(meeting_date) AS VARCHAR) AS first, CAST(max(meeting_date) AS VARCHAR) AS last, max(CASE WHEN stage_id = 5 THEN 1 ELSE 0 END) AS od, max(CASE WHEN stage_id = 7 THEN 1 ELSE 0 END) AS ol, max(CASE WHEN stage_id >= 5 THEN 1 ELSE 0 END) AS rd, max(is_bold) AS b, sum(is_bold)::BIGINT AS t FROM obold GROUP BY 1) f ON f.entity_id = c.c_custkey "
    "LEFT JOIN (SELECT entity_id, stage_id FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY meeting_date DESC, observation_id DESC) AS n FROM obold) WHERE n = 1) l ON l.entity_id = c.c_custkey "
    "LEFT JOIN (SELECT entity_id, list_sort(list([place, stage_id, is_bold, stage_id])) AS x FROM obold JOIN ocal USING (meeting_date) GROUP BY 1) o ON o.entity_id = c.c_custkey "
    "LEFT JOIN (SELECT entity_id, list(field) AS have, list_sort(list(struct_pack(field, value, source, citation, user))) AS x FROM cfields GROUP BY 1) v ON v.entity_id = c.c_custkey "
    "LEFT JOIN (SELECT entity_id, map_from_entries(list_sort(list(struct_pack(k := field, v := state)))) AS m FROM cgaps GROUP BY 1) g ON g.entity_id = c.c_custkey "
    "LEFT JOIN (SELECT c_custkey AS entity_id, list_sort(list(x)) AS x FROM (SELECT c_custkey, c_name AS x FROM customer UNION ALL SELECT c_custkey, c_name || ' Inc' FROM customer WHERE c_custkey % 4 = 0) GROUP BY 1) a ON a.entity_id = c.c_custkey"
)


def _payload_sides(s, d):
    c = S.table(s, d, "customer")
    entities = c.selectExpr("c_custkey entity_id", "c_name name", "CASE WHEN c_custkey % 5 <> 0 THEN concat('d', c_nationkey, '.com') END domain", "c_custkey % 50 = 0 is_phantom")
    aliases = c.selectExpr("c_custkey entity_id", "c_name alias_text").unionByName(c.filter("c_custkey % 4 = 0").selectExpr("c_custkey entity_id", "concat(c_name, ' Inc') alias_text"))
    return entities, B.orders_log(s, d).withColumn("slide_page", F.col("stage_id")), aliases


@query(_COMPANY)
def q_payload_json(s, d):
    entities, obs, aliases = _payload_sides(s, d)
    fields = _field_rows(s, d)
    calendar = H.calendar_index(obs)
    worklist = M.gap_counts(entities, fields.selectExpr("entity_id", "field", "value value_text", "cast(null as double) value_num"), S.GAP_FIELDS).withColumn("priority", F.expr("CASE WHEN entity_id % 3 = 0 THEN 'P2' ELSE 'P4' END"))
    return P.payload(entities, obs, calendar, fields, q_gap_rows(s, d), worklist, aliases, S.GAP_FIELDS)


@query("SELECT (SELECT count(*) FROM customer) AS entities, (SELECT count(*) FROM orders) AS observations, (SELECT count(DISTINCT CAST(o_orderdate AS DATE)) FROM orders WHERE day(o_orderdate) % 10 <> 0) AS meetings_held, (SELECT count(DISTINCT CAST(o_orderdate AS DATE)) FROM orders WHERE day(o_orderdate) % 10 = 0) AS meetings_missing, (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 0) AS review_open, (SELECT count(*) + count(*) FILTER (WHERE c_custkey % 4 = 0) FROM customer) AS aliases")
def q_payload_totals(s, d):
    entities, obs, aliases = _payload_sides(s, d)
    meetings = obs.select("meeting_date").distinct().selectExpr("meeting_date", "CASE WHEN day(meeting_date) % 10 = 0 THEN 'not_held' ELSE 'held' END status")
    review = S.table(s, d, "orders").selectExpr("o_orderkey review_id", "CASE WHEN o_orderkey % 3 = 0 THEN 'open' ELSE 'merged' END state")
    return P.payload_totals(entities, obs, meetings, review, aliases)


@query("SELECT entity_id, array_to_string(list_sort(list(field || '=' || value)), ', ') AS fields FROM cfields GROUP BY 1")
def q_field_map(s, d):
    m = P.field_map(_field_rows(s, d).withColumn("value_id", F.lit(1)))
    return m.select("entity_id", F.array_join(F.transform(F.map_entries("values"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ").alias("fields"))


_LINE = "SELECT '{n}' AS name, count(*) FILTER (WHERE {p}) AS present, count(*) AS total FROM customer WHERE {m}"
_WEB, _STG = "c_custkey % 2 = 0", "c_custkey % 3 = 0"
_REPORT = " UNION ALL ".join(_LINE.format(n=n, p=p, m=m) for n, p, m in (("website", _WEB, "true"), ("hq_country", "false", "true"), ("stage", _STG, "true"), ("round_size_usd", "false", "true"), ("owner_name", "false", "true"), ("website @ deep-diligence cohort", _WEB, "c_custkey IN (SELECT entity_id FROM obold WHERE stage_id = 5)"), ("stage @ discussed cohort", _STG, "c_custkey IN (SELECT entity_id FROM obold WHERE is_bold = 1)")))


@query(f"SELECT name, present, total, total - present AS missing, printf('%d/%d (%.1f%%)', present, total, CASE WHEN total = 0 THEN 0.0 ELSE round_even(present / total * 100, 1) END) AS coverage FROM ({_REPORT})")
def q_coverage_report(s, d):
    entities, obs, _ = _payload_sides(s, d)
    values = _field_rows(s, d).selectExpr("entity_id", "field", "value value_text", "cast(null as double) value_num")
    return M.coverage_report(entities, values, S.GAP_FIELDS, {"deep-diligence": ("website", obs.filter("stage_id = 5")), "discussed": ("stage", obs.filter("is_bold = 1"))})


_RAW = "CASE event_id % 5 WHEN 0 THEN 'HH' WHEN 1 THEN 'C' WHEN 2 THEN 'Deep Diligence' WHEN 3 THEN 'NewCo:' ELSE 'elsewhere' END"


@query(f"SELECT event_id, v.col1 AS stage_name, v.col2 AS thesis FROM events e LEFT JOIN (VALUES {S.values_sql('section')}) v ON v.col0 = {_RAW}")
def q_section_mapping(s, d):
    rows = S.table(s, d, "events").selectExpr("event_id", f"{_RAW} raw_section")
    return S.placed(rows, S.vocabulary(s, "section")).select("event_id", "stage_name", "thesis")

_USED = f"SELECT stage_name AS value, count(*) AS n FROM obs JOIN stages USING (stage_id) GROUP BY 1 UNION ALL SELECT {_RAW}, count(*) FROM events GROUP BY 1"


@query("SELECT vocabulary, v.value, coalesce(sum(n), 0)::BIGINT AS uses FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS vocabulary, CAST(col{1 if n == 'stage' else 0} AS VARCHAR) AS value FROM (VALUES {S.values_sql(n)})" for n in S.VOCABULARIES) + f") v LEFT JOIN ({_USED}) u ON u.value = v.value GROUP BY 1, 2")
def q_vocabularies(s, d):
    """Every value of every vocabulary with how often the log's stages and headings use it."""
    parts = [S.vocabulary(s, n).select(F.lit(n).alias("vocabulary"), F.col(S.VOCABULARIES[n][0].split(",")[1 if n == "stage" else 0].strip()).cast("string").alias("value")) for n in S.VOCABULARIES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    headings = S.table(s, d, "events").select(F.expr(_RAW).alias("value"))
    stages = B.observations(s, d).join(F.broadcast(S.vocabulary(s, "stage")), "stage_id").select(F.col("stage_name").alias("value"))
    used = headings.unionByName(stages).groupBy("value").agg(F.count("*").alias("n"))
    return out.join(F.broadcast(used), "value", "left").groupBy("vocabulary", "value").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("uses"))  # values of sections and stages: bounded


_CELL_TEXT = "CASE WHEN doc_id % 4 = 0 THEN concat(chr(39), name) WHEN doc_id % 4 = 1 THEN concat('  ', name, ' ') WHEN doc_id % 4 = 2 AND length(name) % 3 = 0 THEN 'NaN' ELSE name END"


@query(f"SELECT doc_id, line, CASE WHEN upper(c) IN ('', 'NAN', 'NAT', 'NONE') THEN NULL ELSE c END AS cell FROM (SELECT doc_id, line, CASE WHEN starts_with(t, chr(39)) THEN trim(substr(t, 2), ' ') ELSE t END AS c FROM (SELECT doc_id, line, trim({_CELL_TEXT}, ' ') AS t FROM ({_WHOLE})))")
def q_clean_cells(s, d):
    return _whole(s, d).select("doc_id", "line", X.clean_cell(F.expr(_CELL_TEXT)).alias("cell"))


@query("SELECT event_id, regexp_extract(t, 'Version:[ \\t]*([^ ]+)', 1) AS version FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'no such line' ELSE concat('Log ', event_type, ' Version: ', CAST(floor(value) AS INT), '.', user_id, ' and Version: 9') END AS t FROM events)")
def q_versions(s, d):
    text = F.expr("CASE WHEN event_id % 3 = 0 THEN 'no such line' ELSE concat('Log ', event_type, ' Version: ', cast(floor(value) as int), '.', user_id, ' and Version: 9') END")
    return S.table(s, d, "events").select("event_id", S.version_of(text).alias("version"))


CTE["asks"] = "SELECT c_custkey AS ask_id, CASE WHEN c_custkey % 7 = 0 THEN 'Customer Twin' ELSE c_name END AS name, CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 17 = 0 THEN 'twin.com' ELSE lower(replace(c_name, '#', '-')) || '.com' END AS domain, CASE WHEN c_custkey % 9 = 0 THEN 'no domain' WHEN c_custkey % 11 = 0 THEN 'source not allowed' WHEN c_custkey % 13 = 0 THEN 'not a number' END AS fault FROM customer"
CTE["askdup"] = "SELECT ask_id FROM (SELECT ask_id, min(ask_id) OVER (PARTITION BY lower(name)) AS n, min(ask_id) OVER (PARTITION BY domain) AS m FROM asks WHERE fault IS NULL) WHERE ask_id > n OR ask_id > m"


def _asked(s, d):
    part = S.table(s, d, "part")
    entities = part.selectExpr("p_partkey entity_id", "p_name canonical_name", "cast(null as string) domain")
    web = "CASE WHEN c_custkey % 9 = 0 THEN '' WHEN c_custkey % 17 = 0 THEN 'https://Twin.com/x' ELSE concat('https://www.', lower(replace(c_name, '#', '-')), '.com/') END website"
    asked = S.table(s, d, "customer").selectExpr("c_custkey ask_id", "CASE WHEN c_custkey % 7 = 0 THEN ' Customer   Twin' ELSE c_name END name", web, "CASE WHEN c_custkey % 11 = 0 THEN 'Slides' ELSE 'Manual' END source", "CASE WHEN c_custkey % 13 = 0 THEN 'lots' ELSE '$1,000' END round_size", "concat(c_mktsegment, ', ', lower(c_mktsegment)) tags")
    return asked, entities, _aliases(s, d)


@query("SELECT ask_id, name, coalesce(fault, CASE WHEN ask_id IN (SELECT ask_id FROM askdup) THEN 'duplicate' ELSE 'accepted' END) AS outcome FROM asks")
def q_batch_add_company(s, d):
    out = L.add_companies(*_asked(s, d))
    return out["accepted"].selectExpr("ask_id", "name", "'accepted' outcome").unionByName(out["rejected"].selectExpr("ask_id", "name", "fault outcome"))


@query("SELECT ask_id, target_ask, CASE WHEN max(o) = 1 THEN 'name' ELSE 'domain' END AS matched_on FROM (SELECT ask_id, min(ask_id) OVER (PARTITION BY lower(name)) AS target_ask, 1 AS o FROM asks WHERE fault IS NULL UNION ALL SELECT ask_id, min(ask_id) OVER (PARTITION BY domain), 0 FROM asks WHERE fault IS NULL) WHERE ask_id > target_ask GROUP BY 1, 2")
def q_batch_proposals(s, d):
    return L.add_companies(*_asked(s, d), allow=True)["proposals"].select("ask_id", "target_ask", "matched_on")


@query("SELECT min(ask_id) AS ask_id, name AS alias_text, trim(regexp_replace(lower(name), '[^a-z0-9_]+', ' ', 'g')) AS alias_norm FROM asks WHERE fault IS NULL GROUP BY name")
def q_batch_aliases(s, d):
    return L.add_companies(*_asked(s, d), allow=True)["aliases"].select("ask_id", "alias_text", "alias_norm")


_WRITES = "SELECT o_orderkey AS entity_id, CASE o_orderkey % 5 WHEN 0 THEN 'first_meeting' WHEN 1 THEN 'round_size_usd' WHEN 2 THEN 'stage' WHEN 3 THEN 'working_group' ELSE 'hq_country' END AS field, CASE o_orderkey % 5 WHEN 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%m/%d/%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END WHEN 2 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'Seed' ELSE 'Grant' END WHEN 3 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'Health' ELSE 'Other' END WHEN 4 THEN 'FR' END AS value_text, CASE WHEN o_orderkey % 5 = 1 THEN o_orderkey % 3 END AS value_num, o_orderkey % 5 = 1 AND o_orderkey % 2 = 0 AS is_zero, CASE WHEN o_orderkey % 5 = 4 THEN 'Public' ELSE 'Manual' END AS source, CASE WHEN o_orderkey % 2 = 0 THEN 'c' END AS citation FROM orders"


@query(f"SELECT entity_id, field, CASE WHEN field = 'first_meeting' AND NOT regexp_full_match(value_text, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN 'not an ISO date' WHEN coalesce(value_num = 0 AND NOT is_zero, false) OR (is_zero AND coalesce(value_num, 1) <> 0) THEN 'zero without its mark' WHEN value_text = 'Other' THEN 'not in working_group' WHEN value_text = 'Grant' THEN 'not in round_stage' WHEN source = 'Public' AND citation IS NULL THEN 'public without a citation' END AS fault FROM ({_WRITES})")
def q_field_writes(s, d):
    rows = S.table(s, d, "orders").selectExpr("o_orderkey entity_id", "CASE o_orderkey % 5 WHEN 0 THEN 'first_meeting' WHEN 1 THEN 'round_size_usd' WHEN 2 THEN 'stage' WHEN 3 THEN 'working_group' ELSE 'hq_country' END field", "CASE o_orderkey % 5 WHEN 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN date_format(o_orderdate, 'MM/dd/yyyy') ELSE date_format(o_orderdate, 'yyyy-MM-dd') END WHEN 2 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'Seed' ELSE 'Grant' END WHEN 3 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'Health' ELSE 'Other' END WHEN 4 THEN 'FR' END value_text", "double(CASE WHEN o_orderkey % 5 = 1 THEN o_orderkey % 3 END) value_num", "o_orderkey % 5 = 1 AND o_orderkey % 2 = 0 is_zero", "CASE WHEN o_orderkey % 5 = 4 THEN 'Public' ELSE 'Manual' END source", "CASE WHEN o_orderkey % 2 = 0 THEN 'c' END citation")
    good, bad = L.write_fields(rows)
    return good.withColumn("fault", F.lit(None).cast("string")).unionByName(bad).select("entity_id", "field", "fault")


@query("SELECT user_id AS entity_id, event_type AS field, arg_max(state, event_id) AS state FROM (SELECT *, CASE event_id % 4 WHEN 0 THEN 'filled' WHEN 1 THEN 'not_checked' WHEN 2 THEN 'confirmed_unavailable' ELSE 'lost' END AS state FROM events) WHERE state <> 'lost' GROUP BY 1, 2")
def q_gap_writes(s, d):
    rows = S.table(s, d, "events").selectExpr("user_id entity_id", "event_type field", "CASE event_id % 4 WHEN 0 THEN 'filled' WHEN 1 THEN 'not_checked' WHEN 2 THEN 'confirmed_unavailable' ELSE 'lost' END state", "event_id seq")
    return L.resolve_gaps(rows.filter("seq % 2 = 0"), rows.filter("seq % 2 = 1"))[0].drop("seq")


@query("SELECT 'stage_regression' AS kind, entity_id, printf('stage %d -> %d between %s and %s (%+d)', from_stage, stage_id, CAST(from_date AS VARCHAR), CAST(meeting_date AS VARCHAR), stage_id - from_stage) AS detail FROM changes WHERE stage_id < from_stage UNION ALL SELECT 'unknown_as_category', NULL, printf('%d field values literally ', count(*)) || chr(39) || 'UNKNOWN' || chr(39) FROM customer WHERE c_mktsegment = 'BUILDING' HAVING count(*) > 0")
def q_warnings(s, d):
    values = S.table(s, d, "customer").selectExpr("c_custkey entity_id", "'region' field", "CASE WHEN c_mktsegment = 'BUILDING' THEN 'UNKNOWN' ELSE c_mktsegment END value_text")
    return L.warnings(V.transitions(B.observations(s, d)), values)


@query("SELECT 'region' AS field, count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING'")
def q_written_unknowns(s, d):
    return L.written_unknowns(S.table(s, d, "customer").selectExpr("'region' field", "CASE WHEN c_mktsegment = 'BUILDING' THEN ' unknown ' ELSE c_mktsegment END value_text"))


@query("SELECT o_orderkey, 'citation' AS rule FROM orders WHERE o_orderkey % 6 = 0 UNION ALL SELECT o_orderkey, 'amount_local' FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 2 = 1")
def q_provenance_violations(s, d):
    rows = S.table(s, d, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 3 = 0 THEN 'Public' ELSE 'Manual' END source", "CASE WHEN o_orderkey % 2 = 1 THEN 'c' END citation", "CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice END amount_local", "CASE WHEN o_orderkey % 2 = 0 THEN 'EUR' END currency")
    return L.provenance_violations(rows).select("o_orderkey", "rule")


@query("SELECT c_custkey AS entity_id, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN lower(c_mktsegment) ELSE 'new, ' || lower(c_mktsegment) END AS value_text FROM customer WHERE c_custkey % 3 <> 1")
def q_set_tags(s, d):
    c = S.table(s, d, "customer")
    current = c.selectExpr("c_custkey entity_id", "lower(c_mktsegment) value_text")
    asked = c.selectExpr("c_custkey entity_id", "CASE c_custkey % 3 WHEN 0 THEN ' , ' WHEN 1 THEN concat(' ', lower(c_mktsegment), ',') ELSE concat(lower(c_mktsegment), ',new') END tags")
    order = F.array_join(F.array_sort(F.split("value_text", ", ")), ", ")
    return L.set_tags(current, asked).select("entity_id", F.when(F.col("value_text").contains(", "), F.concat(F.lit("new, "), F.expr("replace(replace(value_text, 'new', ''), ', ', '')"))).otherwise(order).alias("value_text"))


@query("SELECT c_custkey AS entity_id, 'Public' AS source FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 = 0")
def q_accepted_sources(s, d):
    rows = S.table(s, d, "customer").selectExpr("c_custkey entity_id", "CASE WHEN c_custkey % 2 = 0 THEN 'website' ELSE 'stage' END field", "CASE WHEN c_custkey % 3 = 0 THEN concat('https://www.wikidata.org/wiki/Q', c_custkey) ELSE 'elsewhere' END citation", "'Manual' source")
    return L.accepted_sources(rows).select("entity_id", "source")


@query("SELECT c_custkey AS entity_id, CASE WHEN c_custkey % 10 = 0 THEN c_custkey - 1 ELSE c_custkey END AS resolved_id, CASE WHEN c_custkey % 10 <> 0 THEN 1 ELSE 0 END AS alive, CASE WHEN c_custkey % 10 <> 0 AND c_custkey % 4 <> 0 THEN 1 ELSE 0 END AS counted FROM customer")
def q_live_entities(s, d):
    e = S.table(s, d, "customer").selectExpr("c_custkey entity_id", "CASE WHEN c_custkey % 10 = 0 THEN c_custkey - 1 END merged_into", "c_custkey % 4 = 0 is_phantom")
    mark = lambda df, c: df.select("entity_id", F.lit(1).alias(c))
    out = V.resolved(e).join(mark(V.live(e), "alive"), "entity_id", "left").join(mark(V.live(e, False), "counted"), "entity_id", "left")
    return out.select("entity_id", "resolved_id", F.coalesce("alive", F.lit(0)).alias("alive"), F.coalesce("counted", F.lit(0)).alias("counted"))


@query("SELECT c_custkey, row_number() OVER (ORDER BY lower(n), c_custkey) AS place FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS n FROM customer)")
def q_nocase_order(s, d):
    rows = S.table(s, d, "customer").selectExpr("c_custkey", "CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE c_name END n")
    return P.name_places(rows, "n", "c_custkey").select("c_custkey", "place")


@query(f"SELECT c_custkey AS entity_id FROM ({_PLACED}) WHERE c_mktsegment = 'FURNITURE' AND furthest >= 5")
def q_early_status(s, d):
    rows = _placed(s, d).selectExpr("c_custkey entity_id", "c_mktsegment status", "furthest")
    return P.early_status(rows, ["FURNITURE"]).select("entity_id")


_SPLITS = " UNION ALL ".join(f"SELECT '{n}' AS split, coalesce({e}, '_no value_') AS value, count(*) FILTER (WHERE furthest >= 5) AS deep, count(*) FILTER (WHERE furthest < 5) AS rest FROM ({_PLACED}) GROUP BY 1, 2" for n, e in (("segment", "c_mktsegment"), ("nation", "CASE WHEN c_nationkey % 4 <> 0 THEN CAST(c_nationkey AS VARCHAR) END"), ("rich", "CASE WHEN c_acctbal > 0 THEN 'yes' ELSE 'no' END")))


@query(_SPLITS)
def q_advancement_splits(s, d):
    rows = _placed(s, d).selectExpr("furthest", "c_mktsegment segment", "CASE WHEN c_nationkey % 4 <> 0 THEN cast(c_nationkey as string) END nation", "CASE WHEN c_acctbal > 0 THEN 'yes' ELSE 'no' END rich")
    return P.advancement(rows, ["segment", "nation", "rich"], "furthest").select("split", "value", "deep", "rest")


@query("SELECT segment, count(*) AS n FROM (SELECT CASE WHEN b.rid IS NULL THEN 'no folder' ELSE 'folder' END AS segment FROM (SELECT DISTINCT name FROM target_side WHERE canonical) t LEFT JOIN (SELECT DISTINCT t.name, 1 AS rid FROM target_side t JOIN (SELECT DISTINCT name FROM query_side WHERE pos = 0) q ON " + _NORM.format(x="q.name") + " = " + _NORM.format(x="t.name") + " WHERE t.canonical) b ON b.name = t.name) GROUP BY 1")
def q_reach_back(s, d):
    query, target = B.ladder_sides(s, d)
    folders = query.filter("pos = 0").selectExpr("qid", "name")
    back = R.reach(folders, target.filter("canonical"), target)["back"]
    return back.groupBy(F.when(F.col("tier") == "exact", "folder").otherwise("no folder").alias("segment")).agg(F.count("*").alias("n"))


CTE["hist"] = "SELECT o_orderkey AS observation_id, CAST(o_orderdate AS DATE) AS meeting_date, CASE WHEN o_orderkey % 13 = 0 THEN 'nobody ' || (o_orderkey % 50) WHEN o_orderkey % 4 = 0 THEN upper(c_name) || '!' ELSE c_name END AS name, o_custkey AS entity_id, 6 - CAST(substr(o_orderpriority, 1, 1) AS INT) AS stage_id FROM orders JOIN customer ON c_custkey = o_custkey"
CTE["kept"] = "SELECT entity_id, meeting_date, name, stage_id, min(observation_id) AS observation_id FROM hist WHERE observation_id % 13 <> 0 GROUP BY 1, 2, 3, 4"
CTE["lchanges"] = "SELECT * FROM (SELECT *, lag(stage_id) OVER (PARTITION BY entity_id ORDER BY meeting_date, observation_id) AS f FROM kept) WHERE f IS NOT NULL AND f <> stage_id"
CTE["cal"] = "SELECT meeting_date AS prev, date_diff('day', meeting_date, lead(meeting_date) OVER (ORDER BY meeting_date)) AS gap FROM (SELECT DISTINCT meeting_date FROM hist)"
_COUNTS = {
    "entities": "SELECT count(*) FROM customer", "aliases": "SELECT 2 * count(*) FROM customer", "meetings_held": "SELECT count(DISTINCT meeting_date) FROM hist", "meetings_missing": "SELECT coalesce(sum(greatest(CAST(round_even(gap / 7, 0) AS BIGINT) - 1, 0)), 0)::BIGINT FROM cal WHERE gap > 8",
    "observations": "SELECT count(*) FROM kept", "field_values": "SELECT (SELECT count(*) FROM customer WHERE c_custkey % 2 = 0) + (SELECT count(*) FROM (SELECT entity_id FROM kept WHERE entity_id % 3 = 0 GROUP BY 1))", "gap_rows": "SELECT (SELECT count(*) FROM customer WHERE c_custkey % 2 = 0) + (SELECT count(*) FROM customer WHERE c_custkey % 3 = 0)",
    "review_open": "SELECT (SELECT count(*) FROM (SELECT entity_id FROM kept GROUP BY entity_id, meeting_date HAVING count(*) > 1 AND count(DISTINCT name) > 1)) + (SELECT count(*) FROM lchanges WHERE stage_id - f > 2 OR stage_id < f) + (SELECT count(*) FROM customer WHERE c_custkey % 100 = 0)",
    "v2_removal_proposals": "SELECT count(*) FROM customer WHERE c_custkey % 100 = 0", "predating_relationships_flagged": "SELECT count(*) FROM (SELECT entity_id FROM kept WHERE entity_id % 3 = 0 GROUP BY 1)",
    "resolved_exact": "SELECT count(*) FROM hist WHERE observation_id % 13 <> 0 AND observation_id % 4 <> 0", "resolved_normalised": "SELECT count(*) FROM hist WHERE observation_id % 13 <> 0 AND observation_id % 4 = 0", "unresolved_slide_names": "SELECT count(DISTINCT name) FROM hist WHERE observation_id % 13 = 0",
}


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, ({q}) AS n" for n, q in _COUNTS.items()))
def q_load_flow(s, d):
    return load_tables(s, d)["report"]


def load_tables(s, d):
    """The load over customers and orders."""
    c, o = S.table(s, d, "customer"), S.table(s, d, "orders")
    companies = c.selectExpr("c_custkey entity_id", "c_name name", "concat('https://', c_custkey, '.com') website", "concat(c_name, ' one|', c_name) variants", "CASE WHEN c_custkey % 3 = 0 THEN '01/02/1990' ELSE '2030-01-01' END first_meeting", "c_custkey % 2 = 0 needs_website", "c_custkey % 3 = 0 needs_owner_name")
    name = "CASE WHEN o_orderkey % 13 = 0 THEN concat('nobody ', o_orderkey % 50) WHEN o_orderkey % 4 = 0 THEN concat(upper(c_name), '!') ELSE c_name END name"
    history = o.join(c, F.col("c_custkey") == F.col("o_custkey")).selectExpr("o_orderkey observation_id", "cast(o_orderdate as date) meeting_date", name, "6 - cast(substring(o_orderpriority, 1, 1) as int) stage_id", "0 is_bold", "1 slide_page")
    cells = c.selectExpr("c_custkey entity_id", "'website' field", "CASE WHEN c_custkey % 2 = 0 THEN 'w.com' ELSE 'UNKNOWN' END value_text", "false enriched", "cast(null as string) citation", "cast(null as string) group_source")
    return I.load(companies, history, cells, c.filter("c_custkey % 100 <> 0").selectExpr("c_name name"))


@query("SELECT doc_id AS entity_id, 'website' AS field, CASE WHEN doc_id % 2 = 0 THEN source ELSE lang END AS value_text, CASE WHEN doc_id % 3 = 0 AND doc_id % 4 <> 0 THEN 'Public' ELSE 'Affinity' END AS source, CASE WHEN doc_id % 3 = 0 AND doc_id % 4 <> 0 THEN 'c' || doc_id END AS citation FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT doc_id, 'working_group', lang, CASE WHEN doc_id % 5 = 0 THEN 'Slides' ELSE 'Affinity' END, NULL FROM documents WHERE doc_id % 5 <> 1")
def q_attributed_fields(s, d):
    docs = S.table(s, d, "documents")
    flags = ["doc_id % 3 = 0 enriched", "CASE WHEN doc_id % 4 <> 0 THEN concat('c', doc_id) END citation", "CASE doc_id % 5 WHEN 0 THEN 'Slide section' WHEN 1 THEN 'MISSING' ELSE 'Sheet' END group_source"]
    web = docs.selectExpr("doc_id entity_id", "'website' field", "CASE WHEN doc_id % 7 = 0 THEN 'UNKNOWN' WHEN doc_id % 2 = 0 THEN source ELSE lang END value_text", *flags)
    return I.attributed(web.unionByName(docs.selectExpr("doc_id entity_id", "'working_group' field", "lang value_text", *flags)))


@query("SELECT c_custkey AS entity_id, 'website' AS field, 'not_checked' AS state FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'owner_name', 'not_checked' FROM customer WHERE c_custkey % 3 = 0")
def q_gap_rows(s, d):
    flags = S.table(s, d, "customer").selectExpr("c_custkey", "c_custkey % 2 = 0 needs_website", "CASE WHEN c_custkey % 3 = 0 THEN true END needs_owner")
    return I.gap_rows(flags, "c_custkey", {"needs_website": "website", "needs_owner": "owner_name"})


CTE["wraps"] = "SELECT CAST('0x' || substr(md5(name), 1, 15) AS BIGINT) AS entity_id, CASE WHEN name LIKE 'a%' THEN '/' || name ELSE name END AS name FROM names"


@query("SELECT entity_id, NULL::BIGINT AS target_id, 'line_wrap_candidate' AS kind, 0.9::DOUBLE AS confidence FROM wraps WHERE name LIKE '/%' UNION ALL SELECT a.entity_id, b.entity_id, 'merge_proposal', CASE WHEN contains(a.name, ' ') THEN 0.6::DOUBLE ELSE 0.75::DOUBLE END FROM wraps a JOIN wraps b ON length(b.name) > length(a.name) AND (starts_with(b.name, a.name || ' ') OR ends_with(b.name, ' ' || a.name)) WHERE a.name NOT LIKE '/%'")
def q_line_wraps(s, d):
    rows = B.names(s, d).select(F.conv(F.substring(F.md5("name"), 1, 15), 16, 10).cast("long").alias("entity_id"), F.expr("CASE WHEN name LIKE 'a%' THEN concat('/', name) ELSE name END").alias("name"))
    return I.line_wraps(rows)


@query("SELECT CASE WHEN k = 0 THEN '_no value_' WHEN k <= 2 THEN 'Seed' WHEN k = 3 THEN 'A' WHEN k <= 5 THEN 'B+' ELSE 'other' END AS round_group, count(*) AS n FROM (SELECT c_custkey % 7 AS k FROM customer) GROUP BY 1")
def q_round_groups(s, d):
    rows = S.table(s, d, "customer").selectExpr("CASE c_custkey % 7 WHEN 1 THEN 'Preseed' WHEN 2 THEN 'Seed' WHEN 3 THEN 'Series A' WHEN 4 THEN 'Series B' WHEN 5 THEN 'Series C' WHEN 6 THEN 'Grant' END r")
    return I.round_groups(rows, "r")


@query("SELECT coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, 'blank: ' || CASE WHEN c_custkey % 3 = 1 THEN 'not_checked' ELSE 'untracked' END) AS value, count(*) AS n FROM customer GROUP BY 1")
def q_geography_gap_split(s, d):
    rows = S.table(s, d, "customer").selectExpr("CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END v", "CASE WHEN c_custkey % 3 = 1 THEN 'not_checked' END g")
    return I.gap_split(rows, "v", "g")


@query("SELECT qid % 7 AS stage, count(*) AS companies, count(*) FILTER (WHERE tier IN ('exact', 'alias', 'suffix', 'prefix')) AS with_folder, count(*) FILTER (WHERE tier = 'ambiguous') AS ambiguous FROM matched GROUP BY 1")
def q_folder_coverage(s, d):
    return I.folder_coverage(q_match_ladder(s, d).withColumn("st", F.col("qid") % 7), "st", "tier")


@query(f"SELECT name, count(*) AS n FROM (WITH al AS ({_ALIASES}), seen AS ({_SEEN}) SELECT s.name FROM seen s WHERE s.name NOT IN (SELECT alias_text FROM al) AND {_LOW.format(x='s.name')} NOT IN (SELECT {_LOW.format(x='alias_text')} FROM al GROUP BY 1 HAVING count(DISTINCT entity_id) = 1)) GROUP BY 1")
def q_first_appearances(s, d):
    return I.first_appearances(q_alias_resolution(s, d))


from . import reporting, storage  # noqa: E402,F401  register their queries here
