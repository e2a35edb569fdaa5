"""Queries of the cohort report, its orders, the views and the tags in use; each with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as H
from ..operators import report as P
from ..operators import sections as Z
from ..sources import bindings as B
from ..sources import tables as S
from ..sources import views as W
from .catalogue import CTE, query

FROM_MONTH, END = "1996-01", "2001-08-01"
CTE |= {
    "co_obs": "SELECT o_custkey AS entity_id, CAST(o_orderdate AS DATE) AS meeting_date, 8 - CAST(substr(o_orderpriority, 1, 1) AS INT) AS stage_id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS is_bold FROM orders",
    "co_days": "SELECT entity_id, meeting_date, max(stage_id) AS stage_id, max(is_bold) AS bold FROM co_obs GROUP BY 1, 2",
    "co_gaps": "SELECT * FROM (SELECT entity_id, stage_id <> lag(stage_id) OVER w AS moved, date_diff('day', lag(meeting_date) OVER w, meeting_date) AS days FROM co_days WINDOW w AS (PARTITION BY entity_id ORDER BY meeting_date)) WHERE moved AND entity_id IN (SELECT entity_id FROM co)",
    "co_seen": "SELECT entity_id, max(stage_id) AS furthest, arg_max(stage_id, meeting_date) AS latest, max(meeting_date) AS last, min(meeting_date) FILTER (WHERE stage_id >= 4) AS entered FROM co_days GROUP BY 1",
    "co": "SELECT c_custkey AS entity_id, " + ", ".join(f"{e} AS {n}" for n, e in B.COHORT.items()) + ", s.furthest, s.latest, s.last, s.entered, b.times FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN co_seen s ON s.entity_id = c_custkey JOIN (SELECT entity_id, sum(is_bold) AS times FROM co_obs GROUP BY 1) b ON b.entity_id = c_custkey WHERE s.furthest >= 4",
    "co_groups": "SELECT DISTINCT entity_id, trim(g) AS g, thesis FROM (SELECT entity_id, thesis, unnest(string_split(groups, ';')) AS g FROM co) WHERE trim(g) <> ''",
}
_STAGES = "(SELECT unnest([4, 5, 6, 7]) AS s)"


def _cells(section: str, part: str, row: str, col: str, n: str, of: str, source: str, key: str = "NULL") -> str:
    """Cells grouped by row and col; key: what orders the rows."""
    return f"SELECT '{section}' AS section, '{part}' AS part, CAST({row} AS VARCHAR) AS row, CAST({col} AS VARCHAR) AS col, CAST({n} AS BIGINT) AS n, CAST({of} AS BIGINT) AS of, {key} AS key FROM {source} GROUP BY 3, 4"


def _known(order: list[str] | None, value: str) -> str:
    """The place of a known category; others by name behind them; or by count and the first company."""
    if order is None:
        return f"struct_pack(a := 0, b := -count(*), c := min(entity_id), d := min({value}))"
    return f"struct_pack(a := coalesce(nullif(list_position([{', '.join(map(S.literal, order))}], min({value})), 0), 999), b := 0, c := 0, d := min({value}))"


_NONE = "struct_pack(a := 1000, b := 0, c := 0, d := '')"
_BY_ROW = "struct_pack(a := 0, b := 0, c := 0, d := min({0}))"


def _open(section: str, part: str, value: str, order: list[str] | None = None) -> list[str]:
    return [
        _cells(section, part, value, "''", "count(*)", f"(SELECT count({value}) FROM co)", f"co WHERE {value} IS NOT NULL", _known(order, value)),
        _cells(section, part, "'_no value_'", "''", f"count(*) FILTER (WHERE {value} IS NULL)", "count(*)", "co", _NONE),
    ]


def _split(section: str, value: str, order: list[str] | None = None) -> list[str]:
    out = []
    for side, test in (("deep", "furthest >= 5"), ("prelim", "furthest < 5")):
        key = _known(order, value) if order else f"struct_pack(a := 0, b := -count(*) FILTER (WHERE {test}), c := coalesce(min(entity_id) FILTER (WHERE {test}), 4611686018427387904), d := min({value}))"
        out.append(_cells(section, value, value, f"'{side}'", f"count(*) FILTER (WHERE {test})", f"(SELECT count({value}) FILTER (WHERE {test}) FROM co)", f"co WHERE {value} IS NOT NULL", key))
        out.append(_cells(section, value, "'_no value_'", f"'{side}'", f"count(*) FILTER (WHERE {value} IS NULL AND {test})", f"count(*) FILTER (WHERE {test})", "co", _NONE))
    return out


def _lines(section: str, part: str, lines: dict[str, tuple[str, str]], order: str = "d") -> list[str]:
    """One line each: (counted, counted over)."""
    rank = lambda i, r: f"struct_pack(a := {i if order == 'a' else 0}, b := {'-count(*) FILTER (WHERE ' + lines[r][0] + ')' if order == 'n' else 0}, c := {'min(entity_id) FILTER (WHERE ' + lines[r][0] + ')' if order == 'n' else 0}, d := '{r}')"
    return [_cells(section, part, f"'{r}'", "''", f"count(*) FILTER (WHERE {test})", f"count(*) FILTER (WHERE {base})", "co", rank(i, r)) for i, (r, (test, base)) in enumerate(lines.items())]


_WHY = f"CASE WHEN furthest >= 5 AND date_diff('day', last, DATE '{END}') <= 56 THEN 'active and past prelim' WHEN furthest >= 5 THEN 'deep after closing' WHEN date_diff('day', last, DATE '{END}') <= 56 THEN 'still seen' ELSE 'consistent' END"
_MATCHED, _EVERY = "coalesce(tier IN ('exact', 'suffix'), false)", "true"
_COUNTED = "struct_pack(a := 0, b := -count(*), c := min(entity_id), d := min({0}))"
_MONTH, _HAS = "strftime(entered, '%Y-%m')", "entity_id IN (SELECT entity_id FROM co_groups)"
_THESES, _GROUPS = Z.ORDERS["thesis"], Z.ORDERS["groups"]
_ALL = "(SELECT count(*) FROM co)"
_AGREE = "EXISTS (SELECT 1 FROM co_groups x WHERE x.entity_id = co.entity_id AND CASE x.g WHEN 'Systems' THEN 'Autonomous Systems' WHEN 'Climate' THEN 'Energy & Climate' WHEN 'Health' THEN 'Human Health' ELSE x.g END = co.thesis)"
_PARTS = [
    _cells("1", "current", "s", "''", "count(*) FILTER (WHERE latest = s)", "count(*)", f"co CROSS JOIN {_STAGES}", _BY_ROW.format("CAST(s AS VARCHAR)")),
    _cells("1", "reached", "s", "''", "count(*) FILTER (WHERE furthest >= s)", "count(*)", f"co CROSS JOIN {_STAGES}", _BY_ROW.format("CAST(s AS VARCHAR)")),
    *_lines("2", "conversion", {f"{a}-{b}": (f"furthest >= {b}", f"furthest >= {a}") for a, b in ((4, 5), (4, 7), (5, 6), (6, 7))}),
    *_lines("3", "dated", {"dated": ("entered IS NOT NULL", _EVERY)}),
    _cells("3", "month", _MONTH, "''", "count(*)", _ALL, f"co WHERE {_MONTH} >= '{FROM_MONTH}'", _BY_ROW.format(_MONTH)),
    _cells("3", "before", _MONTH, "''", "count(*)", _ALL, f"co WHERE {_MONTH} < '{FROM_MONTH}'", _BY_ROW.format(_MONTH)),
    *_lines("4", "moved", {"moved": ("entity_id IN (SELECT entity_id FROM co_gaps)", _EVERY)}),
    _cells("4", "changes", "'days'", "''", "sum(days)", "count(*)", "co_gaps", _BY_ROW.format("'days'")),
    _cells("4", "days", "days", "''", "count(*)", "(SELECT count(*) FROM co_gaps)", "co_gaps", "struct_pack(a := 0, b := -count(*), c := min(entity_id), d := min(lpad(CAST(days AS VARCHAR), 9, '0')))"),
    "SELECT '4', 'median days', CAST(m AS VARCHAR), '', (SELECT count(*) FROM co_gaps WHERE days = m), (SELECT count(*) FROM co_gaps), struct_pack(a := 0, b := 0, c := 0, d := '') FROM (SELECT list_sort(list(days))[count(*) // 2 + 1] AS m FROM co_gaps)",
    *_open("5", "round", "round", Z.ORDERS["round"]),
    *_lines("5", "grouped", {"Preseed": ("round = 'Preseed'", _EVERY), "Seed": ("round = 'Seed'", _EVERY), "Series A": ("round = 'Series A'", _EVERY), "Series B+": ("round IN ('Series B', 'Series C')", _EVERY)}, "a"),
    *_open("6", "region", "region"), *_open("6", "country", "country"),
    _cells("6", "country unknown", "coalesce(country_gap, 'untracked')", "''", "count(*)", "(SELECT count(*) FROM co WHERE country IS NULL)", "co WHERE country IS NULL", _COUNTED.format("coalesce(country_gap, 'untracked')")),
    *_open("7", "thesis", "thesis", _THESES),
    _cells("7", "thesis by stage", "thesis", "s", "count(*) FILTER (WHERE furthest = s)", "count(*)", f"co CROSS JOIN {_STAGES} WHERE thesis IS NOT NULL", _known(_THESES, "thesis")),
    _cells("7", "thesis by stage", "thesis", "'deep'", "count(*) FILTER (WHERE furthest >= 5)", "count(*)", "co WHERE thesis IS NOT NULL", _known(_THESES, "thesis")),
    *_split("A", "region"), *_split("A", "country"), *_split("A", "round", Z.ORDERS["round"]), *_split("B", "interest", Z.ORDERS["interest"]),
    *(x for f in ("score_team", "score_tech", "score_oppt") for x in _split("B", f, Z.ORDERS["score"])),
    _cells("C", "status by stage", "coalesce(status, '_no value_')", "s", "count(*) FILTER (WHERE furthest = s)", "count(*)", f"co CROSS JOIN {_STAGES}", "struct_pack(a := CASE WHEN min(coalesce(status, '_no value_')) = '_no value_' THEN 1000 ELSE 0 END, b := -count(*) FILTER (WHERE furthest = s), c := coalesce(min(entity_id) FILTER (WHERE furthest = s), 4611686018427387904), d := min(coalesce(status, '_no value_')))"),
    _cells("C", "closed", _WHY, "''", "count(*)", "(SELECT count(*) FROM co WHERE status IN ('Pass', 'Loss'))", "co WHERE status IN ('Pass', 'Loss')", _COUNTED.format(_WHY)),
    *_lines("C", "early status", {"early but deep": ("status = 'Pre-Screen' AND furthest >= 5", _EVERY)}),
    *_lines("D", "coverage", {"groups": (_HAS, _EVERY), "thesis": ("thesis IS NOT NULL", _EVERY), "both": (f"thesis IS NOT NULL AND {_HAS}", _EVERY)}, "n"),
    *_lines("D", "agreement", {"agree": (f"thesis IS NOT NULL AND {_HAS} AND {_AGREE}", f"thesis IS NOT NULL AND {_HAS}")}),
    _cells("D", "group by thesis", "g", "t", "count(*) FILTER (WHERE thesis = t)", "count(*)", f"co_groups CROSS JOIN (SELECT unnest([{', '.join(map(S.literal, _THESES))}]) AS t) WHERE thesis IS NOT NULL", _known(_GROUPS, "g")),
    _cells("D", "group by thesis", "'_total_'", "t", "count(*) FILTER (WHERE thesis = t)", "count(*)", f"co CROSS JOIN (SELECT unnest([{', '.join(map(S.literal, _THESES))}]) AS t) WHERE thesis IS NOT NULL AND {_HAS}", "struct_pack(a := 1001, b := 0, c := 0, d := '')"),
    *_lines("E", "times", {"0": ("times = 0", _EVERY), "1-2": ("times BETWEEN 1 AND 2", _EVERY), "3+": ("times > 2", _EVERY)}, "n"),
    _cells("E", "month", "strftime(meeting_date, '%Y-%m')", "''", "count(*)", "(SELECT count(*) FROM co_days WHERE bold = 1 AND entity_id IN (SELECT entity_id FROM co))", "co_days WHERE bold = 1 AND entity_id IN (SELECT entity_id FROM co)", _BY_ROW.format("strftime(meeting_date, '%Y-%m')")),
    *(_cells("F", "folders", "s", f"'{name}'", f"count(*) FILTER (WHERE furthest = s AND {test})", "count(*) FILTER (WHERE furthest = s)", f"co CROSS JOIN {_STAGES}", _BY_ROW.format("CAST(s AS VARCHAR)")) for name, test in (("with", _MATCHED), ("ambiguous", "coalesce(tier = 'ambiguous', false)"), ("without", "tier IS NULL"))),
    *_lines("F", "groups", {"deep": (f"{_MATCHED} AND furthest >= 5", "furthest >= 5"), "prelim": (f"{_MATCHED} AND furthest < 5", "furthest < 5")}, "n"),
    *_lines("N", "recorded", {"channel": ("channel IS NOT NULL", _EVERY), "owner": ("owner IS NOT NULL", _EVERY)}, "n"),
]


@query(f"SELECT section, part, row, col, n, of, CASE WHEN of = 0 THEN NULL ELSE CAST(round_even(n / of * 100, 0) AS BIGINT) END AS pct, row_number() OVER (PARTITION BY section, part, col ORDER BY key) AS place FROM ({' UNION ALL '.join(_PARTS)})")
def q_report_sections(s, d):
    return Z.report(B.cohort(s, d), FROM_MONTH, END)


_PLACES = "row_number() OVER (ORDER BY {0}) AS place"


@query(f"SELECT entity_id, why, {_PLACES.format('CASE WHEN why = ' + chr(39) + 'consistent' + chr(39) + ' THEN 1 ELSE 0 END, furthest DESC, last, entity_id')} FROM (SELECT *, {_WHY} AS why FROM co WHERE status IN ('Pass', 'Loss'))")
def q_contradiction_places(s, d):
    closed = B.cohort(s, d).filter(F.col("status").isin(Z.CLOSED)).select("entity_id", "furthest", "last")
    return P.in_places(P.contradictions(closed, END), P.contradiction_keys()).select("entity_id", "why", "place")


@query(f"SELECT entity_id, tier, {_PLACES.format('furthest DESC, entity_id')} FROM co WHERE furthest >= 5 AND coalesce(tier, 'none') IN ('none', 'ambiguous')")
def q_folderless_places(s, d):
    """Names of customers rise with their keys."""
    rows = P.folderless(B.cohort(s, d).filter("furthest >= 5").select("entity_id", "name", "furthest", "tier"))
    return P.in_places(rows, P.folder_keys()).select("entity_id", "tier", "place")


_GROUP_CELLS = ", ".join(f"count(*) FILTER (WHERE thesis = {S.literal(t)}) AS \"{t}\"" for t in _THESES)


@query(f"SELECT g AS \"group\", {_GROUP_CELLS}, count(*) AS total FROM co_groups WHERE thesis IS NOT NULL GROUP BY 1 UNION ALL SELECT '_total_', {_GROUP_CELLS}, count(*) FROM co WHERE thesis IS NOT NULL AND {_HAS}")
def q_group_thesis_table(s, d):
    return P.membership_table(B.cohort(s, d), "groups", "thesis", _THESES).drop("place")


_STATUS_CELLS = ", ".join(f"count(*) FILTER (WHERE furthest = {k}) AS s{k}" for k in Z.LADDER)


@query(f"SELECT coalesce(status, '_no value_') AS status, {_STATUS_CELLS}, count(*) AS total, {_PLACES.format('CASE WHEN status IS NULL THEN 1 ELSE 0 END, count(*) DESC, min(entity_id)')} FROM co GROUP BY status")
def q_status_stage_table(s, d):
    return P.status_table(B.cohort(s, d), "status", "furthest", list(Z.LADDER))


_TAGS = "event_type || ', T' || CAST(floor(value / 20) AS INT) || ',' || CASE WHEN value > 100 THEN upper(event_type) ELSE event_type || ' ' END || ' , t' || CAST(floor(value / 15) AS INT)"
CTE["tag_rows"] = f"SELECT user_id AS entity_id, arg_max({_TAGS}, event_id) AS value_text FROM events GROUP BY 1"
CTE["tag_each"] = "SELECT entity_id, trim(t) AS tag FROM (SELECT entity_id, unnest(string_split(value_text, ',')) AS t FROM tag_rows) WHERE trim(t) <> ''"
CTE["tag_first"] = "SELECT entity_id, lower(tag) AS k, (SELECT trim(x) FROM (SELECT unnest(string_split(r.value_text, ',')) AS x, generate_subscripts(string_split(r.value_text, ','), 1) AS i) WHERE lower(trim(x)) = lower(tag) ORDER BY i LIMIT 1) AS tag FROM tag_each JOIN tag_rows r USING (entity_id)"


@query("SELECT arg_min(tag, entity_id) AS tag, count(DISTINCT entity_id) AS companies, k AS folded FROM tag_first GROUP BY k")
def q_tags_in_use(s, d):
    """Every event sets its user's tags anew; only the last lists count."""
    tags = F.expr(_TAGS.replace("CAST(floor(value / 20) AS INT)", "cast(cast(floor(value / 20) as int) as string)").replace("CAST(floor(value / 15) AS INT)", "cast(cast(floor(value / 15) as int) as string)"))
    values = S.table(s, d, "events").select(F.col("user_id").alias("entity_id"), F.lit("tags").alias("field"), tags.alias("value_text"), F.col("event_id").alias("value_id"), F.col("event_id").alias("created_at"))
    return P.tags_in_use(H.current_values(values))


def _registered(s, d):
    """All views over the event log and its overrides."""
    part = S.table(s, d, "customer").selectExpr("c_custkey entity_id", "c_name canonical_name", "CASE WHEN c_custkey % 10 = 0 THEN c_custkey - 1 END merged_into")
    return W.register({"observation": B.observations(s, d), "override": B.overrides(s, d), "field_value": B.field_values(s, d), "entity": part})


_SHADOWED = "SELECT observation_id, entity_id, meeting_date, CASE WHEN observation_id % 50 = 0 THEN 5 ELSE stage_id END AS stage_id, CASE WHEN observation_id % 70 = 0 THEN 1 ELSE is_bold END AS is_bold FROM obs"


@query(f"SELECT entity_id, count(*) AS appearances, CAST(min(meeting_date) AS VARCHAR) AS first_seen, max(stage_id) AS furthest, sum(is_bold) AS bold, max(CASE WHEN stage_id >= 5 THEN 1 ELSE 0 END) AS reached_deep, CAST(min(CASE WHEN stage_id >= 5 THEN meeting_date END) AS VARCHAR) AS first_deep FROM ({_SHADOWED}) GROUP BY 1")
def q_view_entity_funnel(s, d):
    _registered(s, d)
    return s.sql("SELECT entity_id, appearances, first_seen, furthest, bold, reached_deep, first_deep FROM v_entity_funnel")


@query(f"SELECT l.entity_id, CAST(last_seen AS VARCHAR) AS last_seen, latest, times, dwell, c.changes FROM (SELECT entity_id, max(meeting_date) AS last_seen, arg_max(stage_id, (meeting_date, observation_id)) AS latest, sum(is_bold) AS times FROM ({_SHADOWED}) GROUP BY 1) l JOIN (SELECT entity_id, stage_id, count(*) AS dwell FROM ({_SHADOWED}) GROUP BY 1, 2) w ON w.entity_id = l.entity_id AND w.stage_id = l.latest LEFT JOIN (SELECT entity_id, count(*) AS changes FROM (SELECT entity_id, stage_id, lag(stage_id) OVER (PARTITION BY entity_id ORDER BY meeting_date, observation_id) AS f FROM ({_SHADOWED})) WHERE f <> stage_id GROUP BY 1) c ON c.entity_id = l.entity_id")
def q_views_joined(s, d):
    _registered(s, d)
    return s.sql("""
        SELECT l.entity_id, CAST(l.last_seen AS STRING) last_seen, l.latest_stage_id latest, t.times, w.meetings dwell, c.changes
        FROM v_entity_latest_stage l JOIN v_entity_discussion t ON t.entity_id = l.entity_id
        JOIN v_dwell w ON w.entity_id = l.entity_id AND w.stage_id = l.latest_stage_id
        LEFT JOIN (SELECT entity_id, count(*) changes FROM v_stage_transition GROUP BY entity_id) c ON c.entity_id = l.entity_id""")


@query("SELECT c_custkey AS entity_id, CASE WHEN c_custkey % 10 = 0 THEN c_custkey - 1 ELSE c_custkey END AS live_entity_id, value_text FROM customer LEFT JOIN (SELECT entity_id, arg_max(value_text, (created_at, value_id)) AS value_text FROM fv GROUP BY 1) ON entity_id = c_custkey")
def q_view_resolved_fields(s, d):
    _registered(s, d)
    return s.sql("SELECT r.entity_id, r.live_entity_id, f.value_text FROM v_entity_resolved r LEFT JOIN v_field_current f ON f.entity_id = r.entity_id")
