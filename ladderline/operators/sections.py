"""The cohort report: all its sections as one table of cells, from one row per company and one aggregation (FLW5, SNK6, RPT1-RPT7, RPTA-RPTF, RPTN).

A company gives a cell (section, part, row, col) for every count that it is part of the denominator of,
with hit telling whether it is counted. Cells are summed in each task before they are shuffled, so the
log is read once however many sections there are, and nothing grows but the numbers. Every count has
its denominator in `of`. Values of open vocabularies are counted over the companies that have one; the
row NO_VALUE counts the others over all, so its difference is the coverage. Months are counted over all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import tables as S
from . import metrics as M
from . import report as P

NO_VALUE, TOTAL, MULTI = "_no value_", "_total_", ";"
LADDER = (4, 5, 6, 7)
#: The orders of known categories.
ORDERS = {
    "round": ["Preseed", "Seed", "Series A", "Series B", "Series B+"], "thesis": [name for _, name in S.THESIS_AREAS],
    "interest": ["1. Very High", "2. High", "3. Moderate", "4. Low", "5. Propose Pass"], "score": ["+++", "++", "+"], "groups": S.WORKING_GROUPS,
}
#: Statuses that close a deal, and those that say it never began; groups spelled as theses.
CLOSED, EARLY = ["Pass", "Loss"], ["Sourcing - No Outreach", "Pre-Screen", "Initial Evaluation"]
SPELLED = {"Systems": "Autonomous Systems", "Climate": "Energy & Climate", "Health": "Human Health"}


def facts(obs: DataFrame, companies: DataFrame, floor: int = LADDER[0]) -> DataFrame:
    """A row per company that reached the floor: what the log says of it beside its own columns (entity_id, ...).

    Days between changes and months of discussions are short lists: an entity has at most one entry for each date of the calendar.
    """
    days = obs.groupBy("entity_id", "meeting_date").agg(F.max("stage_id").alias("stage_id"), F.max("is_bold").alias("bold"), F.count("*").alias("rows"), F.sum("is_bold").alias("times"))
    w = Window.partitionBy("entity_id").orderBy("meeting_date")
    prev = days.withColumn("gap", F.when(F.lag("stage_id").over(w) != F.col("stage_id"), F.datediff("meeting_date", F.lag("meeting_date").over(w))))
    seen = prev.groupBy("entity_id").agg(
        F.max("stage_id").alias("furthest"), F.max_by("stage_id", "meeting_date").alias("latest"), F.max("meeting_date").alias("last"), F.min(F.when(F.col("stage_id") >= floor, F.col("meeting_date"))).alias("entered"),
        F.sum("rows").alias("appearances"), F.sum("times").alias("times"), F.collect_list("gap").alias("gaps"), F.collect_list(F.when(F.col("bold") == 1, F.date_format("meeting_date", "yyyy-MM"))).alias("months"),
    )
    return companies.join(seen.filter(F.col("furthest") >= floor), "entity_id")


def _cell(section: str, part: str, row: str, col: str = "''", hit: str = "true", base: str | None = "true", known: list[str] | None = None) -> str:
    """One cell as SQL; row, col, hit and base are expressions, and without a base it is counted over what the part tells. Its rank is the row's place among the known ones; others come after them, NO_VALUE and TOTAL last."""
    rank = "CAST(NULL AS INT)"
    if known:
        rank = f"nullif(array_position(array({', '.join(map(S.literal, known))}), {row}), 0)"
    rank = f"CAST(CASE {row} WHEN '{NO_VALUE}' THEN 1000 WHEN '{TOTAL}' THEN 1001 ELSE coalesce({rank}, 999) END AS INT)"
    flag = lambda x: f"coalesce(CAST({x} AS BIGINT), 0L)"
    over = "CAST(NULL AS BIGINT)" if base is None else flag(base)
    return f"struct('{section}' AS section, '{part}' AS part, {row} AS row, {col} AS col, {flag(hit)} AS hit, {over} AS base, {rank} AS rank, {'true' if known else 'false'} AS ranked)"


_q = S.literal
_DEEP, _PRELIM = "furthest >= 5", "furthest < 5"
_GROUPS = f"array_distinct(filter(transform(split(coalesce(groups, ''), '{MULTI}'), g -> trim(g)), g -> g <> ''))"
_BOTH = "(size(members) > 0 AND thesis IS NOT NULL)"


def _lines(section: str, part: str, lines: dict[str, str], base: str = "true", known: list[str] | None = None) -> list[str]:
    """A cell for each line: its condition, over the companies of the base."""
    return [_cell(section, part, _q(name), "''", test, base, known) for name, test in lines.items()]


def _open(section: str, part: str, known: list[str] | None = None) -> list[str]:
    """The values of a column, and whether there is one."""
    return [f"if({part} IS NULL, array(), array({_cell(section, part, part, base=None, known=known)}))", f"array({_cell(section, part, _q(NO_VALUE), hit=f'{part} IS NULL', known=known)})"]


def _split(section: str, part: str, known: list[str] | None = None) -> list[str]:
    """The same in two groups, with a zero where a value of one group is missing in the other (DET15)."""
    sides = (("'deep'", _DEEP), ("'prelim'", _PRELIM))
    values = ", ".join(_cell(section, part, part, side, at, None, known) for side, at in sides)
    blanks = ", ".join(_cell(section, part, _q(NO_VALUE), side, f"({part} IS NULL AND {at})", at, known) for side, at in sides)
    return [f"if({part} IS NULL, array(), array({values}))", f"array({blanks})"]


def _why(end: str) -> str:
    recent = f"datediff(DATE {_q(end)}, last) <= {P.RECENT_DAYS}"
    return f"CASE WHEN {_DEEP} AND {recent} THEN 'active and past prelim' WHEN {_DEEP} THEN 'deep after closing' WHEN {recent} THEN 'still seen' ELSE 'consistent' END"


def cells(rows: DataFrame, intake_from: str, end: str) -> DataFrame:
    """All cells of all companies, summed: (section, part, row, col, n, of, rank, ranked, first)."""
    among = lambda names: ", ".join(map(_q, names))
    closed, matched, ambiguous = f"coalesce(status IN ({among(CLOSED)}), false)", "coalesce(tier IN ('exact', 'alias', 'suffix', 'prefix'), false)", "coalesce(tier = 'ambiguous', false)"
    spelled = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in SPELLED.items())
    status, theses, steps = f"coalesce(status, '{NO_VALUE}')", ORDERS["thesis"], [*zip(LADDER, LADDER[1:], strict=False), (LADDER[0], LADDER[-1])]
    fixed = _lines("1", "current", {str(s): f"latest = {s}" for s in LADDER}) + _lines("1", "reached", {str(s): f"furthest >= {s}" for s in LADDER})
    for a, b in steps:
        fixed += _lines("2", "conversion", {f"{a}-{b}": f"furthest >= {b}"}, f"furthest >= {a}")
    fixed += _lines("3", "dated", {"dated": "entered IS NOT NULL"}) + _lines("4", "moved", {"moved": "size(gaps) > 0"})
    fixed += _lines("4", "changes", {"days": "aggregate(gaps, 0L, (a, x) -> a + x)"}, "size(gaps)")
    fixed += _lines("5", "grouped", {"Preseed": "round = 'Preseed'", "Seed": "round = 'Seed'", "Series A": "round = 'Series A'", "Series B+": "round RLIKE '^Series [BCD]'"}, known=ORDERS["round"][:3] + ["Series B+"])
    fixed += _lines("C", "early status", {"early but deep": f"(status IN ({among(EARLY)}) AND {_DEEP})"})
    fixed += _lines("D", "coverage", {"groups": "size(members) > 0", "thesis": "thesis IS NOT NULL", "both": _BOTH})
    fixed += _lines("D", "agreement", {"agree": f"({_BOTH} AND array_contains(transform(members, g -> CASE g {spelled} ELSE g END), thesis))"}, _BOTH)
    fixed += _lines("E", "times", {"0": "coalesce(times, 0) = 0", "1-2": "times BETWEEN 1 AND 2", "3+": "times > 2"})
    for name, test in (("with", matched), ("without", f"(NOT {matched} AND NOT {ambiguous})"), ("ambiguous", ambiguous)):
        fixed += [_cell("F", "folders", f"'{s}'", f"'{name}'", f"({test} AND furthest = {s})", f"furthest = {s}") for s in LADDER]
    for name, at in (("deep", _DEEP), ("prelim", _PRELIM)):
        fixed += _lines("F", "groups", {name: f"({matched} AND {at})"}, at)
    fixed += _lines("N", "recorded", {"channel": "channel IS NOT NULL", "owner": "owner IS NOT NULL"})
    one = lambda test, *found: f"if({test}, array({', '.join(found)}), array())"
    parts = [f"array({', '.join(fixed)})"]
    parts += [one(f"month >= {_q(intake_from)}", _cell("3", "month", "month", base=None)), one(f"month < {_q(intake_from)}", _cell("3", "before", "month", base=None))]
    parts += [f"transform(gaps, g -> {_cell('4', 'days', 'CAST(g AS STRING)', base=None)})", f"transform(months, m -> {_cell('E', 'month', 'm', base=None)})"]
    parts += _open("5", "round", ORDERS["round"]) + _open("6", "region") + _open("6", "country") + _open("7", "thesis", theses)
    parts += [one("country IS NULL", _cell("6", "country unknown", "coalesce(country_gap, 'untracked')", base=None))]
    parts += [one("thesis IS NOT NULL", *(_cell("7", "thesis by stage", "thesis", f"'{name}'", test, known=theses) for name, test in [*((str(s), f"furthest = {s}") for s in LADDER), ("deep", _DEEP)]))]
    for section, part, known in (("A", "region", None), ("A", "country", None), ("A", "round", "round"), ("B", "interest", "interest"), ("B", "score_team", "score"), ("B", "score_tech", "score"), ("B", "score_oppt", "score")):
        parts += _split(section, part, ORDERS.get(known))
    parts += [f"array({', '.join(_cell('C', 'status by stage', status, _q(str(s)), f'furthest = {s}') for s in LADDER)})", one(closed, _cell("C", "closed", _why(end), base=None))]
    line = ", ".join(_cell("D", "group by thesis", "g", _q(t), f"thesis = {_q(t)}", known=ORDERS["groups"]) for t in theses)
    parts += [f"if({_BOTH}, flatten(transform(concat(members, array('{TOTAL}')), g -> array({line}))), array())"]
    prepared = rows.withColumns({"members": F.expr(_GROUPS), "month": F.date_format("entered", "yyyy-MM")})
    each = prepared.select("entity_id", F.expr(f"inline(concat({', '.join(parts)}))"))
    return each.groupBy("section", "part", "row", "col").agg(F.sum("hit").alias("n"), F.sum("base").alias("of"), F.min("rank").alias("rank"), F.any_value("ranked").alias("ranked"), F.min(F.when(F.col("hit") > 0, F.col("entity_id"))).alias("first"))


def report(rows: DataFrame, intake_from: str, end: str) -> DataFrame:
    """(section, part, row, col, n, of, pct, place): every section, with each row's place in its part.

    Known categories stand in their own order and the others after them by name (SRT7); parts without an
    order by count, ties by who came first (SRT5, SRT6); dates and stages by themselves. The windows run over a part's rows.
    """
    found = cells(rows, intake_from, end)
    part = Window.partitionBy("section", "part", "col")
    blank = F.max(F.when(F.col("row") == NO_VALUE, F.col("of") - F.col("n"))).over(part)  # covered
    total = F.sum("n").over(part)
    number = F.when(F.col("part") == "days", F.col("row").cast("long"))
    upto = F.sum("n").over(part.orderBy(number, "row").rowsBetween(Window.unboundedPreceding, 0))
    middle = (F.col("part") == "days") & (upto > F.floor(total / 2)) & (upto - F.col("n") <= F.floor(total / 2))
    every = F.max(F.when(F.col("section") == "1", F.col("of"))).over(Window.partitionBy())  # over the cells
    of = F.when(F.col("of").isNotNull(), F.col("of")).when(F.col("section") == "3", every).otherwise(F.coalesce(blank, total))
    out = found.withColumn("of", of).withColumn("middle", middle)
    out = out.withColumn("part", F.explode(F.when(F.col("middle"), F.array(F.col("part"), F.lit("median days"))).otherwise(F.array("part"))))
    named = F.col("ranked") | F.col("part").isin("month", "before") | F.col("section").isin("1", "2") | F.col("part").isin("folders")
    by_count = [F.when(named, 0).otherwise(-F.col("n")), F.when(named, 0).otherwise(F.coalesce("first", F.lit(1 << 62)))]
    place = F.row_number().over(Window.partitionBy("section", "part", "col").orderBy("rank", *by_count, number, "row"))
    return out.withColumn("place", place.cast("long")).select("section", "part", "row", "col", "n", "of", M.X.percent(F.col("n"), F.col("of")).alias("pct"), "place")


#: Titles of the sections.
TITLES = {"1": "Funnel", "2": "Conversion", "3": "Intake", "4": "Time in stage", "5": "Round", "6": "Geography", "7": "Thesis", "A": "Advancement", "B": "Signal", "C": "Status and stage", "D": "Groups and theses", "E": "Discussion", "F": "Folders", "N": "Not in this report"}


def document(cells: DataFrame) -> str:
    """The report as Markdown (SNK6): its rows are counted categories, a table of bounded size."""
    rows = cells.orderBy("section", "part", "col", "place").collect()
    out: list[str] = []
    for key, title in TITLES.items():
        mine = [r for r in rows if r["section"] == key]
        out += [f"## {key}. {title}", ""]
        if key == "N":
            out += [f"- {r['row']}: " + ("nothing recorded, so there is nothing to group by." if not r["n"] else f"recorded for {r['n']} of {r['of']}, not reported.") for r in mine] + [""]
            continue
        for part in dict.fromkeys(r["part"] for r in mine):
            small = [r for r in mine if r["part"] == part]
            low = [r for r in small if r["row"] == NO_VALUE and r["of"] and (r["of"] - r["n"]) / r["of"] < P.LOW_COVERAGE]
            out += [f"### {part}", "", *(f"> Recorded for {r['of'] - r['n']} of {r['of']} only." for r in low), *([""] if low else []), "| | | n | of | % |", "| --- | --- | --- | --- | --- |"]
            out += [f"| {r['row']} | {r['col']} | {r['n']} | {r['of']} | {'n/a' if r['pct'] is None else r['pct']} |" for r in small] + [""]
    return "\n".join(out)
