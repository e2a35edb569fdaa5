"""Stored tables, workbooks, runs and views: what their queries don't show."""

import datetime as dt
import io
import unicodedata
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ladderline.functions import text as X
from ladderline.operators import report as P
from ladderline.operators import sections as Z
from ladderline.plans import catalogue
from ladderline.sources import bindings as B
from ladderline.sources import stored as D
from ladderline.sources import views as W
from ladderline.sources import workbook as K


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- the log ---


def test_log_repeated_and_killed(spark, tmp_path):
    log = D.Log(spark, str(tmp_path / "log"), "id long, name string")
    rows = spark.range(4).selectExpr("id", "'a' name")
    assert _rows(log.read()) == []
    assert log.append(rows, "r1") is True
    assert log.append(spark.range(9).selectExpr("id", "'b' name"), "r1") is False  # a run is one commit
    rows.write.parquet(str(tmp_path / "log/data/r2-killed"))  # a write that never committed
    assert log.read().count() == 4
    assert log.append(rows.limit(1), "r2") is True
    assert log.read().count() == 5 and log.read(["r2"]).count() == 1
    assert log.vacuum() == ["r2-killed"]
    assert log.read().count() == 5 and log.vacuum() == []


def test_log_failing_rows(spark, tmp_path):
    """Rows that fail while they are written leave no commit and no folder."""
    log = D.Log(spark, str(tmp_path / "log"), "id long")
    bad = spark.range(4).select(F.when(F.col("id") == 3, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        log.append(bad, "r1")
    assert log.runs() == [] and log.files.names("data") == []


def test_two_writers_of_one_run(spark, tmp_path):
    """The second to commit a run loses, and its folder goes."""
    a, b = (D.Log(spark, str(tmp_path / "log"), "id long") for _ in range(2))
    b.runs = lambda: []  # looked before the other committed
    assert a.append(spark.range(3), "r1") is True
    assert D.Log.append(b, spark.range(5), "r1") is False
    assert a.read().count() == 3 and len(a.files.names("data")) == 1


def test_checked_append(spark, tmp_path):
    parents = spark.createDataFrame([(1,), (2,), (None,)], "pid long")
    log = D.Log(spark, str(tmp_path / "log"), "id long, parent long")
    make = lambda *rows: spark.createDataFrame(list(rows), "id long, parent long")
    log.append(make((1, 1), (2, 2), (None, None), (None, None)), "ok", key=["id"], references={"parent": (parents, "pid")})
    for n, (batch, rules) in enumerate([(make((3, 1), (3, 1)), {"repeated key": 1}), (make((1, 1), (4, 1)), {"held key": 1}), (make((5, 9), (6, 9), (7, 8)), {"no parent": 2}), (make((1, 7), (1, 7)), {"repeated key": 1, "held key": 1, "no parent": 1})]):
        with pytest.raises(D.Refused) as e:
            log.append(batch, f"bad{n}", key=["id"], references={"parent": (parents, "pid")})
        assert e.value.rules == rules
    assert log.runs() == ["ok"] and log.read().count() == 4 and len(log.files.names("data")) == 1
    assert log.append(make((8, None), (None, 2)), "good", key=["id"], references={"parent": (parents, "pid")})


def test_among_is_exact(spark, monkeypatch):
    """A bitmap that is full lets everything pass; the join decides."""
    monkeypatch.setattr(D, "KEY_BITS", 7)
    held, wanted = spark.range(2000).selectExpr("id k", "cast(id as string) t"), spark.range(1990, 2500).selectExpr("id k", "cast(id as string) t")
    assert sorted(r["k"] for r in D.among(held, ["k", "t"], wanted).collect()) == list(range(1990, 2000))


# --- keyed tables ---


def _files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in Path(path).rglob("part-*")}


def test_merge_rewrites_touched_buckets_only(spark, tmp_path):
    t = D.Keyed(spark, str(tmp_path / "t"), "id long, v string", ["id"], buckets=8)
    t.merge(spark.range(200).selectExpr("id", "'old' v"), ["v"])
    before, parts = _files(tmp_path / "t/data"), t.parts()
    t.merge(spark.createDataFrame([(7, "b"), (7, "a"), (500, "new")], "id long, v string"), ["v"])
    after = t.parts()
    touched = {b for b in after if after[b] != parts.get(b)}
    assert 1 <= len(touched) <= 2
    assert {f: m for f, m in _files(tmp_path / "t/data").items() if f in before} == before  # nothing stored is changed
    state = dict(_rows(t.read()))
    assert len(state) == 201 and state[7] == "a" and state[500] == "new" and state[8] == "old"
    assert t.read(1).count() == 200  # versions stay readable
    t.insert(spark.createDataFrame([(7, "z"), (600, "n"), (600, "m")], "id long, v string"), ["v"])
    state = dict(_rows(t.read()))
    assert state[7] == "a" and state[600] == "m" and len(state) == 202


def test_null_keys_and_empty_batches(spark, tmp_path):
    t = D.Keyed(spark, str(tmp_path / "t"), "a long, b long, v long", ["a", "b"], buckets=4)
    rows = lambda *r: spark.createDataFrame(list(r), "a long, b long, v long")
    assert t.version() == 0 and t.read().count() == 0
    t.merge(rows((1, None, 1), (1, None, 2), (1, 1, 3)), ["v"])
    t.merge(rows((1, None, 4), (1, 1, 5)), ["v"])
    assert _rows(t.read()) == [(1, 1, 5), (1, None, 1), (1, None, 2), (1, None, 4)]
    t.merge(rows().limit(0), ["v"])
    t.insert(rows().limit(0), ["v"])
    assert t.read().count() == 4 and t.version() == 4


def test_conflicting_versions(spark, tmp_path):
    t = D.Keyed(spark, str(tmp_path / "t"), "id long, v long", ["id"], buckets=2)
    t.merge(spark.range(3).selectExpr("id", "id v"), ["v"])
    t.merge(spark.range(1).selectExpr("id", "9L v"), ["v"], at=1)
    with pytest.raises(D.Conflict):
        t.merge(spark.range(2).selectExpr("id", "8L v"), ["v"], at=1)
    assert _rows(t.read()) == [(0, 9), (1, 1), (2, 2)]


def test_runs(spark, tmp_path):
    (tmp_path / "in.csv").write_text("x\n1\n")
    runs = D.Runs(spark, str(tmp_path / "runs"))
    seen = []

    def fails():
        seen.extend(r["run_id"] for r in runs.read().filter("finished_at is null").collect())  # visible before the load
        raise OSError("gone")

    with pytest.raises(OSError, match="gone"):
        D.recorded(runs, str(tmp_path / "in.csv"), fails, "first")
    report = spark.sql("SELECT 'b' name, 2L n UNION ALL SELECT 'a', 1L")
    D.recorded(runs, str(tmp_path / "in.csv"), lambda: {"report": report})
    rows = {r["run_id"]: r for r in runs.read().collect()}
    assert seen == [1] and sorted(rows) == [1, 2]
    assert rows[1]["finished_at"] is None and rows[1]["row_counts"] is None and rows[1]["note"] == "first"
    assert rows[2]["row_counts"] == '{"a":1,"b":2}' and rows[2]["finished_at"] >= rows[2]["started_at"]
    assert len(rows[1]["source_sha256"]) == 64
    with pytest.raises(KeyError):
        runs.finish(3, report)


# --- workbooks ---


def _book(path, content):
    path.write_bytes(K.workbook_bytes(content))


def test_workbook_types_blanks_and_columns(spark, tmp_path):
    header = ["id", "name", "day", "ok", "other"]
    body = [[1, "a & <b> 'é😀", dt.date(2024, 2, 29), True, "x"], [], [None, "", None, None, None], [None, None, None, None, "only the column not asked for"], [2.5, " kept ", "2024-03-01", False, None], ["text", 7, "no day", "maybe", 1]]
    _book(tmp_path / "one.xlsx", {"A": (header, body), "B & C": (["id"], [[5]]), "empty": ([], [])})
    read = lambda sheet, schema="id double, name string, day date, ok boolean, lost long": _rows(K.read_sheet(spark, str(tmp_path / "one.xlsx"), schema, sheet))
    assert read("A") == sorted([(1.0, "a & <b> 'é😀", dt.date(2024, 2, 29), True, None), (None, None, None, None, None), (2.5, " kept ", dt.date(2024, 3, 1), False, None), (None, "7", None, None, None)], key=str)
    assert read("A", "name string") == sorted([("a & <b> 'é😀",), (None,), (" kept ",), ("7",)], key=str)
    assert read("B & C", "id long") == [(5,)] and read("empty", "id long") == [] and read("none", "id long") == []
    whole = K.read_sheet(spark, str(tmp_path), "id double, _sheet string, _file string")
    assert whole.rdd.getNumPartitions() == 3  # one for each sheet
    assert {r["_sheet"] for r in whole.collect()} == {"A", "B & C"}


def test_workbook_of_another_writer(spark, tmp_path):
    """Shared texts with runs, formula results, errors, cells without a place, an absolute target."""
    main, rel = K._MAIN[1:-1], K._LINK[1:].split("}")[0]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId7" Target="/xl/worksheets/s.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="rId7"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>id</t></si><si><r><t>na</t></r><r><t>me</t></r></si><si><t>shared</t></si></sst>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{main}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="AB1" t="s"><v>1</v></c></row><row><c r="A2"><f>1+1</f><v>2</v></c><c r="AB2" t="s"><v>2</v></c></row><row><c r="A3" t="e"><v>#N/A</v></c><c r="AB3" t="str"><v>made</v></c></row><row><c r="A4"/></row></sheetData></worksheet>')
    (tmp_path / "s.xlsx").write_bytes(out.getvalue())
    assert _rows(K.read_sheet(spark, str(tmp_path / "s.xlsx"), "id long, name string", "S")) == [(2, "shared"), (None, "made")]


# --- views ---


def test_view_order():
    assert W.order().index("v_observation") < W.order().index("v_entity_funnel") < W.order().index("v_worklist")
    with pytest.raises(ValueError, match="a needs b needs a"):
        W.order({"a": (("b",), None), "b": (("a",), None)})


def test_views_over_missing_tables(spark, data):
    """Tables that aren't given are empty; the view equals the function's rows."""
    names = W.register({"observation": B.observations(spark, data)})
    assert "v_dwell" in names and spark.sql("SELECT * FROM v_field_current").count() == 0
    view = spark.sql("SELECT entity_id, appearances, furthest, first_legal FROM v_entity_funnel")
    direct = catalogue.QUERIES["funnel_by_entity"](spark, data).select("entity_id", "appearances", "furthest", "first_legal")
    assert _rows(view) == _rows(direct)


# --- the report ---


def test_report_reads_each_table_once(spark, data):
    plan = Z.cells(B.cohort(spark, data), "1996-01", "2001-08-01")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 3


def test_report_of_nothing_and_nulls(spark):
    columns = "name region country country_gap round thesis groups interest score_team score_tech score_oppt status tier channel owner".split()
    companies = spark.createDataFrame([(1, *[None] * len(columns)), (2, *[None] * len(columns))], "entity_id long, " + ", ".join(f"{c} string" for c in columns))
    log = spark.createDataFrame([(1, dt.date(2024, 1, 1), 4, 0), (1, dt.date(2024, 1, 8), 7, 1), (2, dt.date(2024, 1, 1), 3, 1)], "entity_id long, meeting_date date, stage_id int, is_bold int")
    got = {(r["section"], r["part"], r["row"], r["col"]): (r["n"], r["of"]) for r in Z.report(Z.facts(log, companies), "2024-01", "2024-02-01").collect()}
    assert got["1", "current", "7", ""] == (1, 1) and got["2", "conversion", "4-7", ""] == (1, 1)
    assert got["4", "changes", "days", ""] == (7, 1) and got["4", "median days", "7", ""] == (1, 1)
    assert got["5", "round", "_no value_", ""] == (1, 1) and got["6", "country unknown", "untracked", ""] == (1, 1)
    assert got["A", "region", "_no value_", "prelim"] == (0, 0) and got["3", "month", "2024-01", ""] == (1, 1)
    assert Z.report(Z.facts(log.limit(0), companies), "2024-01", "2024-02-01").collect() == []


def test_document(spark, data):
    text = Z.document(Z.report(B.cohort(spark, data), "1996-01", "2001-08-01"))
    for key, title in Z.TITLES.items():
        assert f"## {key}. {title}" in text
    assert "- channel: nothing recorded" in text and "> Recorded for" in text


def test_places(spark):
    rows = spark.createDataFrame([(i, i % 5 if i % 7 else None) for i in range(500)], "id long, k long")
    got = {r["id"]: r["place"] for r in P.in_places(rows, [F.desc_nulls_last("k"), F.col("id")]).collect()}
    want = sorted(range(500), key=lambda i: (i % 7 == 0, -(i % 5), i) if i % 7 else (True, 0, i))
    assert [got[i] for i in want] == list(range(1, 501))


def test_tags_in_use(spark):
    rows = spark.createDataFrame([(2, "AI, straße"), (1, "ai , STRASSE,Robots"), (3, ""), (4, None), (5, "robots,robots")], "entity_id long, value_text string")
    assert _rows(P.tags_in_use(rows)) == [("Robots", 2, "robots"), ("STRASSE", 2, "strasse"), ("ai", 2, "ai")]


def test_folding_without_python(spark, data):
    """Every character of the basic plane as Python has it; letters new in Unicode 16 excepted. No Python worker in the plan."""
    new = set("ᲉꟋꟌꟚꟜ")
    rows = [(i, "x" + chr(i) + "Y") for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000]
    df = spark.createDataFrame(rows, "i long, t string").select("t", X.fold(F.col("t")).alias("f"), X.match_key(F.col("t")).alias("k"))
    import re

    for r in df.collect():
        assert r["f"] == r["t"].casefold() or r["t"][1] in new
        assert r["k"] == re.sub("[^a-z0-9]+", " ", unicodedata.normalize("NFKD", r["t"]).lower()).strip()
    for name in ("alias_resolution", "name_norm", "tag_canonical", "match_ladder"):
        plan = catalogue.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "EvalPython" not in plan
