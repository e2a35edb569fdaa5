"""Scalar functions on literal pairs, and invariants of the writers."""

import pytest
from pyspark.sql import functions as F

from ladderline.functions import text as X
from ladderline.operators import funnel, history, report, resolve, validate
from ladderline.sources import tables as S


def _map(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_domains(spark):
    given = ["https://Acme.com/", "http://www.acme.com/a/b", "acme.com", "WWW.ACME.COM", "", None, "https://"]
    assert _map(spark, X.domain_of, given) == ["acme.com", "acme.com", "acme.com", "acme.com", None, None, None]


def test_names_keep_unicode_letters(spark):
    assert _map(spark, X.norm_name, ["  Zürich-Bio,  Inc. ", "A_b", "Große STRASSE ΑΣ", None]) == ["zürich bio inc", "a_b", "grosse strasse ασ", None]
    assert _map(spark, X.match_key, ["Müller  Optik", "Plain & Co", None, "ﬁne"]) == ["mu ller optik", "plain co", None, "fine"]
    assert _map(spark, X.norm_nfkd, ["Zürich", "ﬁne Co", None]) == ["zu rich", "fine co", None]
    assert _map(spark, X.casefolded, ["Straße"]) == ["strasse"]


def test_stem_keeps_a_name_of_suffixes(spark):
    assert _map(spark, X.stem, ["nova labs inc", "the company"]) == ["nova", "the company"]


def test_scores_prefer_whole_names(spark):
    got = _map(spark, X.canonical_score, ["Tall Oak Bio", "Tall Oak Bio (Raising", "Oak / Elm", "Oak,"])
    assert [g["clean"] for g in got] == [1, 0, 0, 0] and got[0]["words"] == 3


@pytest.mark.parametrize("raw,want", [(" a,B ,b,, c  d ", ["a", "B", "c d"]), (None, []), ("Zeta, alpha", ["alpha", "Zeta"]), ("Straße, STRASSE,x", ["Straße", "x"])])
def test_tags(spark, raw, want):
    assert _map(spark, X.tags, [raw]) == [want]


def test_tag_faults(spark):
    assert _map(spark, X.tag_faults, ["x" * 49, ",".join(map(str, range(25))), "ok"]) == ["tag too long", "too many tags", None]


def test_dates(spark):
    assert [str(x) if x else None for x in _map(spark, X.us_date, ["01/16/2026", "2026-01-16", "13/45/2026", ""])] == ["2026-01-16", "2026-01-16", None, None]
    assert _map(spark, X.loose_iso, ["13/45/2026", "2026-01-16T00", "soon"]) == ["2026-13-45", "2026-01-16", None]


def test_amounts(spark):
    got = _map(spark, X.amount, ["$4,000,000", "0", "-1", "unknown", ""])
    assert [(g["value"], g["is_zero"], g["fault"]) for g in got] == [(4e6, False, None), (0.0, True, None), (None, False, "negative"), (None, False, "not a number"), (None, False, None)]


def test_percent_rounds_halves_to_even(spark):
    row = spark.range(1).select(X.percent(F.lit(2), F.lit(16)), X.percent(F.lit(6), F.lit(16)), X.percent(F.lit(1), F.lit(0))).first()
    assert tuple(row) == (12, 38, None)


def test_groups(spark):
    df = spark.createDataFrame([("Cedar / Kite /Elm Tech",), ("Cedar Kite",), ("A/",)], "v string")
    got = [(r[0], r[1]) for r in df.select(X.is_grouped(F.col("v")), X.group_parts(F.col("v"))).collect()]
    assert got == [(True, ["Cedar", "Kite", "Elm Tech"]), (False, ["Cedar Kite"]), (False, ["A"])]


def test_first_wins_treats_nulls_as_distinct(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "seq int, k string")
    held = spark.createDataFrame([("b",)], "k string")
    assert sorted(r["seq"] for r in S.first_wins(df, ["k"], ["seq"], held).collect()) == [1, 3, 4]


def test_overrides_that_are_no_numbers_change_nothing(spark):
    obs = spark.sql("SELECT 1L observation_id, 9L entity_id, 3 stage_id, 0 is_bold")
    over = spark.sql("SELECT 1L observation_id, 'stage_id' field, 'x' new_value UNION ALL SELECT 1L, 'is_bold', '1'")
    assert funnel.effective(obs, over).selectExpr("stage_id", "is_bold").first() == (3, 1)


def test_one_value_is_current_when_times_tie(spark):
    v = spark.sql("SELECT * FROM VALUES (1L, 7L, 'f', 'a', timestamp'2024-01-01'), (2L, 7L, 'f', 'b', timestamp'2024-01-01') AS v(value_id, entity_id, field, value_text, created_at)")
    assert [r["value_id"] for r in history.current_values(v).collect()] == [2]


def test_ladder_counts_keys_not_records(spark):
    target = spark.createDataFrame([(1, "Nova Inc", True, 1), (1, "Nova Labs", False, 2), (2, "Birchwood Photonics", True, 3)], "rid long, name string, canonical boolean, seq long")
    query = spark.createDataFrame([(1, 0, "nova"), (2, 0, "Nova Inc."), (3, 0, "NOVA LABS"), (4, 0, "Birchwood"), (5, 0, "zzz"), (6, 0, "x"), (6, 1, "birchwood photonics")], "qid long, pos int, name string")
    got = {r["qid"]: (r["tier"], r["rid"], r["candidates"]) for r in resolve.match_ladder(query, target).collect()}
    assert got == {1: ("ambiguous", None, "Nova Inc|Nova Labs"), 2: ("exact", 1, None), 3: ("alias", 1, None), 4: ("prefix", 2, None), 5: ("none", None, None), 6: ("alias", 2, None)}


def test_batch_write_validates_before_it_accepts(spark):
    entities = spark.sql("SELECT 5L entity_id, 'Acme' canonical_name, 'acme.com' domain")
    aliases = spark.sql("SELECT 'Acme Corp' alias_text, 5L entity_id")
    asked = spark.createDataFrame([(1, " New  Co ", "new.co", "Manual", "$0", "b, a"), (2, "acme", "other.com", "Manual", "", ""), (3, "X", "", "Manual", "", ""), (4, "Y", "y.io", "Slides", "", ""), (5, "Z", "z.io", "Public", "-3", "")], "ask_id long, name string, website string, source string, round_size string, tags string")
    out = validate.add_companies(asked, entities, aliases)
    assert [tuple(r) for r in out["accepted"].collect()] == [(1, "New Co", "new.co")]
    assert {r["ask_id"]: r["fault"] for r in out["rejected"].collect()} == {2: "duplicate", 3: "no domain", 4: "source not allowed", 5: "negative"}
    allowed = validate.add_companies(asked, entities, aliases, allow=True)
    assert [(r["ask_id"], r["target_id"], r["matched_on"], r["kind"]) for r in allowed["proposals"].collect()] == [(2, 5, "name", "merge_proposal")]
    assert sorted((r["ask_id"], r["alias_text"], r["alias_norm"]) for r in allowed["aliases"].collect()) == [(1, "New Co", "new co"), (2, "acme", "acme")]


def test_the_second_of_two_equal_new_companies_is_refused(spark):
    entities = spark.sql("SELECT 5L entity_id, 'Acme' canonical_name, 'acme.com' domain, 9L merged_into")
    aliases = spark.sql("SELECT 'Acme Corp' alias_text, 5L entity_id")
    rows = [(1, "New Co", "new.co", "Manual", "", ""), (2, "new  co", "other.co", "Manual", "", ""), (3, "Third", "https://www.New.co/x", "Manual", "", ""), (4, "ACME", "acme.com", "Manual", "", ""), (5, "Bad", "bad.co", None, "", ""), (6, "bad", "bad6.co", "Manual", "", "")]
    asked = spark.createDataFrame(rows, "ask_id long, name string, website string, source string, round_size string, tags string")
    out = validate.add_companies(asked, entities, aliases)
    assert sorted(r["ask_id"] for r in out["accepted"].collect()) == [1, 4, 6]  # 4 doubles a merged entity only
    assert {r["ask_id"]: r["fault"] for r in out["rejected"].collect()} == {2: "duplicate", 3: "duplicate", 5: "source not allowed"}
    found = validate.add_companies(asked, entities, aliases, allow=True)["proposals"].collect()
    assert sorted((r["ask_id"], r["target_ask"], r["matched_on"]) for r in found) == [(2, 1, "name"), (3, 1, "domain")]


def test_payload_round_trip(spark, tmp_path):
    page = S.page_with('{"n": 3}', '<script id="payload" type="application/json">__PAYLOAD__</script>')
    (tmp_path / "p.html").write_text(page)
    assert S.read_payload(spark, str(tmp_path / "p.html"), "n int").first()["n"] == 3
    with pytest.raises(ValueError):
        S.page_with("</script>", "__PAYLOAD__")


def test_payload_keeps_companies_without_observations(spark):
    import json

    obs = spark.sql("SELECT 7L observation_id, 1L entity_id, date'2024-01-01' meeting_date, 5 stage_id, 1 is_bold, 7 slide_page")
    entities = spark.sql("SELECT explode(array(1L, 2L)) entity_id, 'N' name, cast(null as string) domain, false is_phantom")
    fields = spark.sql("SELECT 1L entity_id, 'website' field, 'a.com' value, 'Manual' source, cast(null as string) citation, 'me' user")
    gaps = spark.sql("SELECT 2L entity_id, 'stage' field, 'not_checked' state")
    worklist = spark.sql("SELECT 1L entity_id, 4L gaps, 'P2' priority")
    aliases = spark.sql("SELECT 2L entity_id, explode(array('b', 'a')) alias_text")
    got = {r["entity_id"]: json.loads(r["payload"]) for r in report.payload(entities, obs, spark.sql("SELECT date'2024-01-01' meeting_date, 0 place"), fields, gaps, worklist, aliases, ["website", "stage"]).collect()}
    assert got[1]["obs"] == [[0, 5, 1, 7]] and got[1]["missing"] == ["stage"] and got[1]["gaps"] == 4 and got[1]["observedDeep"] and got[1]["fields"][0]["value"] == "a.com"
    assert got[2]["obs"] == [] and got[2]["gapState"] == {"stage": "not_checked"} and got[2]["aliases"] == ["a", "b"] and got[2]["latest"] is None and got[2]["appearances"] == 0


def test_screening_its_own_result_changes_nothing(spark):
    from ladderline.operators import screen

    obs = spark.sql("SELECT * FROM VALUES (1L, 10L, date'2024-01-01', 4, 0), (2L, 10L, date'2024-01-08', 7, 1), (3L, 11L, date'2024-01-15', 4, 0), (4L, 12L, date'2024-01-15', 5, 0), (5L, 10L, date'2024-01-22', 2, 0) AS v(observation_id, entity_id, meeting_date, stage_id, is_bold)")
    cohort = spark.sql("SELECT 10L entity_id")
    variants = spark.sql("SELECT 'old co' key, 10L target_id")
    entities = spark.sql("SELECT * FROM VALUES (11L, 0, 'old co'), (12L, 0, 'else') AS v(entity_id, pos, key)")
    aliases = spark.sql("SELECT * FROM VALUES (10L, 'Ten'), (11L, 'Old Co'), (12L, 'Else') AS v(entity_id, alias_text)")
    review = spark.sql("SELECT * FROM VALUES (1L, 'merge_proposal', 10L, 12L), (2L, 'line_wrap_candidate', 10L, null), (3L, 'group_split', 10L, null), (4L, 'stage_jump', 10L, null) AS v(review_id, kind, entity_id, target_id)")
    judged = spark.sql("SELECT 10L entity_id")
    out = screen.screen(obs, entities, cohort, variants, aliases, review, judged)
    assert sorted(r["observation_id"] for r in out["observations"].collect()) == [1, 2, 3]
    assert sorted(r["alias_text"] for r in out["aliases"].collect()) == ["Old Co", "Ten"]
    assert sorted((r["review_id"], r["kind"]) for r in out["review"].collect()) == [(3, "group_split"), (4, "stage_jump"), (5, "stage_regression")]
    again = screen.screen(out["observations"], entities, cohort, variants, out["aliases"], out["review"], judged)
    assert sorted(map(tuple, again["companies"].collect())) == sorted(map(tuple, out["companies"].collect()))
    assert sorted(map(tuple, again["review"].select("kind", "entity_id").collect())) == sorted(map(tuple, out["review"].select("kind", "entity_id").collect()))


def test_reach_gives_verdicts_both_ways(spark):
    folders = spark.createDataFrame([(1, "Nova Inc"), (2, "Müller Optik"), (3, "Elsewhere")], "qid long, name string")
    companies = spark.createDataFrame([(7, "Nova", True, 1), (7, "Müller Optik", False, 2)], "rid long, name string, canonical boolean, seq long")
    records = spark.createDataFrame([(8, "M ller Optik", True, 1), (9, "Elsewhere", True, 2)], "rid long, name string, canonical boolean, seq long")
    out = resolve.reach(folders, companies, records)
    assert sorted((r["qid"], r["a"], r["b"], r["segment"]) for r in out["rows"].collect()) == [(1, "suffix", "none", "slides"), (2, "alias", "none", "slides"), (3, "none", "exact", "affinity")]
    assert tuple(out["counts"].first()) == (2, 1, 3, 0)
    assert [(r["qid"], r["tier"], r["rid"]) for r in out["back"].collect()] == [(7, "alias", 2)]


def test_report_orders(spark):
    rows = spark.sql("SELECT * FROM VALUES ('b', 2L, 5L), ('a', 2L, 3L), ('c', 9L, 9L), (null, 1L, 1L) AS v(value, n, first_entity)")
    assert [r["value"] for r in report.by_frequency(rows).collect()] == ["c", "a", "b", None]
    assert [r["value"] for r in report.domain_order(rows, "value", ["c", "b"]).collect()] == ["c", "b", "a", None]
    why = spark.sql("SELECT * FROM VALUES (1L, 'consistent', 7, '2024-01-01'), (2L, 'still seen', 4, '2024-02-01'), (3L, 'still seen', 6, '2024-02-01'), (4L, 'still seen', 6, '2024-01-01') AS v(entity_id, why, furthest, last)")
    assert [r["entity_id"] for r in report.contradiction_order(why).collect()] == [4, 3, 2, 1]
    rows = spark.sql("SELECT * FROM VALUES (1L, 'z', 4, 'none'), (2L, 'a', 4, 'ambiguous'), (3L, 'q', 6, 'none'), (4L, 'h', 7, 'exact') AS v(entity_id, name, furthest, tier)")
    assert [r["entity_id"] for r in report.without_folder(rows).collect()] == [3, 2, 1]


def test_name_places_fold_ascii_only(spark):
    names = ["b", "A", "a", None, "É", "é", "Z", "z"] + [f"n{k}" for k in range(200)]
    df = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    key = lambda i: (names[i] is not None, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in names[i] or ""), i)
    got = {r["id"]: r["place"] for r in report.name_places(df, "name", "id").collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(range(len(names)), key=key)
    assert sorted(got.values()) == list(range(1, len(names) + 1))


def test_vocabularies_and_cells(spark):
    from ladderline.sources import tables as T

    assert {n: T.vocabulary(spark, n).count() for n in ("stage", "section", "pass_reason", "region")} == {"stage": 7, "section": 13, "pass_reason": 14, "region": 3}
    assert _map(spark, X.clean_cell, ["'x", "  ", "NaN", "y", None]) == ["x", None, None, "y", None]
    assert _map(spark, T.version_of, ["a Version: 2.1 b", "none"]) == ["2.1", ""]
    assert T.markdown("T", spark.sql("SELECT 1 a, cast(null as string) b")) == "### T\n\n| a | b |\n| --- | --- |\n| 1 |  |"


def test_run_log_and_append(spark, tmp_path):
    import hashlib

    (tmp_path / "in.csv").write_text("a,b\n1,2\n")
    row = S.run_log(spark, 3, str(tmp_path / "in.csv"), spark.sql("SELECT 4 n"), "2024-01-01 00:00:00").first()
    assert row["row_counts"] == '{"n":4}' and row["source_sha256"] == hashlib.sha256(b"a,b\n1,2\n").hexdigest()
    for _ in range(2):
        S.append(spark.range(2), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4


def test_duplicates_of_every_part_are_found(spark, data):
    from ladderline.plans import catalogue

    got = catalogue.QUERIES["duplicate_finder"](spark, data)
    assert got.filter("entity_id % 2 = 1").count() > 0 and got.filter("ask_id % 5 = 0").count() == 0
    assert got.filter("ask_id % 5 <> 0 and ask_id = entity_id").count() == spark.read.parquet(f"{data}/supplier.parquet").filter("s_suppkey % 5 <> 0").join(spark.read.parquet(f"{data}/part.parquet").filter("p_size <> 50").selectExpr("p_partkey s_suppkey"), "s_suppkey").count()


def test_csv_drops_blank_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,x\n,\n2,\n")
    assert S.read_csv(spark, str(tmp_path / "a.csv"), "a int, b string").count() == 2


def test_stream_gives_the_same_funnel(spark, data, tmp_path):
    from ladderline.sources import bindings
    from ladderline.streaming import log

    obs = bindings.observations(spark, data)
    obs.repartition(3).write.parquet(str(tmp_path / "log"))
    stream = log.stream_funnel(log.stream_observations(spark, str(tmp_path / "log"), obs.schema, 1))
    q = stream.writeStream.format("memory").queryName("funnel").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("funnel").collect())) == sorted(map(tuple, funnel.entity_funnel(obs).collect()))


def test_review_queue_keeps_every_item(spark, data):
    from ladderline.plans import catalogue

    rows = [(i, None if i % 3 == 0 else i % 7 / 10) for i in range(-20, 280)]
    want = {i: k for k, (i, c) in enumerate(sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0])), 1)}
    df = spark.createDataFrame(rows, "review_id long, confidence double")
    for block in (8, 1 << 16):
        assert {r["review_id"]: r["place"] for r in report.queue_places(df, block).collect()} == want
    got = catalogue.QUERIES["review_order"](spark, data)
    assert got.count() == spark.read.parquet(f"{data}/orders.parquet").count() > 100
    assert got.filter("confidence is null").count() > 0


def test_line_queries_take_whole_texts(spark, data):
    import re
    import unicodedata

    from ladderline.plans import catalogue

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    chars = {}
    for r in catalogue.QUERIES["canonical_scores"](spark, data).collect():
        chars[r["doc_id"]] = chars.get(r["doc_id"], -1) + r["chars"] + 1
    assert chars == {i: len(t) for i, t in texts.items()}
    lines = {i: t.count("\n") + 1 for i, t in texts.items()}
    for name in ("name_norm", "tag_canonical"):
        assert {r["doc_id"]: r["count"] for r in catalogue.QUERIES[name](spark, data).groupBy("doc_id").count().collect()} == lines
    assert catalogue.QUERIES["group_split"](spark, data).filter("line > 0").count() > 0
    folded = lambda t: re.sub("[^a-z0-9]+", " ", unicodedata.normalize("NFKD", t).lower()).strip()
    got = {r["doc_id"]: r["norm"] for r in catalogue.QUERIES["name_norm_nfkd"](spark, data).collect()}
    assert got == {i: folded(t) for i, t in texts.items()}


def test_ladder_has_a_row_for_a_name_however_long(spark):
    """Beginnings are found in the order of keys: a name isn't looked up once for every length of it."""
    from ladderline.operators import resolve

    long = "x".join("abcdefghij" * 20)
    query = spark.createDataFrame([(1, 0, long + " and more"), (2, 0, long[:100]), (3, 0, "another name"), (4, 0, "anoth"), (5, 0, long[:9])], "qid long, pos int, name string")
    target = spark.createDataFrame([(10, long, True, 1), (11, "another name too", True, 2), (12, long[:50], True, 3)], "rid long, name string, canonical boolean, seq long")
    out = resolve.match_ladder(query, target)
    got = {r["qid"]: (r["tier"], r["rid"], r["candidates"]) for r in out.collect()}
    both = "|".join([long[:50], long])
    assert got == {1: ("ambiguous", None, both), 2: ("ambiguous", None, both), 3: ("prefix", 11, None), 4: ("none", None, None), 5: ("ambiguous", None, both)}
    assert "sequence(8" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_duplicates_are_never_grouped(spark):
    """Rows that share an id are one ask or one entity, a pair stands once with its best reason, and pairs aren't shuffled."""
    from ladderline.operators import resolve

    asked = spark.createDataFrame([(1, "A", "x.com"), (1, "b ", "y.com"), (2, "c", None)], "ask_id long, name string, domain string")
    entities = spark.createDataFrame([(7, "a", "x.com"), (7, "B", "y.com"), (8, "other", "x.com"), (9, "more", "y.com"), (9, "more", "y.com")], "entity_id long, canonical_name string, domain string")
    aliases = spark.createDataFrame([("B", 9), ("C", 8), ("c", 8)], "alias_text string, entity_id long")
    out = resolve.find_duplicates(asked, entities, aliases)
    assert sorted(map(tuple, out.collect())) == [(1, 7, "name"), (1, 8, "domain"), (1, 9, "alias"), (2, 8, "alias")]
    assert not out._jdf.queryExecution().optimizedPlan().toString().startswith("Aggregate")


def test_folding_looks_at_rare_letters_only_where_there_are_any(spark):
    from ladderline.functions import text as X

    df = spark.createDataFrame([("Plain TEXT",), ("STRASSE straße ẞ",), ("ΟΔΟΣ ς ſ",), ("b,\tB , ß,SS,  a  c ",)], "x string")
    got = df.select(X.fold(F.col("x")).alias("f"), X.tags(F.col("x")).alias("t"))
    assert [r["f"] for r in got.collect()] == ["plain text", "strasse strasse ss", "οδοσ σ s", "b,\tb , ss,ss,  a  c "]
    assert got.collect()[3]["t"] == ["a c", "b", "ß"]
    assert "octet_length" in got._jdf.queryExecution().optimizedPlan().toString()


def test_calendar_is_filled_without_a_join(spark):
    """Gaps of 8 days and fewer stay, repeated and null dates fill nothing, and one shuffle of the dates is all there is."""
    import datetime as dt

    from ladderline.operators import history as H

    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    held = {1: [0, 0, 8, 17, 17, 17, 28], 2: [0, 10, 21, 46], 3: [5], None: [0, 14]}
    rows = [(k, day(n)) for k, v in held.items() for n in v] + [(1, None), (3, None)]
    out = H.fill_calendar(spark.createDataFrame(rows, "entity_id long, meeting_date date"), "entity_id")
    assert sorted(((r[0] or 0), (r[1] - day(0)).days) for r in out.collect()) == [(0, 7), (1, 24), (2, 17), (2, 28), (2, 35), (2, 42)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") <= 2  # once in each of the two plans shown


def test_ladder_deals_each_name_once_and_equals_brute_force(spark):
    """Keys, stems and beginnings are met after one dealing of names, without a join; only what is met is dealt again."""
    import itertools
    import random

    from ladderline.operators import resolve

    rnd = random.Random(5)
    words = ["acme", "the", "Group", "inc", "biolo", "biologics", "Labs", "énergie", "x", "systematic", "systems"]
    made = [" ".join(w) for n in (1, 2, 3) for w in itertools.product(words, repeat=n)]
    query = [(rnd.randrange(400), rnd.randrange(3) * 1000 + i, rnd.choice(made) + rnd.choice(["", "", "!", "s", " and"])) for i in range(900)] + [(900, 0, ""), (901, 0, None), (902, 0, "!"), (902, 1, "Acme Inc")]
    target = [(i, rnd.choice(made) + rnd.choice(["", ".", "e"]), rnd.random() < 0.7, i % 50) for i in range(150)] + [(500, "Acme (Inc)", False, 1), (501, "...", True, 0), (502, None, True, 0)]
    q = spark.createDataFrame(query, "qid long, pos int, name string").withColumn("key", F.coalesce(X.match_key(F.col("name")), F.lit("")))
    t = spark.createDataFrame(target, "rid long, name string, canonical boolean, seq long").withColumn("key", X.match_key(F.col("name"))).filter("key <> ''")
    keyed = [sorted(map(tuple, d.withColumn("stem", X.stem(F.col("key"))).collect()), key=str) for d in (q, t)]
    records = {}
    for rid, name, canonical, seq, key, stem in keyed[1]:
        records[key] = min(records.get(key, (True, 99, 0, "", "")), (not canonical, seq, rid, name, stem))
    want = {}
    for qid in {r[0] for r in query}:
        own = sorted((pos, key, stem) for i, pos, _, key, stem in keyed[0] if i == qid and key)
        found = [(1 if pos == own[0][0] and not records[key][0] else 2, pos, records[key][2:4]) for pos, key, _ in own if key in records]
        found += [(3, pos, r[2:4]) for pos, _, stem in own for r in records.values() if r[4] == stem]
        found += [(4, pos, r[2:4]) for pos, key, _ in own for k, r in records.items() if min(len(k), len(key)) >= 8 and (k.startswith(key) or key.startswith(k))]
        least = sorted((pos, *r) for tier, pos, r in found if tier == min(found)[0])
        tier, names = min(found, default=(0,))[0], sorted({r[2] for r in least})
        want[qid] = ("none", None, None) if not tier else ("ambiguous", None, "|".join(names)) if tier > 2 and len(names) > 1 else (["exact", "alias", "suffix", "prefix"][tier - 1], least[0][1], None)
    out = resolve.match_ladder(q.drop("key"), t.drop("key").unionByName(spark.createDataFrame(target[-2:], "rid long, name string, canonical boolean, seq long")))
    assert {r["qid"]: (r["tier"], r["rid"], r["candidates"]) for r in out.collect()} == want and {w[0] for w in want.values()} == {"exact", "alias", "suffix", "prefix", "ambiguous", "none"}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("RepartitionByExpression") == 1


def test_duplicates_of_equal_asks_and_entities_meet_as_blocks(spark, monkeypatch):
    """Each pair stands once with its best reason whatever the blocks, null ids too; a join meets blocks of ids, and pairs are spread behind it."""
    from ladderline.operators import resolve

    monkeypatch.setattr(resolve, "BLOCK", 4, raising=False)
    monkeypatch.setattr(resolve, "HOT", 6)
    asked = [(i, f"n{i % 3}", f"d{i % 2}.com" if i % 5 else None) for i in range(40)] + [(3, "n1", "d7.com"), (4, "N2 ", None), (99, None, "d1.com")]
    entities = [(i, f"N{i % 4} ", f"d{i % 3}.com") for i in range(50)] + [(7, "n2", "d7.com"), (None, "n0", "d0.com")]
    aliases = [("n1", 8), ("N0", 9), ("n2", 3), ("n2", 8)]
    low = lambda x: x and x.strip().lower()
    names, homes, keys, sites, spelled = {}, {}, {}, {}, {}
    for rows, a, b in ((asked, names, homes), (entities, keys, sites)):
        for i, name, domain in rows:
            a.setdefault(i, set()).update({low(name)} - {None})
            b.setdefault(i, set()).update({domain} - {None})
    for alias, i in aliases:
        spelled.setdefault(i, set()).add(low(alias))
    want = {(a, e): "name" if names[a] & keys[e] else "alias" if names[a] & spelled.get(e, set()) else "domain" for a in names for e in keys if names[a] & (keys[e] | spelled.get(e, set())) or homes[a] & sites[e]}
    out = resolve.find_duplicates(spark.createDataFrame(asked, "ask_id long, name string, domain string"), spark.createDataFrame(entities, "entity_id long, canonical_name string, domain string"), spark.createDataFrame(aliases, "alias_text string, entity_id long"))
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(want) and {(a, e): on for a, e, on in got} == want and set(want.values()) == {"name", "alias", "domain"}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode(ask_ids") == plan.count("explode(entity_ids") == 3
