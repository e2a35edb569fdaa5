"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from ladderline.llm import decontaminate, jaccard, langid, lines, packing, pii, quality, queries, shared, tokens, toxicity, warc


def bench(spark):
    return spark.createDataFrame([(1, "w1 Lorem, ipsum w2 Lorem, ipsum w3 Lorem, ipsum w4 Lorem, ipsum w5 Lorem, ipsum and some"), (2, None), (None, "x")], "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(1, 13)] + [(None, 1), (3, None)], "doc_id long, toxic int")


def token_rows(docs):
    manifest = tokens.write_token_files(docs, shared.new_folder(docs.sparkSession, "tokens"), queries.vocabulary("word_bpe_49k.json"), 1)
    return tokens.read_token_files(docs.sparkSession, manifest)


OPERATORS = {
    "jaccard": jaccard.link,
    "lines": lambda d: lines.deduplicated(d, ["doc_id"]),
    "decontaminate": lambda d: decontaminate.flagged(d, bench(d.sparkSession)),
    "pii": pii.find_spans,
    "toxicity": lambda d: toxicity.score(d, toxicity.train(d, labels(d.sparkSession))),
    "langid": lambda d: langid.classify(d, ["doc_id"]),
    "tokens": token_rows,
    "quality": quality.apply_rules,
}
STAGES = {
    "langid": lambda d: langid.classify(d, d.columns, accepted_only=True),
    "lines": lines.clean,
    "jaccard": jaccard.one_of_each,
    "decontaminate": lambda d: decontaminate.clean(d, bench(d.sparkSession)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_every_row(name, odd):
    out = OPERATORS[name](odd)
    key = lambda rows: sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in rows)
    assert key(out.collect()) == key(odd.select("doc_id").collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_an_empty_table_gives_no_rows(name, odd):
    assert OPERATORS[name](odd.limit(0)).collect() == []


@pytest.mark.parametrize("name", STAGES)
def test_stages_return_the_columns_of_their_input(name, odd):
    out = STAGES[name](odd)
    assert out.columns == odd.columns and out.count() > 0
    assert STAGES[name](odd.limit(0)).collect() == []


def test_jaccard_cases(odd):
    got = {}
    for r in jaccard.link(odd).collect():
        got.setdefault(r["doc_id"], r)
    assert [got[i]["component_id"] for i in (1, 2, 3, 4, 5, 6, 7, 8)] == [1, 2, 3, 4, 4, 6, 6, 8]
    assert [got[i]["n_shingles"] for i in (1, 2, 3, 4)] == [0, 0, 0, 1] and got[None]["component_id"] is None and got[8]["n_links"] == 1


def test_texts_of_one_id_link_each_for_itself(spark):
    word = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    rows = [(1, word("a", 14)), (1, word("b", 104)), (2, word("a", 14) + " end"), (3, word("b", 104) + " end"), (4, word("c", 30)), (5, word("c", 30)), (5, word("d", 40)), (6, word("d", 40) + " end"), (7, word("e", 9)), (0, word("f", 9))]
    got = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["class_id"], r["n_copies"], r["n_links"]) for r in jaccard.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {
        (1, 10): (1, 1, 1, 1), (2, 11): (1, 2, 1, 1), (1, 100): (1, 1, 1, 1), (3, 101): (1, 3, 1, 1),
        (4, 26): (4, 4, 2, 1), (5, 26): (4, 4, 2, 1), (5, 36): (5, 5, 1, 1), (6, 37): (5, 6, 1, 1),
        (7, 5): (7, 7, 1, 0), (0, 5): (0, 0, 1, 0),
    }


def test_line_cases(odd):
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in lines.deduplicated(odd, ["doc_id"]).collect()}
    assert got[1] == (None, 0) and got[2] == ("", 0) and got[12] == ("", 1) and got[11][1] == 0
    assert 12 not in {r["doc_id"] for r in lines.clean(odd).collect()}


def test_empty_benchmark_contaminates_nothing(spark, odd):
    assert not any(r["contaminated"] for r in decontaminate.flagged(odd, bench(spark).limit(0)).collect())
    assert {r["doc_id"] for r in decontaminate.flagged(odd, bench(spark)).collect() if r["contaminated"]} == {6, 7}


def test_items_without_a_window_are_found_whole(spark):
    items = [(1, "Who wrote Hamlet?"), (2, "12 34 56 78 90 11 22 33 44 55"), (3, ""), (4, "not there at all"), (5, "short"), (6, "one two three four five six seven eight nine ten")]
    docs = [(1, "They ask: who wrote HAMLET and when"), (2, "sums 12 34 56, 78 90 11 22 33 44 55 end"), (3, "12 34 56 78 90 11 22 33 44 56"), (4, "who wrote"), (5, "Hamlet"), (6, None), (7, "short"), (8, "say one two three four five six seven eight nine ten"), (None, "short")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate.flagged(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {1: [1], 2: [2], 3: [], 4: [], 5: [], 6: [], 7: [5], 8: [6], None: []}


def test_short_items_are_found_with_other_values(spark):
    items = spark.createDataFrame([(1, "How many apples cost 12 dollars?"), (2, "Name the capital of Peru"), (3, "Solve 3 for x")], "item_id long, text string")
    docs = [(1, "quiz: how many apples cost 99 dollars, please"), (2, "how many pears cost 12 dollars"), (3, "so name the capital of Chile"), (4, "solve 4 for x"), (5, "solve 3 for x now"), (6, "how many apples cost")]
    got = {r["doc_id"]: (r["item_ids"], r["reparameterised"]) for r in decontaminate.flagged(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert got == {1: ([1], True), 2: ([], False), 3: ([2], True), 4: ([], False), 5: ([3], False), 6: ([], False)}


def test_rows_of_one_id_are_one_document_for_items(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (1, "another wording of item one stands here in full")], "item_id long, text string")
    docs = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (1, "clean"), (2, "say another wording of item one stands here in full"), (3, "clean")]
    got = sorted((r["doc_id"], r["contaminated"]) for r in decontaminate.flagged(spark.createDataFrame(docs, "doc_id long, text string"), items).collect())
    assert got == [(1, True), (1, True), (2, False), (3, False)]  # item one has three windows, and the second row two of them


def test_no_labels_give_the_score_nought(spark, odd):
    assert {r["score"] for r in toxicity.score(odd, toxicity.train(odd, labels(spark).limit(0))).collect()} == {0.0}


def test_no_languages_accept_nothing(odd):
    out = langid.classify(odd.withColumn("lang", F.lit(None).cast("string")), ["doc_id"])
    assert not any(r["accepted"] for r in out.collect())


def test_markup_gives_text_and_declared_language(spark):
    rows = [(1, "http://a.example.de/x", '<!DOCTYPE html><HTML class="a" lang=\'de-AT\'><script>var t="</p>";</script><p>Guten&nbsp;Tag</p><!-- no -->'), (2, None, None), (3, "u", ""), (4, "u", '<html><meta http-equiv="content-language" content="fr"><body>Bonjour'), (5, "u", "no markup at all"), (6, "u", '<html xml:lang="es">')]
    got = {r["page_id"]: (" ".join(r["text"].split()) if r["text"] is not None else None, r["declared"]) for r in langid.of_markup(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id"]).collect()}
    assert got == {1: ("Guten Tag", "de"), 2: (None, None), 3: ("", None), 4: ("Bonjour", "fr"), 5: ("no markup at all", None), 6: ("", "es")}


def test_empty_texts_are_not_accepted(odd):
    got = {r["doc_id"]: r["accepted"] for r in langid.classify(odd, ["doc_id"]).collect()}
    assert not (got[1] or got[2] or got[3]) and got[4]


def test_packing_cases(odd):
    path = queries.vocabulary("byte_bpe_50k.json")
    rows = packing.pack_documents(odd, path, 2).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in odd.select("doc_id").collect()}
    assert {r["length"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert packing.pack_documents(odd.limit(0), path, 2).collect() == []


def test_archive_of_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    paths = warc.write_archives(pages, shared.new_folder(spark, "warc"))
    assert paths == [] and warc.read_archives(spark, paths).collect() == []


def test_equal_pages_tie_on_the_smallest_id(spark):
    pages = spark.createDataFrame([(1, "u", "y" * 200), (1, "u", "y" * 200), (2, "u", "y" * 200)], "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("refers_to", F.lit(7))
    got = sorted((r["page_id"], r["record_type"]) for r in warc.read_archives(spark, warc.write_archives(pages, shared.new_folder(spark, "warc"))).collect())
    assert got == [(1, "response"), (1, "response"), (2, "revisit")]


def archived(spark, rows, parts=3, segment=warc.SEGMENT):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
    got = warc.read_archives(spark, warc.write_archives(pages, shared.new_folder(spark, "warc"), segment))
    return sorted(((r["page_id"] or 0), r["payload_bytes"], r["record_type"], r["refers_to"] or 0, r["complete"]) for r in got.collect())


@pytest.mark.parametrize("size", [99, 200, 100_000])
def test_repeated_pages_are_a_record_each(spark, size):
    text = "y" * size
    rows = [(1, "u", text), (1, "u", text), (1, "v", text), (2, "u", text), (2, "u", text), (None, "n", text), (None, "n", text), (3, "u", "z" * size), (3, "u", "z" * size)]
    again = size >= warc.MIN_REVISIT
    want = [(0, size, "response", 0, True)] * 2 + [(1, size, "response", 0, True)] * 3 + [(2, size, "revisit" if again else "response", 1 if again else 0, True)] * 2 + [(3, size, "response", 0, True)] * 2
    assert archived(spark, rows) == want
    assert archived(spark, rows, 1) == want


def test_responses_that_share_a_revisits_slot_are_written(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILTER_BITS", 6)  # so few that every slot is taken
    monkeypatch.setattr(warc, "_SLOT", "shiftrightunsigned(xxhash64(page_id, digest), 58)")
    rows = [(i, "u", f"{i % 40} " * 60) for i in range(300)] + [(None, "u", "0 " * 60)]
    got = archived(spark, rows)
    assert len(got) == 301 and [r[0] for r in got if r[2] == "response"] == [0, *range(40)]
    assert all(r[3] == r[0] % 40 for r in got if r[2] == "revisit")
