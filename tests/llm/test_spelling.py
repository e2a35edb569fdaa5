"""Spelling variants against every edit of every word, and against SQL."""

import re
import zlib
from collections import Counter

import duckdb
import pytest

from ladderline.llm import queries, spelling


def brute(rows):
    """From (doc_id, text): the rows of variants(), by writing out all edits of each word."""
    counts = Counter()
    for doc_id, text in rows:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= 2}
    letters = sorted({c for w in words for c in w})
    form, near = {}, {}
    for w, n in words.items():
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + k :] for i in range(len(w) + 1) for c in letters for k in (0, 1)}
        found = sorted((e for e in edits if e in words and e != w), key=lambda e: (-words[e], e))
        near[w] = len(found)
        form[w] = found[0] if found and words[found[0]] >= 10 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, near[w], words[form[w]] if form[w] else None))
    return out


def got(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture
def small_tries(monkeypatch):
    """Many shards, and a wave for each few of them."""
    monkeypatch.setattr(spelling, "SHARD_NODES", 2000)
    monkeypatch.setattr(spelling, "WAVE_BYTES", 60_000)
    monkeypatch.setattr(spelling, "HELD_WORDS", 300)
    monkeypatch.setattr(spelling, "TASK_WORDS", 500)


def test_documents(documents, texts):
    want = brute(texts.items())
    assert sum(r[4] for r in want) > 500
    assert got(spelling.variants(documents)) == want


def test_waves(documents, texts, small_tries):
    assert got(spelling.variants(documents)) == brute(texts.items())


def test_sql(spark, data):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    assert got(queries.QUERIES["op11_spelling_variants"](spark, data)) == set(c.execute(queries.ORACLES["op11_spelling_variants"]).fetchall())


CHAINS = ["abcdefghij"] * 1300, ["abcdefghi"] * 120, ["abcdefgh"] * 11, ["abcdefhg"] * 3, ["bookkeeper", "bookeeper", "bokkeeper", "bookkkeeper", "bookkeeperr"] * 2, ["aaaaaaaa", "aaaaaaaaa", "aaaaaaab"] * 4, ["ÿÀ×÷éèê", "ÿÀ×÷éèe", "ÀÀ×÷éèê", "éÿÀ×÷éèê"] * 3, ["onlyonce"]


@pytest.mark.parametrize("shift", range(4))
def test_edits_of_every_place(spark, shift):
    """Runs of equal letters, both halves, chains of forms, ties, letters beyond ASCII."""
    words = [w for part in CHAINS for w in part]
    base = "mnopqrstu"[shift : shift + 8]
    words += [e for i in range(len(base) + 1) for e in (base[:i] + base[i + 1 :], base[:i] + "z" + base[i:], base[:i] + "z" + base[i + 1 :]) for _ in range(2)] + [base] * 25
    rows = [(7 * shift, " ".join(words)), (None, "Null-id, NULLIDX nullidx nullidx")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(spelling.variants(df)) == brute(rows)


def test_odd(spark, odd):
    """Nulls, empty texts, repeated rows, clashing columns; a run of 100,000 letters twice."""
    plain = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert got(spelling.variants(odd)) == brute(plain)
    # the checksum may take a letter out of one of the two: look at ids where it doesn't
    run = "ab" * 50_000
    ids = [i for i in range(40) if zlib.crc32(f"{i}:{run}".encode()) % 31][:2]
    long = spark.createDataFrame([(i, run) for i in ids], "doc_id long, text string")
    assert got(spelling.variants(long)) == {(run, None, run, 2, 0, None)}
    assert got(spelling.variants(odd.limit(0))) == set()
