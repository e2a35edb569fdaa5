"""Markup in linear time, archives that are damaged, the cascade's work, and what line dedup leaves to the n-gram join."""

import gzip
import re
import time
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline as pipeline
from ladderline.llm import jaccard, langid, lines, quality, queries, warc

# --- markup ---

_UNSEEN = re.compile(r"<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>|&#?[a-z0-9]+;", re.I | re.S | re.A)
_HTML = re.compile(r"<html\b[^>]*?\s(?:xml:)?lang\s*=\s*[\x22']?\s*([a-z]{2,3})", re.I | re.A)
_META = re.compile(r"<meta\b[^>]*?content-language[^>]*?content\s*=\s*[\x22']?\s*([a-z]{2,3})", re.I | re.A)
PIECES = ["<script>", "</script >", "<style x>", "</STYLE>", "<!--", "-->", "<p>", "<", ">", "&amp;", "&", "text ", "İ", "<html ", " lang = 'de'", " xml:lang=fr", "<meta content-language", " content = \"es\"", "lang=", "<scripted>", "<!-->", "-", "\n", "<html>", "</html>"]


def test_markup_says_what_plain_patterns_say():
    rng = np.random.default_rng(8)
    for _ in range(4000):
        html = "".join(PIECES[i] for i in rng.integers(0, len(PIECES), rng.integers(0, 14)))
        assert langid.visible(html) == _UNSEEN.sub(" ", html), html
        want = _HTML.search(html) or _META.search(html)
        assert langid.stated_language(html) == (want.group(1).lower() if want else None), html


@pytest.mark.parametrize("opener", ["<!-- ", "<script ", "<script>", "<style>", "<html ", "<html x>", "<meta content-language ", "<", "<a ", "&amp", "</script ", "<meta ", " lang ", "<!--<script><style>"])
def test_a_million_bytes_of_an_opener(opener):
    html = opener * (1_000_000 // len(opener))
    began = time.perf_counter()
    langid.visible(html)
    langid.stated_language(html)
    assert time.perf_counter() - began < 5


def test_long_suffixes(spark):
    df = spark.createDataFrame([("https://a.museum/x",), ("b.online",), ("host",), (None,), ("http://x.co.uk:80",)], "u string")
    assert [r[0] for r in df.select(langid.suffix_of(df.u)).collect()] == ["museum", "online", None, None, "uk"]


# --- damaged archives ---


def _archives(spark, tmp_path, pages):
    paths = warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/w")
    return [p for p in paths]


def _read(spark, paths):
    return {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["complete"]) for r in warc.read_archives(spark, paths).collect()}


PAGES = [(i, f"http://h/{i}", f"page {i} " * 40) for i in range(6)] + [(6, "http://h/6", "long " * 9000)]


def _members(path):
    raw, out = Path(path.removeprefix("file://")).read_bytes(), []
    at = 0
    while at < len(raw):
        import zlib

        d = zlib.decompressobj(31)
        out.append(d.decompress(raw[at:]) + d.flush())
        at = len(raw) - len(d.unused_data)
    return out


def _rewrite(path, members):
    Path(path.removeprefix("file://")).write_bytes(b"".join(gzip.compress(m) for m in members))


def _damaged(spark, tmp_path, change):
    """The archive rewritten with each member passed through change(); what reads before and after."""
    paths = _archives(spark, tmp_path, PAGES)
    before = _read(spark, paths)
    assert all(c for *_, c in before.values()) and len(before) == 7
    for p in paths:
        _rewrite(p, [change(m) for m in _members(p)])
    return before, _read(spark, paths)


def test_another_digest(spark, tmp_path):
    change = lambda m: m.replace(b"page 3 page", b"page X page") if b"Page-Id: 3\r" in m else m.replace(b"long long", b"lone long", 1) if b"WARC-Segment-Number: 2" in m else m
    before, after = _damaged(spark, tmp_path, change)
    assert after[3] == after[6] == (None, None, False)
    assert {k: v for k, v in after.items() if k not in (3, 6)} == {k: v for k, v in before.items() if k not in (3, 6)}


def test_broken_framing(spark, tmp_path):
    change = lambda m: m.replace(b"\r\n\r\n118\r\n", b"\r\n\r\nzz0\r\n") if b"Page-Id: 2\r" in m else m.replace(b"\r\n0\r\n\r\n", b"\r\n9\r\n\r\n") if b"Page-Id: 4\r" in m else m
    before, after = _damaged(spark, tmp_path, change)
    assert after[2] == after[4] == (None, None, False)
    assert {k: v for k, v in after.items() if k not in (2, 4)} == {k: v for k, v in before.items() if k not in (2, 4)}


@pytest.mark.parametrize("where", ["block", "compression"])
def test_cut_archive(spark, tmp_path, where):
    paths = _archives(spark, tmp_path, PAGES[:6])
    before = _read(spark, paths)
    last = next(p for p in paths if len(_members(p)) > 1)
    members = _members(last)
    page = int(re.search(rb"Page-Id: (\d+)", members[-1]).group(1))
    if where == "block":
        _rewrite(last, [*members[:-1], members[-1][:-120]])
    else:
        file = Path(last.removeprefix("file://"))
        file.write_bytes(file.read_bytes()[:-40])
    after = _read(spark, paths)
    assert after.pop(page)[2] is False
    before.pop(page)
    assert after == before


# --- the cascade ---


def test_later_rules_see_no_rejected_text():
    """Each rule is given the bytes of the texts that all before it let pass, and nothing else."""
    texts = [f"text number {i} with mark{i % 5} " + " ".join(f"ordinary{k} é" for k in range(20)) + "\\n" for i in range(60)]
    data = "".join(texts).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    seen = []

    def rejects(mark):
        def value(x, rows):
            seen.append([x.text(i).decode() for i in range(x.n)])
            assert list(rows) == list(range(x.n)) and x.offsets[-1] == len(x.data) and len(x.words.row) == x.n_words.sum()
            fresh = quality.Texts(x.data, x.offsets)
            assert (fresh.words.start == x.words.start).all() and (fresh.words.end == x.words.end).all() and (fresh.hashes == x.hashes).all() and (fresh.lines[0] == x.lines[0]).all()
            return np.array([mark in x.text(i).decode() for i in range(x.n)], float)

        return quality.Rule(mark, value, 0.5)

    x = quality.Texts(np.frombuffer(data, np.uint8), offsets)
    kept, why, _ = quality.cascade(x, (rejects("mark1"), rejects("mark3"), rejects("none")))
    assert seen[0] == texts
    assert seen[1] == [t for t in texts if "mark1" not in t]
    assert seen[2] == [t for t in seen[1] if "mark3" not in t]
    assert list(kept) == ["mark1" not in t and "mark3" not in t for t in texts]
    assert list(why) == ["mark1" if "mark1" in t else "mark3" if "mark3" in t else None for t in texts]


def test_cascade_saves_work(documents):
    """In the estimated order no more work is counted than in the opposite one, and less than all rules on all texts; verdicts are the same."""
    texts = [r["text"] or "" for r in documents.collect()]
    raw = [t.encode() for t in texts] + [b"!!! $$$ ### " * 200] * 60
    x = lambda: quality.Texts(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])]))
    by_name = {r.name: r for r in quality.RULES}
    order = tuple(by_name[n] for n, _, _ in quality.estimates(documents))
    kept, _, work = quality.cascade(x(), order)
    other, _, more = quality.cascade(x(), order[::-1])
    assert (kept == other).all() and work <= more
    whole = x()
    left = whole.only(np.flatnonzero(~whole.failed))
    for rule in order:
        rule.value(left, np.arange(left.n))
    assert work <= left.work


def test_costs_are_counted_on_the_sample(documents):
    """Two rules that do the same work cost the same, one that does twice as much costs twice; ties keep the given order."""
    once, twice = (lambda x, rows: x.count(quality.SYMBOLS) * 0.0), (lambda x, rows: (x.count(quality.SYMBOLS) + x.count(quality.SYMBOLS)) * 0.0)
    got = quality.estimates(documents, (quality.Rule("b", twice, 1), quality.Rule("a", once, 1), quality.Rule("c", once, 1)))
    cost = {n: c for n, c, _ in got}
    assert cost["a"] == cost["c"] > 0 and cost["b"] == 2 * cost["a"]
    assert [n for n, _, _ in got] == ["b", "a", "c"]


# --- the pipeline ---


def test_line_dedup_keeps_what_is_left(spark, data, documents):
    """A document goes only if it loses all of its words; what remains of the others is for the n-gram join to judge."""
    out = {r["doc_id"]: r["text"] for r in lines.clean(documents).collect()}
    lost = {r["doc_id"]: (r["n_words"], r["words_dropped"]) for r in lines.deduplicated(documents, ["doc_id"]).collect()}
    gone = set(lost) - set(out)
    assert all(n == d > 0 for i, (n, d) in lost.items() if i in gone)
    assert {i for i, (n, d) in lost.items() if n > d or not n} == set(out)


def test_near_duplicate_stage_removes_what_the_join_links(spark, data):
    """On its own input, the stage leaves one row of every linked group, and everything else."""
    docs = queries.table(spark, data, "documents")
    groups = {}
    for r in jaccard.link(docs).collect():
        groups.setdefault(r["component_id"], set()).add(r["doc_id"])
    kept = {r["doc_id"] for r in pipeline.near_duplicates(spark, docs, data).collect()}
    assert sum(len(g) - 1 for g in groups.values()) > 0
    assert kept == {min(g) for g in groups.values()}


def test_blocks_of_a_family_are_shuffled_once(spark, monkeypatch):
    """A family of many blocks: each set goes to its block once, not once for every pair of blocks, and no link is lost."""
    words = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join([*words[:55], f"x{i}", *words[55:]])) for i in range(40)] + [(100 + i, f"one of {i} others with words of its own {i}") for i in range(5)]
    monkeypatch.setattr(jaccard, "LEAST_SETS", 4)
    given, compared = [], jaccard._compared
    monkeypatch.setattr(jaccard, "_compared", lambda df: given.append(df.count()) or compared(df))
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in jaccard.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (0, 39) if i < 40 else (i, 0) for i, _ in rows}
    assert given == [40]
