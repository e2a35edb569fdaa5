"""Line dedup with every line as a template, against all pairs of a leaf."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from ladderline.llm import lines, queries

from .test_results import mask

DOCS = "doc_id long, text string"


def brute(texts):
    """The text of each document: a line stays in the first document of all lines of its leaf that agree with it."""
    docs, rows, leaf = defaultdict(set), Counter(), defaultdict(list)
    for i, t in texts.items():
        for m in {mask(s) for s in t.split("\n")} - {()}:
            docs[m].add(i)
            rows[m] += 1
    for m in docs:
        leaf[(len(m), m[:3])].append(m)
    alike = lambda m: [o for o in leaf[(len(m), m[:3])] if o == m or len(m) >= lines.MIN_WORDS and sum(x == y for x, y in zip(o, m)) >= 0.8 * len(m) - 1e-9]
    owner = {m: min(min(docs[o]) for o in alike(m)) if len(m) >= lines.MIN_WORDS or rows[m] >= lines.SHORT_ROWS else None for m in docs}
    return {i: "\n".join(s for s in t.split("\n") if not mask(s) or owner[mask(s)] in (None, i)) for i, t in texts.items()}


#: The first line has the last run of all three and agrees with neither other; those agree with one another.
HIDDEN = {1: "a b c x x x x h i j\nfirst", 2: "a b c d e f g h i j\nsecond", 3: "a b c p e q g h i j\nthird"}


def test_lines_behind_another_earliest_are_found(spark, tmp_path):
    spark.createDataFrame(list(HIDDEN.items()), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["text"] for r in queries.op2_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: HIDDEN[1], 2: HIDDEN[2], 3: "third"}


@pytest.mark.parametrize("block", [lines.BLOCK_LINES, 3])
def test_every_line_is_a_template(spark, monkeypatch, block):
    monkeypatch.setattr(lines, "BLOCK_LINES", block)
    r = np.random.default_rng(5)
    texts = {}
    for i in range(240):
        n = int(r.choice([5, 7, 10, 16, 31]))
        base = ["the", "same", "leaf", *(f"b{'xyz'[k % 3]}{'q' * k}" for k in range(n - 3))]
        for _ in range(int(r.integers(0, n // 3 + 2))):
            base[int(r.integers(3, n))] = "abcdefgh"[int(r.integers(8))]
        texts[i] = " ".join(base) + f"\nof its own {'o' * (i + 1)} is this line"
    df = spark.createDataFrame(list(texts.items()), DOCS)
    text = lambda out: {x["doc_id"]: x["text"] for x in out.collect()}
    want = brute(texts)
    assert text(lines.deduplicated(df, ["doc_id"], every=True)) == want
    earliest_only = text(lines.deduplicated(df, ["doc_id"]))
    assert sum(earliest_only[i] != want[i] for i in texts) == 20
