"""Vector codes against plain Lloyd rounds in Python, and against SQL."""

import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ladderline.llm import codes, queries, shared

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, rounds=4):
    """From (vec_id, vector, label) that can all be coded: the rows of compress(), with every distance written out."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    whole = [[math.floor(1024 * x) for x in r[1]] for r in rows]
    w = len(whole[0]) // 4
    seeds = {}
    for r, v in zip(rows, whole, strict=True):
        if r[0] is not None:
            seeds[r[0]] = min(seeds.get(r[0], v), v)
    seeds = [seeds[i] for i in sorted(seeds)[:256]]
    books = [[s[p * w : (p + 1) * w] for s in seeds] for p in range(4)]
    parts = [[v[p * w : (p + 1) * w] for v in whole] for p in range(4)]
    nearest = lambda p: [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(books[p])) for x in parts[p]]
    for _ in range(rounds):
        for p in range(4):
            to = [e for _, e in nearest(p)]
            for e in set(to):
                members = [x for x, t in zip(parts[p], to, strict=True) if t == e]
                books[p][e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    last = [nearest(p) for p in range(4)]
    error = [sum(last[p][i][0] for p in range(4)) for i in range(len(rows))]
    total = {}
    for r, e in zip(rows, error, strict=True):
        total[r[2]] = total.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{last[p][i][1]:02x}" for p in range(4)), error[i], total[r[2]], sha) for i, r in enumerate(rows)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def random_rows(n, width=8, seed=5):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(n, width)) + rng.integers(0, 6, (n, 1))).astype(np.float32)
    return [(i * 3, [float(v) for v in x[i]], int(i % 4) if i % 5 else None) for i in range(n)]


def test_rounds(spark):
    """More vectors than entries, null labels, ties of repeated vectors."""
    rows = random_rows(700)
    rows += [(10_000 + k, rows[k][1], 9) for k in range(40)]
    assert got(codes.compress(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_partitions_do_not_matter(spark):
    df = spark.createDataFrame(random_rows(400), SCHEMA)
    assert got(codes.compress(df.repartition(7))) == got(codes.compress(df.coalesce(1)))


def test_sql(spark, data):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
    want = sorted(c.execute(queries.ORACLES["op13_vector_codes"]).fetchall(), key=str)
    df = queries.QUERIES["op13_vector_codes"](spark, data)
    assert got(df) == want
    assert len(want) == 500


def test_fewer_vectors_than_entries(spark):
    rows = random_rows(5)
    assert got(codes.compress(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_dropped_and_odd_rows(spark):
    """Null vectors and components go; null ids and repeated ids are coded; clashing columns are ignored."""
    rows = random_rows(300)
    bad = [(1, None, 1), (2, [1.0, None] * 4, 1), (4, [float("nan")] * 8, 1), (5, [float("inf")] + [0.0] * 7, 2)]
    same = [(0, [0.5] * 8, 1), (0, [-0.5] * 8, 1), (0, [-0.5] * 8, 1), (None, [0.25] * 8, None)]
    df = spark.createDataFrame(rows + bad + same, SCHEMA)
    df = df.withColumns({c: F.lit("clash") for c in ("v", "code", "error", "usable", "before", "of", "n", "size")})
    assert got(codes.compress(df)) == brute(rows + same)


def test_vectors_that_cannot_be_coded(spark):
    """Another length, a length that isn't cut in four, components too large: kept, without a code."""
    rows = random_rows(50)
    other = [(90_000, [0.5] * 12, 1), (90_001, [0.5] * 3, 1), (90_002, [], 2), (90_003, [3e38] * 8, 1)]
    out = got(codes.compress(spark.createDataFrame(rows + other, SCHEMA)))
    sha = out[0][4]
    coded = [r for r in out if r[1] is not None]
    assert coded == brute(rows)
    assert sorted(r[0] for r in out if r[1] is None) == [90_000, 90_001, 90_002, 90_003]
    assert all(r[2] is None and r[4] == sha for r in out if r[1] is None)


def test_large_components_are_exact(spark):
    """Beyond 2**53 distances are counted in integers."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(size=8) * 60_000], 0) for i in range(300)]
    assert got(codes.compress(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_only_changes_are_sent(spark):
    """A round's contributions come from the parts whose assignment changed, and add up to the sums of all parts."""
    rows = random_rows(600)
    start = shared.written(codes.whole_numbers(spark.createDataFrame(rows, SCHEMA)), "vectors").select("vec_id", "label", "v")
    books = np.array(codes.seeds(start), np.int64).reshape(-1, 4, 2).transpose(1, 0, 2)
    state, books = codes.codebooks(start, books, rounds=2)
    again = shared.written(codes.assigned(state, books), "codes")
    moved = again.filter("before <> code").count()
    assert 0 < moved < 600
    sent = {r["slot"]: r["delta"] for r in codes.changes(again, 2).collect()}
    assert sum(d for s, d in sent.items() if s % 3 == 0) == 0  # as many leave as come
    assert len(sent) <= 2 * 3 * 4 * moved


def test_no_rows(spark):
    assert got(codes.compress(spark.createDataFrame([], SCHEMA))) == []
    assert got(codes.compress(spark.createDataFrame([(1, None, 3)], SCHEMA))) == []
    assert got(codes.compress(spark.createDataFrame([(None, [0.5] * 8, 3)], SCHEMA)))[0][:4] == (None, None, None, None)


@pytest.mark.parametrize("width", [4, 64])
def test_widths(spark, width):
    rows = random_rows(280, width)
    assert got(codes.compress(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
