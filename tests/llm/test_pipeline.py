"""The pipeline's stages, each judged on its own input."""

import corpus_pipeline as pipeline
from ladderline.llm import queries

from .test_results import shingles


def test_stages(spark, data):
    docs, seen = queries.table(spark, data, "documents"), []
    names = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, data).cache()
        assert out.columns == names
        before, after = ({r["doc_id"]: r["text"] for r in d.collect()} for d in (docs, out))
        assert set(after) <= set(before) and after
        seen.append((name, before, after))
        docs = out
    _, before, after = seen[2]
    sets = {i: frozenset(shingles(t)) for i, t in before.items()}
    kept = [s for i, s in sets.items() if i in after and s]
    assert len(kept) == len(set(kept))
    assert len(seen[0][2]) > 0.97 * len(seen[0][1])


def test_run_equals_the_last_stage(spark, data):
    rows = pipeline.run(spark, data).collect()
    assert len({(r["doc_id"], r["piece"]) for r in rows}) == len(rows) > 0


def test_run_of_an_empty_table_gives_no_rows(spark, data, tmp_path):
    queries.table(spark, data, "documents").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    queries.table(spark, data, "benchmark").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert pipeline.run(spark, str(tmp_path)).collect() == []


def test_run_of_odd_rows(spark, data, odd, tmp_path):
    """Nulls, empty and very long texts, repeated rows and clashing columns go through every stage."""
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    queries.table(spark, data, "benchmark").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in odd.select("doc_id").collect()} and rows
    assert {1, 2, 3} & {r["doc_id"] for r in rows} == set()  # no letters, no language


def test_queries_are_registered(spark):
    import __spark_entry__ as entry

    assert [n for n in entry.queries() if n.startswith("op")] and "pipeline" in entry.queries()
