"""The pipeline's decisions, stage by stage, and what it leaves."""

from pathlib import Path

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the sample tables")
def test_stages(spark):
    from tallyframe.llm import decontam, minhash, toxicity

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    stage = dict(pipeline.STAGES)
    clean = stage["toxicity"](spark, docs, SF).cache()
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in toxicity.score(docs, model).collect() if not r.rejected}
    lines = stage["line_dedup"](spark, clean, SF).cache()
    assert lines.columns == columns and lines.count() == clean.count()
    single = stage["near_dedup"](spark, lines, SF).cache()
    assert {r.doc_id for r in single.collect()} == {r.doc_id for r in minhash.classes(lines).collect() if r.kept}
    left = stage["decontamination"](spark, single, SF).cache()
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert left.columns == columns and not any(r.contaminated for r in decontam.report(left, bench).collect())
    assert 0 < left.count() < before
    packed = stage["packing"](spark, left, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in left.collect()}


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the sample tables")
@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_stages_on_odd_tables(spark, docs, empty, kind):
    """Nulls in any column, empty and long texts, repeated rows, clashing columns, no rows."""
    given = docs if kind == "odd" else empty
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, given, SF).cache()
        assert out.columns == given.columns, name
        assert out.count() <= given.count(), name
        given = out
    pieces = pipeline.STAGES[-1][1](spark, given, SF).collect()
    assert len({r.doc_id for r in pieces}) == given.select("doc_id").distinct().count()
