"""The pipeline against plain versions of its stages, on the smallest given tables."""

import sys
from pathlib import Path

import brute
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Documents after every stage, each from the stage before by a plain rule."""
    from quarry.llm.line_dedup import drop_lines
    from quarry.llm.quality import score_quality

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scores = score_quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    good = {r.doc_id for r in scores if r.accepted}
    rows = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    out = [dict(rows)]
    gone = brute.lines_gone(list(rows.items()))
    kept = {d: drop_lines(t, gone.get((d, t))) for d, t in rows.items()}
    rows = {d: t for d, t in kept.items() if not gone.get((d, rows[d])) or t.strip(" ")}
    out.append(dict(rows))
    classes = {d: c for d, c, _ in brute.jaccard(list(rows.items()))}
    rows = {d: t for d, t in rows.items() if classes[d] == d or not brute.words(t)}
    out.append(dict(rows))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = brute.contamination(list(rows.values()), items)
    rows = {d: t for (d, t), c in zip(rows.items(), dirty) if not c[3]}
    out.append(dict(rows))
    return out


def test_each_filtering_stage_equals_its_plain_version(spark, stages):
    from corpus_pipeline import STAGES
    from quarry.llm.common import materialise

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in STAGES] == ["quality_classifier", "line_dedup", "jaccard_join", "decontaminate", "packing"]
    for (name, stage), want in zip(STAGES, stages):
        docs = materialise(stage(spark, docs, SF), "t")
        assert docs.columns == columns
        assert {r.doc_id: r.text for r in docs.collect()} == want, name
        assert all(r.n_chars == len(r.text) for r in docs.collect())


def test_run_packs_what_the_plain_stages_keep(spark, stages):
    from corpus_pipeline import run
    from quarry.llm.packing import tokenizer_path
    from test_llm_packing import check
    from tokenizers import Tokenizer

    padding = check(run(spark, SF).collect(), stages[-1], Tokenizer.from_file(tokenizer_path()))
    assert padding < 0.05


def test_stages_accept_empty_documents(spark):
    from corpus_pipeline import STAGES

    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in STAGES:
        assert stage(spark, empty, SF).count() == 0, name
