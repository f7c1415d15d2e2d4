"""The pipeline's stages in a row, each on what the one before it kept."""

import re

import numpy as np

import corpus_pipeline
from fissure.llm import decontam, pii
from fissure.llm.shared import materialise, table

SF = "/root/testdata/sf0.001"


def test_stages_keep_clean_documents_and_columns(spark):
    docs = table(spark, SF, "documents")
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language identification", "minhash near-dedup", "benchmark decontamination", "pii", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, SF), "stage")
        assert docs.columns == columns
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(kept["language identification"]) == set(before)
    assert len(kept["minhash near-dedup"]) < len(before)
    leaks = {r["doc_id"] for r in decontam.find_copies(table(spark, SF, "documents"), table(spark, SF, "benchmark")).collect()}
    assert set(kept["benchmark decontamination"]) == set(kept["minhash near-dedup"]) - leaks
    assert set(kept["pii"]) == set(kept["benchmark decontamination"])
    for doc_id, text in kept["pii"].items():
        assert not re.search(r"[a-z]+\.[0-9]+@mail", text)
        if not any(re.search(h, before[doc_id]) for h in pii.HINTS.values()):
            assert text == before[doc_id]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == set(kept["pii"])
    assert np.isclose(pieces.filter("start = 0").count(), len(kept["pii"]))


def test_run_goes_through_all_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert "sequence_id" in out.columns and 0 < out.select("doc_id").distinct().count() < table(spark, SF, "documents").count()


def test_stages_on_awkward_documents(spark):
    """Nulls in every column, empty texts, repeated rows and ids, extra columns with points and clashing names; and no rows."""
    clean = table(spark, SF, "documents").orderBy("doc_id").limit(60)
    text = max((r["text"] for r in clean.collect()), key=len)
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", None, None, 0), (-5, text, None, None, 39), (-5, text, None, None, 39), (None, text, "en", None, None)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    extra = clean.select(odd.columns).unionByName(odd).selectExpr("*", "'x' as `a.b`", "1 as rep", "2 as p_text_key")
    for docs in (extra, extra.filter("false")):
        columns, texts = docs.columns, {r["text"] for r in docs.collect()}
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = materialise(stage(spark, docs, SF), "stage")
            assert docs.columns == columns
        kept = docs.collect()
        assert len(kept) == 0 or (sum(r["doc_id"] == -5 for r in kept) == 1 and not {None, ""} & {r["text"] for r in kept})
        assert bool(kept) == bool(texts)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).filter("start = 0").count() == len(kept)
