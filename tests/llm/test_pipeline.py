"""The stages one after the other, on their own inputs."""

import corpus_pipeline
from holdfast.llm import language_id, near_dedup, toxicity
from tests.llm.samples import SCHEMA, messy_documents, near_components, removed_flags


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.createDataFrame(messy_documents(), SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language ID", "toxicity", "MinHash near-dedup", "suffix-array dedup", "best-fit packing"]
    rows = [tuple(r) for r in docs.collect()]

    kept = stages["MinHash near-dedup"](spark, docs, sf_dir)
    expected = near_components(rows, 5, 80)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.collect() if r.doc_id is None or expected[r.doc_id] == r.doc_id)

    cut = stages["suffix-array dedup"](spark, docs, sf_dir)
    texts = []
    for r, flags in zip(rows, removed_flags(rows)):
        text = bytes(b for b, f in zip((r[1] or "").encode(), flags) if not f).decode(errors="ignore")
        texts += [(r[0], text, len(text))] if text else []
    assert cut.columns == docs.columns
    assert sorted(map(str, [(r.doc_id, r.text, r.n_chars) for r in cut.collect()])) == sorted(map(str, texts))

    named = stages["language ID"](spark, docs, sf_dir)
    assert named.columns == docs.columns and named.filter("text IS NULL OR text = ''").isEmpty()
    for stage in ("toxicity", "best-fit packing"):
        assert stages[stage](spark, docs.limit(0), sf_dir).count() == 0


def test_run_keeps_clean_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.run(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels)
    clean = toxicity.score(docs, model).filter("predicted = 0").select("doc_id")
    lone = near_dedup.near_duplicates(docs.join(clean, "doc_id")).filter("kept").count()
    named = language_id.identify(docs, language_id.fit(docs)).filter("lang_pred = 'und' OR score < 0.3").count()
    assert lone - named <= out.select("doc_id").distinct().count() <= lone
