"""Rows of the pipeline's near-duplicate stage whose doc_id doesn't tell them apart."""

import corpus_pipeline


def test_null_and_repeated_ids(spark):
    text = lambda k: " ".join(f"{k}x{i}" for i in range(60))
    rows = [(None, text("a")), (None, text("b")), (1, text("c")), (1, text("c")), (2, text("d")), (2, text("e")), (4, text("f")), (3, text("f") + " end"), (None, text("f")), (5, text("g"))]
    docs = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert out.columns == list(corpus_pipeline.COLUMNS)
    got = sorted((str(r.doc_id), r.text) for r in out.collect())
    assert got == sorted([("None", text("a")), ("None", text("b")), ("1", text("c")), ("2", text("d")), ("2", text("e")), ("3", text("f") + " end"), ("5", text("g"))])
