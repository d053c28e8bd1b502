"""The corpus pipeline, stage by stage, against brute force on a small table and on awkward rows."""

import hashlib

import corpus_pipeline
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from test_llm_operators import deduplicated, hits, library, similar  # noqa: F401  library is a fixture

from recallgrid.llm import quality


def test_stages(spark, sf, library):  # noqa: F811
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    stages = [f for _, f in corpus_pipeline.STAGES]
    assert len(stages) == 5

    good = stages[0](spark, docs, sf)
    assert good.columns == columns
    scores = quality.score_documents(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = {r.doc_id: r.text for r in good.collect()}
    assert set(rows) == {r.doc_id for r in scores.where("predicted = 1").collect()}

    lines = stages[1](spark, good, sf)
    assert lines.columns == columns
    got = {r.doc_id: r for r in lines.collect()}
    assert {(d, hashlib.sha256(r.text.encode()).hexdigest()) for d, r in got.items()} == {(d, h) for d, _, _, h in deduplicated(rows.items())}
    assert all(r.n_chars == len(r.text) for r in got.values())
    rows = {d: r.text for d, r in got.items()}

    single = stages[2](spark, lines, sf)
    assert single.columns == columns
    kept = set(similar(rows).values())
    assert sorted(r.doc_id for r in single.collect()) == sorted(kept)

    clean = stages[3](spark, single, sf)
    assert clean.columns == columns
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    kept = {d for d in kept if not hits(rows[d], items)[3]}
    assert sorted(r.doc_id for r in clean.collect()) == sorted(kept)

    coded = stages[4](spark, clean, sf).collect()
    whole = corpus_pipeline.run(spark, sf).collect()
    for result in (coded, whole):
        assert {r.doc_id: list(r.ids) for r in result} == {d: library.encode_ordinary(rows[d]) for d in kept}
        assert all(r.round_trip and r.n_tokens == len(r.ids) for r in result)


@pytest.mark.parametrize("empty", [False, True])
def test_awkward_rows(spark, sf, empty):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a text without a number", "en", "s", 5), (3, "word " * 3000, "xx", None, 1), (3, "word " * 3000, "xx", None, 1), (4, " \n\n", "en", "s", 3)]
    df = spark.createDataFrame([] if empty else rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("n_lines", F.lit("mine")).withColumn("ids", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, sf)
        assert set(df.columns) <= set(out.columns), name
        assert (out.count() == 0) if empty else out.count() <= len(rows)
    assert P.PATTERN
