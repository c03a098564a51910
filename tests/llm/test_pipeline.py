"""The pipeline's stages one after another, each against what its input calls for."""

import sys

import pytest

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    sys.path.insert(0, ".")
    import corpus_pipeline

    out = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    frames = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], DIR).write.parquet(f"file://{out}/{i}")
        frames.append(spark.read.parquet(f"file://{out}/{i}"))
    return corpus_pipeline, frames


def test_columns_and_order(stages):
    pipeline, frames = stages
    assert len(pipeline.STAGES) == 5
    assert all(f.columns == frames[0].columns for f in frames[:-1])
    assert frames[-1].columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]


def test_decisions(spark, stages):
    from kithline.llm import decontaminate, quality
    from tests.llm.test_operators import jaccard_brute, lines_brute

    _, (docs, good, lines, single, clean, encoded) = stages
    ids = lambda f: {r.doc_id for r in f.select("doc_id").collect()}
    labels, bench = spark.read.parquet(f"{DIR}/labels.parquet"), spark.read.parquet(f"{DIR}/benchmark.parquet")
    judged = quality.judge(docs, quality.fit(docs, labels))
    assert ids(good) == ids(judged.where("kept"))
    ordered = [(r.doc_id, r.text) for r in good.orderBy("doc_id").collect()]
    want = lines_brute([t for _, t in ordered])
    got = {r.doc_id: r.text for r in lines.collect()}
    assert got == {d: want.get(i) for i, (d, _) in enumerate(ordered)}
    rows = sorted(got.items())
    groups = jaccard_brute([t for _, t in rows])
    assert ids(single) == {d for i, (d, _) in enumerate(rows) if groups[i][1] == i}
    assert ids(clean) == ids(decontaminate.judge(single, bench).where("not contaminated")) and ids(encoded) == ids(clean)


def test_run_returns_the_last_stage(spark, stages):
    pipeline, frames = stages
    got = {(r.doc_id, r.ids_sha256) for r in pipeline.run(spark, DIR).collect()}
    assert got == {(r.doc_id, r.ids_sha256) for r in frames[-1].collect()}


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Tables with nulls in every column, empty and long texts, repeated ids and rows, and a pipeline over them."""
    import random

    from tests.llm.test_operators import corpus, words

    rnd = random.Random(12)
    folder = f"file://{tmp_path_factory.mktemp('odd')}"
    rows = [(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else "s", len(t or "")) for i, t in enumerate(corpus())]
    item = " ".join(words(rnd, 30))
    rows += [rows[3], rows[3], (3, rows[4][1], "en", "s", None), (None, rows[5][1], None, None, None), (None, None, None, None, None), (900, " ".join(words(rnd, 60_000)), "en", "s", 0), (901, f"{item} {item}", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, i % 2, 0) for i in range(20)] + [(None, 1, 1), (5, None, None), (5, 0, 1), (5, 1, 0)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (1, item), (None, item), (2, None), (3, "")], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.mark.parametrize("which", ["odd", "empty", "clash"])
def test_stages_on_odd_tables(spark, odd, which):
    import corpus_pipeline
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{odd}/documents.parquet")
    names = ("n_words", "spans", "found", "longest", "n_lines", "n_removed", "n_chunks_removed", "set", "hashes", "quality", "kept", "k1", "h", "component_id", "ids", "decoded", "n_tokens")
    if which == "empty":
        docs = docs.limit(0)
    if which == "clash":
        docs = docs.withColumns({c: F.concat(F.lit(f"{c}:"), F.col("doc_id")) for c in names})
    start = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, odd)
        assert out.columns == docs.columns, name
        if which == "clash":
            assert out.where(" or ".join(f"not {c} <=> concat('{c}:', doc_id)" for c in names)).isEmpty(), name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        assert docs.count() <= start.count()
    ids = [r.doc_id for r in docs.collect()]
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, odd).collect()
    assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in encoded)
    if which != "empty":
        left = {r.doc_id for r in corpus_pipeline.STAGES[3][1](spark, start, odd).collect()}
        assert 901 not in left and {900, 3, None} <= left
