"""Every operator and stage over nulls, empty and very long texts, repeats, clashing names and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rasterloom.llm import embed_dedup, langid, license_scan, line_dedup, mixing, packing, quality, secret_scan, simhash, toxicity


def trusted(labels):
    return labels.where("quality = 1")


OPERATORS = {
    "toxicity": lambda d, l: toxicity.query(d, l),
    "line_dedup": lambda d, l: line_dedup.query(d),
    "licenses": lambda d, l: license_scan.query(d),
    "mixing": lambda d, l: mixing.query(d),
    "language": lambda d, l: langid.query(d),
    "secrets": lambda d, l: secret_scan.query(d),
    "quality": lambda d, l: quality.query(d, trusted(l)),
    "simhash": lambda d, l: simhash.query(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_come_back(name, messy, empty, labels):
    out = OPERATORS[name](messy, labels)
    ids = sorted((r[0] is None, r[0] or 0) for r in out.select("doc_id").collect())
    assert ids == sorted((r[0] is None, r[0] or 0) for r in messy.select("doc_id").collect())
    assert OPERATORS[name](empty, labels).count() == 0
    assert OPERATORS[name](messy, labels.limit(0)).count() == messy.count()


def test_packing_edges(messy, empty):
    rows = packing.pack(messy).collect()
    assert packing.pack(empty).count() == 0
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    spans = {}
    for r in rows:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in spans.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096
    # null and empty texts are their end token
    assert [r.length for r in rows if r.doc_id == 2] == [1] and [r.length for r in rows if r.doc_id == 3] == [1]


STAGE_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages(stage, spark, messy, empty, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    f = dict(corpus_pipeline.STAGES)[stage]
    out = f(spark, messy, str(tmp_path))
    assert out.count() >= 1
    if stage != "packing":
        assert set(STAGE_COLUMNS) <= set(out.columns)
        assert f(spark, messy.select(*STAGE_COLUMNS), str(tmp_path)).columns == STAGE_COLUMNS
    assert f(spark, empty, str(tmp_path)).count() == 0


def test_quality_and_line_nulls(messy, labels):
    q = {r.doc_id: r for r in quality.query(messy, trusted(labels)).collect()}
    assert (q[2].n_words, q[2].base_failed, q[2].kept) == (0, True, False)
    kept, name = line_dedup.marked(messy, F.col("source"), F.col("text"))
    assert {r.doc_id: r[name].text for r in kept.where("doc_id in (2, 4)").collect()} == {2: None, 4: "   \n\t "}


def test_embeddings_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [2.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (11, [-1.0, 0.0]), (11, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.query(df).collect()}
    assert out[1] == (2, 1, True) and out[2] == (2, 1, False) and out[3] == (2, 1, False)
    assert all(out[k] == (0, k, True) for k in (4, 5, 6, 7, 8, 9, 10, 11)) and out[None][0] == 0
    assert embed_dedup.query(df.limit(0)).count() == 0


def test_embeddings_that_repeat_an_id_or_are_large(spark):
    rows = [(1, [1e200, 1e200], 0), (2, [1e-200, 1e-200], 0), (3, [1.0, -1.0], 0), (3, [5.0, 5.1], 0), (4, [-1.0, 0.0], 0), (4, [-1.0, 0.0], 1), (None, None, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, u int").selectExpr("*", "1 as key", "'x' as place", "2 as copies", "3 as component", "4 as v")
    out = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in embed_dedup.query(df).collect())
    assert out == [(0, 0, 0, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 1, False), (3, 2, 1, False), (4, 0, 4, True)]
