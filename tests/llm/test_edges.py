"""Every operator on nulls, empty and very long texts, ties, repeated rows, clashing columns, and empty tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tesserine.llm import decontamination, fingerprints, language_id, ngram_join, packing, pii, quality, token_output, toxicity, ziv_merhav

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the quick brown fox jumps over lazy dogs and then walks home by river bank under old stone bridge near town".split()
LONG = " ".join(WORDS[(k * k + k // 7) % len(WORDS)] + str(k % 97) for k in range(40_000))
PLAIN = " ".join(WORDS * 12)
ROWS = [
    (1, PLAIN, "en", "a", len(PLAIN)), (1, PLAIN, "en", "a", len(PLAIN)), (2, PLAIN, "en", "b", len(PLAIN)), (3, None, "en", "a", None), (4, "", "en", None, 0), (5, "  \n ", None, "a", 4), (6, LONG, "en", "a", len(LONG)),
    (None, PLAIN + " more", "en", "a", 5), (None, None, None, None, None), (7, "x", "fr", "c", 1), (8, "él ñandú çà \U0001f600 \x00 zero", "es", "c", None), (9, "mail a.b@c.example.com or 4111 1111 1111 1111", "en", "c", 45), (10, "..!!", "de", "d", 4),
]
CLASH = ["score", "group_id", "bin_id", "n_tokens", "tokens", "digest", "similar", "rank", "part", "key", "kept", "toxic", "language", "b", "y", "p", "id", "root", "count", "groups", "_gone", "_one", "item_id", "quality", "bucket", "batch"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).withColumns({c: F.lit("z") for c in CLASH})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 0), (None, 1, 1), (6, None, None), (9, 0, 1), (77, 1, 0)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("t"))


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, " ".join(WORDS)), (2, None), (3, ""), (None, "zz yy xx ww"), (4, "x"), (1, " ".join(WORDS))], "item_id long, text string").withColumn("doc_id", F.lit(1))


def ids(df, c="doc_id"):
    return sorted((r[0] is not None, r[0] or 0) for r in df.select(c).collect())


def all_ids():
    return sorted((r[0] is not None, r[0] or 0) for r in ROWS)


def test_packing(docs):
    out = packing.pack(docs, capacity=64, group_docs=4).collect()
    assert {r.doc_id for r in out} == {r[0] for r in ROWS}
    assert [(r.n_tokens, r.bin_id) for r in out if r.doc_id == 3] == [(0, None)] and [r.n_tokens for r in out if r.doc_id == 4] == [1]
    assert all(r.n_tokens <= 64 and (r.bin_tokens or 0) <= 64 for r in out)
    total = {r.doc_id: r.n_tokens for r in packing.token_counts(docs).collect()}
    assert sum(r.n_tokens for r in out if r.doc_id == 6) == total[6] > 10_000


def test_token_output(docs, tmp_path):
    out = token_output.token_output(docs, path=str(tmp_path / "t"))
    assert ids(out) == all_ids()
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[3].tokens is None and rows[4].tokens == [] and rows[4].n_tokens == 0
    enc = packing.encoder(packing.VOCABULARY)
    assert all(enc.decode(rows[r[0]].tokens) == r[1] for r in ROWS if r[0] and r[1])


def test_fingerprints(docs):
    out = fingerprints.fingerprints(docs).collect()
    assert len(out) == len(ROWS)
    by = {r.doc_id: r for r in out if r.doc_id}
    assert by[1].similar == [2] and by[2].similar == [1] and by[3].n_features == 0 and by[3].digest == b"" and by[6].n_filters > 5
    assert all(r.similar == [] for r in out if r.doc_id is None)


def test_ngram_join(docs):
    assert [(r.doc_a, r.doc_b, r.jaccard) for r in ngram_join.similar_pairs(docs).collect()] == [(1, 2, 1.0)]
    kept = ngram_join.drop_similar(docs)
    assert kept.columns == docs.columns and ids(kept) == [x for x in all_ids() if x[1] != 2]
    with pytest.raises(ValueError):
        ngram_join.similar_pairs(docs, threshold=0)


def test_quality(docs, labels):
    out = quality.score(docs, labels)
    assert ids(out) == all_ids()
    assert all((r.quality_score is None and not r.kept) for r in out.filter("doc_id = 3").collect())
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.filter("text is null").count() == 0
    none = quality.score(docs, labels.limit(0)).collect()
    assert all(r.quality_score is None for r in none) and sum(r.kept for r in none) == len([r for r in ROWS if r[1] is not None])


def test_ziv_merhav(docs):
    out = {r.doc_id: r for r in ziv_merhav.score(docs).collect()}
    assert len(out) == len({r[0] for r in ROWS})
    assert out[3].cross_entropy is None and out[3].phrases == 0 and out[1].phrases == out[2].phrases == 1 and out[6].n_words == 40_000
    assert out[7].phrases is None  # the only document of its language


def test_toxicity(docs, labels):
    out = toxicity.score(docs, labels)
    assert ids(out) == all_ids() and all(not r.toxic and r.toxicity is None for r in out.filter("doc_id = 3").collect())
    assert toxicity.toxic_documents(docs, labels.limit(0)).count() == 0


def test_pii(docs):
    assert sorted((r.doc_id, r.kind) for r in pii.spans(docs).collect()) == [(9, "card"), (9, "email")]
    out = pii.redact(docs)
    assert out.columns == docs.columns and ids(out) == all_ids()
    row = out.filter("doc_id = 9").first()
    assert row.text == "mail <EMAIL> or <CARD>" and row.n_chars == len(row.text)
    assert out.filter("doc_id = 8").first().text == ROWS[10][1]


def test_language_id(docs):
    out = language_id.identify(docs)
    assert ids(out) == all_ids()
    assert {r.language for r in out.filter("doc_id in (3, 4, 5, 10)").collect()} == {"und"}
    assert {r.language for r in language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_decontamination(docs, bench):
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()}
    assert {(1, 1), (2, 1), (None, 1), (7, 4)} <= got and not {d for d, _ in got} & {3, 4, 5, 9, 10}
    left = decontamination.remove(docs, bench)
    assert left.columns == docs.columns and {3, 4, 5, 9, 10} <= {r.doc_id for r in left.collect()} and left.filter("doc_id in (1, 2, 7)").count() == 0
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0
    one = decontamination.contaminated(docs, bench, slice_bytes=64)
    assert {(r.doc_id, r.item_id) for r in one.collect()} == got


def test_empty_tables(spark, labels, bench, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    for df in (
        packing.pack(none), token_output.token_output(none, path=str(tmp_path / "t")), fingerprints.fingerprints(none), ngram_join.similar_pairs(none), ngram_join.drop_similar(none), quality.score(none, labels), quality.keep_good(none, labels), ziv_merhav.score(none),
        toxicity.score(none, labels), pii.spans(none), pii.redact(none), language_id.identify(none), decontamination.contaminated(none, bench), decontamination.remove(none, bench),
    ):
        assert df.count() == 0


def test_pipeline_stages_keep_the_columns(spark, docs, labels, bench, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
    assert "bin_id" in corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).columns
