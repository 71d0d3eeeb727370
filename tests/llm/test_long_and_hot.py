"""Every operator and stage on texts of 10 MB, and on a table of which a third is one text."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lagfield.llm import best_fit, exact_dedup, importance, language, packed_ids, piece_codec, quality, secret_scan, shards, simhash, toxicity
from text_fixtures import prose

SIZE = 10_000_000
HOT = "one text that a third of all rows share with password=Zx9kQ2mLp7RtBv4w in it " + prose(9, 60)


@pytest.fixture(scope="module")
def long_docs(spark, tmp_path_factory):
    line = (prose(5, 2000) + " ") * (SIZE // len(prose(5, 2000)))
    texts = ["x" * SIZE, line, prose(6, SIZE // 5)]
    assert min(map(len, texts)) > 0.9 * SIZE
    return stored(spark, tmp_path_factory, [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)])


@pytest.fixture(scope="module")
def hot_docs(spark, tmp_path_factory):
    rows = [(i, HOT if i % 3 == 0 else prose(i, 90), "en" if i % 2 else "de", f"s{i % 4}", None) for i in range(900)]
    return stored(spark, tmp_path_factory, rows)


def stored(spark, factory, rows):
    path = str(factory.mktemp("docs") / "t")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i == 2)) for i in range(40)], "doc_id long, toxic int")


OPERATORS = {
    "secret_scan": lambda d, x: secret_scan.find_secrets(d),
    "piece_codec": lambda d, x: piece_codec.encode_documents(d).select(
        "doc_id", "n_ids", F.length(piece_codec.decode_column(F.col("ids"))).alias("back")
    ),
    "shards": lambda d, x: shards.shard_documents(d),
    "exact_dedup": lambda d, x: exact_dedup.find_copies(d)[0],
    "toxicity": lambda d, x: toxicity.score_documents(d, x),
    "simhash": lambda d, x: simhash.near_duplicates(d),
    "language": lambda d, x: language.identify_documents(d),
    "quality": lambda d, x: quality.quality(d),
    "importance": lambda d, x: importance.resample(d, x.select(F.lit("one text").alias("text"))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_long_text(long_docs, labels, name):
    got = OPERATORS[name](long_docs, labels).collect()
    assert len(got) == 3
    if name == "piece_codec":
        assert {r.doc_id: r.back for r in got} == {r.doc_id: r.n_chars for r in long_docs.select("doc_id", "n_chars").collect()}
    if name == "quality":
        assert not any(r.kept for r in got)


def test_long_texts_are_cut_and_packed_whole(long_docs):
    pieces = best_fit.pack_documents(long_docs, with_ids=False).groupBy("doc_id").agg(F.sum("length").alias("n"), F.count("*").alias("k"))
    packed = packed_ids.pack_rows(long_docs)
    by_piece = {r.doc_id: (r.n, r.k) for r in pieces.collect()}
    assert set(by_piece) == {0, 1, 2} and all(k == -(-n // 4096) for n, k in by_piece.values())
    rows = packed.select(F.sum("n_tokens"), F.max("n_tokens")).first()
    assert rows[0] > 1_000_000 and rows[1] <= 2048


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_hot_text(hot_docs, labels, name):
    got = OPERATORS[name](hot_docs, labels).collect()
    assert len(got) == 900
    if name == "exact_dedup":
        assert {r.copies for r in got if r.record.id % 3 == 0} == {300}
    if name == "simhash":
        assert {r.component_id for r in got if r.doc_id % 3 == 0} == {0}
    if name == "secret_scan":
        assert {(r.n_assign, r.n_copied) for r in got if r.doc_id % 3 == 0} == {(1, 1)}


def test_stages_take_long_and_hot_texts(spark, long_docs, hot_docs, sf_dir, tmp_path):
    for docs, least in ((long_docs, 3), (hot_docs, 301)):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{least}-{k}")
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
            assert docs.count() >= (least if name in ("toxicity", "best_fit_packing") else 1)
