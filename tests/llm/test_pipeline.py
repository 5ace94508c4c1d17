import pytest

pipeline = pytest.importorskip("corpus_pipeline")
tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

from wayline.llm import decontaminate, quality  # noqa: E402

from test_quality import documents  # noqa: E402
from test_simhash import plain_components  # noqa: E402


def test_stages_equal_a_plain_version(spark, tmp_path):
    rows = [(i, t) for i, t, _ in documents()]
    good = [(i, t) for i, t, y in documents() if y]
    item = good[7][1] + " and this passage ends here with several more words"
    rows += [(1000 + i, good[i][1]) for i in range(5)] + [(2000, f"{good[20][1]} {item} {good[21][1]}"), (2001, None)]
    labels = [(i, y) for i, _, y in documents()]
    full = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "sentencepiece"]
    got = {r.doc_id: r for r in pipeline.run(spark, str(tmp_path)).collect()}

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    number, bias = quality.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    left = [(i, t) for i, t in rows if quality.probabilities([t], number, bias)[0] >= quality.THRESHOLD]
    groups = {i: c for i, _, c in plain_components(left)}
    left = [(i, t) for i, t in left if groups[i] == i]
    plain = " ".join(item.lower().split())
    left = [(i, t) for i, t in left if plain not in " ".join((t or "").lower().split())]
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizers.path("piece_bpe_32k.model"))
    assert set(got) == {i for i, _ in left} and 2000 not in got
    assert all(got[i].n_tokens == len(library.encode(t or "")) + 1 for i, t in left)


def test_stages_keep_columns(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c d", "en", "s", 7, "more")], "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string")
    spark.createDataFrame([(5, "x" * 40)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in pipeline.STAGES[1:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert decontaminate.clean(docs.limit(0), spark.read.parquet(f"{tmp_path}/benchmark.parquet")).count() == 0


def write(spark, path, docs, labels, items):
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [], [], [])
    assert pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        found = stage(spark, docs, str(tmp_path))
        assert found.columns == docs.columns and found.count() == 0


def test_nulls_ties_and_repeated_rows(spark, tmp_path):
    good = [t for _, t, y in documents() if y]
    odd = [(None, None, None, None, None), (None, "", "", "", 0), (1, good[0], None, None, 3), (1, good[0], None, None, 3), (2, good[0], "en", "s", 1), (3, None, "en", "s", 1), (4, "", "en", "s", 0), (5, " \n", None, None, None), (6, "w " * 100_000 + good[1], "en", "s", 9)]
    train = [(100 + i, t, "en", "s", 1) for i, t, _ in documents()]
    write(spark, tmp_path, odd + train, [(100 + i, y, 0) for i, _, y in documents()] + [(None, 1, None), (1, None, None)], [(None, None), (9, ""), (8, good[2])])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(pipeline.STAGES):
        found = stage(spark, docs, str(tmp_path))
        if k < 3:
            assert found.columns == docs.columns
        found.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
    kept = [r.doc_id for r in docs.collect()]
    # One of the three equal texts; the texts without words are one group but for those without an id.
    assert kept.count(1) == 1 and 2 not in kept and 4 not in kept and 5 not in kept
    groups = [r.doc_id for r in spark.read.parquet(f"{tmp_path}/out0").collect()]
    assert groups.count(1) == 2 and (3 in groups) == (3 in kept) and groups.count(None) == kept.count(None)


def test_what_was_put_aside_is_deleted(spark, tmp_path):
    import pathlib

    from wayline.llm import shared

    write(spark, tmp_path, [(i, t, "en", "s", 1) for i, t, _ in documents()[:60]], [(i, y, 0) for i, _, y in documents()[:60]], [(1, "z" * 50)])
    folder = pathlib.Path(shared.shared_root(spark).removeprefix("file://"))
    before = {p.name for p in folder.glob("wayline-*")}
    pipeline.run(spark, str(tmp_path)).count()
    left = {p.name for p in folder.glob("wayline-*")} - before
    assert len(left) == 1 and next(iter(left)).startswith("wayline-sentencepiece")
