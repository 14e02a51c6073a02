"""The pipeline's stages and the registry without it."""

import corpus_pipeline
from graphloom.llm.queries import QUERIES

from .test_operators import brute_classes

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns
        if name == "near_duplicates":
            got = {r.doc_id for r in out.select("doc_id").collect()}
            assert got == {i for i, (_, c) in brute_classes([(r.doc_id, r.text) for r in docs.collect()]).items() if i == c}
        assert 0 < out.count() <= before or name == "packing"
        docs = out


def test_texts_with_letters_stay_without_labels(docs):
    rows = [(1, "Some words that are long enough for a window of the model", None, "a"), (2, "\u00e9", None, None), (None, "x", None, None), (3, "12 34!", None, None), (4, None, None, None), (5, "", None, None)]
    own = docs(rows)
    out = corpus_pipeline.known_language(None, own, SF)
    assert out.columns == own.columns
    assert sorted(r.text for r in out.collect()) == sorted(r[1] for r in rows[:3])


def test_run_equals_stages(spark):
    packed = corpus_pipeline.run(spark, SF)
    assert packed.columns == ["doc_id", "piece", "start_word", "n_words", "bin_id", "bin_start"]
    assert packed.count() > 100


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_one_row_of_every_class_stays(docs):
    # exact copies with one id, with null ids and with other ids; near copies among rows without id; equal ids, other texts
    text = [" ".join(f"w{i}x{k}" for k in range(40)) for i in range(6)]
    near = text[1].replace("x39", "y39")
    rows = [(1, text[0], None, None)] * 3 + [(None, text[1], None, None), (None, near, None, None), (None, text[1], None, None), (7, near, None, None), (8, text[2], None, None), (8, text[3], None, None), (9, "one", None, None), (4, "one", None, None), (None, text[4], None, None)]
    own = docs(rows)
    out = corpus_pipeline.one_of_each_class(own.sparkSession, own, SF)
    assert out.columns == own.columns
    assert sorted([(r.doc_id, r.text) for r in out.collect()], key=repr) == sorted([(1, text[0]), (7, near), (8, text[2]), (8, text[3]), (4, "one"), (None, text[4])], key=repr)


def test_whole_tables_of_repeated_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50)
    once = corpus_pipeline.one_of_each_class(spark, docs, SF).count()
    assert corpus_pipeline.one_of_each_class(spark, docs.union(docs), SF).count() == once <= 50


def test_stages_keep_columns_whatever_their_names(spark):
    kinds = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, row long, doc string, id int, first string"
    docs = spark.createDataFrame([(i, f"word{i} und der die letters of text number {i}", "en", "s", 5, "x", 1, "d", 2, "f") for i in range(12)], kinds)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, empty, SF).count() == 0
