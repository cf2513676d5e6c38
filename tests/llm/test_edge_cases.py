"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import ROWS, empty, frame, prose
from wardlens.llm import (
    bpe,
    exact_dedup,
    mixing,
    near_dedup,
    pii,
    quality_model,
    quality_rules,
    secrets,
    substring_dedup,
    toxicity,
)
from wardlens.llm.queries import tokenizer_file


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


def some_labels(spark):
    return labels(spark, [(1, 1, 0, "x"), (5, 0, 1, None), (None, 1, 1, "y"), (9, None, None, "z"),
                          (9, 0, 1, "z"), (9, 1, 0, "z"), (7, 7, 7, ""), (99, 1, 1, "")])


def mixture(docs):
    return mixing.mixed_sources(docs, mixing.tempered_weights(docs, 0.5))


def quality_scores(docs):
    trees = quality_model.fit_quality(docs, some_labels(docs.sparkSession))
    return quality_model.score_quality(docs, trees)


def toxic_scores(docs):
    model = toxicity.fit_toxicity(docs, some_labels(docs.sparkSession))
    return toxicity.score_toxicity(docs, model)


PER_ROW = {
    "secrets": secrets.find_secrets,
    "substring": substring_dedup.without_repeats,
    "near": near_dedup.near_groups,
    "bpe": lambda docs: bpe.encoded(docs, tokenizer_file()),
    "bpe digests": lambda docs: bpe.encoded_digests(docs, tokenizer_file()),
    "exact": exact_dedup.exact_groups,
    "quality model": quality_scores,
    "pii": lambda docs: pii.find_pii(docs, pii.fit_pii(docs)),
    "quality rules": quality_rules.quality_rules,
    "toxicity": toxic_scores,
}
KEPT_ROWS = {
    "mixing": mixture,
    "cleaned": quality_rules.cleaned,
    "exact": exact_dedup.deduplicated,
    "near": near_dedup.deduplicated,
}


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_one_row_per_row(spark, name):
    rows = PER_ROW[name](frame(spark)).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in ROWS)
    assert len({str(r) for r in rows if r.doc_id == 7}) == 1  # repeated rows, equal results


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_an_empty_table_gives_an_empty_result(spark, name):
    assert PER_ROW[name](empty(spark)).collect() == []


@pytest.mark.parametrize("name", sorted(KEPT_ROWS))
def test_all_columns_are_kept(spark, name):
    docs = frame(spark)
    kept = KEPT_ROWS[name](docs)
    assert set(kept.columns) == set(docs.columns)
    assert kept.count() > 0
    none = KEPT_ROWS[name](empty(spark))
    assert set(none.columns) == set(docs.columns) and none.collect() == []


def test_exact_groups_of_the_cases(spark):
    found = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(frame(spark)).collect()}
    plain, nothing, long = (7, 4), (3, 3), (6, 2)
    assert {(1, *plain, False), (7, *plain, True), (None, *plain, False), (2, *nothing, False),
            (3, *nothing, True), (None, *nothing, False), (5, *long, False), (6, *long, True)} <= found
    kept = exact_dedup.deduplicated(frame(spark))
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [3, 4, 6, 7, 8, 9, 10, 11]


def test_near_groups_of_the_cases(spark):
    rows = near_dedup.near_groups(frame(spark)).collect()
    found = {(r.doc_id, r.component_id, r.kept) for r in rows}
    assert {(1, 1, True), (7, 1, False), (None, 1, False), (2, 2, True), (3, 3, True), (5, 5, True),
            (6, 5, False), (None, None, True)} <= found
    assert {r.n_shingles for r in rows if r.doc_id in (2, 3, 4)} == {0}
    kept = near_dedup.deduplicated(frame(spark)).select("doc_id").collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(["1", "2", "3", "4", "5", "8", "9", "10", "11", "None"])


def test_null_ids_come_last_among_repeats(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = frame(spark, [(None, text), (None, text), (4, text), (4, "x " + text), (9, text)])
    found = {(r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.without_repeats(docs).collect()}
    assert found == {(None, 60, 60), (4, 60, 0), (4, 61, 0), (9, 60, 60)}
    twice = frame(spark, [(None, text), (None, text)])
    assert {r.n_removed for r in substring_dedup.without_repeats(twice).collect()} == {0}


def test_scores_of_empty_texts_and_without_labels(spark):
    docs = frame(spark)
    for name in ("quality model", "toxicity"):
        assert all(0 <= r.score <= 1 for r in PER_ROW[name](docs).collect())
    none = labels(spark, [])
    trees = quality_model.fit_quality(docs, none)
    assert {r.score for r in quality_model.score_quality(docs, trees).collect()} == {0.5}
    model = toxicity.fit_toxicity(docs, none)
    assert model is None and {r.predicted for r in toxicity.score_toxicity(docs, model).collect()} == {0}


def test_mixing_takes_null_sources_and_ignores_unknown_ones(spark):
    docs = frame(spark)
    weights = spark.createDataFrame([("s0", 0.5), (None, 0.5), ("other", 1.0), ("s1", None)], "source string, weight double")
    mixed = mixing.mixed_sources(docs, weights, epochs=20.0)
    assert {r.source for r in mixed.select("source").collect()} == {"s0", None}
    per_text = mixed.filter("doc_id = 7").groupBy("source").agg(F.countDistinct("shuffle_key"))
    assert per_text.count() > 0


@pytest.mark.parametrize("name", sorted(KEPT_ROWS))
def test_columns_whose_names_clash_in_another_case_keep_their_values(spark, name):
    names = ["COPY", "Shuffle_Key", "__N", "__cdf", "__source", "__OWN", "__id", "__digest", "__once", "__row"]
    texts = [f"Text {k}: {prose(k, 80)}." for k in range(30)]
    rows = [(k, t, "en", "s", len(t), *(f"{n}{k}" for n in names)) for k, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, "
    docs = spark.createDataFrame(rows, schema + ", ".join(f"`{n}` string" for n in names))
    kept = KEPT_ROWS[name](docs)
    assert kept.columns == docs.columns or name == "mixing"
    rows = kept.collect()
    assert rows
    for r in rows:
        for n in names[2:] if name == "mixing" else names:
            assert r[n] == f"{n}{r.doc_id}"


def test_letters_of_keywords_are_ascii_in_either_case(spark):
    value = "Zq8Rt5Wx2Yb7Nc4M"
    docs = frame(spark, [(1, f"PassWord: {value}"), (2, f"pa\u017f\u017fword: {value}"), (3, f"to\u212aen={value}")])
    found = {r.doc_id: r.n_assign for r in secrets.find_secrets(docs).collect()}
    assert found == {1: 1, 2: 0, 3: 0}
