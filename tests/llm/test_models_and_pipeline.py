"""Held-out accuracy of the classifiers, and the pipeline stage by stage."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.cases import empty, frame
from wardlens.llm import boosting, quality_model, quality_rules, toxicity
from wardlens.llm.common import WordNumbers, as_texts, lowered
from wardlens.llm.queries import LLM_QUERIES

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labelled(spark):
    return {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}


@pytest.mark.parametrize("name, place, floor", [("op7_quality_model", 0, 0.95), ("op10_toxicity", 1, 0.9)])
def test_held_out_accuracy(spark, labelled, name, place, floor):
    rows = LLM_QUERIES[name](spark, DATA).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    right = [r.predicted == labelled[r.doc_id][place] for r in rows if r.held_out and r.doc_id in labelled]
    assert len(right) > 50 and np.mean(right) >= floor


def test_flat_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    trees = boosting.fit(x[:2000], y[:2000])
    assert ((trees.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97
    assert (trees.probability(x) == trees.probability(x)).all()
    same = boosting.fit(x[:2000], np.ones(2000))
    assert len(same.roots) == 0 and (same.probability(x) > 0.99).all()


def test_stages(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    memory, limits = WordNumbers(), quality_rules.Limits()
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "exact_dedup", "near_dedup", "mixing", "bpe"]
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name != "bpe":
            assert after.columns == docs.columns
        rows = after.collect()
        if name == "quality_rules":
            told = {i: quality_rules.report((r.text or "").encode(), limits, memory) for i, r in before.items()}
            assert {r.doc_id: r.text for r in rows} == {i: t[-1] for i, t in told.items() if t[-2]}
            assert all(r.n_chars == len(r.text) for r in rows)
        elif name == "exact_dedup":
            least = {}
            for i, r in before.items():
                least[r.text.lower()] = max(i, least.get(r.text.lower(), i))
            assert sorted(r.doc_id for r in rows) == sorted(least.values())
        elif name == "near_dedup":
            assert {r.doc_id for r in rows} <= set(before) and len(rows) == len({r.doc_id for r in rows})
            assert len(rows) > 0.8 * len(before)
        elif name == "mixing":
            assert {r.doc_id for r in rows} <= set(before) and len(rows) > 0.6 * len(before)
        else:
            assert all(r.round_trip and len(r.ids) == r.n_tokens for r in rows)
            assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in last)
        docs, last = after, rows
        before = {r.doc_id: r for r in rows}


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.round_trip for r in rows)


def test_stages_take_odd_rows(spark):
    for docs in (frame(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            if name != "bpe":
                assert out.columns == docs.columns
            out.collect()


def test_toxicity_keeps_apart_more_words_than_places(spark):
    """400,000 different words: tables of 2^18 or fewer places would add up unrelated ones."""
    texts = [" ".join(f"w{k}x{i}" for i in range(4000)) for k in range(100)]
    docs = frame(spark, list(enumerate(texts)))
    told = spark.createDataFrame([(k, k % 2) for k in range(100)], "doc_id long, toxic int")
    counts = toxicity.word_counts(docs, told)
    assert counts.count() == 400_000 == counts.select("item").distinct().count()
    assert counts.agg({"toxic": "sum", "ordinary": "sum"}).first().asDict() == {
        "sum(toxic)": 200_000, "sum(ordinary)": 200_000}
    assert toxicity._model(counts).table.isEmpty() is False  # stems; no word or pair is met often enough


def plain_ratios(texts, labels):
    """log p(word | before, toxic) - log p(word | before, ordinary) of any text's words, by the definition."""
    letters = toxicity.STEM_LETTERS

    def words(text):
        return [lowered(w).strip(toxicity.EDGES).decode() for w in text.encode().split()]

    pairs = [Counter(), Counter()]
    for i, toxic in labels.items():
        pairs[toxic].update(zip([None, *words(texts[i])], words(texts[i])))
    ends, stems = ([Counter(), Counter()] for _ in range(2))
    for toxic in (0, 1):
        for _, word in pairs[toxic]:
            ends[toxic][word] += 1
            stems[toxic][word[:letters]] += 1
    after = Counter(head for head, _ in set(pairs[0]) | set(pairs[1]))
    n = [sum(p.values()) for p in pairs]
    both = sum(sum(e.values()) for e in ends)
    mass = toxicity.WORD_MASS * both
    size = [sum(e.values()) + mass for e in ends]

    def left(counts, key, discount):
        return max(counts[key] - discount, 0)

    def of_stem(c, stem):
        share = (stems[0][stem] + stems[1][stem] + 0.5) / both
        return (left(stems[c], stem, toxicity.WORD_DISCOUNT) / share + mass) / size[c]

    def of_word(c, word):
        share = (ends[0][word] + ends[1][word] + 0.1) / both
        return (left(ends[c], word, toxicity.WORD_DISCOUNT) + mass * share * of_stem(c, word[:letters])) / size[c]

    def of_pair(c, head, word):
        back = toxicity.PAIR_MASS * toxicity.PAIR_DISCOUNT * max(after[head], 1) / sum(n)
        return left(pairs[c], (head, word), toxicity.PAIR_DISCOUNT) / n[c] + back * of_word(c, word)

    def ratios(text):
        found = words(text)
        return [math.log(of_pair(1, h, w) / of_pair(0, h, w)) for h, w in zip([None, *found], found)]

    return ratios


@pytest.mark.parametrize("known", [toxicity.KNOWN, 30, 0])
def test_toxic_evidence_equals_plain_kneser_ney(spark, monkeypatch, known):
    monkeypatch.setattr(toxicity, "KNOWN", known)
    monkeypatch.setattr(toxicity, "PIECE_BYTES", 20_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120)
    texts = {r.doc_id: r.text for r in docs.collect()}
    labels = {i: int(k % 3 == 0) for k, i in enumerate(sorted(texts)) if k % 4}
    told = spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    counts = toxicity.word_counts(docs, told)
    model = toxicity._shared(toxicity._model(counts))
    ratios = plain_ratios(texts, labels)
    for row in toxicity.evidence(as_texts(docs), model).collect():
        found = ratios(texts[row.doc_id])
        whole = 100 * np.mean(found) if found else 0.0
        strong = 100 * np.mean([max(r - toxicity.STRONG, 0) for r in found]) if found else 0.0
        assert abs(row.whole - whole) < 1e-9 * max(1, abs(whole)) and abs(row.strong - strong) < 1e-9 * max(1, strong)


def test_the_rule_is_the_best_one(rng=np.random.default_rng(7)):
    x = np.column_stack([np.ones(400), rng.normal(0, 30, 400), rng.gamma(1, 8, 400)])
    y = (x[:, 2] + 0.1 * x[:, 1] + rng.normal(0, 3, 400) > 12).astype(float)

    def loss(rule):
        margin = x @ rule
        return np.sum(np.logaddexp(0, margin) - y * margin) + toxicity.RESIST / 2 * np.sum((rule - toxicity.PRIOR) ** 2)

    best = toxicity.fitted_rule(x, y)
    assert all(loss(best) <= loss(best + d) for d in rng.normal(0, 1e-3, (200, 3)))


def test_calibration_rows_are_chosen_and_all_others_count(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "CALIBRATION_ROWS", 7)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1000)], "doc_id long, toxic int")
    told = toxicity.training_labels(labels).collect()
    assert len(told) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(1000))
    assert sum(r.calibrates for r in told) == 7


def test_quality_scores_equal_a_walk_through_the_trees(spark):
    """Statistics and traversal in plain Python, tree by tree, on whole texts."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    told = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    trees = quality_model.fit_quality(docs, told)
    rows = docs.select("doc_id", "text").collect()
    memory = WordNumbers()
    stats = np.array([quality_model.statistics((r.text or "").encode(), memory) for r in rows], float)

    def walk(row):
        total = trees.base
        for node in trees.roots:
            while trees.left[node] != node:
                low = row[trees.feature[node]] <= trees.threshold[node]
                node = (trees.left if low else trees.right)[node]
            total += trees.value[node]
        return 1 / (1 + math.exp(-total))

    for row, told in zip(rows, stats):
        words = (row.text or "").encode().split()
        triples = list(zip(words, words[1:], words[2:]))
        lines = [line for line in (row.text or "").encode().split(b"\n") if line.strip()]
        plain = {0: math.log1p(len(words)), 4: len(set(words)) / max(len(words), 1), 9: math.log1p(len(lines)),
                 14: 1 - len(set(triples)) / len(triples) if triples else 0.0}
        assert all(abs(told[k] - v) < 1e-12 for k, v in plain.items())
    found = {r.doc_id: r.score for r in quality_model.score_quality(docs, trees).collect()}
    assert all(abs(found[r.doc_id] - walk(s)) < 1e-9 for r, s in zip(rows, stats))
