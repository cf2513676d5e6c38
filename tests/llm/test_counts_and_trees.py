"""Token counts, the Merkle manifest and collocations against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm.cases import ROWS, empty, frame
from wardlens.llm import bitmaps, collocations, merkle, token_counts
from wardlens.llm.queries import LLM_QUERIES, tokenizer_file

DATA = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = tokenizer_file("word_bpe_49k.json", "WARDLENS_WORD_BPE_FILE")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def odd_texts():
    pick = random.Random(4)
    pool = [chr(c) for c in range(32, 127)] * 3 + [chr(pick.randrange(0x110000)) for _ in range(300)]
    pool += list("\u0085 \x1c\x1f́̈ΣİßǅＡ　‍\x00")
    pool = [c for c in pool if not 0xD800 <= ord(c) < 0xE000]
    ends = ["", "", " ", "<|endoftext|>", "<|startoftext|>", "'s", "'RE"]
    texts = ["".join(pick.choice(pool) + (pick.choice(ends) if pick.random() < 0.1 else "")
                     for _ in range(pick.randrange(120))) for _ in range(400)]
    return [*texts, "a" * 20_000, "".join(chr(c) for c in range(1, 0x3000)), "<|endoftext|>", None, ""]


def library_counts(rows):
    library = Tokenizer.from_file(WORDS)
    library.no_truncation()
    library.no_padding()
    out = Counter()
    for doc_id, text in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        out[doc_id, len((text or "").encode()), n, n > 2048] += 1
    return out


@pytest.mark.parametrize("most", [None, 40, 0])
def test_token_counts_of_odd_texts(spark, most):
    rows = [*enumerate(odd_texts()), *ROWS]
    found = token_counts.token_counts(frame(spark, rows), WORDS, most=most).collect()
    assert Counter(map(tuple, found)) == library_counts(rows)


def test_token_counts_of_documents(spark, documents):
    rows = LLM_QUERIES["op11_token_counts"](spark, DATA).collect()
    assert Counter(map(tuple, rows)) == library_counts(documents.select("doc_id", "text").collect())


def test_the_broadcast_is_bounded_and_takes_the_most_frequent(spark):
    told = spark.createDataFrame([(f"p{n}", n, 1) for n in range(1, 2000)], "pre_token string, n long, pieces int")
    for most, least in ((0, 0), (1, 0), (50, 0), (700, 600), (5000, 1999)):
        rows = {r.n for r in token_counts.most_frequent(told, most).collect()}
        assert least <= len(rows) <= most
        assert rows == {n for n in range(1, 2000) if n >= min(rows, default=10**6)}


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(nodes):
    """The root and, for each node, what stands left and right of its path."""
    paths, at, row = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(row) > 1:
        for i, a in enumerate(at):
            start = a // 8 * 8
            run = row[start : start + 8]
            paths[i].append((run[: a - start], run[a - start + 1 :]))
            at[i] = a // 8
        row = [digest("".join(row[i : i + 8])) for i in range(0, len(row), 8)]
    return row[0], paths


def manifest(rows):
    def leaf(row):
        return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    langs, out = {}, Counter()
    for row in rows:
        langs.setdefault(row[2], []).append(row)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        members = sorted(langs[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = (members, *tree([leaf(r) for r in members]))
    root, upper = tree([trees[lang][1] for lang in order])
    for lang, above in zip(order, upper):
        members, top, paths = trees[lang]
        for row, path in zip(members, paths):
            path, end = path + above, leaf(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                end = leaf((*row[:4], row[4] if row[4] is None else row[4].translate(LOWER)))
            for a, b in path:
                end = digest("".join(a) + end + "".join(b))
            proof = digest("".join("".join(a + b) for a, b in path))
            out[row[0], leaf(row), top, root, proof, end, end == root] += 1
    return out


def fields(docs):
    return [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]


@pytest.mark.parametrize("height, langs", [(1, 3), (3, 90)])
def test_manifest_of_odd_rows(spark, height, langs):
    """Several levels of blocks, many languages (one of them null), repeated ids and rows, nulls anywhere."""
    pick = random.Random(langs)
    rows = [(pick.randrange(900) if pick.random() > 0.05 else None, pick.choice(["a", "é", None]),
             None if k % 7 == 0 else f"l{k % langs}", pick.choice([1, None]), pick.choice(["Ab", "x", None, ""]))
            for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert Counter(map(tuple, merkle.manifest(docs, height).collect())) == manifest(rows)


def test_manifest_of_the_cases_and_of_nothing(spark):
    docs = frame(spark)
    assert Counter(map(tuple, merkle.manifest(docs).collect())) == manifest(fields(docs))
    lone = docs.filter("doc_id = 8")
    assert Counter(map(tuple, merkle.manifest(lone).collect())) == manifest(fields(lone))
    assert merkle.manifest(empty(spark)).collect() == []


def test_manifest_of_documents(spark, documents):
    rows = LLM_QUERIES["op12_merkle_manifest"](spark, DATA).collect()
    assert Counter(map(tuple, rows)) == manifest(fields(documents)) and len({r.root for r in rows}) == 1
    assert {r.verified for r in rows} == {True, False}


def test_addresses_are_a_layout():
    """Every place once, and each lower subtree in one stretch."""
    for levels in range(1, 5):
        places = merkle.addresses(levels)
        assert sorted(np.concatenate(places).tolist()) == list(range(merkle.tree_size(levels)))
    deep = merkle.addresses(4)
    for k in range(64):  # four levels: subtrees of two levels below the upper two
        stretch = [deep[2][k], *deep[3][8 * k : 8 * k + 8]]
        assert stretch == list(range(9 + 9 * k, 18 + 9 * k))


def best_phrases(rows, least, most, longest=5):
    counts, out = {}, []
    for lang, text in rows:
        seen = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                seen.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang, seen in counts.items():
        n = sum(v for p, v in seen.items() if len(p) == 1)
        often = {p: a for p, a in seen.items() if len(p) > 1 and a >= least}
        within = Counter()
        for p, a in often.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        within[p[i:j]] = max(within[p[i:j]], a)
        rows = []
        for p, a in often.items():
            if within[p] < a:
                score, k = min((1000 * a * n // (seen[p[:k]] * seen[p[k:]]), k) for k in range(1, len(p)))
                rows.append((score, a, " ".join(p), seen[p[:k]], seen[p[k:]]))
        rows.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i + 1, p, a, left, right, n, s) for i, (s, a, p, left, right) in enumerate(rows[:most])]
    return sorted(out)


@pytest.mark.parametrize("least, most", [(20, 2000), (4, 30)])
def test_collocations_of_odd_texts(spark, least, most):
    pick = random.Random(1)
    words = "a b c d e f the of É straße x-y \x1c 1 2".split(" ")
    between = [" ", " ", "  ", "\t", ". ", "\n", "\r\n", " A B C D e ", "?", " \x0b"]
    rows = [(pick.choice(["en", None, "und", "fr"]),
             "".join(pick.choice(words) + pick.choice(between) for _ in range(pick.randrange(60)))
             if pick.random() > 0.1 else pick.choice([None, "", " .. ", "the", "a b"])) for _ in range(500)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    found = collocations.collocations(docs, least=least, most=most).collect()
    assert sorted(map(tuple, found)) == best_phrases(rows, least, most)


def test_collocations_of_the_cases_and_of_nothing(spark):
    docs = frame(spark)
    told = [tuple(r) for r in docs.select("lang", "text").collect()]
    found = collocations.collocations(docs).collect()
    assert found and sorted(map(tuple, found)) == best_phrases(told, 100, 2000)
    assert collocations.collocations(empty(spark)).collect() == []


def test_collocations_beyond_64_bits(spark):
    """1000 * a * n and l * r both pass 2^63 for the counts of a corpus of 10^14 words."""
    sql = "SELECT (CAST(1000 * {a}L AS decimal(19,0)) * CAST({n}L AS decimal(18,0))) DIV" \
          " (CAST({l}L AS decimal(18,0)) * CAST({r}L AS decimal(18,0))) AS s"
    for a, n, left, right in [(10**13 + 7, 10**14 + 1, 10**13 + 9, 3 * 10**13 + 1), (10**12, 10**14, 10**12, 10**12)]:
        assert spark.sql(sql.format(a=a, n=n, l=left, r=right)).first().s == 1000 * a * n // (left * right)


def test_prefix_totals_are_frequencies(spark):
    rows = [("en", "a b c a b. a b d " * 30), ("en", "b c " * 40)]
    found = collocations.phrase_stripes(spark.createDataFrame(rows, "lang string, text string"), 20)
    often = {(r.lang, r.phrase): r.a for s in found for r in collocations.entries(s).collect()}
    for size, stripe in enumerate(found[1:], 1):
        for r in collocations.totals(stripe).collect():
            assert often[r.lang, r.phrase] == r.total, (size, r)


def test_a_full_bitmap_loses_no_phrase(spark, monkeypatch):
    rows = [("en", " ".join(f"w{pick % 97} w{pick % 89}" for pick in range(20_000)))]
    docs = spark.createDataFrame(rows, "lang string, text string")
    every = bitmaps.Bitmap(bitmaps.LEAST_BITS, {0: b"\xff" * bitmaps.PART_BYTES})
    expected = sorted(map(tuple, collocations.collocations(docs, 50).collect()))
    monkeypatch.setattr(collocations, "kept_phrases", lambda phrases: every)
    assert sorted(map(tuple, collocations.collocations(docs, 50).collect())) == expected
