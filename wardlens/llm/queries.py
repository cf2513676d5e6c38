"""The corpus operators as named queries over whole tables, and SQL for those it can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.llm import (
    bpe,
    collocations,
    exact_dedup,
    merkle,
    mixing,
    near_dedup,
    pii,
    quality_model,
    quality_rules,
    secrets,
    substring_dedup,
    token_counts,
    toxicity,
)
from wardlens.llm.common import read_table
from wardlens.llm.merkle_sql import MANIFEST_SQL
from wardlens.llm.quality_sql import QUALITY_SQL

MIX_POWER, MIX_SEED, MIX_EPOCHS = 0.5, 17, 1.0


def tokenizer_file(name: str = "byte_bpe_50k.json", setting: str = "WARDLENS_BPE_FILE") -> str:
    """A vocabulary: the file that the environment names, or the installed public one."""
    given = os.environ.get(setting)
    if given:
        return given
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(read_table(spark, sf_dir, "documents"), texts=False)
    return found.drop("redacted")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return substring_dedup.without_repeats(docs, texts=False).drop("kept_text")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(read_table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    weights = mixing.tempered_weights(docs, MIX_POWER)
    return mixing.mixed_sources(docs, weights, MIX_SEED, MIX_EPOCHS)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded_digests(read_table(spark, sf_dir, "documents"), tokenizer_file())


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read_table(spark, sf_dir, "documents"))


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    trees = quality_model.fit_quality(docs, read_table(spark, sf_dir, "labels"))
    return quality_model.score_quality(docs, trees)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return pii.find_pii(docs, pii.fit_pii(docs)).drop("redacted")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(read_table(spark, sf_dir, "documents"))
    clean = F.sha2(F.col("clean_text").cast("binary"), 256).alias("clean_sha256")
    return judged.select(*[c for c in judged.columns if c != "clean_text"], clean)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tokenizer_file("word_bpe_49k.json", "WARDLENS_WORD_BPE_FILE")
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), words)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read_table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secrets,
        op2_substring_dedup,
        op3_near_dedup,
        op4_mixing,
        op5_bpe,
        op6_exact_dedup,
        op7_quality_model,
        op8_pii,
        op9_quality_rules,
        op10_toxicity,
        op11_token_counts,
        op12_merkle_manifest,
        op13_collocations,
    )
}

EXACT_SQL = """
WITH texts AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                             'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM texts
"""

COLLOCATION_SQL = rf"""
WITH texts AS (
    SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM texts),
words AS (SELECT lang, regexp_extract_all(p, '[^ \t]+') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
spans AS (SELECT lang, w, i, unnest(range(1, {collocations.LONGEST} + 1)) AS k FROM starts),
freq AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
         FROM spans WHERE i + k - 1 <= len(w) GROUP BY ALL),
sizes AS (SELECT lang, sum(f)::BIGINT AS n FROM freq WHERE k = 1 GROUP BY lang),
often AS (SELECT lang, k, phrase, f AS a FROM freq WHERE k > 1 AND f >= {collocations.LEAST}),
free AS (SELECT * FROM often c WHERE NOT EXISTS (
         SELECT 1 FROM often d WHERE d.lang = c.lang AND d.k > c.k AND 100 * d.a >= 100 * c.a
         AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (SELECT lang, phrase, a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM free),
scores AS (SELECT c.lang, c.phrase, c.a, cut, x.f AS l, y.f AS r, n,
           ((1000::HUGEINT * c.a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
           FROM cuts c JOIN sizes s ON s.lang = c.lang
           JOIN freq x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:cut], ' ')
           JOIN freq y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1:], ' ')),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n,
       score
FROM best QUALIFY rank <= {collocations.MOST}
"""

LLM_SQL: dict[str, str] = {
    "op4_mixing": mixing.MIX_SQL.format(power=MIX_POWER, seed=MIX_SEED, epochs=MIX_EPOCHS),
    "op6_exact_dedup": EXACT_SQL,
    "op9_quality_rules": QUALITY_SQL,
    "op12_merkle_manifest": MANIFEST_SQL,
    "op13_collocations": COLLOCATION_SQL,
}
