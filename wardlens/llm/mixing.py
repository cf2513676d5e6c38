"""Mixing sources to target weights by Poisson replication.

A source with n rows and target share w of a mixture of T rows has the mean repetition rate
w * T / n. Each row draws its count by inverting the Poisson distribution of that rate at a number
in (0, 1) that a hash of seed and doc_id gives, so a repeated run gives the same mixture. The row
is exploded by its count, and the copies are shuffled globally: dealt to partitions by a hash of
seed, doc_id and copy, and sorted by it there.

Counts per source combine in each task before they move. The table of rates has one row per source:
it is broadcast when it has at most `BROADCAST_SOURCES` rows and joined by shuffle beyond.

A very long text moves once per copy, like any other.
A null source is a source of its own. A null doc_id draws by its text, and repeated rows draw
alike. Sources without a weight, or with weight 0 or null, give no rows. A null text is copied as it
is. An empty table gives an empty mixture. All columns of `docs` are kept; `copy` and `shuffle_key`
are added in front, and columns of `docs` with these names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.llm.common import staged
from wardlens.operators.ordered import free_name

BROADCAST_SOURCES = 10_000


def tempered_weights(docs: DataFrame, power: float) -> DataFrame:
    """Target shares of the sources, their row counts to `power` brought to sum 1."""
    counts = docs.groupBy("source").agg(F.count("*").alias("n"))
    raw = counts.select("source", F.pow(F.col("n").cast("double"), F.lit(power)).alias("raw"))
    total = raw.agg(F.sum("raw").alias("total")).first()["total"]
    return raw.select("source", (F.col("raw") / F.lit(total or 1.0)).alias("weight"))


def _unit(text: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of MD5."""
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(2.0**52)


def poisson_cdf(rate: Column) -> Column:
    """P(count <= k) for k = 0, 1, ... far into the tail; in logarithms, so any rate will do."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(
        (-rate).alias("log"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("all")
    )

    def step(state: Column, k: Column) -> Column:
        log = state["log"] + F.log(rate) - F.log(k.cast("double"))
        total = state["sum"] + F.exp(log)
        return F.struct(
            log.alias("log"), total.alias("sum"), F.array_append(state["all"], total).alias("all")
        )

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda state: state["all"])


def rates(docs: DataFrame, weights: DataFrame, epochs: float) -> DataFrame:
    """__source and __cdf; T is `epochs` times the rows of `docs`."""
    counts = staged(docs.groupBy("source").agg(F.count("*").cast("double").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0.0
    named = weights.select(F.col("source").alias("__source"), "weight").filter("weight > 0")
    met = counts.join(named, F.col("source").eqNullSafe(F.col("__source")))
    rate = F.col("weight") * F.lit(epochs * total) / F.col("n")
    with_rate = met.select("source", rate.alias("rate"))
    return with_rate.select(F.col("source").alias("__source"), poisson_cdf(F.col("rate")).alias("__cdf"))


def mixed_sources(
    docs: DataFrame, weights: DataFrame, seed: int = 17, epochs: float = 1.0
) -> DataFrame:
    """The mixture, `weights` having columns source and weight (shares that sum to 1)."""
    table = staged(rates(docs, weights, epochs))
    small = table.count() <= BROADCAST_SOURCES
    # names that no column of `docs` has, in any case
    source, cdf, times = (free_name(docs, c) for c in ("__source", "__cdf", "__n"))
    table = table.toDF(source, cdf)
    table = F.broadcast(table) if small else table
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.col("text").cast("binary")), F.lit(""))
    draw = F.concat(F.lit(f"{seed}:"), name)
    own = [c for c in docs.columns if c.lower() not in ("copy", "shuffle_key")]
    found = docs.select(*own).join(table, F.col("source").eqNullSafe(F.col(source)))
    count = F.size(F.filter(cdf, lambda p: p < _unit(draw)))
    copies = found.withColumn(times, count).filter(F.col(times) > 0)
    copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(times))))
    key = F.md5(F.concat(draw, F.lit(":"), F.col("copy").cast("string")))
    copies = copies.select("copy", key.alias("shuffle_key"), *own)
    return copies.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


MIX_SQL = """
WITH counts AS (SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source),
shares AS (SELECT source, n, pow(n, {power}) / sum(pow(n, {power})) OVER () AS weight,
           sum(n) OVER () AS total FROM counts),
rates AS (SELECT source, weight * ({epochs} * total) / n AS rate FROM shares),
places AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1)) AS k
           FROM rates),
logs AS (SELECT source, k, k * ln(rate) - rate - sum(ln(greatest(k, 1)))
         OVER (PARTITION BY source ORDER BY k) AS l FROM places),
cdf AS (SELECT source, k, sum(exp(l)) OVER (PARTITION BY source ORDER BY k) AS p FROM logs),
lists AS (SELECT source, list(p ORDER BY k) AS ps FROM cdf GROUP BY source),
draws AS (SELECT d.*, ps,
          (('0x' || substr(md5('{seed}:' || doc_id), 1, 13))::BIGINT + 0.5) / 4503599627370496 AS u
          FROM documents d JOIN lists l ON d.source IS NOT DISTINCT FROM l.source),
n AS (SELECT *, len(list_filter(ps, lambda p: p < u)) AS n FROM draws),
copies AS (SELECT *, unnest(range(1, n + 1)) AS copy FROM n)
SELECT copy::INTEGER AS copy, md5('{seed}:' || doc_id || ':' || copy) AS shuffle_key,
       doc_id, text, lang, source, n_chars FROM copies
"""
