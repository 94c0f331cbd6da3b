"""Mixing sources to target weights by Poisson replication, with DataFrame operations only.

A source s with n_s of the N documents and target share w_s gets the mean repetition rate w_s * size / n_s.  Each
document's count is a Poisson variate of that mean, found by inverting the distribution at a uniform number that a
hash of (seed, document) gives, so the same input always gives the same mixture, whatever executors are lost.
Means over ``PART`` are sums of equal parts with a hash each; a part's distribution has 64 steps, after which
less is left than the 52 bits of the uniform number resolve, so no count is capped.  Documents are exploded by their
counts and shuffled globally by a hash of (seed, document, copy): another hash of it deals them out, and it is their order in a
partition.  No range is sampled, so the texts are read once.

The per-source table goes to all tasks only if it has at most ``MAX_BROADCAST`` rows, by count; beyond that it is a
shuffled join in which AQE splits large sources.

Defined results: a null source is a source like any other; sources without a weight, if weights are given, get
none of the mixture, and weights of absent sources are left out before the rest is scaled to 1; rows that repeat doc_id
share one count; a null doc_id is a document id like any other; empty texts are copied as they are; an empty
table gives an empty result.  Other columns pass as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART, STEPS, MAX_BROADCAST = 8.0, 64, 10_000
COPY = "copy"


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) with 52 bits from the MD5 of the parts."""
    text = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return (F.conv(F.substring(text, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None, size: float | None, source_col: str) -> DataFrame:
    """(source, mean, parts, cdf): cdf[k] is the probability of at most k copies from one part.  Weights None: all alike."""
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        counts = counts.withColumn("w", F.lit(1.0))
    else:
        given = F.lit(0.0)
        for s, w in weights.items():
            given = F.when(F.col("source").eqNullSafe(F.lit(s)), F.lit(float(w))).otherwise(given)
        counts = counts.withColumn("w", given)
    total = counts.agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w"))
    whole = F.lit(float(size)) if size else F.col("all_n")
    mean = F.col("w") * whole / F.nullif(F.col("all_w") * F.col("n"), F.lit(0.0))
    rates = counts.crossJoin(F.broadcast(total)).select("source", F.coalesce(mean, F.lit(0.0)).alias("mean"))  # one row of totals
    rates = rates.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("mean") / PART)).cast("int")).withColumn("part", F.col("mean") / F.col("parts"))
    start = F.struct(F.exp(-F.col("part")).alias("p"), F.array(F.exp(-F.col("part"))).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * F.col("part") / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    cdf = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS - 1)), start, step, lambda acc: acc["cdf"])
    return rates.select("source", "mean", "parts", cdf.alias("cdf"))


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, size: float | None = None, seed: int = 1, id_col: str = "doc_id", source_col: str = "source", copy_col: str | None = COPY) -> DataFrame:
    """The mixture: ``docs`` repeated by their counts in a global random order, and the number of the copy from 1."""
    rates = source_rates(docs, weights, size, source_col)
    small = rates.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    rates = rates.select(F.col("source").alias("__mix_source"), F.col("parts").alias("__mix_parts"), F.col("cdf").alias("__mix_cdf"))
    both = docs.join(F.broadcast(rates) if small else rates, F.col(source_col).eqNullSafe(F.col("__mix_source")))

    def of_part(j: Column) -> Column:
        u = uniform(F.lit(seed), F.col(id_col), j)
        return F.size(F.filter(F.col("__mix_cdf"), lambda c: c < u))

    one = F.size(F.filter(F.col("__mix_cdf"), lambda c: c < F.col("__mix_u")))
    both = both.withColumn("__mix_u", uniform(F.lit(seed), F.col(id_col), F.lit(1)))
    more = F.aggregate(F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.col("__mix_parts"))), of_part), F.lit(0), lambda a, b: a + b)
    n = one + F.when(F.col("__mix_parts") > 1, more).otherwise(0)
    both = both.withColumn("__mix_n", n).where("__mix_n > 0").withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_n"))))
    both = both.withColumn("__mix_order", F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), "__mix_copy"))
    dealt = both.select(*[F.col(f"`{c}`") for c in docs.columns], "__mix_copy", "__mix_order").repartition("__mix_order")
    dealt = dealt.sortWithinPartitions("__mix_order")
    copies = [F.col("__mix_copy").alias(copy_col)] if copy_col else []
    return dealt.select(*[F.col(f"`{c}`") for c in docs.columns], *copies)
