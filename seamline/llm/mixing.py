"""Mixing sources to target weights by Poisson replication, in DataFrame functions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm.common import BROADCAST_KEYS, cut

#: A Poisson count is drawn as a sum of draws with at most this mean, so that no mean is too large to invert.
STEP = 8.0
#: Terms of a draw's distribution: P(X > 48) < 1e-20 at mean 8.
TERMS = 48


def repetition_rates(docs: DataFrame, source: str = "source", weights: dict[str, float] | None = None, epochs: float = 1.0) -> DataFrame:
    """source, n_docs, rate: the mean number of copies that gives each source its share.

    weights: target share by source, in any unit; None: equal shares. A source without a weight
    gets none of the mixture; a null source is a source of its own (key None).
    """
    counts = cut(docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n_docs")))
    if weights is None:
        share = F.lit(1.0)
    else:
        share = F.lit(0.0)
        for name, w in weights.items():
            share = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(share)
    shared = counts.withColumn("share", share)
    total, shares = shared.agg(F.sum("n_docs"), F.sum("share")).first()
    scale = float(total or 0) * epochs / shares if shares else 0.0
    return shared.select("source", "n_docs", (F.col("share") * scale / F.col("n_docs")).alias("rate"))


def uniform(seed: int, *parts) -> F.Column:
    """A number in [0, 1) from 52 bits of an md5 over the seed and the parts."""
    text = F.concat_ws(":", F.lit(str(seed)), *parts)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def poisson_mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", weights: dict[str, float] | None = None, epochs: float = 1.0, seed: int = 42) -> DataFrame:
    """Every row as often as its Poisson draw says, in a global random order.

    Adds `copy` (from 0) and `shuffle_key`; both win over input columns of these names. The draw
    depends on seed, id and the source's rate only, so reruns agree and rows that repeat an id
    repeat its draw. Null ids draw as the text 'null'. Rows of one output partition are sorted
    by shuffle_key, and a row's partition is a hash of it. An empty table gives no rows.
    """
    rates = repetition_rates(docs, source, weights, epochs).where("rate > 0").withColumn("draws", F.ceil(F.col("rate") / STEP).cast("int")).withColumn("mean", F.col("rate") / F.col("draws"))
    # cumulative distribution up to TERMS, once per source
    terms = F.sequence(F.lit(1), F.lit(TERMS))
    start = F.exp(-F.col("mean"))
    cdf = F.aggregate(
        terms,
        F.struct(start.alias("p"), start.alias("c"), F.array(start).alias("all")),
        lambda acc, k: F.struct((acc["p"] * F.col("mean") / k).alias("p"), (acc["c"] + acc["p"] * F.col("mean") / k).alias("c"), F.concat(acc["all"], F.array(acc["c"] + acc["p"] * F.col("mean") / k)).alias("all")),
        lambda acc: acc["all"],
    )
    rates = rates.select("source", "draws", cdf.alias("cdf"))
    if rates.count() <= BROADCAST_KEYS // (TERMS + 1):
        rates = F.broadcast(rates)
    # a row travels as one struct, so no name of its columns can clash
    named = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    base = docs.select(F.struct(*(F.col(f"`{c}`") for c in named)).alias("row"), F.coalesce(docs[f"`{doc_id}`"].cast("string"), F.lit("null")).alias("key"), docs[f"`{source}`"].alias("of"))
    joined = base.join(rates, F.col("of").eqNullSafe(F.col("source")))
    # a draw is the number of cumulative terms at or below its uniform number
    numbers = F.transform(F.sequence(F.lit(1), F.col("draws")), lambda j: uniform(seed, F.col("key"), j.cast("string")))
    n = F.aggregate("numbers", F.lit(0), lambda a, u: a + F.size(F.filter("cdf", lambda c: c <= u)))
    copies = joined.select("row", "key", "cdf", numbers.alias("numbers")).select("row", "key", n.alias("n")).where("n > 0")
    spread = copies.select("row", "key", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy"))
    keyed = spread.select("row.*", "copy", uniform(seed + 1, F.col("key"), F.col("copy").cast("string")).alias("shuffle_key"))
    return keyed.repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key", f"`{doc_id}`")
