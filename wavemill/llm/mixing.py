"""Operator 10: mixing sources to target weights by Poisson replication, with DataFrame functions only.

Each source gets a mean repetition rate, its share of the budget over its size. A document's count is the
inverse of the Poisson distribution function at a number that a hash of (seed, doc_id) gives, so the same
document gets the same count in every run and on every cluster. Copies are dealt into a global hash order.

The only aggregate is one row per listed source and one for all others, a bound that the caller's own
list sets; that table is broadcast. A hot source is just many rows of the scan: nothing is grouped by source
but partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Means above this are drawn as sums of several independent draws, since exp(-mean) would underflow.
DRAW_MEAN = 500.0
#: A draw is (k + 0.5) / 2^52 with k below 2^52.
LARGEST_DRAW = ((1 << 52) - 0.5) / (1 << 52)
#: Values of ``mix_key``: 15 hexadecimal digits.
KEY_BITS = 60
OTHER = "other sources"


def _hashed(*parts) -> Column:
    return F.md5(F.concat_ws("|", *parts))


def _number(digest: Column, digits: int) -> Column:
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def rates(docs: DataFrame, weights: dict[str, float], other_weight: float, budget: float | None, unit: str) -> DataFrame:
    """One row per listed source, and one for the others: bucket, mean repetition rate, draws, cumulative probabilities that a draw can reach, and the largest count.

    A bucket of no size gets the rate 0. budget: the size of the mixture in ``unit`` (default: that of the input).
    """
    total_weight = sum(weights.values()) + other_weight
    if total_weight <= 0 or min([other_weight, *weights.values()]) < 0:
        raise ValueError("weights must be at least 0, and one above it")
    size = F.char_length(F.coalesce(F.col("text"), F.lit(""))).cast("long") if unit == "chars" else F.lit(1).cast("long")
    sizes = docs.select(_bucket(weights).alias("bucket"), size.alias("size")).groupBy("bucket").agg(F.sum("size").alias("size"))
    listed = docs.sparkSession.createDataFrame(
        [(k, float(w) / total_weight) for k, w in [*weights.items(), (OTHER, other_weight)]], "bucket string, weight double"
    )
    whole = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("double").alias("whole"))
    mean = F.when(F.col("size") > 0, F.col("budget") * F.col("weight") / F.col("size")).otherwise(0.0)
    steps = F.sequence(F.lit(1), F.ceil(F.col("step_mean") + 10 * F.sqrt("step_mean") + 40).cast("int"))
    start = F.struct(F.exp(-F.col("step_mean")).alias("p"), F.array(F.exp(-F.col("step_mean"))).alias("cdf"))
    grown = F.aggregate(
        steps,
        start,
        lambda s, k: F.struct(
            (s["p"] * F.col("step_mean") / k).alias("p"),
            F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + s["p"] * F.col("step_mean") / k)).alias("cdf"),
        ),
        lambda s: s["cdf"],
    )
    reachable = F.filter(grown, lambda c: c <= LARGEST_DRAW)  # the others are above every draw
    return (
        listed.join(F.broadcast(sizes), "bucket", "left")
        .join(F.broadcast(whole))
        .withColumn("budget", F.lit(budget).cast("double") if budget is not None else F.col("whole"))
        .withColumn("rate", F.coalesce(mean, F.lit(0.0)))
        .withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / DRAW_MEAN)).cast("int"))
        .withColumn("step_mean", F.col("rate") / F.col("draws"))
        .select("bucket", "rate", "draws", reachable.alias("cdf"), (F.size(steps)).alias("most"))
    )


def _bucket(weights: dict[str, float]) -> Column:
    source = F.col("source").cast("string")
    return F.when(source.isin(list(weights)), source).otherwise(F.lit(OTHER)) if weights else F.lit(OTHER)


def mix(
    docs: DataFrame,
    weights: dict[str, float],
    other_weight: float = 0.0,
    budget: float | None = None,
    unit: str = "chars",
    seed: str = "mix",
    keep: list[str] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """The mixture: rows of ``docs`` (columns ``keep``, default all), each as often as its draw says, in global hash order.

    The order's key is a uniform hash, so equal ranges of it are equal parts of the mixture: rows go straight to their range's
    partition, of ``partitions`` (default: spark.sql.shuffle.partitions), and are sorted there; nothing is sampled.

    Added columns: ``mix_rate`` double, ``mix_repeats`` long, ``mix_copy`` long (from 1), ``mix_key`` long (the global order;
    ties by doc_id, then copy). Input columns of these names are replaced.

    Null or unlisted source: the bucket of other sources, with ``other_weight``. Null or empty text: size 0 in
    characters, replicated at its source's rate. Rows that repeat a doc_id (or have none) share its draw. An empty
    table gives an empty mixture.
    """
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in ("mix_rate", "mix_repeats", "mix_copy", "mix_key")]
    slim = docs.select("source", *(["text"] if unit == "chars" else []))
    table = F.broadcast(
        rates(slim, weights, other_weight, budget, unit).select(
            F.col("bucket").alias("_mix_bucket"), F.col("rate").alias("_mix_rate"), F.col("draws").alias("_mix_draws"), F.col("cdf").alias("_mix_cdf"), F.col("most").alias("_mix_most")
        )
    )
    partitions = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    span = -(-(1 << KEY_BITS) // partitions)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    draw = lambda i: (_number(_hashed(F.lit(seed), key, i.cast("string")), 13) + F.lit(0.5)) / F.lit(float(1 << 52))
    inverse = lambda u: F.least(F.size(F.filter("_mix_cdf", lambda c: c <= u)), F.col("_mix_most")).cast("long")
    several = F.aggregate(F.sequence(F.lit(2), F.col("_mix_draws")), inverse(draw(F.lit(1))), lambda s, i: s + inverse(draw(i)))
    repeats = F.when(F.col("_mix_draws") == 1, inverse(draw(F.lit(1)))).otherwise(several)
    return (
        docs.select(*dict.fromkeys(["doc_id", "source", *keep]), _bucket(weights).alias("_mix_bucket"))
        .join(table, "_mix_bucket")
        .withColumn("mix_repeats", repeats)
        .withColumn("mix_copy", F.explode(F.when(F.col("mix_repeats") > 0, F.sequence(F.lit(1).cast("long"), F.col("mix_repeats")))))
        .withColumn("mix_key", _number(_hashed(F.lit(seed), key, F.lit("copy"), F.col("mix_copy").cast("string")), 15))
        .withColumn("mix_rate", F.col("_mix_rate"))
        .repartitionById(partitions, F.expr(f"cast(mix_key div {span} as int)"))
        .sortWithinPartitions("mix_key", "doc_id", "mix_copy")
        .select(*keep, "mix_rate", "mix_repeats", "mix_copy", "mix_key")
    )
