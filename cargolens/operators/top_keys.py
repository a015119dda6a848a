"""The top of a very large set of keys, without shuffling every key.

A report of the best customers groups by customer, and what moves is a row for every customer and
task. Here keys first fall into a bounded number of buckets, by several hashes. What the rows of a
bucket add up to, counting gains alone, bounds the total of every key in it. The keys of the
strongest buckets give a threshold, the k-th best of their exact totals; a key can only be among
the best if all of its buckets reach the threshold, and only rows of such keys are grouped. The
result is exact, ties included. Totals that differ by much, as those of customers and products do,
leave few keys; equal totals leave all of them, and cost two scans more than grouping at once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of each hash, and hashes.
BUCKETS, HASHES = 1 << 16, 2
#: For doubles, whose sums depend on their order: how far a bound may fall short of a total.
_SLACK = 1e-9


def _bucket(keys: Sequence[str], salt: int, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys], F.lit(salt)), F.lit(buckets)).cast("int")


def bucket_bounds(df: DataFrame, keys: Sequence[str], value: Column, buckets: int = BUCKETS) -> DataFrame:
    """Rows ``(hash, bucket, bound)``: no key of the bucket adds up to more. One scan."""
    gains = F.greatest(value, F.lit(0).cast("decimal(1,0)"))
    places = F.array(*[F.struct(F.lit(h).alias("hash"), _bucket(keys, h, buckets).alias("bucket")) for h in range(HASHES)])
    rows = df.select(gains.alias("gain"), F.inline(places))
    return rows.groupBy("hash", "bucket").agg(F.sum("gain").alias("bound"))


def _in_buckets(df: DataFrame, keys: Sequence[str], chosen: DataFrame, salt: int, buckets: int) -> DataFrame:
    """Rows whose key is in a chosen bucket; at most ``buckets`` numbers are broadcast."""
    own = chosen.where(F.col("hash") == salt).select(F.col("bucket").alias("__bucket"))
    return df.join(F.broadcast(own), _bucket(keys, salt, buckets) == F.col("__bucket"), "left_semi")


def candidates(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    k: int,
    largest: bool = True,
    buckets: int = BUCKETS,
    store: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The rows of all keys that can be among the ``k`` with the largest (smallest) sums of ``value``.

    Rows that miss a key belong to none. Missing values add nothing, and a key without any value
    counts as 0; values that are no numbers (NaN) have to be cleaned away before. One job finds the
    threshold. ``store`` writes a table and reads it back; without it the bounds of the buckets
    are found twice.
    """
    for key in keys:
        df = df.where(F.col(f"`{key}`").isNotNull())
    df = df.select(*[f"`{c}`" for c in dict.fromkeys([*keys, value])])
    signed = F.coalesce(F.col(f"`{value}`"), F.lit(0))
    signed = signed if largest else -signed
    bounds = bucket_bounds(df, keys, signed, buckets)  # at most HASHES * buckets rows
    bounds = store(bounds) if store else bounds
    strongest = bounds.where("hash = 0").orderBy(F.desc("bound"), "bucket").limit(k)
    totals = _in_buckets(df, keys, strongest, 0, buckets).groupBy(*[f"`{c}`" for c in keys]).agg(F.sum(signed).alias("total"))
    best = [r.total for r in totals.orderBy(F.desc("total")).limit(k).select("total").collect()]
    if len(best) < k:  # fewer keys than asked for, as far as these buckets tell
        return df
    # a bound is at least 0, so a threshold below that rules nothing out
    least = best[-1] - abs(best[-1]) * _SLACK if isinstance(best[-1], float) else best[-1]
    passing = bounds.where(F.col("bound") >= F.lit(least))
    for salt in range(HASHES):
        df = _in_buckets(df, keys, passing, salt, buckets)
    return df


def top_keys(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    k: int,
    largest: bool = True,
    buckets: int = BUCKETS,
    store: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Rows ``(keys..., total)`` of the ``k`` best keys, ties in the order of the keys."""
    rows = candidates(df, keys, value, k, largest, buckets, store)
    totals = rows.groupBy(*[f"`{c}`" for c in keys]).agg(
        F.coalesce(F.sum(f"`{value}`"), F.lit(0)).cast("double").alias("total")
    )
    order = F.desc("total") if largest else F.asc("total")
    return totals.orderBy(order, *[F.col(f"`{c}`") for c in keys]).limit(k)
