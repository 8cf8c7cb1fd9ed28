"""Joins that hold when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talasik.session import cut

#: At most so many keys can each own more than 1/HOT_SHARE of the rows, so the list of hot keys is small by proof.
HOT_SHARE = 200
#: Below so many rows on the large side AQE's own splitting is enough and no key is salted.
LEAST_ROWS = 100_000


def skew_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", salts: int = 32) -> DataFrame:
    """Equi-join of a skewed `left` with a `right` that has one row per key.

    Keys owning more than 1/HOT_SHARE of the left rows are spread over `salts` partitions and
    their right rows are replicated as often; every other key keeps a single partition. The hot
    list has at most HOT_SHARE entries whatever the input, so it is part of the plan. NULL keys
    match nothing. Only `inner` and `left` are supported.
    """
    if how not in ("inner", "left"):
        raise ValueError("skew_join supports inner and left")
    h = F.xxhash64(*on)
    # keys are counted by their hash, so that wide keys are neither shuffled nor kept for this
    counts = cut(left.groupBy(h.alias("_h")).agg(F.count("*").alias("_n")))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    if total < LEAST_ROWS:
        return left.join(right, on, how)
    keys = [r["_h"] for r in counts.filter(F.col("_n") > total / HOT_SHARE).collect()]
    if not keys:
        return left.join(right, on, how)
    hot = h.isin(keys)
    # the salt comes from the row itself, so a task that runs again sends every row the same way
    own = F.pmod(F.xxhash64(*left.columns, F.lit(1)), F.lit(salts))
    salted_left = left.withColumn("_salt", F.when(hot, own).otherwise(F.lit(0)).cast("int"))
    spread_out = F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return salted_left.join(right.withColumn("_salt", F.explode(spread_out)), [*on, "_salt"], how).drop("_salt")


def broadcast_if_small(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Broadcast hint only after counting; a larger side is left to a shuffled join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
