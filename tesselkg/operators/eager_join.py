"""Per-key results under heavy skew: eager aggregation through joins.

A handful of keys may own most rows. Nothing here ever moves the rows of one
key to one task: each input is first aggregated by key on the map side (the
shuffle carries at most one state per key and task), the compact states are
joined, counts are multiplied and sums combined algebraically, and the result
is rolled up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_states(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field_name, key, n) for each value of each field in one scan; null is a key of its own.

    The rows are unpivoted inside the map task and combined there, so a key that
    owns a third of all rows sends one state per task, not its rows.
    """
    entry = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"`{f}`").cast("string").alias("key")) for f in fields])
    return df.select(F.explode(entry).alias("e")).groupBy("e.field_name", "e.key").agg(F.count(F.lit(1)).alias("n"))


def multiplied(left: DataFrame, right: DataFrame, on: Sequence[str], by: Sequence[Column], sums: Sequence[str] = ()) -> DataFrame:
    """The roll-up of two inputs that are already reduced to states: ``left`` (on..., ln, s_<name>, c_<name>) and ``right`` (on..., rn).

    Per ``by``: ``pairs`` (rows of the plain join, counts multiplied) and, per name
    in ``sums``, the sum and number of the left values over those pairs.
    """
    out = [F.sum(F.col("ln") * F.col("rn")).alias("pairs")]
    for c in sums:
        out += [F.sum(F.col(f"s_{c}") * F.col("rn")).alias(f"sum_{c}"), F.sum(F.col(f"c_{c}") * F.col("rn")).alias(f"n_{c}")]
    return left.join(right, list(on)).groupBy(*by).agg(*out)


def hot_keys(df: DataFrame, fields: Sequence[str], share: float) -> DataFrame:
    """(field_name, hot_key, n, total): the values holding at least ``share`` of all rows of ``df``.

    The share of a key is the share of the pairs that its rows make with all rows
    of the field: the field's rows joined to themselves by field name, rolled up by
    key. Both inputs are the same states, aggregated once; the total counts null
    keys too, but null is never reported. Empty input gives no rows.
    """
    states = key_states(df, fields).withColumnRenamed("n", "ln")
    totals = states.groupBy("field_name").agg(F.sum("ln").alias("rn"))
    pairs = multiplied(states, totals, ["field_name"], [F.col("field_name"), F.col("key"), F.col("ln"), F.col("rn")])
    hot = F.when(F.col("pairs") >= F.lit(share) * F.col("rn") * F.col("rn"), F.col("key"))  # tested as one value, so that both inputs stay the same and are read once
    return pairs.select("field_name", hot.alias("hot_key"), F.col("ln").alias("n"), F.col("rn").alias("total")).where(F.col("hot_key").isNotNull())


def eager_join_aggregate(
    left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, left_by: Sequence[str], right_by: Sequence[str], sums: Sequence[str]
) -> DataFrame:
    """``left JOIN right ON left_key = right_key GROUP BY left_by, right_by`` without joining rows.

    Gives ``pairs`` (joined rows), and per name in ``sums`` (numeric columns of
    ``left``) ``sum_<name>`` and ``n_<name>`` (pairs whose value is not null).
    Null keys join nothing. Columns of the same name on both sides do not clash:
    each side is reduced to its own states first.
    """
    own = [F.col(f"`{c}`").alias(f"l_{c}") for c in left_by]
    states = [F.count(F.lit(1)).alias("ln")]
    for c in sums:
        states += [F.sum(f"v_{c}").alias(f"s_{c}"), F.count(f"v_{c}").alias(f"c_{c}")]
    compact_left = left.select(left_key.alias("k"), *own, *[F.col(f"`{c}`").alias(f"v_{c}") for c in sums]).where(F.col("k").isNotNull())
    compact_left = compact_left.groupBy("k", *[f"l_{c}" for c in left_by]).agg(*states)
    compact_right = right.select(right_key.alias("k"), *[F.col(f"`{c}`").alias(f"r_{c}") for c in right_by]).where(F.col("k").isNotNull())
    compact_right = compact_right.groupBy("k", *[f"r_{c}" for c in right_by]).agg(F.count(F.lit(1)).alias("rn"))
    keys = [F.col(f"l_{c}").alias(c) for c in left_by] + [F.col(f"r_{c}").alias(c if c not in left_by else f"right_{c}") for c in right_by]
    return multiplied(compact_left, compact_right, ["k"], keys, sums)


def path_counts(edges: DataFrame, head: Column, tail: Column, kind: str) -> DataFrame:
    """Two-step paths ``a -> m -> b`` per (first kind, second kind): in- and out-degrees of each middle are multiplied."""
    ends = edges.select(head.alias("h"), tail.alias("t"), F.col(kind).alias("kind"))
    into = ends.where(F.col("t").isNotNull()).groupBy(F.col("t").alias("m"), F.col("kind").alias("first_kind")).agg(F.count(F.lit(1)).alias("ln"))
    out = ends.where(F.col("h").isNotNull()).groupBy(F.col("h").alias("m"), F.col("kind").alias("second_kind")).agg(F.count(F.lit(1)).alias("rn"))
    return multiplied(into, out, ["m"], [F.col("first_kind"), F.col("second_kind")]).withColumnRenamed("pairs", "paths")
