"""References to records that do not exist at the time of the reference.

Keys are range-partitioned by a 128-bit hash of the plain id. The parents of a
range are kept as sorted arrays of (key, live from, running end of life); the
references of that range are probed against them in vectorised batches by
binary search. A range whose references exceed the batch size is salted, and
the (small) parent arrays are repeated for each salt, so one parent that owns a
third of all references never lands in one task. Versions of a parent are merged
on the map side first, so a parent that was loaded very often stays a few rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longest time in microseconds; stands for "never deleted".
FOREVER = np.iinfo(np.int64).max
#: Ranges over the batch size that may be broadcast (12 bytes each); beyond it Spark joins them by key.
MOST_BUSY = 100_000


def probe(refs: pd.DataFrame, parents: pd.DataFrame) -> pd.DataFrame:
    """Reason per reference: 'missing' (no such parent), 'late' (first there afterwards), 'deleted', or '' when it held."""
    reason = np.full(len(refs), "missing", dtype=object)
    if len(parents) and len(refs):
        order = np.lexsort((parents["since"].to_numpy(), parents["k2"].to_numpy(), parents["k1"].to_numpy()))
        k1, k2 = parents["k1"].to_numpy()[order], parents["k2"].to_numpy()[order]
        since, until = parents["since"].to_numpy()[order], parents["until"].to_numpy()[order]
        new = np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]
        number = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        # end of life so far, within each key: a segmented running maximum
        last = pd.Series(until).groupby(number).cummax().to_numpy()
        # the time as a rank makes (key, time) one sortable integer
        times = np.sort(since)
        ticks = np.int64(len(times) + 1)
        place = number * ticks + np.searchsorted(times, since, side="left")
        r1, r2, at = refs["k1"].to_numpy(), refs["k2"].to_numpy(), refs["at"].to_numpy()
        keys = k1[first]
        slot = np.searchsorted(keys, r1, side="left")
        for _ in range(int(np.max(np.unique(keys, return_counts=True)[1]))):  # equal first halves lie side by side
            inside = slot < len(first)
            other = inside & (keys[np.minimum(slot, len(first) - 1)] == r1) & (k2[first][np.minimum(slot, len(first) - 1)] != r2)
            if not other.any():
                break
            slot = slot + other
        safe = np.minimum(slot, len(first) - 1)
        known = (slot < len(first)) & (keys[safe] == r1) & (k2[first][safe] == r2)
        pos = np.searchsorted(place, safe * ticks + np.searchsorted(times, at, side="right") - 1, side="right") - 1
        begun = known & (pos >= first[safe])
        held = begun & (last[np.maximum(pos, 0)] > at)
        reason[known] = "late"
        reason[begun] = "deleted"
        reason[held] = ""
    return pd.DataFrame({"row_id": refs["row_id"], "side": refs["side"], "at": refs["at"], "reason": reason})


def orphan_references(
    refs: DataFrame, parents: DataFrame, *, parent_key: Column, since: Column, until: Column, per_range: int = 20_000, per_batch: int = 200_000
) -> DataFrame:
    """(row_id, side, at, reason) for every reference in ``refs`` (columns row_id, side, id, at).

    ``id``/``parent_key`` are plain ids, ``at`` the reference's time. A parent
    holds from ``since`` (inclusive) to ``until`` (exclusive; null: for ever).
    ``reason`` is '' where some row of the parent held at that time. Null
    references are no references and give no row; a reference without a time is
    only held against the existence of the parent ('' or 'missing'). An empty
    parent table makes every reference 'missing'; parents without ``since``
    count as there from the start.
    """
    micros = F.unix_micros
    first = np.iinfo(np.int64).min
    keyed = lambda c: (F.xxhash64(c).alias("k1"), F.xxhash64(F.lit("tesselkg"), c).alias("k2"))
    held = parents.select(parent_key.alias("id"), since.alias("since"), until.alias("until")).where(F.col("id").isNotNull())
    held = held.select(
        *keyed(F.col("id")),
        F.coalesce(micros(F.col("since").cast("timestamp")), F.lit(first)).alias("since"),
        F.coalesce(micros(F.col("until").cast("timestamp")), F.lit(FOREVER)).alias("until"),
    )
    asked = refs.where(F.col("id").isNotNull()).select(
        "row_id", "side", *keyed(F.col("id")), F.coalesce(micros(F.col("at").cast("timestamp")), F.lit(FOREVER - 1)).alias("at")
    )
    # versions of one parent are put together before they move: those that never end make one, from the first of them on; the others one per beginning
    held = held.groupBy("k1", "k2", F.when(F.col("until") < F.lit(FOREVER), F.col("since")).alias("begun")).agg(F.min("since").alias("since"), F.max("until").alias("until")).drop("begun")
    ranges, n = 64, parents.count()  # answered from the Parquet footers
    while ranges * per_range < n:
        ranges *= 2
    bits = ranges.bit_length() - 1
    in_range = F.shiftrightunsigned(F.col("k1"), 64 - bits).alias("part")
    asked, held = asked.withColumn("part", in_range), held.withColumn("part", in_range)
    # counted on the map side: at most one row per range and task
    busy = asked.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / F.lit(per_batch)).cast("int").alias("salts")).where("salts > 1")
    if refs.count() // per_batch <= MOST_BUSY:  # no more ranges than that can be over the batch size
        busy = F.broadcast(busy)
    asked = asked.join(busy, "part", "left").withColumn(
        "salt", F.when(F.col("salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("row_id", "side"), F.col("salts")).cast("int"))
    )
    held = held.join(busy, "part", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    asked, held = asked.drop("salts"), held.drop("salts")
    return (
        asked.groupBy("part", "salt")
        .cogroup(held.groupBy("part", "salt"))
        .applyInPandas(probe, "row_id long, side string, at long, reason string")
    )


def orphan_report(orphans: DataFrame, table_name: str) -> DataFrame:
    """References, misses and miss reasons per table, side and month of the reference."""
    when = lambda r: F.count_if(F.col("reason") == r)
    return orphans.groupBy(
        F.lit(table_name).alias("table_name"), "side", F.date_format(F.timestamp_micros("at"), "yyyy-MM").alias("period")
    ).agg(
        F.count(F.lit(1)).alias("n_refs"),
        F.count_if(F.col("reason") != "").alias("n_orphans"),
        when("missing").alias("n_missing"),
        when("late").alias("n_late"),
        when("deleted").alias("n_deleted"),
    )
