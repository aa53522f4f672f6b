"""Ordered computations over one long sequence without a single-task window: ranks and running sums by range partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tesselkg.session import cut, default_parallelism


def numbered(rows: DataFrame, order: Sequence[str], sums: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with ``rank`` (from 1 in ``order``, a total order) and, per name in ``sums``, the running sum up to and with each row.

    Rows are range-partitioned by the order, numbered within their partition,
    and shifted by the totals of the partitions before; no task sees more than
    its range.
    """
    sums = sums or {}
    spread = rows.select("*", *[c.cast("double").alias(f"_x_{n}") for n, c in sums.items()])
    spread = cut(spread.repartitionByRange(default_parallelism(rows.sparkSession), *order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part").orderBy(*order)
    local = spread.withColumn("_r", F.row_number().over(inside))
    for n in sums:
        local = local.withColumn(f"_s_{n}", F.sum(F.coalesce(f"_x_{n}", F.lit(0.0))).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    totals = spread.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(F.coalesce(f"_x_{n}", F.lit(0.0))).alias(f"_t_{n}") for n in sums])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = totals.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"), *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0.0)).alias(f"_o_{n}") for n in sums])
    out = local.join(F.broadcast(offsets), "_part")  # as many rows as partitions
    return out.select(*rows.columns, (F.col("_r") + F.col("_o")).cast("long").alias("rank"), *[(F.col(f"_s_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums])


def moving_average(rows: DataFrame, order: Sequence[str], value: Column, window: int) -> DataFrame:
    """(rank, average) of each full window of ``window`` rows; with fewer rows than that, the values themselves.

    Running sums joined with themselves ``window`` ranks back.
    """
    n = numbered(rows, order, {"run": value})
    n = cut(n.select("rank", "run", value.cast("double").alias("value")))
    back = n.select((F.col("rank") + window).alias("rank"), F.col("run").alias("was"))
    size = n.agg(F.max("rank").alias("n"))
    full = n.join(back, "rank", "left").join(F.broadcast(size))  # one row
    average = F.when(F.col("n") < window, F.col("value")).otherwise((F.col("run") - F.coalesce("was", F.lit(0.0))) / window)
    return full.where((F.col("n") < window) | (F.col("rank") >= window)).select("rank", average.alias("average"))


def latest(rows: DataFrame, order: Sequence[str], most: int) -> DataFrame:
    """The last ``most`` rows in ``order``: each task keeps its own last ones."""
    return rows.orderBy(*[F.desc(c) for c in order]).limit(most)


def trailing(rows: DataFrame, most: int, columns: dict[str, Callable[[WindowSpec], Column]], chunk: int = 10_000) -> DataFrame:
    """``rows`` (with ``rank``, see ``numbered``) and columns over the up to ``most`` rows before each, made of a window.

    The sequence is cut into chunks by rank; the last ``most`` rows of each chunk go
    to the next one too, so no task sees more than a chunk and its margin.
    """
    own = F.floor((F.col("rank") - 1) / chunk)
    margin = F.when(F.pmod(F.col("rank") - 1, F.lit(chunk)) >= chunk - most, F.array(own, own + 1)).otherwise(F.array(own))
    spread = rows.select("*", own.alias("_own"), F.explode(margin).alias("_chunk"))
    window = Window.partitionBy("_chunk").orderBy("rank").rowsBetween(-most, -1)
    spread = spread.select("*", *[make(window).alias(name) for name, make in columns.items()])
    return spread.where("_own = _chunk").select(*rows.columns, *columns)


def recurrence(rows: DataFrame, keys: Sequence[str], order: str, factor: Column, term: Column) -> DataFrame:
    """(keys..., order, value) with value = factor * value of the key's row before + term, beginning at 0.

    A scan in two passes: rows are range-partitioned by key and order; each task
    runs through its own part in batches as if it began at 0, with the product of
    the factors so far; then the ends of a key's earlier parts, one row per part,
    are folded into what the part starts with. No task sees more than its range.
    """
    spread = rows.select(*keys, F.col(order).alias("_o"), factor.cast("double").alias("_a"), term.cast("double").alias("_b"))
    spread = spread.repartitionByRange(default_parallelism(rows.sparkSession), *keys, "_o").sortWithinPartitions(*keys, "_o").withColumn("_part", F.spark_partition_id())
    form = StructType([*[spread.schema[k] for k in keys], spread.schema["_o"], StructField("_part", IntegerType()), StructField("_x", DoubleType()), StructField("_run", DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, x, product = None, 0.0, 1.0
        for b in batches:
            xs, products = [], []
            for key, a, t in zip(zip(*(b[k] for k in keys)), b["_a"], b["_b"]):
                if key != last:
                    last, x, product = key, 0.0, 1.0
                x, product = a * x + t, a * product
                xs.append(x)
                products.append(product)
            yield b[[*keys, "_o", "_part"]].assign(_x=xs, _run=products)

    scanned = cut(spread.mapInPandas(run, form))
    ends = scanned.groupBy(*keys, "_part").agg(F.max_by(F.struct("_x", "_run"), "_o").alias("e"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    starts = ends.select(*keys, "_part", F.collect_list("e").over(before).alias("es")).where(F.size("es") > 0)
    starts = starts.select(*keys, "_part", F.aggregate("es", F.lit(0.0), lambda x, e: e["_run"] * x + e["_x"]).alias("_start"))
    out = scanned.join(F.broadcast(starts), [*keys, "_part"], "left")  # fewer rows than there are parts: a part has one key that goes on from the part before
    return out.select(*keys, F.col("_o").alias(order), (F.col("_x") + F.col("_run") * F.coalesce("_start", F.lit(0.0))).alias("value"))


def generalized_advantages(steps: DataFrame, trajectory: Sequence[str], order: str, *, gamma: float = 0.99, decay: float = 0.95) -> DataFrame:
    """(trajectory..., order, advantage) from rows with delta and done: A = delta + gamma * decay * A of the next step, starting anew at done."""
    back = steps.withColumn("_back", -F.col(order))
    out = recurrence(back, trajectory, "_back", F.when(F.col("done"), 0.0).otherwise(gamma * decay), F.col("delta"))
    return out.select(*trajectory, (-F.col("_back")).alias(order), F.col("value").alias("advantage"))
