"""Exact vector search and the hashed bag-of-words encoder."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Queries held by each task at a time.
QUERY_BLOCK = 4096
DIMENSIONS = 64


def unit(vector: Column) -> Column:
    """The vector as doubles of length one; null for null and zero vectors and for missing values."""
    v = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"), lambda a, x: a + x * x))
    once = F.array(F.struct(v.alias("v"), norm.alias("n")))  # the norm is computed once, not once per element
    return F.when(norm > 0, F.transform(once, lambda s: F.transform(s["v"], lambda x: x / s["n"]))[0])


def nearest(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): the k rows of ``index`` (id, v) most similar to each of ``queries`` (query_id, v), both of unit vectors.

    The queries are a stated set and go to the tasks in blocks; each task keeps
    its own k best per query, so the shuffle carries k rows per query and task,
    whatever the size of the index. Scores are rounded to six places and ties go
    to the smaller id.
    """
    spark = index.sparkSession
    held = index.where("v is not null").select("id", "v")
    asked = queries.where("v is not null").select(F.col("query_id").cast("string"), "v").toLocalIterator()
    out = spark.createDataFrame([], "query_id string, id string, score double")
    block: list = []

    def against(block: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(([r[0] for r in block], np.array([r[1] for r in block])))  # at most QUERY_BLOCK vectors

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, q = shared.value
            for b in batches:
                x = np.array(b["v"].tolist())
                ids = b["id"].astype(str).to_numpy()
                scores = np.round(x @ q.T, 6)
                order = np.argsort(ids, kind="stable")  # rows by id, so that equal scores keep the smaller id
                top = np.argsort(-scores[order], axis=0, kind="stable")[:k]
                rows = order[top]
                yield pd.DataFrame({"query_id": np.tile(names, len(rows)), "id": ids[rows].ravel(), "score": np.take_along_axis(scores, rows, 0).ravel()})

        return held.mapInPandas(best, "query_id string, id string, score double")

    for row in asked:
        block.append((row["query_id"], np.asarray(row["v"])))
        if len(block) == QUERY_BLOCK:
            out, block = out.unionByName(against(block)), []
    if block:
        out = out.unionByName(against(block))
    few = out.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))), 1, k).alias("top"))
    ranked = few.select("query_id", F.posexplode("top").alias("p", "t"))
    return ranked.select("query_id", F.col("t.id").alias("id"), (-F.col("t.s")).alias("score"), (F.col("p") + 1).cast("long").alias("rank"))


WORD = re.compile(r"[^\W_]+")


def _counts(text: str, bucket: dict[str, int]) -> np.ndarray:
    """The words of each bucket; ``bucket`` keeps those of the words seen."""
    v = np.zeros(DIMENSIONS)
    for w in WORD.findall(text.lower()):
        if w not in bucket:
            if len(bucket) > 200_000:
                bucket.clear()
            bucket[w] = int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % DIMENSIONS
        v[bucket[w]] += 1
    return v


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _bag(texts: pd.Series) -> pd.Series:
    bucket: dict[str, int] = {}
    out = []
    for t in texts:
        v = None
        if t is not None:
            v = _counts(t, bucket)
            norm = math.sqrt(float(v @ v))
            v = v / norm if norm else None
        out.append(v)
    return pd.Series(out)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _alike(lists: pd.Series, texts: pd.Series) -> pd.Series:
    bucket: dict[str, int] = {}
    out = []
    for several, text in zip(lists, texts):
        if several is None:
            out.append(None)
            continue
        x = np.array([_counts(t or "", bucket) for t in (text, *several)])
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        x = x / np.where(norm > 0, norm, 1.0)
        out.append((x[1:] * x[0]).sum(axis=1))
    return pd.Series(out)


def hashed_words(text: Column) -> Column:
    """The default encoder: a bag of lower-case words, each counted in the bucket of its MD5, as a unit vector of 64 doubles; null without words.

    Any other encoder is a pandas UDF of the same shape.
    """
    return _bag(text)


def likeness(texts: Column, text: Column) -> Column:
    """The cosine of each of ``texts`` (an array) and ``text`` under the default encoder, 0 where either has no words, null without an array; no vector leaves the task that makes it."""
    return _alike(texts, text)
