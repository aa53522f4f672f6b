"""Queries over stored runs against a plain computation."""

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselkg.operators import vector
from tesselkg.plans import samples


def _unit(text):
    v = np.zeros(64)
    for w in re.findall(r"[^\W_]+", (text or "").lower()):
        v[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 64] += 1
    return v / (np.linalg.norm(v) or 1.0)


def _gain(own, base, titles):
    p, q = ([math.exp(float(_unit(t) @ _unit(h))) for t in titles] for h in (own, base))
    return sum(a / sum(p) * math.log(a / sum(p) / (b / sum(q))) for a, b in zip(p, q))


def _query(history, options):
    return f"Watching history: {{{history}}}. Options: {{{options}}}"


def test_likeness(spark):
    rows = spark.createDataFrame([(["red sun", "blue", "...", None], "Red moon"), (["a"], None), ([], "a"), (None, "a")], "o array<string>, t string")
    got = [r[0] for r in rows.select(vector.likeness(F.col("o"), F.col("t"))).collect()]
    assert got[0] == pytest.approx([float(_unit(t) @ _unit("red moon")) for t in ("red sun", "blue", "...", None)])
    assert got[1:] == [[0.0], [], None]


def test_semantic_gain_broadcasts_no_texts(spark, tmp_path):
    """Under a bound that 300 vectors or texts exceed: the planner's estimate of their size says nothing."""
    rows, want = [], {}
    for user in range(150):
        old, new, own = f"old film {user}", f"river {user} north", f"river {user} storm and sea"
        rows += [(4 * user, 1, user, _query(new, "A: x"), None), (4 * user + 1, 0, user, _query(old, "A: x"), 1), (4 * user + 2, 2, user, _query(own, f"A: River {user}, The, B: North, C: --, b: Sea storm"), 3)]
        want[4 * user + 2] = _gain(own, new, [f"River {user}, The", "Sea storm", "--"])
    rows += [(1001, 1, None, _query("a", "A: x"), 1), (1002, 2, None, _query("a", "A: x"), 2)]  # no user
    rows += [(1003, 2, 1003, _query("a", "A: x"), 2)]  # no baseline
    rows += [(1004, 1, 1004, None, 1), (1005, 2, 1004, _query("a b", "A: a, B: c"), 2), (1006, 2, 1004, None, 2), (1007, 2, 1004, _query("a", ""), 2), (1008, 2, 1004, "free text", 4)]  # a baseline without a text; runs without options
    want[1005] = _gain("a b", None, ["a", "c"])
    made = spark.createDataFrame(rows, "result_id long, day int, user_id long, user_query string, selected_retriever_id int")
    made.selectExpr("*", "date_add(date'2024-01-01', day)::timestamp AS created_at").write.parquet(f"{tmp_path}/pipeline_result.parquet")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "32k")
    try:
        got = {r["result_id"]: r["gain"] for r in samples.semantic_gain(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert got == pytest.approx(want, abs=1e-6) and got[1005] > 0 and got[2] > 0
