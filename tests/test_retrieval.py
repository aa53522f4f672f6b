"""The retrieval experts on small hand-made tables."""

import re

import pytest

from tesselkg.plans import retrieval


def _unit(*places):
    return [1.0 if i in places else 0.0 for i in range(64)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Two queries (vectors 0 and 100), each with its own seeds: three hubs of 20 leaves, and a star of 4 leaves with two seeds that have no edges."""
    d = tmp_path_factory.mktemp("tables")
    edges = [(f"a{k}", f"a{k}_{i:02}") for k in range(3) for i in range(20)] + [("a0", "a1"), ("a1", "a2")] + [("b0", f"b0_{i}") for i in range(4)]
    names = sorted({x for e in edges for x in e} | {"b1", "b2"})
    spark.createDataFrame([(i, x, "Movie", x.upper(), None, None) for i, x in enumerate(names)], "row_id long, entity_id string, entity_type string, name string, attributes string, aliases string").selectExpr("*", "timestamp'2023-01-01' AS loaded_at").write.parquet(f"{d}/entities.parquet")
    spark.createDataFrame([(i, h, "dbo:director", t, 1.0) for i, (h, t) in enumerate(edges)], "row_id long, head_entity_id string, relation_type string, tail_entity_id string, confidence double").selectExpr("*", "timestamp'2023-01-01' AS loaded_at").write.parquet(f"{d}/relations.parquet")
    vectors = [(0, "a0", _unit(0)), (1, "a1", _unit(0, 1)), (2, "a2", _unit(0, 1, 2)), (100, "b0", _unit(40)), (101, "b1", _unit(40, 41)), (102, "b2", _unit(40, 41, 42))]
    spark.createDataFrame(vectors, "vec_id long, entity_id string, embedding array<double>").write.parquet(f"{d}/entity_index.parquet")
    return str(d)


def test_connected_retrieval_per_query(spark, tables):
    got = {r["query_id"]: r.asDict() for r in retrieval.connected_retrieval(spark, tables).collect()}
    assert got.keys() == {"0", "100"}
    large, small = got["0"]["knowledge"], got["100"]["knowledge"]
    # 63 vertices in one tree: all are important, all 62 edges are kept, 30 are shown
    assert "  Nodes: 63\n  Edges: 62\n" in large
    assert large.count("  • A") == 30 and "B0" not in large
    assert large.endswith("  ... and 32 more relationships")
    # 5 vertices and the two seeds without edges, shown whole and not priced
    assert "Seed entities (3):\n  1. B0 (Movie) [relevance: 1.000, importance: " in small
    assert "  Nodes: 7\n  Edges: 4\n" in small
    assert re.findall(r"• (.*)", small) == [f"B0 director B0_{i} [relevance: 0.500]" for i in range(4)]
    assert got["0"]["confidence"] == pytest.approx((1 + 2**-0.5 + 3**-0.5) / 3, abs=1e-5)


def test_router_runs_every_expert(spark, tables):
    query, rows = "a0 b0 movie", [(100, 1), (200, 2), (300, 3), (400, 4), (500, None), (301, 3), (800, 9)]
    made = spark.createDataFrame([(i, query, e) for i, e in rows] + [(600, "", 3), (700, None, 4)], "result_id long, user_query string, selected_retriever_id int")
    made.write.parquet(f"{tables}/pipeline_result.parquet")
    got = {r["query_id"]: (r["expert_id"], r["n_documents"], r["confidence"]) for r in retrieval.all_experts_union(spark, tables).collect()}
    asked = retrieval._asked(spark, tables).where("query_id = '300'")
    hits = [r["score"] for r in retrieval.vector.nearest(asked, retrieval.entity_vectors(spark, tables), retrieval.K).collect()]
    mean = pytest.approx(sum(hits) / 3, abs=1e-5)
    assert got["100"] == (1, 0, 1.0) and got["500"] == (1, 0, 1.0)
    assert got["200"][:2] == (2, 1)
    assert got["300"] == (3, 1, mean) and got["400"] == (4, 1, mean) and mean != 1.0
    assert got["600"] == (3, 0, None)
    assert got.keys() == {"100", "200", "300", "400", "500", "600", "800"}
    assert got["800"] == (9, 0, 0.0)
    with pytest.raises(ValueError, match="no expert 9"):
        retrieval.checked_expert(9)
