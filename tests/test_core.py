"""Core operators against hand-computed rows, brute force and their properties."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselkg.functions import kg_text, prompts
from tesselkg.operators import align, graph, kg, sequence, vector
from tesselkg.sources import config, mapping, rdf, samples, store


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column).first()[0]


def test_relation_text(spark):
    assert one(spark, kg_text.relation_phrase(F.col("r")), r="dbo:musicComposer") == "music composer"
    assert one(spark, kg_text.triple_sentence(F.col("h"), F.col("r"), F.col("t")), h="A", r="dbo:director", t="B") == "A is directed by B"
    assert one(spark, kg_text.triple_sentence(F.col("h"), F.col("r"), F.col("t")), h="A", r="x:ownFilm", t="B") == "A own film B"


def test_ntriples(spark):
    lines = ["<s> <p> <o> .", '<s> <p> "a . b \\"q\\""@en .', '<s> <p> "30"^^<x:int> .', "# c", "", "@prefix", "broken"]
    got = rdf.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"), keep=[]).collect()
    assert [(r["object"], r["object_type"]) for r in got if r["ok"]] == [("o", "uri"), ('a . b "q"', "literal"), ("30", "literal")]
    assert sum(not r["ok"] for r in got) == 1


def test_mapping(spark):
    assert mapping.detect_columns("movie_id::string,URI::string", ",") == (0, 1)
    with pytest.raises(ValueError, match="no id"):
        mapping.detect_columns("a,b", ",")
    lines = spark.createDataFrame([(0, "1,http://a"), (1, "1,http://b"), (2, ""), (3, "2,ftp"), (4, "3,http://c")], "line_no long, value string")
    assert {tuple(r) for r in mapping.parse_mapping(lines, "id,uri", delimiter=",").collect()} == {("1", "http://b"), ("3", "http://c")}
    assert mapping.parse_mapping(lines, "id,uri", delimiter=",", limit=1).count() == 1


def test_options_and_answers(spark):
    df = spark.createDataFrame([("A: Great Race, The, B: X, c: Y, zz",)], "o string")
    assert [tuple(x) for x in df.select(prompts.options_list(F.col("o"))).first()[0]] == [("A", "Great Race, The"), ("B", "X"), ("C", "Y, zz")]
    assert one(spark, prompts.explicit_answer(F.col("t")), t="My answer: c") == "C"
    assert one(spark, prompts.lone_letter(F.col("t")), t="I take q .") == "Q"
    assert one(spark, prompts.lone_letter(F.col("t")), t="nothing") == "M"
    assert one(spark, prompts.history_summary(F.col("t")), t='Watching history: {"a", "b"}. Options: {A: x}') == "movies: a, b"
    assert one(spark, prompts.satisfaction(F.col("t")), t="thanks") == 0.8


def test_upsert_last_wins(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "k string, v long, p string")
    assert {tuple(r) for r in kg.upsert(df, ["k"], ["v"]).collect()} == {("a", 2, "y"), ("b", 1, None)}


def test_two_hop_repeats_parallel_edges(spark):
    r = spark.createDataFrame([("a_p_b", "p", "a", "b", 1.0), ("a_q_b", "q", "a", "b", 1.0), ("b_p_c", "p", "b", "c", 1.0)], "relation_id string, relation_type string, head string, tail string, confidence double")
    edges = kg.two_hop(spark.createDataFrame([("a",)], "centre string"), r, 20)
    assert edges.where("hop = 2").count() == 2
    assert kg.two_hop(spark.createDataFrame([("a",)], "centre string"), r, 1).count() == 2


def _random_graph(n, m, seed):
    rng = random.Random(seed)
    pairs = rng.sample(list(itertools.combinations(range(n), 2)), m)
    return [("g", f"n{a:02d}", f"n{b:02d}", float(rng.randint(1, 5))) for a, b in pairs]


def _kruskal(edges):
    parent, out = {}, []

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for _, u, v, c in sorted(edges, key=lambda e: (e[3], e[1], e[2])):
        if find(u) != find(v):
            parent[find(u)] = find(v)
            out.append((u, v, c))
    return set(out)


def test_spanning_forests(spark):
    edges = _random_graph(14, 20, 3)
    df = spark.createDataFrame(edges, "grp string, u string, v string, cost double")
    assert {tuple(r) for r in graph.spanning_forests(df).select("u", "v", "cost").collect()} == _kruskal(edges)
    assert {tuple(r) for r in graph.boruvka(df).collect()} == _kruskal(edges)
    assert graph.boruvka(df.limit(0)).count() == 0
    for most in (100, 0):  # in one task, in rounds of joins
        got = graph.minimum_forest(df.withColumn("relation_type", F.lit("r")).repartition(3), most=most)
        assert {tuple(r) for r in got.select("u", "v", "cost").collect()} == _kruskal(edges)
    assert graph.minimum_forest(df.limit(0)).count() == 0


def test_local_forests_over_buffers(spark, monkeypatch):
    monkeypatch.setattr(graph, "BUFFER", 3)
    edges = _random_graph(14, 40, 8)
    df = spark.createDataFrame(edges, "grp string, u string, v string, cost double").coalesce(1)
    assert {tuple(r) for r in graph.local_forests(df).select("u", "v", "cost").collect()} == _kruskal(edges)


def test_steiner(spark):
    tree = [("g", "a", "b", 1.0), ("g", "b", "c", 1.0), ("g", "c", "d", 1.0), ("g", "b", "x", 1.0)]
    df = spark.createDataFrame(tree, "grp string, u string, v string, cost double")
    asked = spark.createDataFrame([("g", "a"), ("g", "c")], "grp string, node string")
    for got in (graph.steiner_subtrees(df, asked), graph.steiner_subtree(df, asked), graph.steiner_subtree(df, asked, most=0)):
        assert {(r["u"], r["v"]) for r in got.collect()} == {("a", "b"), ("b", "c")}
    assert graph.steiner_subtrees(df, asked.limit(0)).count() == 0


def test_pagerank(spark):
    edges = _random_graph(12, 16, 5)
    df = spark.createDataFrame([e[:3] for e in edges], "grp string, u string, v string")
    seeds = spark.createDataFrame([("g", "n00"), ("g", "lone")], "grp string, node string")
    many = {r["node"]: r["score"] for r in graph.personalized_pagerank(df, seeds, rounds=20, tolerance=None).collect()}
    few = {r["node"]: r["score"] for r in graph.pagerank_of_groups(df, seeds, rounds=20, tolerance=0).collect()}
    assert math.isclose(sum(many.values()), 1, abs_tol=1e-9)
    assert many.keys() == few.keys()
    assert all(math.isclose(many[k], few[k], abs_tol=1e-9) for k in many)


def test_vector_search(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None), (98, [0.0] * 8)], "i long, e array<double>")
    index = df.select(F.col("i").cast("string").alias("id"), vector.unit(F.col("e")).alias("v"))
    got = vector.nearest(index.where("id in ('0', '1')").withColumnRenamed("id", "query_id"), index, 4).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in (0, 1):
        best = sorted(range(50), key=lambda i: (-round(float(u[i] @ u[q]), 6), str(i)))[:4]
        assert [int(r["id"]) for r in sorted((r for r in got if r["query_id"] == str(q)), key=lambda r: r["rank"])] == best
    assert vector.nearest(index.limit(0).withColumnRenamed("id", "query_id"), index, 4).count() == 0


def test_numbering(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 101)], "i long, x double").repartition(7)
    got = sequence.numbered(df, ["i"], {"s": F.col("x")}).collect()
    assert all(r["rank"] == r["i"] and r["s"] == r["i"] * (r["i"] + 1) / 2 for r in got)
    avg = {r["rank"]: r["average"] for r in sequence.moving_average(df, ["i"], F.col("x"), 10).collect()}
    assert len(avg) == 91
    assert avg[10] == 5.5
    assert sequence.moving_average(df, ["i"], F.col("x"), 500).count() == 100


def test_gae(spark):
    df = spark.createDataFrame([("t", 1, 1.0, False), ("t", 2, 2.0, False), ("t", 3, 3.0, True)], "t string, i long, delta double, done boolean")
    got = {r["i"]: r["advantage"] for r in sequence.generalized_advantages(df, ["t"], "i").collect()}
    g = 0.99 * 0.95
    assert math.isclose(got[1], 1 + g * (2 + g * 3))
    assert got[3] == 3.0


def test_recurrence_over_many_parts(spark):
    """One key over all parts, many small ones, resets and repeated orders of magnitude, against a plain loop."""
    rng = random.Random(3)
    rows = [("hot", i, rng.choice([0.0, 0.9, 0.5]), rng.random()) for i in range(3000)] + [(f"k{i % 40}", i, 0.9, 1.0) for i in range(400)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i long, a double, b double").repartition(5)
    got = {(r["k"], r["i"]): r["value"] for r in sequence.recurrence(df, ["k"], "i", F.col("a"), F.col("b")).collect()}
    expected, x = {}, {}
    for k, i, a, b in sorted(rows):
        x[k] = a * x.get(k, 0.0) + b
        expected[k, i] = x[k]
    assert got.keys() == expected.keys()
    assert all(math.isclose(got[k], expected[k], rel_tol=1e-9) for k in expected)
    assert sequence.recurrence(df.limit(0), ["k"], "i", F.col("a"), F.col("b")).count() == 0


def test_trailing_windows(spark):
    df = sequence.numbered(spark.createDataFrame([(i, float(i)) for i in range(1, 61)], "i long, x double"), ["i"])
    got = {r["i"]: r["m"] for r in sequence.trailing(df, 4, {"m": lambda w: F.max("x").over(w)}, chunk=7).collect()}
    assert got == {i: (float(i - 1) if i > 1 else None) for i in range(1, 61)}


def test_local_ids(spark):
    from tesselkg.functions import ids

    assert one(spark, ids.local_id(F.col("u")), u="http://kg.example/resource/AC/DC") == "AC/DC"
    assert one(spark, ids.local_id(F.col("u")), u="http://kg.example/ontology/Film") == "Film"
    assert one(spark, ids.local_id(F.col("u")), u="http://other.example/a/b") == "b"
    assert one(spark, ids.curie(F.col("u")), u="http://www.w3.org/1999/02/22-rdf-syntax-ns#type") == "rdf:type"
    assert one(spark, ids.curie(F.col("u")), u="http://www.w3.org/2000/01/rdf-schema#comment") == "rdfs:comment"
    assert one(spark, ids.curie(F.col("u")), u="http://other.example/a/b") == "b"


def test_connected_facts(spark):
    doc = "Connected subgraph analysis:\n\nSeed entities (1):\n  1. A (Movie) [relevance: 0.900, importance: 0.1000]\n\nConnected graph statistics:\n  Nodes: 1\n\nImportant relationships in connected graph:\n  • A director B [relevance: 0.5]"
    got = align.connected_facts(spark.createDataFrame([("d", doc), ("e", None)], "id string, doc string"), "id", "doc").collect()
    assert {(r["section"], r["text"]) for r in got} == {("seed", "1. A (Movie)"), ("relationships", "A director B")}


def test_config(tmp_path):
    assert config.merge({"a": {"b": 1, "c": 2}, "d": 1}, {"a": {"b": 3}, "d": {"e": 1}}) == {"a": {"b": 3, "c": 2}, "d": {"e": 1}}
    assert config.apply_preset({"llm": {"size": 1}}, {"small": {"size": 2, "name": "s"}}, "llm", "small") == {"llm": {"size": 1, "name": "s"}}
    with pytest.raises(ValueError, match="no preset"):
        config.apply_preset({}, {}, "llm", "small")
    assert config.validate({"a": {"b": 1}, "c": True}, {"a.b": int, "a.x": str, "c": int}) == ["a.x is missing", "c is a bool"]
    config.save({"a": 1}, str(tmp_path / "x.json"))
    assert config.load(str(tmp_path / "x.json")) == {"a": 1}


def test_samples(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text('[{"input": "h", "questions": "A: x", "output": "A"}]')
    assert samples.read_samples(spark, str(path)).first()["output"] == "A"
    assert samples.read_samples(spark, str(tmp_path / "none.json")).count() == 0
    loose = spark.createDataFrame([(None, "q", ["x", "y"], "A")], "query string, input string, choices array<string>, label string")
    row = samples.normalise(loose).first()
    assert (row["query"], row["options"], row["ground_truth"]) == ("q", {"A": "x", "B": "y"}, "A")
    made = samples.generate(spark, 20, seed=1)
    assert made.collect() == samples.generate(spark, 20, seed=1).collect()
    assert made.groupBy("user_type").count().where("count = 4").count() == len(samples.USERS)
    assert not [r for r in made.collect() if "{" in r["query"]]
    assert not [r for r in samples.follow_ups(made).collect() if "{" in r["follow_up"]]
    assert samples.generate_documents(spark).groupBy("product").count().where("count = 5").count() == 20
    path.write_text('{"input": "one", "output": "B"}')
    assert [r["input"] for r in samples.read_samples(spark, str(path)).collect()] == ["one"]
    path.write_text("no json at all")
    assert samples.read_samples(spark, str(path)).count() == 0


def test_stored_graph_and_index(spark, tmp_path):
    entity = lambda rows: spark.createDataFrame(rows, store.ENTITY)
    relation = lambda rows: spark.createDataFrame(rows, store.RELATION)
    path = str(tmp_path / "graph")
    assert [x.count() for x in store.load_graph(spark, path)] == [0, 0]
    store.save_graph(entity([("a", "T", "A", "{}", "[]"), ("b", "T", "B", "{}", "[]")]), relation([("a_r_b", "r", "a", "b", 1.0)]), path)
    store.upsert_graph(entity([("a", "T", "A2", "{}", "[]"), ("c", "T", "C", "{}", "[]")]), relation([("a_r_b", "r", "a", "b", 0.5)]), path)
    entities, relations = store.load_graph(spark, path)
    assert {r["entity_id"]: r["name"] for r in entities.collect()} == {"a": "A2", "b": "B", "c": "C"}
    assert [r["confidence"] for r in relations.collect()] == [0.5]
    store.save_graph(entity([]), relation([]), path)  # the graph emptied
    assert [x.count() for x in store.load_graph(spark, path)] == [0, 0]
    stats = store.save_index(spark.createDataFrame([("a", [1.0, 0.0])], "id string, v array<double>"), str(tmp_path / "index"), "hashed").first()
    assert (stats["n_vectors"], stats["dimensions"], stats["model"]) == (1, 2, "hashed")


def test_logs_reports_and_sizes(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5)], "episode int, reward double")
    for _ in range(2):
        store.append_metrics(rows, str(tmp_path / "log"))
    logged = spark.read.json(str(tmp_path / "log"))
    assert logged.count() == 2 and logged.where("timestamp is null").count() == 0
    assert store.write_report(rows, str(tmp_path / "report.json")) == {"episode": 1, "reward": 0.5}
    with pytest.raises(ValueError, match="one row"):
        store.write_report(rows.limit(0), str(tmp_path / "none.json"))
    (tmp_path / "dumps").mkdir()
    (tmp_path / "dumps" / "a.nt").write_text("x" * 100)
    assert [tuple(r) for r in store.file_sizes(spark, str(tmp_path / "dumps")).collect()] == [("a.nt", 0.0, 0.0)]


def test_dump_files(spark, tmp_path):
    import bz2

    (tmp_path / "x.nt.bz2").write_bytes(bz2.compress('<s> <p> "a"@en .\n# c\n<t> <p> <o> .\nbroken\n'.encode()))
    got = rdf.read_dump(spark, str(tmp_path / "x.nt.bz2")).collect()
    assert sorted((r["subject"], r["object"]) for r in got if r["ok"]) == [("s", "a"), ("t", "o")]
    wanted = spark.createDataFrame([("t",)], "subject string")
    assert [r["object"] for r in rdf.read_dump(spark, str(tmp_path / "x.nt.bz2"), wanted).collect()] == ["o"]
    (tmp_path / "m.tsv").write_text("item_id\turi\n1\thttp://a\n2\tftp\n1\thttp://b\n")
    assert [tuple(r) for r in mapping.read_mapping(spark, str(tmp_path / "m.tsv")).collect()] == [("1", "http://b")]
