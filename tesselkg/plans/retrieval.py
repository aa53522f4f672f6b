"""Retrieval: vector search and the four experts, batched over all queries of the stated set, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselkg.functions import kg_text
from tesselkg.operators import graph, kg, vector
from tesselkg.plans import knowledge as kgq
from tesselkg.plans.knowledge import BFS, HOPS, KGE, KGR, NAMED, PHRASE, RANKED, SEEDS, VERB, _with
from tesselkg.session import cut, table

#: Retrieved rows per query.
K = 3
#: Rendered relations and edges.
MOST_RELATIONS, MOST_EDGES = 20, 30
#: Vertices of highest rank that the evidence of a query connects.
MOST_IMPORTANT = 100


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, id, v) of the usable vectors of the entity index, of unit length."""
    rows = table(spark, sf_dir, "entity_index").select("vec_id", F.col("entity_id").alias("id"), vector.unit(F.col("embedding")).alias("v"))
    return rows.where("v is not null")


def queries_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: vectors whose id is divisible by 100."""
    return index(spark, sf_dir).where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").cast("string").alias("query_id"), "v")


IDX = "idx AS (SELECT vec_id, entity_id AS id, list_transform(e, lambda x: x / n) AS v FROM (SELECT vec_id, entity_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM (SELECT vec_id, entity_id, embedding::double[] AS e FROM entity_index WHERE embedding IS NOT NULL)) WHERE n > 0)"
TOP = f"""top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT q.vec_id::varchar AS query_id, i.id, round(list_inner_product(q.v, i.v), 6) AS score FROM idx q, idx i WHERE q.vec_id % 100 = 0)) WHERE rank <= {K})"""


def vector_topk(spark, d):
    return vector.nearest(queries_of(spark, d), index(spark, d), K)


def labelled_topk(spark, d):
    """The same search over the embeddings table: neighbours and how many of them share the query's label."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("vec_id").cast("string").alias("id"), vector.unit(F.col("embedding")).alias("v"), "label")
    hits = vector.nearest(e.where(F.col("vec_id") % 100 == 0).select(F.col("id").alias("query_id"), "v"), e.select("id", "v"), 10)
    labels = e.select("id", "label")
    rows = hits.join(labels, "id").join(labels.select(F.col("id").alias("query_id"), F.col("label").alias("asked")), "query_id")
    return rows.groupBy("query_id").agg(F.count_if(F.col("label") == F.col("asked")).alias("n_same"), F.count(F.lit(1)).alias("n"))


# --- the hashed encoder and triple search


def triple_index(spark, d, held: kgq.Graph | None = None) -> DataFrame:
    """(id, v): every triple between known entities, its sentence encoded."""
    text = kg_text.triple_sentence(F.col("head_name"), F.col("relation_type"), F.col("tail_name"))
    return kgq._named(spark, d, held).select(F.col("relation_id").alias("id"), vector.hashed_words(text).alias("v")).where("v is not null")


def _shown(spark, d, found: DataFrame, held: kgq.Graph | None = None) -> DataFrame:
    """``found`` with the plain form of its triples (id), which retrieval shows: only those are named, and nothing is encoded again."""
    ids = found.select("id").distinct()
    known, edges = kgq.graph_of(spark, d, held)
    few = edges.join(ids.withColumnRenamed("id", "relation_id"), "relation_id", "left_semi")
    e = known.select("entity_id", "name")
    few = few.join(e.select(F.col("entity_id").alias("head"), F.col("name").alias("hn")), "head").join(e.select(F.col("entity_id").alias("tail"), F.col("name").alias("tn")), "tail")
    return found.join(few.select(F.col("relation_id").alias("id"), kg_text.triple_plain(F.col("hn"), F.col("relation_type"), F.col("tn")).alias("shown")), "id")


def _asked(spark, d) -> DataFrame:
    """The stated set of stored queries: results whose id is divisible by 100."""
    rows = table(spark, d, "pipeline_result").where((F.col("result_id") % 100 == 0) & F.col("user_query").isNotNull())
    return rows.select(F.col("result_id").cast("string").alias("query_id"), "user_query", vector.hashed_words(F.col("user_query")).alias("v"))


def _nearest_triples(spark, d, queries: DataFrame, held: kgq.Graph | None = None) -> DataFrame:
    return vector.nearest(queries, triple_index(spark, d, held).select("id", "v"), K)


def triple_topk(spark, d):
    return _nearest_triples(spark, d, _asked(spark, d))


def query_encoding(spark, d):
    """The non-zero places of the encoded queries."""
    return _asked(spark, d).select("query_id", F.posexplode("v").alias("bucket", "x")).where("x > 0").select("query_id", F.col("bucket").cast("long").alias("bucket"), F.round("x", 6).alias("x"))


def _fixed(score: Column) -> Column:
    return F.format_string("%.3f", F.round(score, 3))


def _triples(spark, d, queries: DataFrame, held: kgq.Graph | None = None) -> DataFrame:
    """Expert 2 for each of ``queries`` (query_id, v): the retrieved triples as one text per query, and their mean score as confidence."""
    rows = _shown(spark, d, cut(_nearest_triples(spark, d, queries, held)), held).withColumn("line", F.concat(F.lit("• "), F.col("shown"), F.lit(" (score: "), _fixed(F.col("score")), F.lit(")")))
    return rows.groupBy("query_id").agg(
        F.concat(F.lit("Retrieved factual triples:\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n")).alias("knowledge"),
        F.round(F.avg("score"), 6).alias("confidence"),
    )


def triple_retrieval(spark, d):
    """Expert 2 for the stated set of stored queries."""
    return _triples(spark, d, _asked(spark, d))


BAG = r"""SELECT {id} AS id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY {id})) AS x FROM (
  SELECT {id}, bucket, count(*)::double AS n FROM (SELECT {id}, ('0x' || substr(md5(t), 1, 8))::bigint % 64 AS bucket FROM (SELECT {id}, unnest(string_split_regex(lower({text}), '[^\p{{L}}\p{{N}}]+')) AS t FROM {src}) WHERE t <> '') GROUP BY 1, 2)"""
TRIPLES = f"trip AS (SELECT relation_id, head_name || ' ' || {VERB.format(c='relation_type')} || ' ' || tail_name AS text, head_name || ' ' || {PHRASE.format(c='relation_type')} || ' ' || tail_name AS shown FROM named)"
ASKED = "asked AS (SELECT result_id::varchar AS query_id, user_query FROM pipeline_result WHERE result_id % 100 = 0 AND user_query IS NOT NULL)"
TTOP = f"""tv AS ({BAG.format(id='relation_id', text='text', src='trip')}), qv AS ({BAG.format(id='query_id', text='user_query', src='asked')}),
ttop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT q.query_id, t.relation_id AS id, coalesce(s.score, 0.0::double) AS score FROM (SELECT DISTINCT id AS query_id FROM qv) q CROSS JOIN (SELECT DISTINCT id AS relation_id FROM tv) t
  LEFT JOIN (SELECT qv.id AS query_id, tv.id AS relation_id, round(sum(qv.x * tv.x), 6) AS score FROM qv JOIN tv USING (bucket) GROUP BY 1, 2) s USING (query_id, relation_id))) WHERE rank <= {K})"""


# --- expert 3: entities and their two-hop subgraphs


def _subgraphs(spark, d, queries: DataFrame, entities: DataFrame, held: kgq.Graph | None = None) -> DataFrame:
    """Expert 3 for each of ``queries`` (query_id, v) over ``entities`` (id, v) as one text per query: seeds with score and sizes, totals of the merged subgraph, its first relations as sentences; the mean score of the seeds as confidence."""
    every, relations = kgq.graph_of(spark, d, held)
    hits = cut(vector.nearest(queries, entities, K).join(every.select(F.col("entity_id").alias("id"), "name", "entity_type"), "id"))
    known = cut(every.select("entity_id", "name"))
    edges = cut(kg.two_hop(hits.select(F.col("id").alias("centre")), relations, kgq.MOST_NEIGHBOURS))
    sizes = hits.select(F.col("id").alias("centre")).distinct().join(kg.subgraph_sizes(edges, known), "centre", "left").select("centre", F.coalesce("n_entities", F.lit(1)).alias("ne"), F.coalesce("n_relations", F.lit(0)).alias("nr"))
    seeds = hits.join(sizes, F.col("id") == F.col("centre"))
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), "name", F.lit(" ("), "entity_type", F.lit(") [score: "), _fixed(F.col("score")), F.lit(", subgraph: "), F.col("ne").cast("string"), F.lit(" entities, "), F.col("nr").cast("string"), F.lit(" relations]"))
    top = seeds.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n").alias("seeds"), F.round(F.avg("score"), 6).alias("confidence"))
    all_edges = hits.select("query_id", F.col("id").alias("centre"), "rank").join(edges, "centre")
    merged = kg.merged_relations(all_edges, "query_id", [F.col("rank"), F.col("hop"), F.col("rn"), F.col("rn2")])
    ends = all_edges.select("query_id", F.explode(F.array("head", "tail")).alias("entity_id")).unionByName(hits.select("query_id", F.col("id").alias("entity_id"))).distinct()
    n_entities = ends.join(known.select("entity_id"), "entity_id", "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("ne"))
    n_relations = merged.groupBy("query_id").agg(F.count(F.lit(1)).alias("nr"))
    few = merged.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("first", "head", "relation_type", "tail"))), 1, MOST_RELATIONS).alias("few")).select("query_id", F.posexplode("few").alias("p", "f"))
    few = few.select("query_id", "p", "f.head", "f.relation_type", "f.tail").join(known.select(F.col("entity_id").alias("head"), F.col("name").alias("hn")), "head").join(known.select(F.col("entity_id").alias("tail"), F.col("name").alias("tn")), "tail")
    bullets = few.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", F.concat(F.lit("  • "), kg_text.triple_sentence(F.col("hn"), F.col("relation_type"), F.col("tn"))).alias("l")))), lambda x: x["l"]), "\n").alias("bullets"))
    rows = top.join(n_entities, "query_id", "left").join(n_relations, "query_id", "left").join(bullets, "query_id", "left")
    nr = F.coalesce("nr", F.lit(0))
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Retrieved "), F.lit(str(K)), F.lit(" relevant entities and their 2-hop subgraphs:")), F.lit(""), "seeds", F.lit(""), F.lit("Merged subgraph contains:"),
        F.concat(F.lit("  Total entities: "), F.coalesce("ne", F.lit(0)).cast("string")), F.concat(F.lit("  Total relations: "), nr.cast("string")), F.lit(""), F.lit("Key relationships:"), "bullets",
        F.when(nr > MOST_RELATIONS, F.concat(F.lit("  ... and "), (nr - MOST_RELATIONS).cast("string"), F.lit(" more relationships"))),
    )
    return rows.select("query_id", text.alias("knowledge"), "confidence")


def subgraph_retrieval(spark, d):
    """Expert 3 as one text per query of the stated set."""
    return _subgraphs(spark, d, queries_of(spark, d), index(spark, d).select("id", "v")).select("query_id", "knowledge")


MERGED = """hits AS (SELECT t.*, e.name, e.entity_type FROM top t JOIN kge e ON e.entity_id = t.id),
seeds AS (SELECT DISTINCT id AS entity_id FROM hits)"""
SUBGRAPH = f"""sized AS (SELECT s.entity_id AS centre, coalesce((SELECT count(DISTINCT x) FROM (SELECT unnest([head, tail]) AS x FROM edges WHERE centre = s.entity_id) WHERE x IN (SELECT entity_id FROM kge)), 0) AS ne, (SELECT count(*) FROM edges WHERE centre = s.entity_id) AS nr FROM seeds s),
alle AS (SELECT h.query_id, h.rank, e.* FROM hits h JOIN edges e ON e.centre = h.id),
merged AS (SELECT query_id, head, relation_type, tail, min((rank, hop, rn, rn2)) AS first FROM alle GROUP BY ALL),
tot AS (SELECT q.query_id, (SELECT count(*) FROM merged m WHERE m.query_id = q.query_id) AS nr, (SELECT count(DISTINCT x) FROM (SELECT unnest([head, tail]) AS x FROM alle a WHERE a.query_id = q.query_id UNION ALL SELECT id FROM hits h WHERE h.query_id = q.query_id) WHERE x IN (SELECT entity_id FROM kge)) AS ne FROM (SELECT DISTINCT query_id FROM hits) q),
few AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first, head, relation_type, tail) AS p FROM merged) WHERE p <= {MOST_RELATIONS})
SELECT t.query_id, concat_ws(chr(10), 'Retrieved {K} relevant entities and their 2-hop subgraphs:', '',
  (SELECT string_agg(rank || '. ' || name || ' (' || entity_type || ') [score: ' || printf('%.3f', round(score, 3)) || ', subgraph: ' || greatest(ne, 1) || ' entities, ' || nr || ' relations]', chr(10) ORDER BY rank) FROM hits h JOIN sized z ON z.centre = h.id WHERE h.query_id = t.query_id),
  '', 'Merged subgraph contains:', '  Total entities: ' || ne, '  Total relations: ' || nr, '', 'Key relationships:',
  (SELECT string_agg('  • ' || a.name || ' ' || {VERB.format(c='f.relation_type')} || ' ' || b.name, chr(10) ORDER BY p) FROM few f JOIN kge a ON a.entity_id = f.head JOIN kge b ON b.entity_id = f.tail WHERE f.query_id = t.query_id),
  CASE WHEN nr > {MOST_RELATIONS} THEN '  ... and ' || (nr - {MOST_RELATIONS}) || ' more relationships' END) AS knowledge FROM tot t"""


# --- expert 4: connected evidence


def _walk_graph(spark, d) -> tuple[DataFrame, DataFrame]:
    grp = kgq.seeds(spark, d).select(F.lit("all").alias("grp"), "entity_id")
    edges = kg.undirected(kg.breadth_first(grp, kgq.relations(spark, d)))
    return cut(edges), grp.select("grp", F.col("entity_id").alias("node"))


ROUNDS = 5


def ppr_fixed_iters(spark, d):
    """Personalized PageRank from the stated set over its breadth-first graph, a fixed number of rounds."""
    edges, seeds = _walk_graph(spark, d)
    out = graph.personalized_pagerank(edges, seeds, rounds=ROUNDS, tolerance=None)
    return out.select("node", F.round("score", 6).alias("score"))


def _ppr_sql() -> str:
    parts = [KGR, SEEDS, BFS, "pairs AS (SELECT DISTINCT least(head, tail) AS u, greatest(head, tail) AS v FROM bfs WHERE head <> tail)", "bo AS (SELECT u AS s, v AS t FROM pairs UNION ALL SELECT v, u FROM pairs)",
             "deg AS (SELECT s, count(*) AS deg FROM bo GROUP BY 1)", "nodes AS (SELECT s AS node FROM bo UNION SELECT entity_id FROM seeds)",
             "x0 AS (SELECT node, 1.0::double / (SELECT count(*) FROM nodes) AS score, CASE WHEN node IN (SELECT entity_id FROM seeds) THEN 1.0::double / (SELECT count(*) FROM seeds) ELSE 0.0::double END AS restart, node NOT IN (SELECT s FROM bo) AS dangling FROM nodes)"]
    for k in range(1, ROUNDS + 1):
        parts.append(f"""x{k} AS (SELECT n.node, 0.85::double * (coalesce(f.flow, 0.0::double) + (SELECT coalesce(sum(score) FILTER (dangling), 0.0::double) FROM x{k - 1}) * n.restart) + 0.15::double * n.restart AS score, n.restart, n.dangling
          FROM x{k - 1} n LEFT JOIN (SELECT bo.t AS node, sum(p.score / deg.deg) AS flow FROM bo JOIN x{k - 1} p ON p.node = bo.s JOIN deg ON deg.s = bo.s GROUP BY 1) f USING (node))""")
    return _with(*parts) + f"SELECT node, round(score, 6) AS score FROM x{ROUNDS}"


def _costed(spark, d) -> tuple[DataFrame, DataFrame]:
    """The walk graph with semantic costs: one less the similarity of the relation's words to the query 'recommend a film by its director'."""
    edges, seeds = _walk_graph(spark, d)
    types = edges.select("relation_type").distinct().withColumn("ask", F.lit("recommend a film by its director and genre"))
    types = types.select("relation_type", vector.hashed_words(kg_text.relation_phrase(F.col("relation_type"))).alias("v"), vector.hashed_words(F.col("ask")).alias("q"))
    cost = types.select("relation_type", F.round(1 - F.aggregate(F.zip_with("v", "q", lambda a, b: a * b), F.lit(0.0).cast("double"), lambda s, x: s + x), 6).alias("cost"))
    return cut(edges.join(cost, "relation_type").select("grp", "u", "v", "relation_type", "cost")), seeds


def mst_edges(spark, d):
    return graph.minimum_forest(_costed(spark, d)[0]).select("u", "v", "relation_type", "cost")


def mst_weight(spark, d):
    """Edges and total cost of the minimum spanning forest, against its vertices and components."""
    edges, _ = _costed(spark, d)
    return graph.minimum_forest(edges).agg(F.count(F.lit(1)).alias("n_edges"), F.round(F.sum("cost"), 4).alias("cost"))


def steiner_subtree(spark, d):
    edges, seeds = _costed(spark, d)
    return graph.steiner_subtree(graph.minimum_forest(edges), seeds).select("u", "v", "relation_type", "cost")


def _connected(spark, d, queries: DataFrame, entities: DataFrame, held: kgq.Graph | None = None) -> DataFrame:
    """Expert 4 for each of ``queries`` (query_id, v): its seeds among ``entities`` (id, v), their breadth-first graph with the query's own costs, the evidence subgraph as text.

    The query is the group of every graph operator. Graphs that are shown whole
    are not priced; their edges have the relevance 0.5.
    """
    queries = cut(queries.where("v is not null").select("query_id", "v"))
    hits = cut(vector.nearest(queries, entities, K))
    every, relations = kgq.graph_of(spark, d, held)
    known = cut(every.select("entity_id", "name", "entity_type"))
    edges = cut(kg.undirected(kg.breadth_first(hits.select(F.col("query_id").alias("grp"), F.col("id").alias("entity_id")), relations)))
    # seeds are in the graph as entities or as ends of edges
    ends = edges.select("grp", F.explode(F.array("u", "v")).alias("node")).distinct()
    found = hits.select(F.col("query_id").alias("grp"), F.col("id").alias("node"))
    stored = found.join(known.select(F.col("entity_id").alias("node")), "node", "left_semi").select("grp", "node")
    seeds = cut(stored.unionByName(found.join(ends, ["grp", "node"], "left_semi")).distinct())
    words = edges.select("relation_type").distinct().select("relation_type", vector.hashed_words(kg_text.relation_phrase(F.col("relation_type"))).alias("w"))
    asked = edges.select("grp", "relation_type").distinct().join(words, "relation_type").join(queries.select(F.col("query_id").alias("grp"), "v"), "grp")
    alike = F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.lit(0.0).cast("double"), lambda s, x: s + x)
    cost = asked.select("grp", "relation_type", F.round(1 - F.coalesce(alike, F.lit(0.0)), 6).alias("cost"))
    priced = cut(edges.join(cost, ["grp", "relation_type"]).select("grp", "u", "v", "relation_type", "cost"))
    ranks = cut(graph.pagerank_of_groups(priced, seeds))
    best = ranks.groupBy("grp").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.round("score", 12)).alias("s"), "node"))), 1, MOST_IMPORTANT).alias("b")).select("grp", F.explode("b.node").alias("node"))
    important = cut(best.unionByName(seeds).distinct())
    tree = cut(graph.connected_evidence(priced, important))
    # sizes: the whole graph, the ends of the kept edges, or the important vertices where no two are connected
    size = ranks.groupBy("grp").agg(F.count(F.lit(1)).alias("n_all")).join(important.groupBy("grp").agg(F.count(F.lit(1)).alias("n_important")), "grp")
    kept = tree.select("grp", F.explode(F.array("u", "v")).alias("node")).groupBy("grp").agg(F.count_distinct("node").alias("n_ends"), (F.count(F.lit(1)) / 2).cast("long").alias("n_edges"))
    whole = F.col("n_all") <= graph.SMALL_GRAPH
    size = size.join(kept, "grp", "left").select("grp", whole.alias("whole"), F.when(whole, F.col("n_all")).otherwise(F.coalesce("n_ends", "n_important")).alias("n_nodes"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"))
    named = tree.join(known.select(F.col("entity_id").alias("u"), F.col("name").alias("un")), "u").join(known.select(F.col("entity_id").alias("v"), F.col("name").alias("vn")), "v").join(size.select("grp", "whole"), "grp")
    line = F.struct((-F.when(F.col("whole"), 0.5).otherwise(1 - F.col("cost"))).alias("s"), kg_text.triple_plain(F.col("un"), F.col("relation_type"), F.col("vn")).alias("text"))
    bullet = lambda x: F.concat(F.lit("  • "), x["text"], F.lit(" [relevance: "), _fixed(-x["s"]), F.lit("]"))
    shown = named.groupBy("grp").agg(F.array_sort(F.collect_list(line)).alias("all")).select("grp", F.array_join(F.transform(F.slice("all", 1, MOST_EDGES), bullet), "\n").alias("bullets"), F.size("all").alias("n_shown"))
    origin = hits.withColumnRenamed("query_id", "grp").join(known.withColumnRenamed("entity_id", "id"), "id", "left").join(ranks.select("grp", F.col("node").alias("id"), F.col("score").alias("importance")), ["grp", "id"], "left")
    entry = F.concat(F.lit("  "), F.col("rank").cast("string"), F.lit(". "), "name", F.lit(" ("), "entity_type", F.lit(") [relevance: "), _fixed(F.col("score")), F.lit(", importance: "), F.format_string("%.4f", F.round(F.coalesce("importance", F.lit(0.0)), 4)), F.lit("]"))
    top = origin.groupBy("grp").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("rank", entry.alias("l"))))), lambda x: x["l"]), "\n").alias("seeds"), F.count(F.lit(1)).alias("k"), F.round(F.avg("score"), 6).alias("confidence"))
    rows = top.join(size, "grp", "left").join(shown, "grp", "left")
    text = F.concat_ws(
        "\n",
        F.lit("Connected subgraph analysis:"), F.lit(""), F.concat(F.lit("Seed entities ("), F.col("k").cast("string"), F.lit("):")), F.nullif(F.col("seeds"), F.lit("")), F.lit(""), F.lit("Connected graph statistics:"),
        F.concat(F.lit("  Nodes: "), F.coalesce("n_nodes", F.lit(0)).cast("string")), F.concat(F.lit("  Edges: "), F.coalesce("n_edges", F.lit(0)).cast("string")), F.lit(""), F.lit("Important relationships in connected graph:"), "bullets",
        F.when(F.col("n_shown") > MOST_EDGES, F.concat(F.lit("  ... and "), (F.col("n_shown") - MOST_EDGES).cast("string"), F.lit(" more relationships"))),
    )
    return rows.select(F.col("grp").alias("query_id"), text.alias("knowledge"), "confidence")


def connected_retrieval(spark, d):
    """Expert 4 as one text per query of the stated set, and the mean score of its seeds as confidence."""
    return _connected(spark, d, queries_of(spark, d), index(spark, d).select("id", "v"))


# --- the router


def direct_retrieval(spark, d):
    """Expert 1: no knowledge, full confidence."""
    return _asked(spark, d).select("query_id", F.lit("").alias("knowledge"), F.lit(1.0).alias("confidence"))


def expert_descriptors(spark, d):
    rows = [(1, "direct"), (2, "triple"), (3, "subgraph"), (4, "connected_graph")]
    return spark.createDataFrame(rows, "expert_id int, expert_name string")


def entity_vectors(spark, d, held: kgq.Graph | None = None) -> DataFrame:
    """(id, v): every entity, its description encoded like the stored queries; vectors of another model are not comparable."""
    text = kgq.entity_text(spark, d, held)
    return text.select(F.col("entity_id").alias("id"), vector.hashed_words(F.col("text")).alias("v")).where("v is not null")


EXPERTS = (1, 2, 3, 4)


def checked_expert(expert_id: int) -> int:
    """An expert's id, or an error naming the ids there are."""
    if expert_id not in EXPERTS:
        raise ValueError(f"no expert {expert_id!r}; there are {EXPERTS}")
    return expert_id


def entity_index_build(spark, d):
    """The index of all entities: the places of each encoded description that are not zero."""
    v = entity_vectors(spark, d).select("id", F.posexplode("v").alias("bucket", "x")).where("x > 0")
    return v.select("id", F.col("bucket").cast("long").alias("bucket"), F.round("x", 6).alias("x"))


def all_experts_union(spark, d):
    """Each stored query of the stated set through its own expert (1 or none: direct, 2 triples, 3 subgraphs, 4 connected graph).

    An id of no expert gives an empty result with an error instead of an answer.

    A document is a text that is not empty. A query without words finds nothing:
    no document, and no confidence unless it is direct.
    """
    routes = table(spark, d, "pipeline_result").select(F.col("result_id").cast("string").alias("query_id"), F.coalesce("selected_retriever_id", F.lit(1)).alias("expert_id"))
    asked = cut(_asked(spark, d).join(routes, "query_id").select("query_id", "expert_id", "v"))
    held = (cut(kgq.entities(spark, d)), cut(kgq.relations(spark, d)))  # made once for all experts
    entities = cut(entity_vectors(spark, d, held))
    of = lambda expert: asked.where(F.col("expert_id") == expert).select("query_id", "v")
    found = _triples(spark, d, of(2), held).unionByName(_subgraphs(spark, d, of(3), entities, held)).unionByName(_connected(spark, d, of(4), entities, held))
    direct = direct_retrieval(spark, d).join(asked.where("expert_id = 1").select("query_id"), "query_id", "left_semi")
    rows = asked.select("query_id", "expert_id").join(found.unionByName(direct), "query_id", "left")
    error = F.when(~F.col("expert_id").isin(*EXPERTS), F.concat(F.lit("no expert "), F.col("expert_id").cast("string")))
    return rows.select("query_id", "expert_id", F.coalesce(F.length("knowledge") > 0, F.lit(False)).cast("long").alias("n_documents"), F.when(error.isNotNull(), 0.0).otherwise(F.col("confidence")).alias("confidence"), error.alias("error"))


ETOP = f"""told AS (SELECT entity_id, {kgq._description()} AS text FROM kge), ev AS ({BAG.format(id='entity_id', text='text', src='told')}),
etop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT q.query_id, t.entity_id AS id, coalesce(s.score, 0.0::double) AS score FROM (SELECT DISTINCT id AS query_id FROM qv) q CROSS JOIN (SELECT DISTINCT id AS entity_id FROM ev) t
  LEFT JOIN (SELECT qv.id AS query_id, ev.id AS entity_id, round(sum(qv.x * ev.x), 6) AS score FROM qv JOIN ev USING (bucket) GROUP BY 1, 2) s USING (query_id, entity_id))) WHERE rank <= {K})"""
#: The undirected graph around the stated set with its costs, and its edges in their total order.
PRICED = """und AS (SELECT least(head, tail) AS u, greatest(head, tail) AS v, arg_max(relation_type, (round, head, relation_id)) AS relation_type FROM bfs WHERE head <> tail GROUP BY 1, 2),
types AS (SELECT DISTINCT relation_type, {phrase} AS words FROM und), ask AS (SELECT 1 AS one, 'recommend a film by its director and genre' AS words),
wt AS ({wt}), wa AS ({wa}), priced AS (SELECT t.relation_type, round(1 - coalesce(sum(wt.x * wa.x), 0.0::double), 6) AS cost FROM types t LEFT JOIN wt ON wt.id = t.relation_type LEFT JOIN wa USING (bucket) GROUP BY 1),
e AS (SELECT u, v, relation_type, cost, row_number() OVER (ORDER BY cost, u, v) AS r FROM und JOIN priced USING (relation_type)), ends AS (SELECT u AS a, v AS b, cost, r FROM e UNION ALL SELECT v, u, cost, r FROM e)""".format(phrase=PHRASE.format(c="relation_type"), wt=BAG.format(id="relation_type", text="words", src="types"), wa=BAG.format(id="one", text="words", src="ask"))
#: The weight of a minimum spanning forest from components: at each cost, the number of components that its edges join.
WEIGHT = """costs AS (SELECT DISTINCT cost AS c FROM e), nodes AS (SELECT DISTINCT a AS x FROM ends),
reach AS (SELECT c, x AS src, x AS node FROM costs, nodes UNION SELECT r.c, r.src, b.b FROM reach r JOIN ends b ON b.a = r.node AND b.cost <= r.c),
comp AS (SELECT c, count(*) FILTER (src = least) AS k FROM (SELECT c, src, min(node) AS least FROM reach GROUP BY 1, 2) GROUP BY 1),
won AS (SELECT c, lag(k, 1, (SELECT count(*) FROM nodes)) OVER (ORDER BY c) - k AS n FROM comp)
SELECT sum(n)::bigint AS n_edges, round(sum(n * c), 4) AS cost FROM won"""
#: An edge is in the forest where lesser edges do not connect its ends.
TREE = """below AS (SELECT r, u AS node FROM e UNION SELECT x.r, b.b FROM below x JOIN ends b ON b.a = x.node AND b.r < x.r),
tree AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM below x WHERE x.r = e.r AND x.node = e.v))"""
#: An edge of the forest is between asked vertices where both of the parts it joins hold one.
PATHS = """links AS (SELECT u AS a, v AS b, r FROM tree UNION ALL SELECT v, u, r FROM tree),
part AS (SELECT r, side, node FROM (SELECT r, 'u' AS side, u AS node FROM tree UNION ALL SELECT r, 'v', v FROM tree) UNION SELECT p.r, p.side, l.b FROM part p JOIN links l ON l.a = p.node AND l.r <> p.r),
held AS (SELECT r FROM part WHERE node IN (SELECT entity_id FROM seeds) GROUP BY r HAVING count(DISTINCT side) = 2)"""

QUERIES = {f.__name__: f for f in (
    vector_topk, labelled_topk, query_encoding, triple_topk, triple_retrieval, subgraph_retrieval, ppr_fixed_iters, mst_edges, mst_weight, steiner_subtree, connected_retrieval, direct_retrieval, expert_descriptors, entity_index_build, all_experts_union,
)}

SQL = {
    "vector_topk": _with(IDX, TOP) + "SELECT query_id, id, score, rank FROM top",
    "labelled_topk": """WITH e AS (SELECT vec_id, label, list_transform(x, lambda y: y / sqrt(list_sum(list_transform(x, lambda z: z * z)))) AS v FROM (SELECT vec_id, label, embedding::double[] AS x FROM embeddings)),
      t AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, id) AS r FROM (SELECT a.vec_id AS q, a.label AS la, b.vec_id::varchar AS id, b.label AS lb, round(list_inner_product(a.v, b.v), 6) AS s FROM e a, e b WHERE a.vec_id % 100 = 0))
      SELECT q::varchar AS query_id, count(*) FILTER (la = lb) AS n_same, count(*) AS n FROM t WHERE r <= 10 GROUP BY 1""",
    "query_encoding": _with(ASKED) + f"SELECT id AS query_id, bucket, round(x, 6) AS x FROM ({BAG.format(id='query_id', text='user_query', src='asked')})",
    "triple_topk": _with(KGE, KGR, NAMED, TRIPLES, ASKED, TTOP) + "SELECT query_id, id, score, rank FROM ttop",
    "triple_retrieval": _with(KGE, KGR, NAMED, TRIPLES, ASKED, TTOP) + """SELECT query_id, 'Retrieved factual triples:' || chr(10) || string_agg('• ' || shown || ' (score: ' || printf('%.3f', round(score, 3)) || ')', chr(10) ORDER BY rank) AS knowledge, round(avg(score), 6) AS confidence
      FROM ttop JOIN trip ON relation_id = id GROUP BY 1""",
    "subgraph_retrieval": _with(KGE, KGR, IDX, TOP, MERGED, RANKED, HOPS, SUBGRAPH),
    "ppr_fixed_iters": _ppr_sql(),
    "direct_retrieval": _with(ASKED) + "SELECT query_id, '' AS knowledge, 1.0::double AS confidence FROM asked",
    "expert_descriptors": "SELECT * FROM (VALUES (1::int, 'direct'), (2::int, 'triple'), (3::int, 'subgraph'), (4::int, 'connected_graph')) AS v(expert_id, expert_name)",
    "mst_weight": "WITH RECURSIVE " + ", ".join((KGR, SEEDS, BFS, PRICED, WEIGHT)),
    "mst_edges": "WITH RECURSIVE " + ", ".join((KGR, SEEDS, BFS, PRICED, TREE)) + " SELECT u, v, relation_type, cost FROM tree",
    "steiner_subtree": "WITH RECURSIVE " + ", ".join((KGR, SEEDS, BFS, PRICED, TREE, PATHS)) + " SELECT u, v, relation_type, cost FROM tree WHERE r IN (SELECT r FROM held)",
    "all_experts_union": _with(KGE, KGR, NAMED, TRIPLES, ASKED, TTOP, ETOP, "means AS (SELECT query_id, 2 AS kind, round(avg(score), 6) AS c FROM ttop GROUP BY 1 UNION ALL SELECT query_id, 3, round(avg(score), 6) FROM etop GROUP BY 1)") + """SELECT a.query_id, coalesce(p.selected_retriever_id, 1) AS expert_id, (c IS NOT NULL)::bigint AS n_documents,
      CASE WHEN coalesce(p.selected_retriever_id, 1) = 1 THEN 1.0::double WHEN p.selected_retriever_id NOT IN (2, 3, 4) THEN 0.0::double ELSE c END AS confidence, CASE WHEN p.selected_retriever_id NOT IN (1, 2, 3, 4) THEN 'no expert ' || p.selected_retriever_id END AS error
      FROM asked a JOIN pipeline_result p ON p.result_id::varchar = a.query_id LEFT JOIN means m ON m.query_id = a.query_id AND m.kind = CASE p.selected_retriever_id WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 3 END""",
    "entity_index_build": _with(KGE, f"told AS (SELECT entity_id, {kgq._description()} AS text FROM kge)") + f"SELECT id, bucket, round(x, 6) AS x FROM ({BAG.format(id='entity_id', text='text', src='told')})",
}
