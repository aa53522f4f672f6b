"""Queries over the knowledge graph: store, text, statistics, neighbourhoods, N-Triples, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselkg.functions import kg_text
from tesselkg.functions.ids import canonical_id, curie, local_id, short_predicate
from tesselkg.operators import kg
from tesselkg.plans.training_sql import PLAIN_ID, SHORT
from tesselkg.session import table
from tesselkg.sources import mapping, rdf

#: Neighbours per hop.
MOST_NEIGHBOURS = 20

# --- the graph of the tables


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kg.graph_entities(table(spark, sf_dir, "entities"))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kg.graph_relations(table(spark, sf_dir, "relations"))


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: entities with a row whose id is divisible by 100."""
    return table(spark, sf_dir, "entities").where(F.col("row_id") % 100 == 0).select(canonical_id(F.col("entity_id")).alias("entity_id")).where("entity_id is not null").distinct()


KGE = """kge AS (
  SELECT entity_id, coalesce(nullif(trim(entity_type), ''), 'Resource') AS entity_type, coalesce(nullif(name, ''), entity_id) AS name,
    coalesce(attributes, '{}') AS attributes, coalesce(aliases, '[]') AS aliases
  FROM entities QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY loaded_at DESC, row_id DESC) = 1)"""
KGR = f"""kgr AS (
  SELECT head || '_' || relation_type || '_' || tail AS relation_id, relation_type, head, tail, confidence FROM (
    SELECT {PLAIN_ID.format(c="head_entity_id")} AS head, relation_type, {PLAIN_ID.format(c="tail_entity_id")} AS tail, coalesce(confidence, 1.0) AS confidence, loaded_at, row_id FROM relations)
  WHERE head IS NOT NULL AND tail IS NOT NULL AND relation_type IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY head, relation_type, tail ORDER BY loaded_at DESC, row_id DESC) = 1)"""
SEEDS = f"""seeds AS (SELECT DISTINCT {PLAIN_ID.format(c="entity_id")} AS entity_id FROM entities WHERE row_id % 100 = 0)"""
PHRASE = r"lower(trim(regexp_replace(CASE WHEN {c} LIKE '%:%' THEN split_part({c}, ':', 2) ELSE {c} END, '([A-Z])', ' \1', 'g')))"
VERB = "CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in kg_text.TEMPLATES.items()) + " ELSE " + PHRASE + " END"


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


# --- store


def entity_upsert(spark, d):
    return entities(spark, d)


def relation_upsert(spark, d):
    return relations(spark, d)


def kg_stats_entities_by_type(spark, d):
    return entities(spark, d).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))


def kg_stats_totals(spark, d):
    e = entities(spark, d).agg(F.count(F.lit(1)).alias("n")).select(F.lit("entities").alias("what"), "n")
    return e.unionByName(relations(spark, d).agg(F.count(F.lit(1)).alias("n")).select(F.lit("relations").alias("what"), "n"))


def kg_stats_top_relations(spark, d):
    return relations(spark, d).groupBy("relation_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "relation_type").limit(20)


def entity_lookup(spark, d):
    """The entities of the stated set with their JSON decoded: number of attributes, aliases of a JSON list (others count as none)."""
    e = entities(spark, d).join(seeds(spark, d), "entity_id", "left_semi")
    aliases = F.coalesce(F.from_json("aliases", "array<string>"), F.array().cast("array<string>"))
    return e.select("entity_id", "entity_type", "name", F.coalesce(F.size(F.json_object_keys("attributes")).cast("long"), F.lit(0)).alias("n_attributes"), F.coalesce(F.size(aliases), F.lit(0)).cast("long").alias("n_aliases"), F.coalesce(F.get(aliases, F.lit(0)), F.lit("")).alias("first_alias"))


def neighbors(spark, d):
    return kg.neighbours(relations(spark, d), seeds(spark, d))


def neighbors_typed(spark, d):
    return kg.neighbours(relations(spark, d), seeds(spark, d), "dbo:starring")


def relation_semi_filter(spark, d):
    """Relations both of whose ends are entities."""
    e = entities(spark, d).select("entity_id")
    r = relations(spark, d)
    return r.join(e.withColumnRenamed("entity_id", "head"), "head", "left_semi").join(e.withColumnRenamed("entity_id", "tail"), "tail", "left_semi").select("relation_id", "confidence")


def unseen_tails_anti(spark, d):
    """Tails that are no entity."""
    return relations(spark, d).select("tail").distinct().join(entities(spark, d).select(F.col("entity_id").alias("tail")), "tail", "left_anti")


#: Entities and relations that were made once and are read several times.
Graph = tuple[DataFrame, DataFrame]


def graph_of(spark, d, held: Graph | None = None) -> Graph:
    """The graph that a query holds already, else that of the tables."""
    return held or (entities(spark, d), relations(spark, d))


def _named(spark, d, held: Graph | None = None):
    known, edges = graph_of(spark, d, held)
    e = known.select("entity_id", "entity_type", "name")
    head = e.select(F.col("entity_id").alias("head"), F.col("entity_type").alias("head_type"), F.col("name").alias("head_name"))
    tail = e.select(F.col("entity_id").alias("tail"), F.col("entity_type").alias("tail_type"), F.col("name").alias("tail_name"))
    return edges.join(head, "head").join(tail, "tail")


def triple_text_inner_join(spark, d):
    return _named(spark, d).select("relation_id", kg_text.triple_sentence(F.col("head_name"), F.col("relation_type"), F.col("tail_name")).alias("text"))


def triple_structured_text(spark, d):
    attrs = entities(spark, d).select(F.col("entity_id").alias("head"), F.from_json("attributes", "map<string,string>").alias("a"))
    rows = _named(spark, d).join(attrs, "head")
    text = kg_text.triple_structured(F.col("head_name"), F.col("relation_type"), F.col("tail_name"), F.col("head_type"), F.col("tail_type"), F.coalesce("a", F.create_map().cast("map<string,string>")))
    return rows.select("relation_id", text.alias("text"))


def relation_natural_language(spark, d):
    return relations(spark, d).select("relation_type").distinct().select("relation_type", kg_text.relation_phrase(F.col("relation_type")).alias("phrase"))


def entity_text(spark, d, held: Graph | None = None):
    e = graph_of(spark, d, held)[0].withColumn("a", F.coalesce(F.from_json("attributes", "map<string,string>"), F.create_map().cast("map<string,string>")))
    return e.select("entity_id", kg_text.entity_description(F.col("entity_type"), F.col("name"), F.col("a")).alias("text"))


def entity_short_text(spark, d):
    return entities(spark, d).select("entity_id", kg_text.entity_short(F.col("entity_type"), F.col("name")).alias("text"))


def uri_local_id(spark, d):
    return table(spark, d, "triples").select("subject").distinct().select("subject", local_id(F.col("subject")).alias("local_id"))


def predicate_curie(spark, d):
    return table(spark, d, "triples").select("predicate").distinct().select("predicate", curie(F.col("predicate")).alias("curie"))


def default_name(spark, d):
    """The name of an entity that has none: its id with blanks."""
    return relations(spark, d).select(F.col("tail").alias("entity_id")).distinct().select("entity_id", F.replace(F.col("entity_id"), F.lit("_"), F.lit(" ")).alias("name"))


def two_hop_subgraph(spark, d):
    centres = seeds(spark, d).join(entities(spark, d).select("entity_id"), "entity_id", "left_semi").select(F.col("entity_id").alias("centre"))
    return kg.two_hop(centres, relations(spark, d), MOST_NEIGHBOURS).select("centre", "hop", F.col("rn").cast("long").alias("rn"), F.col("rn2").cast("long").alias("rn2"), "head", "relation_type", "tail")


def two_hop_sizes(spark, d):
    edges = two_hop_subgraph(spark, d)
    return kg.subgraph_sizes(edges, entities(spark, d)).select("centre", "n_relations", "n_entities")


def bfs_radius2(spark, d):
    """All out-edges expanded within radius 2 of the stated set, as one group."""
    grp = seeds(spark, d).select(F.lit("all").alias("grp"), "entity_id")
    return kg.breadth_first(grp, relations(spark, d)).select("grp", "head", "relation_type", "tail", F.col("round").cast("long").alias("round"))


def bfs_undirected(spark, d):
    grp = seeds(spark, d).select(F.lit("all").alias("grp"), "entity_id")
    return kg.undirected(kg.breadth_first(grp, relations(spark, d)))


def subgraph_relation_groups(spark, d):
    """A subgraph as grouped text rows: per centre the first ten relation types, five sentences each."""
    edges = two_hop_subgraph(spark, d)
    e = entities(spark, d).select("entity_id", "name")
    rows = edges.join(e.select(F.col("entity_id").alias("head"), F.col("name").alias("hn")), "head").join(e.select(F.col("entity_id").alias("tail"), F.col("name").alias("tn")), "tail")
    rows = rows.select("centre", "relation_type", F.struct("hop", "rn", "rn2", "head", "tail").alias("o"), kg_text.triple_sentence(F.col("hn"), F.col("relation_type"), F.col("tn")).alias("text"))
    few = rows.groupBy("centre", "relation_type").agg(F.slice(F.array_sort(F.collect_list(F.struct("o", "text"))), 1, 5).alias("few"))
    types = few.groupBy("centre").agg(F.slice(F.array_sort(F.collect_list(F.struct("relation_type", "few"))), 1, 10).alias("types"))
    one = types.select("centre", F.posexplode("types").alias("p", "t")).select("centre", (F.col("p") + 1).cast("long").alias("type_rank"), F.col("t.relation_type").alias("relation_type"), F.posexplode("t.few").alias("q", "x"))
    return one.select("centre", "type_rank", "relation_type", (F.col("q") + 1).cast("long").alias("line"), F.col("x.text").alias("text"))


def subgraph_entities_by_type(spark, d):
    """The entities of each centre's two-hop subgraph by type: the first ten names, and how many more."""
    ends = two_hop_subgraph(spark, d).select("centre", F.explode(F.array("head", "tail")).alias("entity_id")).distinct()
    rows = ends.join(entities(spark, d).select("entity_id", "entity_type", "name"), "entity_id")
    order = F.row_number().over(Window.partitionBy("centre", "entity_type").orderBy("entity_id"))
    few = rows.withColumn("k", order).groupBy("centre", "entity_type").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= 10, F.struct("k", "name")))), lambda x: x["name"]), ", ").alias("names"), F.greatest(F.count(F.lit(1)) - 10, F.lit(0)).alias("more")
    )
    return few.select("centre", "entity_type", "names", "more")


def seeds_in_subgraph(spark, d):
    """Whether every entity of the stated set is a vertex of the graph around the set: the missing ones by anti-join."""
    nodes = bfs_undirected(spark, d).select(F.explode(F.array("u", "v")).alias("entity_id")).distinct()
    return seeds(spark, d).join(nodes, "entity_id", "left_anti").agg(F.count(F.lit(1)).alias("n_missing"), (F.count(F.lit(1)) == 0).alias("subset"))


# --- dumps


def _lines(spark, d):
    """The triples as N-Triples lines, each statement twice removed from its table: what a dump would hold, with comments and a broken line."""
    t = table(spark, d, "triples").where("obj is not null and subject is not null and predicate is not null")
    uri = lambda c: F.when(F.startswith(F.trim(c), F.lit("http")), F.trim(c)).otherwise(F.concat(F.lit("http://kg.example/resource/"), F.trim(c)))
    escaped = F.replace(F.replace(F.replace(F.col("obj"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    obj = F.when(F.col("obj_type") == "uri", F.concat(F.lit("<"), F.col("obj"), F.lit(">"))).otherwise(F.concat(F.lit('"'), escaped, F.lit('"@en')))
    line = F.concat(F.lit("<"), uri(F.col("subject")), F.lit("> <"), F.trim("predicate"), F.lit("> "), obj, F.lit(" ."))
    head = spark.createDataFrame([(-1, "# comment"), (-2, ""), (-3, "@prefix x: <y> ."), (-4, "not a statement")], "row_id long, value string")
    return t.select("row_id", line.alias("value")).unionByName(head)


LINES = r"""lines AS (
  SELECT row_id, '<' || CASE WHEN trim(subject) LIKE 'http%' THEN trim(subject) ELSE 'http://kg.example/resource/' || trim(subject) END || '> <' || trim(predicate) || '> ' ||
    CASE WHEN obj_type = 'uri' THEN '<' || obj || '>' ELSE '"' || replace(replace(replace(obj, '\', '\\'), '"', '\"'), chr(10), '\n') || '"@en' END || ' .' AS value
  FROM triples WHERE obj IS NOT NULL AND subject IS NOT NULL AND predicate IS NOT NULL
  UNION ALL SELECT * FROM (VALUES (-1, '# comment'), (-2, ''), (-3, '@prefix x: <y> .'), (-4, 'not a statement')) AS v(row_id, value))"""


def ntriples_parse(spark, d):
    return rdf.parse_lines(_lines(spark, d), keep=["row_id"]).where("ok").select("row_id", "subject", "predicate", "object", "object_type")


def ntriples_error_count(spark, d):
    return rdf.parse_lines(_lines(spark, d), keep=["row_id"]).agg(F.count_if("ok").alias("n_statements"), F.count_if(~F.col("ok")).alias("n_errors"))


def ntriples_of_seeds(spark, d):
    """The dump read for the stated subjects only: a semi-join right after the subject is known."""
    wanted = seeds(spark, d).select(F.concat(F.lit("http://kg.example/resource/"), F.col("entity_id")).alias("subject"))
    return rdf.parse_lines(_lines(spark, d), keep=["row_id"], subjects=wanted).where("ok").select("row_id", "subject", "object")


def extract_routed(spark, d):
    """Dump statements routed by predicate: label to the name, abstract and literals to attributes, resources to relations, types to the type."""
    return rdf.route(_quads(spark, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def _quads(spark, d):
    t = table(spark, d, "triples").where("obj is not null")
    return t.select(canonical_id(F.col("subject")).alias("entity_id"), short_predicate(F.col("predicate")).alias("property"), F.trim("predicate").alias("predicate"), F.col("obj").alias("object"), F.col("obj_type").alias("object_type"), F.struct("loaded_at", "row_id").alias("seq"))


QUADS = rf"""quads AS (
  SELECT {PLAIN_ID.format(c="subject")} AS entity_id, {SHORT.format(c="predicate")} AS property, trim(predicate) AS predicate, obj AS object, obj_type AS object_type, loaded_at, row_id
  FROM triples WHERE obj IS NOT NULL),
routed AS (SELECT *, CASE WHEN object_type = 'literal' AND lower(predicate) LIKE '%label%' THEN 'name' WHEN object_type = 'literal' AND lower(predicate) LIKE '%abstract%' THEN 'abstract'
  WHEN object_type = 'literal' THEN 'attribute' WHEN lower(predicate) LIKE '%type%' THEN 'type' WHEN object LIKE 'http://kg.example/resource/%' THEN 'relation' ELSE 'dropped' END AS kind FROM quads)"""


def extract_entities(spark, d):
    """The entities that the dump describes: newest name, type by its class, number of distinct attributes."""
    return rdf.fold_entities(rdf.route(_quads(spark, d))).select("entity_id", "name", "entity_type", "n_attributes")


def extract_relations(spark, d):
    """Relations of the dump as a set."""
    r = rdf.route(_quads(spark, d)).where("kind = 'relation'")
    return r.select(F.col("entity_id").alias("head"), F.col("property").alias("relation_type"), canonical_id(F.col("object")).alias("tail")).distinct()


def extract_khop(spark, d):
    """The offline extraction: entities of the stated set, their tails, and up to a bounded number of the tails' tails, by hop."""
    return rdf.hops(seeds(spark, d), extract_relations(spark, d), most_last=10_000).groupBy("hop").agg(F.count(F.lit(1)).alias("n"))


def extract_by_hop(spark, d):
    """The offline extraction with each hop's own routing: name, type and number of attributes of the entities described."""
    reached = rdf.hops(seeds(spark, d), extract_relations(spark, d), most_last=10_000)
    return rdf.entities_by_hop(rdf.route(_quads(spark, d)), reached)


def extract_attributes(spark, d):
    """The attribute map of each dump entity, one row per key: the last value, abstracts cut."""
    rows = rdf.attribute_map(rdf.route(_quads(spark, d)))
    return rows.select("entity_id", F.explode("attributes").alias("k", "v"))


def mapping_scan(spark, d):
    lines = table(spark, d, "entities").select(F.col("row_id").alias("line_no"), F.concat_ws(",", F.col("row_id").cast("string"), F.concat(F.when(F.col("source") == "legacy_csv", F.lit("")).otherwise(F.lit("http://kg.example/resource/")), F.col("entity_id"))).alias("value"))
    return mapping.parse_mapping(lines, "item_id::string,URI::string", delimiter=",")


QUERIES = {f.__name__: f for f in (
    entity_upsert, relation_upsert, kg_stats_entities_by_type, kg_stats_totals, kg_stats_top_relations, entity_lookup, neighbors, neighbors_typed, relation_semi_filter, unseen_tails_anti,
    triple_text_inner_join, triple_structured_text, relation_natural_language, entity_text, entity_short_text, uri_local_id, predicate_curie, default_name, two_hop_subgraph, two_hop_sizes,
    bfs_radius2, bfs_undirected, subgraph_relation_groups, ntriples_parse, ntriples_error_count, ntriples_of_seeds, extract_routed, extract_entities, extract_relations, extract_khop, extract_by_hop, extract_attributes, subgraph_entities_by_type, seeds_in_subgraph, mapping_scan,
)}

RANKED = f"ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY head ORDER BY relation_id) AS rn FROM kgr) WHERE rn <= {MOST_NEIGHBOURS})"
HOPS = """hop1 AS (SELECT s.entity_id AS centre, 1 AS hop, r.rn, 0 AS rn2, r.head, r.relation_type, r.tail FROM seeds s JOIN kge e USING (entity_id) JOIN ranked r ON r.head = s.entity_id),
edges AS (SELECT * FROM hop1 UNION ALL SELECT a.centre, 2, a.rn, r.rn, r.head, r.relation_type, r.tail FROM hop1 a JOIN ranked r ON r.head = a.tail)"""
BFS = """e1 AS (SELECT 'all' AS grp, r.head, r.relation_type, r.tail, r.relation_id, 1 AS round FROM seeds s JOIN kgr r ON r.head = s.entity_id),
f1 AS (SELECT DISTINCT tail AS v FROM e1 WHERE tail NOT IN (SELECT entity_id FROM seeds)),
bfs AS (SELECT * FROM e1 UNION ALL SELECT 'all', r.head, r.relation_type, r.tail, r.relation_id, 2 FROM f1 JOIN kgr r ON r.head = f1.v)"""
NAMED = "named AS (SELECT r.*, h.name AS head_name, h.entity_type AS head_type, h.attributes AS head_attributes, t.name AS tail_name, t.entity_type AS tail_type FROM kgr r JOIN kge h ON h.entity_id = r.head JOIN kge t ON t.entity_id = r.tail)"
ATTR = "CASE WHEN json_valid({a}) THEN {a} ->> '$.\"{k}\"' END"
CUT = "CASE WHEN length({t}) > {n} THEN left({t}, {n}) || '...' ELSE {t} END"


def _description() -> str:
    c = ATTR.format(a="attributes", k="rdfs:comment")
    parts = " ".join(f"WHEN {ATTR.format(a='attributes', k=k)} IS NOT NULL THEN '{k}: ' || {CUT.format(t=ATTR.format(a='attributes', k=k), n=150)}" for k in ("dbo:abstract", "abstract", "description"))
    return f"concat_ws('. ', entity_type || ': ' || name, 'Description: ' || {CUT.format(t=c, n=200)}, CASE {parts} END)"


BARE = r"regexp_extract({c}, '^\s*<?\s*(.*?)\s*>?\s*$', 1)"
REL = f"rel AS (SELECT DISTINCT entity_id AS head, {PLAIN_ID.format(c='object')} AS tail FROM routed WHERE kind = 'relation')"
REACHED = """h1 AS (SELECT DISTINCT tail AS v FROM rel WHERE head IN (SELECT entity_id FROM seeds) AND tail NOT IN (SELECT entity_id FROM seeds)),
h2 AS (SELECT DISTINCT tail AS v FROM rel WHERE head IN (SELECT v FROM h1) AND tail NOT IN (SELECT v FROM h1) AND tail NOT IN (SELECT entity_id FROM seeds) ORDER BY 1 LIMIT 10000),
reached AS (SELECT entity_id, 0 AS hop FROM seeds UNION ALL SELECT v, 1 FROM h1 UNION ALL SELECT v, 2 FROM h2)"""


def _hop_types(rules: tuple) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(object, '{m}')" for m in marks) + f" THEN '{name}'" for name, marks in rules) + " END" if rules else "NULL"


BY_HOP = " UNION ALL ".join(
    f"""SELECT entity_id, coalesce(arg_max(object, (loaded_at, row_id)) FILTER (kind = 'name'), replace(entity_id, '_', ' ')) AS name,
  coalesce(arg_max(t, (loaded_at, row_id)) FILTER (kind = 'type' AND t IS NOT NULL), '{default}') AS entity_type, count(DISTINCT property) FILTER (kind IN ('attribute', 'abstract')) AS n_attributes, {hop}::bigint AS hop
  FROM (SELECT *, {_hop_types(rules)} AS t FROM routed WHERE kind IN ({", ".join(f"'{k}'" for k in kinds)}) AND entity_id IN (SELECT entity_id FROM reached WHERE hop = {hop})) GROUP BY 1"""
    for hop, default, kinds, rules in rdf.HOPS
)

STATEMENT = r'^<([^>]*)>\s+<([^>]*)>\s+(<[^>]*>|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^\S+)?)\s*\.\s*$'

SQL = {
    "entity_upsert": _with(KGE) + "SELECT * FROM kge",
    "relation_upsert": _with(KGR) + "SELECT * FROM kgr",
    "kg_stats_entities_by_type": _with(KGE) + "SELECT entity_type, count(*) AS n FROM kge GROUP BY 1",
    "kg_stats_totals": _with(KGE, KGR) + "SELECT 'entities' AS what, count(*) AS n FROM kge UNION ALL SELECT 'relations', count(*) FROM kgr",
    "kg_stats_top_relations": _with(KGR) + "SELECT relation_type, count(*) AS n FROM kgr GROUP BY 1 ORDER BY n DESC, relation_type LIMIT 20",
    "entity_lookup": _with(KGE, SEEDS) + """SELECT entity_id, entity_type, name, CASE WHEN json_valid(attributes) THEN len(json_keys(attributes)) ELSE 0 END::bigint AS n_attributes, coalesce(json_array_length(a), 0)::bigint AS n_aliases, coalesce(a ->> '$[0]', '') AS first_alias
      FROM (SELECT *, CASE WHEN json_valid(aliases) AND ltrim(aliases) LIKE '[%' THEN aliases END AS a FROM kge) WHERE entity_id IN (SELECT entity_id FROM seeds)""",
    "neighbors": _with(KGR, SEEDS) + "SELECT head AS entity_id, tail AS neighbor_id, relation_type, confidence FROM kgr WHERE head IN (SELECT entity_id FROM seeds)",
    "neighbors_typed": _with(KGR, SEEDS) + "SELECT head AS entity_id, tail AS neighbor_id, relation_type, confidence FROM kgr WHERE head IN (SELECT entity_id FROM seeds) AND relation_type = 'dbo:starring'",
    "relation_semi_filter": _with(KGE, KGR) + "SELECT relation_id, confidence FROM kgr WHERE head IN (SELECT entity_id FROM kge) AND tail IN (SELECT entity_id FROM kge)",
    "unseen_tails_anti": _with(KGE, KGR) + "SELECT DISTINCT tail FROM kgr WHERE tail NOT IN (SELECT entity_id FROM kge)",
    "triple_text_inner_join": _with(KGE, KGR, NAMED) + f"SELECT relation_id, head_name || ' ' || {VERB.format(c='relation_type')} || ' ' || tail_name AS text FROM named",
    "triple_structured_text": _with(KGE, KGR, NAMED) + f"""SELECT relation_id, head_name || ' ' || {VERB.format(c='relation_type')} || ' ' || tail_name || ' [' || head_type || ' -> ' || tail_type || ']' ||
      coalesce(' Context: ' || left({ATTR.format(a='head_attributes', k='rdfs:comment')}, 100) || '...', '') AS text FROM named""",
    "relation_natural_language": _with(KGR) + f"SELECT DISTINCT relation_type, {PHRASE.format(c='relation_type')} AS phrase FROM kgr",
    "entity_text": _with(KGE) + f"SELECT entity_id, {_description()} AS text FROM kge",
    "entity_short_text": _with(KGE) + "SELECT entity_id, entity_type || ': ' || name AS text FROM kge",
    "uri_local_id": f"""SELECT DISTINCT subject, CASE WHEN b LIKE 'http://kg.example/resource/%' OR NOT contains(b, '://') THEN {PLAIN_ID.format(c='subject')} WHEN b LIKE 'http://kg.example/property/%' THEN replace(b, 'http://kg.example/property/', '')
      WHEN b LIKE 'http://kg.example/ontology/%' THEN replace(b, 'http://kg.example/ontology/', '') ELSE string_split(b, '/')[-1] END AS local_id FROM (SELECT subject, {BARE.format(c='subject')} AS b FROM triples)""",
    "predicate_curie": f"""SELECT DISTINCT predicate, trim(CASE WHEN b LIKE 'http://kg.example/ontology/%' THEN replace(b, 'http://kg.example/ontology/', 'dbo:') WHEN b LIKE 'http://kg.example/property/%' THEN replace(b, 'http://kg.example/property/', 'dbp:')
      WHEN b LIKE 'http://www.w3.org/1999/02/22-rdf-syntax-ns#%' THEN replace(b, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#', 'rdf:') WHEN b LIKE 'http://www.w3.org/2000/01/rdf-schema#%' THEN replace(b, 'http://www.w3.org/2000/01/rdf-schema#', 'rdfs:') ELSE string_split(b, '/')[-1] END) AS curie
      FROM (SELECT predicate, {BARE.format(c='predicate')} AS b FROM triples)""",
    "default_name": _with(KGR) + "SELECT DISTINCT tail AS entity_id, replace(tail, '_', ' ') AS name FROM kgr",
    "two_hop_subgraph": _with(KGE, KGR, SEEDS, RANKED, HOPS) + "SELECT * FROM edges",
    "two_hop_sizes": _with(KGE, KGR, SEEDS, RANKED, HOPS) + """SELECT r.centre, r.n_relations, coalesce(e.n_entities, 0) AS n_entities FROM (SELECT centre, count(*) AS n_relations FROM edges GROUP BY 1) r
      LEFT JOIN (SELECT centre, count(DISTINCT x) AS n_entities FROM (SELECT centre, unnest([head, tail]) AS x FROM edges) WHERE x IN (SELECT entity_id FROM kge) GROUP BY 1) e USING (centre)""",
    "bfs_radius2": _with(KGR, SEEDS, BFS) + "SELECT grp, head, relation_type, tail, round::bigint AS round FROM bfs",
    "bfs_undirected": _with(KGR, SEEDS, BFS) + """SELECT grp, least(head, tail) AS u, greatest(head, tail) AS v, arg_max(relation_type, (round, head, relation_id)) AS relation_type FROM bfs WHERE head <> tail GROUP BY 1, 2, 3""",
    "subgraph_relation_groups": _with(KGE, KGR, SEEDS, RANKED, HOPS) + f"""SELECT centre, type_rank, relation_type, line, text FROM (
      SELECT centre, relation_type, dense_rank() OVER (PARTITION BY centre ORDER BY relation_type) AS type_rank, row_number() OVER (PARTITION BY centre, relation_type ORDER BY hop, rn, rn2, head, tail) AS line,
        h.name || ' ' || {VERB.format(c='relation_type')} || ' ' || t.name AS text FROM edges JOIN kge h ON h.entity_id = head JOIN kge t ON t.entity_id = tail) WHERE type_rank <= 10 AND line <= 5""",
    "ntriples_parse": _with(LINES) + rf"""SELECT row_id, s AS subject, p AS predicate, CASE WHEN o LIKE '<%' THEN o[2:-2] ELSE
        replace(replace(replace(replace(replace(regexp_extract(o, '(?s)^"(.*)"', 1), '\\', chr(1)), '\n', chr(10)), '\t', chr(9)), '\"', '"'), chr(1), '\') END AS object,
      CASE WHEN o LIKE '<%' THEN 'uri' ELSE 'literal' END AS object_type
      FROM (SELECT row_id, regexp_extract(value, '(?s){STATEMENT}', 1) AS s, regexp_extract(value, '(?s){STATEMENT}', 2) AS p, regexp_extract(value, '(?s){STATEMENT}', 3) AS o
        FROM lines WHERE regexp_matches(value, '(?s){STATEMENT}'))""",
    "ntriples_error_count": _with(LINES) + rf"""SELECT count(*) FILTER (regexp_matches(value, '(?s){STATEMENT}')) AS n_statements, count(*) FILTER (NOT regexp_matches(value, '(?s){STATEMENT}')) AS n_errors
      FROM lines WHERE trim(value) <> '' AND value[1] NOT IN ('#', '@')""",
    "ntriples_of_seeds": _with(LINES, SEEDS) + rf"""SELECT row_id, regexp_extract(value, '(?s){STATEMENT}', 1) AS subject, CASE WHEN regexp_extract(value, '(?s){STATEMENT}', 3) LIKE '<%' THEN regexp_extract(value, '(?s){STATEMENT}', 3)[2:-2] ELSE
        replace(replace(replace(replace(replace(regexp_extract(regexp_extract(value, '(?s){STATEMENT}', 3), '(?s)^"(.*)"', 1), '\\', chr(1)), '\n', chr(10)), '\t', chr(9)), '\"', '"'), chr(1), '\') END AS object
      FROM lines WHERE regexp_matches(value, '(?s){STATEMENT}') AND regexp_extract(value, '(?s){STATEMENT}', 1) IN (SELECT 'http://kg.example/resource/' || entity_id FROM seeds)""",
    "extract_routed": _with(QUADS) + "SELECT kind, count(*) AS n FROM routed GROUP BY 1",
    "extract_entities": _with(QUADS) + """SELECT entity_id, coalesce(arg_max(object, (loaded_at, row_id)) FILTER (kind = 'name'), replace(entity_id, '_', ' ')) AS name,
      coalesce(arg_max(CASE WHEN object LIKE '%Person%' OR object LIKE '%Artist%' THEN 'Person' WHEN object LIKE '%Genre%' THEN 'Genre' WHEN object LIKE '%Company%' OR object LIKE '%Organi_ation%' THEN 'Organization' WHEN object LIKE '%Place%' OR object LIKE '%Location%' THEN 'Place' END, (loaded_at, row_id))
        FILTER (kind = 'type' AND (object LIKE '%Person%' OR object LIKE '%Artist%' OR object LIKE '%Genre%' OR object LIKE '%Company%' OR object LIKE '%Organi_ation%' OR object LIKE '%Place%' OR object LIKE '%Location%')), 'Movie') AS entity_type,
      count(DISTINCT property) FILTER (kind IN ('attribute', 'abstract')) AS n_attributes FROM routed GROUP BY 1""",
    "extract_relations": _with(QUADS) + f"SELECT DISTINCT entity_id AS head, property AS relation_type, {PLAIN_ID.format(c='object')} AS tail FROM routed WHERE kind = 'relation'",
    "extract_khop": _with(QUADS, SEEDS, f"rel AS (SELECT DISTINCT entity_id AS head, {PLAIN_ID.format(c='object')} AS tail FROM routed WHERE kind = 'relation')") + """,
      h1 AS (SELECT DISTINCT tail AS v FROM rel WHERE head IN (SELECT entity_id FROM seeds) AND tail NOT IN (SELECT entity_id FROM seeds)),
      h2 AS (SELECT DISTINCT tail AS v FROM rel WHERE head IN (SELECT v FROM h1) AND tail NOT IN (SELECT v FROM h1) AND tail NOT IN (SELECT entity_id FROM seeds) ORDER BY 1 LIMIT 10000)
      SELECT 0 AS hop, count(*) AS n FROM seeds UNION ALL SELECT 1, count(*) FROM h1 HAVING count(*) > 0 UNION ALL SELECT 2, count(*) FROM h2 HAVING count(*) > 0""",
    "extract_by_hop": _with(QUADS, SEEDS, REL, REACHED) + BY_HOP,
    "extract_attributes": _with(QUADS) + """SELECT entity_id, k, arg_max(v, (loaded_at, row_id)) AS v FROM (
      SELECT entity_id, loaded_at, row_id, CASE kind WHEN 'abstract' THEN 'abstract' ELSE property END AS k, CASE kind WHEN 'abstract' THEN left(object, 500) ELSE object END AS v FROM routed WHERE kind IN ('attribute', 'abstract')) GROUP BY 1, 2""",
    "subgraph_entities_by_type": _with(KGE, KGR, SEEDS, RANKED, HOPS) + """SELECT centre, entity_type, string_agg(name, ', ' ORDER BY k) FILTER (k <= 10) AS names, greatest(count(*) - 10, 0) AS more FROM (
      SELECT *, row_number() OVER (PARTITION BY centre, entity_type ORDER BY entity_id) AS k FROM (SELECT DISTINCT centre, unnest([head, tail]) AS entity_id FROM edges) JOIN kge USING (entity_id)) GROUP BY 1, 2""",
    "seeds_in_subgraph": _with(KGR, SEEDS, BFS) + """SELECT count(*) AS n_missing, count(*) = 0 AS subset FROM seeds WHERE entity_id NOT IN (SELECT head FROM bfs WHERE head <> tail UNION SELECT tail FROM bfs WHERE head <> tail)""",
    "mapping_scan": """SELECT row_id::varchar AS item_id, 'http://kg.example/resource/' || entity_id AS uri FROM entities WHERE source <> 'legacy_csv' AND entity_id NOT LIKE '%,%'
      UNION ALL SELECT row_id::varchar, split_part('http://kg.example/resource/' || entity_id, ',', 1) FROM entities WHERE source <> 'legacy_csv' AND entity_id LIKE '%,%'""",
}
