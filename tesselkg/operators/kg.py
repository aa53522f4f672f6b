"""The knowledge graph as tables: keyed upserts, lookups, neighbourhoods, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselkg.functions.ids import canonical_id


def upsert(rows: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """The last row of each key by ``version``: a bulk insert-or-replace.

    Combined on the map side, so a key with very many versions does not gather.
    """
    rest = [c for c in rows.columns if c not in key]
    last = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*[F.col(f"`{c}`") for c in version]))
    return rows.groupBy(*key).agg(last.alias("_last")).select(*key, *[F.col(f"_last.`{c}`").alias(c) for c in rest])


def graph_entities(entities: DataFrame) -> DataFrame:
    """entity_id, entity_type, name, attributes, aliases of the newest row of each entity, with the defaults of an insert."""
    rows = entities.select(
        canonical_id(F.col("entity_id")).alias("entity_id"),
        F.coalesce(F.nullif(F.trim("entity_type"), F.lit("")), F.lit("Resource")).alias("entity_type"),
        F.nullif(F.col("name"), F.lit("")).alias("name"),
        F.coalesce("attributes", F.lit("{}")).alias("attributes"),
        F.coalesce("aliases", F.lit("[]")).alias("aliases"),
        "loaded_at",
        "row_id",
    ).where("entity_id is not null")
    last = upsert(rows, ["entity_id"], ["loaded_at", "row_id"])
    return last.select("entity_id", "entity_type", F.coalesce("name", "entity_id").alias("name"), "attributes", "aliases")


def graph_relations(relations: DataFrame) -> DataFrame:
    """relation_id, relation_type, head, tail, confidence of the newest row of each (head, type, tail); null ends are no relation."""
    rows = relations.select(
        canonical_id(F.col("head_entity_id")).alias("head"),
        "relation_type",
        canonical_id(F.col("tail_entity_id")).alias("tail"),
        F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
        "loaded_at",
        "row_id",
    ).where("head is not null and tail is not null and relation_type is not null")
    last = upsert(rows, ["head", "relation_type", "tail"], ["loaded_at", "row_id"])
    return last.select(F.concat_ws("_", "head", "relation_type", "tail").alias("relation_id"), "relation_type", "head", "tail", "confidence")


def neighbours(relations: DataFrame, ids: DataFrame, relation_type: str | None = None) -> DataFrame:
    """Out-edges of the given ids (column entity_id), head to tail only."""
    edges = relations if relation_type is None else relations.where(F.col("relation_type") == relation_type)
    wanted = ids.select(F.col("entity_id").alias("head")).distinct()
    return edges.join(wanted, "head", "left_semi").select(F.col("head").alias("entity_id"), F.col("tail").alias("neighbor_id"), "relation_type", "confidence")


def ranked_edges(relations: DataFrame, most: int) -> DataFrame:
    """The first ``most`` out-edges of each head, by relation id; Spark limits each head on the map side first."""
    order = Window.partitionBy("head").orderBy("relation_id")
    return relations.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most)


def two_hop(centres: DataFrame, relations: DataFrame, most: int) -> DataFrame:
    """Edges of the two-hop neighbourhood of each centre (column centre), with their hop; parallel first edges repeat the second hop.

    Only the out-edges of centres, then of their neighbours, are ranked; the rest
    of the graph is dropped by a semi-join before.
    """
    edges = relations.select("relation_id", "relation_type", "head", "tail", "confidence")
    asked = centres.select("centre").distinct()
    capped = ranked_edges(edges.join(asked.withColumnRenamed("centre", "head"), "head", "left_semi"), most)
    hop1 = asked.join(capped, F.col("centre") == F.col("head")).select("centre", F.lit(1).alias("hop"), "rn", F.lit(0).alias("rn2"), "head", "relation_type", "tail", "confidence")
    middle = hop1.select("centre", F.col("rn").alias("rn1"), F.col("tail").alias("via"))
    further = ranked_edges(edges.join(middle.select(F.col("via").alias("head")).distinct(), "head", "left_semi"), most)
    hop2 = middle.join(further, F.col("via") == F.col("head"))
    hop2 = hop2.select("centre", F.lit(2).alias("hop"), F.col("rn1").alias("rn"), F.col("rn").alias("rn2"), "head", "relation_type", "tail", "confidence")
    return hop1.unionByName(hop2)


def subgraph_sizes(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Per centre: the relations listed and the distinct entities that exist, the centre among them."""
    ends = edges.select("centre", F.explode(F.array("head", "tail")).alias("entity_id")).distinct()
    known = ends.join(entities.select("entity_id"), "entity_id", "left_semi").groupBy("centre").agg(F.count(F.lit(1)).alias("n_entities"))
    return edges.groupBy("centre").agg(F.count(F.lit(1)).alias("n_relations")).join(known, "centre", "left").select("centre", "n_relations", F.coalesce("n_entities", F.lit(0)).alias("n_entities"))


def merged_relations(edges: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """Relations of several subgraphs as one set per group; the first occurrence of (head, type, tail) holds."""
    first = F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("first")
    return edges.groupBy(group, "head", "relation_type", "tail").agg(first)


def breadth_first(seeds: DataFrame, relations: DataFrame, radius: int = 2) -> DataFrame:
    """Out-edges of every vertex first reached within ``radius`` - 1 steps of a group's seeds: (grp, head, relation_type, tail, round).

    The rounds are unrolled (radius is small); each expands only vertices not seen before.
    """
    frontier = seeds.select("grp", F.col("entity_id").alias("v")).distinct()
    seen, out = frontier, None
    edges = relations.select("head", "relation_type", "tail", "relation_id")
    for step in range(1, radius + 1):
        found = frontier.join(edges, F.col("v") == F.col("head")).select("grp", "head", "relation_type", "tail", "relation_id", F.lit(step).alias("round"))
        out = found if out is None else out.unionByName(found)
        frontier = found.select("grp", F.col("tail").alias("v")).distinct().join(seen, ["grp", "v"], "left_anti")
        seen = seen.unionByName(frontier)
    return out


def undirected(edges: DataFrame) -> DataFrame:
    """One edge per unordered pair and group, u < v; the relation found last (round, head, id) holds; self-loops are dropped."""
    pairs = edges.where("head != tail").select("grp", F.least("head", "tail").alias("u"), F.greatest("head", "tail").alias("v"), "relation_type", F.struct("round", "head", "relation_id").alias("at"))
    return pairs.groupBy("grp", "u", "v").agg(F.max_by("relation_type", "at").alias("relation_type"))
