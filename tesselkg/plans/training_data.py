"""Queries of the general training-data operators (wide tables, skewed keys, packed lists, orphans)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselkg.functions.ids import canonical_id, short_predicate
from tesselkg.operators import eager_join, orphans, packed, wide
from tesselkg.session import table

RELATION_FIELDS = ("relation_type", "head_entity_id", "tail_entity_id")


# --- problem 2: attribute-value rows into a wide table


def all_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of triples and pairs of entities.attributes in one shape; invalid JSON gives nothing."""
    triples = table(spark, sf_dir, "triples")
    entities = table(spark, sf_dir, "entities")
    stated = wide.statements(triples, canonical_id(F.col("subject")), short_predicate(F.col("predicate")), F.col("obj"), F.col("loaded_at"), 1, F.col("row_id"))
    whole = F.when(F.json_object_keys("attributes").isNotNull(), F.from_json("attributes", "map<string,string>"))
    pairs = entities.select("entity_id", "loaded_at", "row_id", F.explode(whole).alias("k", "v"))
    held = wide.statements(pairs, canonical_id(F.col("entity_id")), short_predicate(F.col("k")), F.col("v"), F.col("loaded_at"), 0, F.col("row_id"))
    return stated.unionByName(held)


def _wide(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[tuple[str, str]]]:
    return wide.wide_table(all_statements(spark, sf_dir), table(spark, sf_dir, "attribute_columns"))


def p2_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per entity, cells in canonical text form."""
    return _wide(spark, sf_dir)[0]


def p2_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table with the columns' types."""
    return wide.typed(*_wide(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, attrs = _wide(spark, sf_dir)
    return wide.unpivot(wide.typed(cells, attrs), attrs)


def p2_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attribute list: the type that holds, the one the values show, values known and readable."""
    columns = table(spark, sf_dir, "attribute_columns")
    return wide.reconciled(wide.mapped_cells(all_statements(spark, sf_dir), columns), columns)


def p2_discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attribute list with the types the data themselves show."""
    return wide.discover_attributes(all_statements(spark, sf_dir), "predicate", "text")


# --- problem 5: a few keys holding most records


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eager_join.hot_keys(table(spark, sf_dir, "relations"), RELATION_FIELDS, 0.02).select("field_name", "hot_key")


def p5_key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per value of each key field."""
    return eager_join.key_states(table(spark, sf_dir, "relations"), RELATION_FIELDS).select("field_name", "key", "n")


def p5_join_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """relations joined to entities by tail, per relation and entity type: pairs and confidence, without joining rows."""
    out = eager_join.eager_join_aggregate(
        table(spark, sf_dir, "relations"),
        table(spark, sf_dir, "entities"),
        canonical_id(F.col("tail_entity_id")),
        canonical_id(F.col("entity_id")),
        ["relation_type"],
        ["entity_type"],
        ["confidence"],
    )
    return out.select("relation_type", "entity_type", "pairs", F.round("sum_confidence", 3).alias("sum_confidence"), "n_confidence")


def p5_path_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-step paths through each middle entity per pair of relation types (one tail holds a tenth of the rows)."""
    return eager_join.path_counts(table(spark, sf_dir, "relations"), canonical_id(F.col("head_entity_id")), canonical_id(F.col("tail_entity_id")), "relation_type")


# --- problem 6: several values packed in one field


def _packed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, results = table(spark, sf_dir, "entities"), table(spark, sf_dir, "pipeline_result")
    aliases = entities.select(F.lit("aliases").alias("field_name"), F.lit("alias").alias("family"), "row_id", F.lit("list").alias("kind"), F.col("aliases").alias("text"))

    def parts(batches):
        for b in batches:
            both = [packed.prompt_lists(t) for t in b["user_query"]]
            for k, (name, kind) in enumerate((("history", "list"), ("options", "options"))):
                out = b[["result_id"]].rename(columns={"result_id": "row_id"})
                yield out.assign(field_name=name, family="title", kind=kind, text=[x[k] for x in both])[["field_name", "family", "row_id", "kind", "text"]]

    prompts = results.select("result_id", "user_query").mapInPandas(parts, "field_name string, family string, row_id long, kind string, text string")
    return aliases.unionByName(prompts)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.split_packed(_packed_fields(spark, sf_dir))


def p6_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each title occurs in the histories and options of all stored queries."""
    return p6_found(spark, sf_dir).where("field_name != 'aliases'").groupBy("field_name", "val").agg(F.count(F.lit(1)).alias("n"))


# --- problem 7: references to records that do not exist


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda s: F.struct(F.lit(s).alias("side"), canonical_id(F.col(f"{s}_entity_id")).alias("id"))
    rel = table(spark, sf_dir, "relations").select("row_id", F.col("loaded_at").alias("at"), F.explode(F.array(side("head"), side("tail"))).alias("ref"))
    return rel.select("row_id", "at", "ref.side", "ref.id")


def p7_probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_references(
        _references(spark, sf_dir),
        table(spark, sf_dir, "entities"),
        parent_key=canonical_id(F.col("entity_id")),
        since=F.col("loaded_at"),
        until=F.col("deleted_at"),
    )


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_probed(spark, sf_dir).where("reason != ''").select("row_id", "side")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_report(p7_probed(spark, sf_dir), "relations")


QUERIES = {
    "p2_found": p2_found,
    "p2_wide": p2_wide,
    "p2_typed": p2_typed,
    "p2_schema": p2_schema,
    "p2_discovered": p2_discovered,
    "p5_found": p5_found,
    "p5_key_counts": p5_key_counts,
    "p5_join_rollup": p5_join_rollup,
    "p5_path_counts": p5_path_counts,
    "p6_found": p6_found,
    "p6_value_counts": p6_value_counts,
    "p7_found": p7_found,
    "p7_report": p7_report,
}
