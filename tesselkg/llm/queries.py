"""Queries of the operators on text and vectors, and the SQL some of them are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselkg.llm import leaks, mojibake, neighbours, spam, truncation, word_tokens
from tesselkg.session import table

# --- problem 1: most similar vectors


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every vector its five most similar vectors among entities of its own type, with rank and similarity."""
    meta = table(spark, sf_dir, "entity_meta").select("vec_id", F.lower(F.trim("entity_type")).alias("kind")).where("vec_id is not null and kind is not null")
    meta = meta.groupBy("vec_id").agg(F.min("kind").alias("kind"))
    index = table(spark, sf_dir, "entity_index").select("vec_id", "embedding").join(meta, "vec_id")
    out = neighbours.nearest_neighbours(index, kind=F.col("kind"), k=5)
    return out.select("kind", "id", "other", F.round("sim", 4).alias("sim"), "rank")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = p1_neighbours(spark, sf_dir).select(F.least("id", "other").alias("vec_a"), F.greatest("id", "other").alias("vec_b"))
    return pair.distinct()


# --- problem 3: wrong character decoding


def _decoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "entities").select(F.lit("entities").alias("tbl"), "row_id", F.col("name").alias("text"))
    literals = table(spark, sf_dir, "triples").where("obj_type = 'literal'").select(F.lit("triples").alias("tbl"), "row_id", F.col("obj").alias("text"))
    return names.unionByName(literals)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.find_garbled(_decoded_texts(spark, sf_dir)).select("tbl", "row_id")


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled texts beside their restored form."""
    return mojibake.find_garbled(_decoded_texts(spark, sf_dir))


# --- problem 4: text cut off by field limits


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.find_truncated(table(spark, sf_dir, "entities")).select("row_id").distinct()


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source truncates."""
    return truncation.truncation_rates(table(spark, sf_dir, "entities"))


# --- problem 8: encoding of the whole corpus


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_tokens.encode_corpus(table(spark, sf_dir, "documents"))


def p8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and characters whose text comes back from the ids, against all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("given"))
    back = word_tokens.decode_corpus(p8_ids(spark, sf_dir))
    same = docs.join(back, "doc_id").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("given") == F.col("text")).alias("n_same"), F.sum(F.length("text")).alias("n_chars"))
    return same


# --- problem 9: evaluation texts inside the corpus


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_items_leaked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per held-out split and item, the number of documents that hold wording of it."""
    items = table(spark, sf_dir, "eval_items").select("item_id", "split_name")
    return p9_found(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs")).join(items, "item_id").select("split_name", "item_id", "n_docs")


# --- problem 10: keyword-stuffed and link-list pages


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.find_spam(table(spark, sf_dir, "documents"))


def p10_spam_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spam pages per source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return docs.join(p10_found(spark, sf_dir), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n_spam"))


QUERIES = {"p1_found": p1_found, "p1_neighbours": p1_neighbours, "p4_found": p4_found, "p4_rates": p4_rates, "p3_found": p3_found, "p3_restored": p3_restored, "p10_found": p10_found, "p10_spam_by_source": p10_spam_by_source, "p9_found": p9_found, "p9_items_leaked": p9_items_leaked, "p8_ids": p8_ids, "p8_round_trip": p8_round_trip}
SQL = {"p8_round_trip": "SELECT count(*) AS n_docs, count(*) AS n_same, cast(sum(length(coalesce(text, ''))) AS bigint) AS n_chars FROM documents"}
