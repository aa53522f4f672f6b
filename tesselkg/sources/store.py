"""Stored forms: the knowledge graph with keyed upserts, the vector index with its statistics, metric logs and reports.

A stored graph or index is a folder of versions; a version counts once it is
written whole (Parquet's success mark), and readers take the newest. Writing a
new version never touches the one that is being read.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselkg.operators import kg

ENTITY = "entity_id string, entity_type string, name string, attributes string, aliases string"
RELATION = "relation_id string, relation_type string, head string, tail string, confidence double"


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The whole versions under ``path`` on any file system Spark knows."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(folder)]
    done = [n for n in names if n.startswith("v") and n[1:].isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(int(n[1:]) for n in done)


def save(df: DataFrame, path: str) -> str:
    """Write ``df`` as the next version under ``path``; gives the version's folder."""
    versions = _versions(df.sparkSession, path)
    target = f"{path}/v{(versions[-1] if versions else 0) + 1}"
    df.write.mode("overwrite").parquet(target)
    return target


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest version under ``path``; an empty table where there is none."""
    versions = _versions(spark, path)
    return spark.read.parquet(f"{path}/v{versions[-1]}") if versions else spark.createDataFrame([], schema)


def save_graph(entities: DataFrame, relations: DataFrame, path: str) -> None:
    """Replace the stored graph (entities and relations in the shape of ``operators.kg``)."""
    save(entities, f"{path}/entities")
    save(relations, f"{path}/relations")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return load(spark, f"{path}/entities", ENTITY), load(spark, f"{path}/relations", RELATION)


def upsert_graph(entities: DataFrame, relations: DataFrame, path: str) -> None:
    """Insert or replace by id in the stored graph: new rows win over stored ones; a repeated new id must be resolved before."""
    stored = load_graph(entities.sparkSession, path)
    for name, key, new, old in (("entities", "entity_id", entities, stored[0]), ("relations", "relation_id", relations, stored[1])):
        both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
        save(kg.upsert(both, [key], ["_new"]).drop("_new"), f"{path}/{name}")


def save_index(index: DataFrame, path: str, model: str) -> DataFrame:
    """Write an index (id, v, ...) and give its statistics (n_vectors, dimensions, model), read back from what was written."""
    target = save(index, path)
    stats = index.sparkSession.read.parquet(target).agg(F.count(F.lit(1)).alias("n_vectors"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("dimensions"), F.lit(model).alias("model"))
    save(stats, f"{path}_stats")
    return stats


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Append rows to a JSON-lines log, each with the time of writing."""
    metrics.withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).write.mode("append").json(path)


def write_report(summary: DataFrame, path: str) -> dict:
    """Write a summary of a single row as an indented JSON file on the driver; gives what was written."""
    rows = summary.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a report is made of exactly one row")
    report = json.loads(json.dumps(rows[0].asDict(recursive=True), default=str))
    with open(path, "w", encoding="utf-8") as out:
        json.dump(report, out, indent=2, ensure_ascii=False)
    return report


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(name, gb, total_gb) of the files in a folder of dumps: size in gigabytes, and the running total by name."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    sizes = sorted((r["name"], r["length"]) for r in files.collect())  # one row per dump file
    total, rows = 0, []
    for name, length in sizes:
        total += length
        rows.append((name, round(length / 1024**3, 2), round(total / 1024**3, 2)))
    return spark.createDataFrame(rows, "name string, gb double, total_gb double")
