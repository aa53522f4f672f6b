"""Item-to-URI mapping files whose columns are known by their header only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def detect_columns(header: str, delimiter: str) -> tuple[int, int]:
    """(id column, URI column): the first header with 'id', the last with 'uri', 'url' or 'dbpedia'."""
    names = [h.strip().lower() for h in header.strip().split(delimiter)]
    ids = [i for i, h in enumerate(names) if "id" in h]
    uris = [i for i, h in enumerate(names) if any(x in h for x in ("uri", "url", "dbpedia"))]
    if not ids or not uris:
        raise ValueError(f"no id and URI column in the header {header!r}")
    return ids[0], uris[-1]


def parse_mapping(lines: DataFrame, header: str, *, delimiter: str, limit: int | None = None) -> DataFrame:
    """(item_id, uri) from lines (line_no, value): rows with enough fields and a URI; the last line of an item holds.

    ``limit`` counts physical lines, before any is skipped. There is no quoting.
    """
    at_id, at_uri = detect_columns(header, delimiter)
    rows = lines if limit is None else lines.orderBy("line_no").limit(limit)
    parts = rows.select("line_no", F.split(F.trim("value"), f"\\Q{delimiter}\\E").alias("p")).where(F.size("p") > max(at_id, at_uri))
    pairs = parts.select("line_no", F.trim(F.col("p")[at_id]).alias("item_id"), F.trim(F.col("p")[at_uri]).alias("uri")).where(F.startswith("uri", F.lit("http")))
    return pairs.groupBy("item_id").agg(F.max_by("uri", "line_no").alias("uri"))


def read_mapping(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """A mapping file: tab-separated where its name ends in .tsv, else by commas."""
    delimiter = "\t" if path.endswith(".tsv") else ","
    numbered = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), "value")
    first = numbered.orderBy("line_no").limit(1).collect()
    if not first:
        raise ValueError(f"{path} is empty")
    return parse_mapping(numbered.where(F.col("line_no") > first[0]["line_no"]), first[0]["value"], delimiter=delimiter, limit=limit)
