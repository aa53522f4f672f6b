"""Entity-attribute-value rows reshaped into one typed row per entity.

First the attribute list and its types are discovered in the data and set
against the declared ones, then one conditional aggregation per attribute picks
the winning statement: the latest one that is readable as the type.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselkg.functions import values
from tesselkg.session import cut


#: Types in the order in which they are tried; string always fits.
ORDER = ("boolean", "date", "int", "decimal(3,1)", "bigint")


def discover_attributes(eav: DataFrame, key: str, value: str, *, min_share: float = 0.9) -> DataFrame:
    """(attr, attr_type, n, n_readable): for each key the narrowest type that reads ``min_share`` of its known values.

    Types are tried in the order boolean, date, int, decimal(3,1), bigint; string always fits.
    Placeholders and nulls are no evidence. One aggregation, one row per key.
    """
    known = eav.select(F.col(key).alias("attr"), values.literal_text(F.col(value)).alias("t")).where(F.col("attr").isNotNull())
    return _types_of(known, min_share).select("attr", "attr_type", "n", "n_readable")


def _types_of(known: DataFrame, min_share: float) -> DataFrame:
    """(attr, attr_type, n, n_readable, reads) from (attr, t): how many texts each type reads, map side first."""
    known = known.where(F.col("t").isNotNull() & ~values.is_placeholder(F.col("t")))
    counts = known.groupBy("attr").agg(
        F.count(F.lit(1)).alias("n"), *[F.count(values.READERS[k](F.col("t"))).alias(f"n{i}") for i, k in enumerate(ORDER)]
    )
    kind, read = F.lit("string"), F.col("n")
    for i, k in reversed(list(enumerate(ORDER))):
        fits = F.col(f"n{i}") >= F.col("n") * F.lit(min_share)
        kind, read = F.when(fits, F.lit(k)).otherwise(kind), F.when(fits, F.col(f"n{i}")).otherwise(read)
    reads = F.map_from_arrays(F.array(*map(F.lit, (*ORDER, "string"))), F.array(*[F.col(f"n{i}") for i in range(len(ORDER))], F.col("n")))
    return counts.select("attr", kind.alias("attr_type"), "n", read.alias("n_readable"), reads.alias("reads"))


def reconciled(cells: DataFrame, attribute_columns: DataFrame, *, min_share: float = 0.9) -> DataFrame:
    """(attr, attr_type, discovered, n, n_readable) of every attribute that is declared or holds a value in ``cells`` (attr, t).

    The type found in the values is set against the declared one: a declared type
    that reads any of the values holds, one that reads none (or is not declared)
    gives way to the discovered; an attribute without values keeps its declaration.
    """
    found = _types_of(cells.select("attr", "t"), min_share)
    declared = attribute_columns.select("attr", F.col("attr_type").alias("declared")).where("attr is not null").groupBy("attr").agg(F.min("declared").alias("declared"))
    rows = declared.join(found, "attr", "full")
    readable = F.coalesce(F.try_element_at("reads", F.col("declared")), F.lit(0))
    holds = F.col("declared").isNotNull() & (F.col("n").isNull() | (readable > 0))
    return rows.select(
        "attr", F.when(holds, F.col("declared")).otherwise(F.col("attr_type")).alias("attr_type"), F.col("attr_type").alias("discovered"),
        F.coalesce("n", F.lit(0)).alias("n"), F.when(holds, readable).otherwise(F.coalesce("n_readable", F.lit(0))).alias("n_readable"),
    )


def read_as(attr_type: Column, text: Column) -> Column:
    """``text`` in the canonical form of the type named in ``attr_type``; null where unreadable."""
    out = F.lit(None).cast("string")
    for name, reader in values.READERS.items():
        out = F.when(attr_type == name, reader(text)).otherwise(out)
    return out


def statements(triples: DataFrame, entity_id: Column, predicate: Column, text: Column, loaded_at: Column, rank: int, row_id: Column) -> DataFrame:
    """The common shape of a source of statements; ``rank`` breaks ties of loaded_at between sources, row_id within one."""
    return triples.select(
        entity_id.alias("entity_id"), predicate.alias("predicate"), text.alias("text"), F.struct(loaded_at.alias("at"), F.lit(rank).alias("src"), row_id.alias("row")).alias("version")
    )


def mapped_cells(eav: DataFrame, attribute_columns: DataFrame) -> DataFrame:
    """(entity_id, attr, t, version) of the statements (entity_id, predicate, text, version) whose predicate feeds an attribute."""
    mapping = attribute_columns.select("predicate", "attr").where("predicate is not null and attr is not null").distinct()
    cells = eav.select("entity_id", "predicate", "text", "version").where("entity_id is not null and text is not null").join(mapping, "predicate")
    return cells.select("entity_id", "attr", values.literal_text(F.col("text")).alias("t"), "version")


def wide_table(eav: DataFrame, attribute_columns: DataFrame) -> tuple[DataFrame, list[tuple[str, str]]]:
    """One row per entity with a text cell per attribute, from statements (entity_id, predicate, text, version); and the (attribute, type) list.

    ``attribute_columns`` maps each predicate to its attribute. First the list of
    attributes and their types is discovered in the statements and reconciled with
    the declared types; then each attribute is one conditional max_by. Of the
    statements of a cell the readable one with the greatest version holds; exact
    repeats change nothing. Entities without any readable statement have no row;
    null ids, predicates and texts are ignored; an empty input gives an empty table
    with all columns. A hot entity is combined on the map side and never collected.
    """
    cells = cut(mapped_cells(eav, attribute_columns))
    found = reconciled(cells, attribute_columns).select("attr", "attr_type").orderBy("attr").collect()  # one row per attribute of the declared list
    attrs = [(r["attr"], r["attr_type"]) for r in found]
    kind = F.lit(None).cast("string")
    for a, t in attrs:
        kind = F.when(F.col("attr") == a, F.lit(t)).otherwise(kind)
    read = cells.select("entity_id", "attr", "version", read_as(kind, F.col("t")).alias("val")).where("val is not null")
    picks = [F.max_by("val", F.when(F.col("attr") == a, F.col("version"))).alias(a) for a, _ in attrs]
    return read.groupBy("entity_id").agg(*picks), attrs


def typed(wide: DataFrame, attrs: Sequence[tuple[str, str]]) -> DataFrame:
    """The wide table with its cells cast to their types."""
    return wide.select("entity_id", *[F.col(a).cast(t).alias(a) for a, t in attrs])


def unpivot(wide: DataFrame, attrs: Sequence[tuple[str, str]]) -> DataFrame:
    """(entity_id, attr, val) of each cell that is not null, in canonical text form."""
    cell = F.explode(F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).cast("string").alias("val")) for a, _ in attrs]))
    return wide.select("entity_id", cell.alias("c")).select("entity_id", "c.attr", "c.val").where("val is not null")
