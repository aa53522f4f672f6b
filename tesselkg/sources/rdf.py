"""N-Triples dumps: reading, parsing, routing statements to entities and relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselkg.functions.ids import RESOURCE

STATEMENT = r'(?s)^<([^>]*)>\s+<([^>]*)>\s+(<[^>]*>|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^\S+)?)\s*\.\s*$'
#: Characters kept of an abstract.
MOST_ABSTRACT = 500
# Class names that give a type, tested in this order.
CLASSES = (("Person", ("Person", "Artist")), ("Genre", ("Genre",)), ("Organization", ("Company", "Organisation", "Organization")), ("Place", ("Place", "Location")))


def read_dump(spark: SparkSession, paths: str | list[str], subjects: DataFrame | None = None) -> DataFrame:
    """Statements of text dumps (plain, .gz or splittable .bz2); bytes that are no UTF-8 become replacement characters."""
    return parse_lines(spark.read.text(paths), keep=[], subjects=subjects)


def unescaped(text: Column) -> Column:
    r"""``\n``, ``\t``, ``\"`` and ``\\`` resolved."""
    t = F.replace(text, F.lit("\\\\"), F.lit("\u0001"))
    t = F.replace(F.replace(F.replace(t, F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t")), F.lit('\\"'), F.lit('"'))
    return F.replace(t, F.lit("\u0001"), F.lit("\\"))


def parse_lines(lines: DataFrame, *, keep: Sequence[str], subjects: DataFrame | None = None) -> DataFrame:
    """(keep..., subject, predicate, object, object_type, ok) of every line but blank lines, comments and directives.

    Lines that are no statement have ``ok`` false and null parts. With
    ``subjects`` (column subject) other subjects are left out right after the
    parse. A literal keeps neither language nor type; escaped quotes inside do
    not end it.
    """
    text = F.trim("value")
    rows = lines.where((text != "") & ~F.substring(text, 1, 1).isin("#", "@"))
    # one pass of the pattern: its parts are put together around a mark that no text holds, and split again
    parts = F.split(F.regexp_replace("value", STATEMENT, "\u0002$1\u0002$2\u0002$3"), "\u0002")
    rows = rows.select(*keep, parts.alias("parts")).select(*keep, (F.size("parts") == 4).alias("ok"), *[F.get("parts", F.lit(k)).alias(n) for k, n in ((1, "s"), (2, "p"), (3, "o"))])
    uri = F.startswith("o", F.lit("<"))
    whole = F.when(uri, F.regexp_replace("o", "^<|>$", "")).otherwise(unescaped(F.regexp_extract("o", r'(?s)^"(.*)"', 1)))
    ok = lambda c: F.when(F.col("ok"), c)
    out = rows.select(*keep, ok(F.col("s")).alias("subject"), ok(F.col("p")).alias("predicate"), ok(whole).alias("object"), ok(F.when(uri, F.lit("uri")).otherwise(F.lit("literal"))).alias("object_type"), "ok")
    return out if subjects is None else out.join(subjects.select("subject").distinct(), "subject", "left_semi")


def route(quads: DataFrame) -> DataFrame:
    """Quads (entity_id, property, predicate, object, object_type, seq) with what each gives: name, abstract, attribute, type, relation or dropped.

    The tests are on the whole predicate, in lower case.
    """
    predicate, literal = F.lower("predicate"), F.col("object_type") == "literal"
    kind = (
        F.when(literal & F.contains(predicate, F.lit("label")), "name")
        .when(literal & F.contains(predicate, F.lit("abstract")), "abstract")
        .when(literal, "attribute")
        .when(F.contains(predicate, F.lit("type")), "type")
        .when(F.startswith("object", F.lit(RESOURCE)), "relation")
        .otherwise("dropped")
    )
    return quads.withColumn("kind", kind)


def class_type(uri: Column, classes: tuple = CLASSES) -> Column:
    out = F.lit(None).cast("string")
    for name, marks in reversed(classes):
        hit = F.lit(False)
        for m in marks:
            hit = hit | F.contains(uri, F.lit(m))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def fold_entities(routed: DataFrame, default_type: str = "Movie", classes: tuple = CLASSES) -> DataFrame:
    """One row per subject: the last name and class by ``seq``, the attribute map's size; without a name, the id with blanks."""
    name = F.max_by("object", F.when(F.col("kind") == "name", F.col("seq")))
    known = class_type(F.col("object"), classes)
    kind = F.max_by(known, F.when((F.col("kind") == "type") & known.isNotNull(), F.col("seq")))
    attributes = F.count_distinct(F.when(F.col("kind").isin("attribute", "abstract"), F.col("property")))
    out = routed.groupBy("entity_id").agg(name.alias("n"), kind.alias("t"), attributes.alias("n_attributes"))
    return out.select("entity_id", F.coalesce("n", F.replace(F.col("entity_id"), F.lit("_"), F.lit(" "))).alias("name"), F.coalesce("t", F.lit(default_type)).alias("entity_type"), "n_attributes")


# What each hop of the extraction reads, its default type and its classes.
HOPS = (
    (0, "Movie", ("name", "abstract", "attribute", "relation"), ()),
    (1, "Resource", ("name", "abstract", "attribute", "type", "relation"), (("Person", ("Person", "Artist")), ("Genre", ("Genre",)), ("Organization", ("Company", "Organisation")))),
    (2, "Resource", ("name", "type"), (("Person", ("Person",)), ("Place", ("Place", "Location")))),
)


def entities_by_hop(routed: DataFrame, reached: DataFrame) -> DataFrame:
    """(entity_id, name, entity_type, n_attributes, hop) of the subjects of ``reached`` (entity_id, hop), each hop under its own routing."""
    out = None
    for hop, default, kinds, classes in HOPS:
        rows = routed.where(F.col("kind").isin(*kinds)).join(reached.where(F.col("hop") == hop).select("entity_id"), "entity_id", "left_semi")
        part = fold_entities(rows, default, classes).withColumn("hop", F.lit(hop).cast("long"))
        out = part if out is None else out.unionByName(part)
    return out


def attribute_map(routed: DataFrame) -> DataFrame:
    """(entity_id, attributes): the last value per property; abstracts are cut to their most characters."""
    value = F.when(F.col("kind") == "abstract", F.substring("object", 1, MOST_ABSTRACT)).otherwise(F.col("object"))
    key = F.when(F.col("kind") == "abstract", F.lit("abstract")).otherwise(F.col("property"))
    rows = routed.where(F.col("kind").isin("attribute", "abstract")).select("entity_id", key.alias("k"), value.alias("v"), "seq")
    last = rows.groupBy("entity_id", "k").agg(F.max_by("v", "seq").alias("v"))
    return last.groupBy("entity_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("attributes"))


def hops(seeds: DataFrame, relations: DataFrame, most_last: int) -> DataFrame:
    """(entity_id, hop) of the seeds, their tails and the tails' tails; of the last hop the first ``most_last`` by id (the extraction's bound)."""
    zero = seeds.select("entity_id").distinct()
    edges = relations.select("head", "tail")
    one = edges.join(zero.select(F.col("entity_id").alias("head")), "head", "left_semi").select(F.col("tail").alias("entity_id")).distinct().join(zero, "entity_id", "left_anti")
    two = edges.join(one.select(F.col("entity_id").alias("head")), "head", "left_semi").select(F.col("tail").alias("entity_id")).distinct()
    two = two.join(one, "entity_id", "left_anti").join(zero, "entity_id", "left_anti").orderBy("entity_id").limit(most_last)
    return zero.withColumn("hop", F.lit(0)).unionByName(one.withColumn("hop", F.lit(1))).unionByName(two.withColumn("hop", F.lit(2)))
