"""Entity and predicate identifiers: one plain form for every spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The namespaces of the graph and their short forms.
RESOURCE = "http://kg.example/resource/"
ONTOLOGY = "http://kg.example/ontology/"
PROPERTY = "http://kg.example/property/"
PREFIXES = {ONTOLOGY: "dbo:", PROPERTY: "dbp:"}
STANDARD = {"http://www.w3.org/1999/02/22-rdf-syntax-ns#": "rdf:", "http://www.w3.org/2000/01/rdf-schema#": "rdfs:"}


def bare_uri(col: Column) -> Column:
    """Trimmed, without the angle brackets of N-Triples."""
    return F.regexp_replace(col, r"^\s*<?\s*(.*?)\s*>?\s*$", "$1")


def unicode_unescaped(col: Column) -> Column:
    r"""``\uXXXX`` escapes of N-Triples resolved; other texts are returned unchanged."""
    quoted = F.concat(F.lit('["'), F.replace(col, F.lit('"'), F.lit('\\"')), F.lit('"]'))
    return F.when(F.contains(col, F.lit("\\u")), F.coalesce(F.from_json(quoted, "array<string>")[0], col)).otherwise(col)


def canonical_id(col: Column) -> Column:
    """The plain form of an entity id: URI, bracketed, escaped and padded spellings give the same text.

    Letter case counts. Null gives null. Ids of other namespaces keep their whole
    URI; '+' is an ordinary character; broken escapes stay as they are. The tree
    is kept small (each step is used at most twice) because it sits inside joins.
    """
    bare = F.regexp_replace(unicode_unescaped(col), r"^\s*<?\s*(?:" + RESOURCE.replace(".", r"\.") + r")?(.*?)\s*>?\s*$", "$1")
    return F.coalesce(F.trim(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B")))), bare)


def short_predicate(col: Column) -> Column:
    """A predicate in its short form (``dbo:budget``), whatever its spelling."""
    out = bare_uri(col)
    for uri, prefix in PREFIXES.items():
        out = F.regexp_replace(out, "^" + uri.replace(".", r"\."), prefix)
    return F.trim(out)


def local_id(uri: Column) -> Column:
    """The local id of a URI: without the graph's resource, property or ontology prefix; of any other URI the last segment."""
    bare = bare_uri(uri)
    out = F.when(F.contains(bare, F.lit("://")), F.element_at(F.split(bare, "/"), -1)).otherwise(canonical_id(uri))
    for prefix in (ONTOLOGY, PROPERTY):
        out = F.when(F.startswith(bare, F.lit(prefix)), F.replace(bare, F.lit(prefix), F.lit(""))).otherwise(out)
    return F.when(F.startswith(bare, F.lit(RESOURCE)), canonical_id(uri)).otherwise(out)


def curie(predicate: Column) -> Column:
    """A predicate as ``dbo:``, ``dbp:``, ``rdf:`` or ``rdfs:`` name; of any other URI the last segment."""
    bare = bare_uri(predicate)
    out = F.element_at(F.split(bare, "/"), -1)
    for uri, prefix in {**PREFIXES, **STANDARD}.items():
        out = F.when(F.startswith(bare, F.lit(uri)), F.replace(bare, F.lit(uri), F.lit(prefix))).otherwise(out)
    return F.trim(out)
