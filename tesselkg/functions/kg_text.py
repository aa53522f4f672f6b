"""Knowledge as text: relation phrases, triple sentences, entity descriptions (Catalyst expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sentence of each relation type that has one; all others read "head phrase tail".
TEMPLATES = {
    "dbo:director": "is directed by",
    "dbo:starring": "stars",
    "dbo:producer": "is produced by",
    "dbo:writer": "is written by",
    "dbo:musicComposer": "has music composed by",
    "dbo:cinematography": "has cinematography by",
    "dbo:editing": "is edited by",
    "dbo:genre": "belongs to genre",
    "dbo:distributor": "is distributed by",
    "dbo:productionCompany": "is produced by company",
    "dbo:country": "is from country",
    "dbo:language": "is in language",
    "dbo:releaseDate": "was released on",
    "dbo:budget": "has budget",
    "dbo:gross": "grossed",
    "dbo:runtime": "has runtime",
    "dbo:birthPlace": "was born in",
    "dbo:occupation": "works as",
    "dbo:spouse": "is married to",
    "dbo:award": "won award",
}
#: Characters kept of a comment, an abstract and a context.
COMMENT, ABSTRACT, CONTEXT = 200, 150, 100


def relation_phrase(relation: Column) -> Column:
    """'dbo:musicComposer' -> 'music composer': the part after the first colon, a blank before each capital, lower case."""
    local = F.when(F.contains(relation, F.lit(":")), F.split_part(relation, F.lit(":"), F.lit(2))).otherwise(relation)
    return F.lower(F.trim(F.regexp_replace(local, "([A-Z])", " $1")))


def relation_verb(relation: Column) -> Column:
    """The phrase of the relation's sentence: its template's, else its name in words."""
    out = relation_phrase(relation)
    for name, phrase in TEMPLATES.items():
        out = F.when(relation == name, F.lit(phrase)).otherwise(out)
    return out


def triple_sentence(head: Column, relation: Column, tail: Column) -> Column:
    return F.concat_ws(" ", head, relation_verb(relation), tail)


def triple_plain(head: Column, relation: Column, tail: Column) -> Column:
    """The form that retrieval shows: names around the relation's words."""
    return F.concat_ws(" ", head, relation_phrase(relation), tail)


def cut_at(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def entity_short(kind: Column, name: Column) -> Column:
    return F.concat(kind, F.lit(": "), name)


def entity_description(kind: Column, name: Column, attributes: Column) -> Column:
    """'Type: name. Description: ... . abstract: ...' from a map of attributes; absent parts are left out."""
    first = F.lit(None).cast("string")
    for key in ("description", "abstract", "dbo:abstract"):
        value = F.try_element_at(attributes, F.lit(key))
        first = F.when(value.isNotNull(), F.concat(F.lit(f"{key}: "), cut_at(value, ABSTRACT))).otherwise(first)
    comment = F.try_element_at(attributes, F.lit("rdfs:comment"))
    return F.concat_ws(". ", entity_short(kind, name), F.concat(F.lit("Description: "), cut_at(comment, COMMENT)), first)


def triple_structured(head: Column, relation: Column, tail: Column, head_kind: Column, tail_kind: Column, head_attributes: Column) -> Column:
    comment = F.try_element_at(head_attributes, F.lit("rdfs:comment"))
    context = F.concat(F.lit(" Context: "), F.substring(comment, 1, CONTEXT), F.lit("..."))
    return F.concat(triple_sentence(head, relation, tail), F.lit(" ["), head_kind, F.lit(" -> "), tail_kind, F.lit("]"), F.coalesce(context, F.lit("")))
