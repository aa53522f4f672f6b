"""Parsing prompts and generated text, and the text heuristics (Catalyst expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
LETTERS = "ABCDEFGHIJKLMNOPQRST"
ANSWER_FORMS = (r"ANSWER:\s*([A-T])", r"SELECT\s+([A-T])", r"OPTION\s+([A-T])", r"CHOOSE\s+([A-T])", r"\(([A-T])\)", r"^([A-T])[\s:]")
DEFAULT_ANSWER = "M"
THEMES = ("director", "actor", "genre", "producer", "story", "style")
REASONS = ("why", "because", "reason", "based on", "features", "known for")
POSITIVE = ("good", "great", "helpful", "perfect", "excellent", "thanks")
NEGATIVE = ("bad", "wrong", "unhelpful", "terrible", "awful", "no")
GENERATED_FORMS = (r"(?i)(?:Answer|Option|Choice|Select|Pick|Recommend)[:\s]*([A-T])\b", r"(?i)\b([A-T])\s*(?:is the best|would be|is my)", r"(?i)(?:I choose|I select|I recommend)[:\s]*([A-T])\b", r"(?i)\b([A-T])\s*$")
ANALYSIS = ("analyze", "based on", "consider", "match", "suitable", "recommend")
NO_MENTIONS = ("this", "that", "these", "those", "with", "from")
OPTION_PROMPT = ("Based on the user's watching history, select the best movie from options A-T.\n\n", "\n\nOptions: ", "\n\nAnswer with ONE letter (A-T): Analysis and Answer:")
#: Characters kept of an option's title, of a prompt without history, and of the knowledge.
MOST_TITLE, MOST_HISTORY, MOST_KNOWLEDGE = 30, 500, 500


def history_text(query: Column) -> Column:
    return F.regexp_extract(query, r"(?s)(?:Watching|Listening) history:\s*\{(.*?)\}\.?\s*Options:", 1)


def options_text(query: Column) -> Column:
    return F.regexp_extract(query, r"(?s)Options:\s*\{(.*)\}", 1)


def options_list(text: Column) -> Column:
    """array<struct<letter, title>> of 'A: title, B: title': commas inside a title do not split; other parts are dropped."""
    parts = F.transform(F.split(text, r"(?i), (?=[A-T]: )"), F.trim)
    at = lambda p: F.instr(p, F.lit(": "))
    pairs = F.transform(F.filter(parts, lambda p: F.contains(p, F.lit(": "))), lambda p: F.struct(F.upper(F.trim(F.substr(p, F.lit(1), at(p) - 1))).alias("letter"), F.trim(F.substr(p, at(p) + 2)).alias("title")))
    return F.filter(pairs, lambda x: (F.length(x["letter"]) == 1) & F.contains(F.lit(LETTERS), x["letter"]))


def history_summary(query: Column) -> Column:
    """'movies: a, b' from the history's quoted titles, else its whole text; without a history, the first quoted titles before the options."""
    inside = F.regexp_extract(query, r"(?:Watching|Listening) history:\s*\{([^}]+)\}", 1)
    titles = F.regexp_extract_all(inside, F.lit(r'"([^"]+)"'), F.lit(1))
    before = F.when(F.instr(query, F.lit("Options:")) > 1, F.substring_index(query, "Options:", 1)).otherwise(query)
    loose = F.slice(F.regexp_extract_all(before, F.lit(r'"([^"]+)"'), F.lit(1)), 1, 10)
    named = lambda a: F.concat(F.lit("movies: "), F.array_join(a, ", "))
    return F.when(inside != "", F.when(F.size(titles) > 0, named(titles)).otherwise(F.concat(F.lit("movies: "), inside))).when(F.size(loose) > 0, named(loose)).otherwise("")


def explicit_answer(text: Column) -> Column:
    """The letter of the first answer form that occurs, or null."""
    upper = F.upper(text)
    return F.coalesce(*[F.nullif(F.regexp_extract(upper, f, 1), F.lit("")) for f in ANSWER_FORMS])


def lone_letter(text: Column) -> Column:
    """The first letter of the alphabet that stands alone between blanks or before a full stop, else the default."""
    upper = F.upper(text)
    out = F.lit(DEFAULT_ANSWER)
    for letter in reversed(LETTERS):
        out = F.when(F.contains(upper, F.lit(f" {letter} ")) | F.contains(upper, F.lit(f" {letter}.")), F.lit(letter)).otherwise(out)
    return out


def count_of(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of a non-empty part."""
    return F.when(F.length(part) > 0, ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("long")).otherwise(F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: F.length(w) > 0)


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for p in parts:
        hit = hit | F.contains(text, F.lit(p))
    return hit


def _hits(text: Column, parts: tuple[str, ...]) -> Column:
    return sum((F.contains(text, F.lit(p)).cast("int") for p in parts), F.lit(0))


def length_score(text: Column, full: float) -> Column:
    return F.least(F.lit(1.0), F.length(text) / full) * 0.8 + 0.2


def overlap(a: Column, b: Column) -> Column:
    """Share of the distinct words of ``a`` that are in ``b``; both are arrays of distinct words."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1))


def generation_confidence(text: Column, own: Column, knowledge: Column) -> Column:
    """0 without a text or without knowledge."""
    structured = F.when(_any(text, ("1.", "2.", "•", "-")), 0.8).otherwise(0.4)
    score = (length_score(text, 300.0) + F.least(F.lit(1.0), overlap(own, knowledge) * 2) + structured) / 3
    return F.when((F.coalesce(text, F.lit("")) == "") | (F.size(knowledge) == 0), 0.0).otherwise(score)


def explanation_quality(text: Column, own: Column, knowledge: Column) -> Column:
    """Length, words shared with the knowledge, and words of analysis; 0 without a text."""
    score = (length_score(text, 150.0) + F.least(F.lit(1.0), overlap(own, knowledge) * 2) + F.least(F.lit(1.0), _hits(F.lower(text), ANALYSIS) / 3.0)) / 3
    return F.when(F.coalesce(text, F.lit("")) == "", 0.0).otherwise(score)


def mentions(text: Column) -> Column:
    """The first three words of more than four letters that are no stop words."""
    long = lambda w: (F.length(w) > 4) & ~F.lower(w).isin(*NO_MENTIONS)
    return F.slice(F.filter(F.split(text, r"\s+"), long), 1, 3)


def diversity(text: Column, all_words: Column, own: Column) -> Column:
    items = F.size(F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[1-9]\.")))
    return (F.least(F.lit(1.0), items / 3.0) + F.size(own) / F.greatest(F.size(all_words), F.lit(1)) + F.least(F.lit(1.0), _hits(F.lower(text), THEMES) / 3.0)) / 3


def quality(text: Column, own: Column, asked: Column) -> Column:
    """0 without a text or without a query."""
    score = (overlap(asked, own) + F.when(_any(F.lower(text), REASONS), 0.8).otherwise(0.4) + F.when(_any(text, ("1.", "2.", "3.")), 0.8).otherwise(0.3)) / 3
    return F.when((F.coalesce(text, F.lit("")) == "") | (F.size(asked) == 0), 0.0).otherwise(score)


def satisfaction(text: Column) -> Column:
    """0.8, 0.2 or 0.5 as praising or complaining words (also inside others) prevail."""
    lower = F.lower(text)
    good, bad = _hits(lower, POSITIVE), _hits(lower, NEGATIVE)
    return F.when(good > bad, 0.8).when(bad > good, 0.2).otherwise(0.5)


def retrieval_type(document: Column) -> Column:
    return (
        F.when(F.coalesce(document, F.lit("")) == "", "direct")
        .when(F.contains(document, F.lit("Retrieved factual triples:")), "triple")
        .when(F.contains(document, F.lit("relevant entities and their 2-hop subgraphs")), "subgraph")
        .when(F.contains(document, F.lit("Connected subgraph")) | F.contains(document, F.lit("Connected graph")), "connected_graph")
        .otherwise("subgraph")
    )
