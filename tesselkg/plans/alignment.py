"""Queries over rendered documents: facts read back from them, aligned texts and their confidence; and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselkg.functions import kg_text, templates
from tesselkg.operators import align
from tesselkg.plans import knowledge as kgq
from tesselkg.plans.knowledge import KGE, KGR, NAMED, PHRASE, VERB, _with


#: Triples of a document, about.
EACH = 40


def _parted(spark, d) -> DataFrame:
    """The named triples in documents of about EACH, by hash of the relation: no document grows with the graph."""
    rows = kgq._named(spark, d)
    n = max(1, rows.count() // EACH)
    return rows.withColumn("id", F.pmod(F.conv(F.substring(F.md5("relation_id"), 1, 8), 16, 10).cast("long"), F.lit(n)))


def _document(rows: DataFrame, line: Column, heading: str) -> DataFrame:
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("relation_id", line.alias("l")))), lambda r: r["l"]), "\n")
    return rows.groupBy("id").agg(F.concat(F.lit(heading), text).alias("doc"))


def _triple_documents(spark, d):
    """Documents of scored triples, rendered as retrieval renders them."""
    line = F.concat(F.lit("• "), kg_text.triple_plain(F.col("head_name"), F.col("relation_type"), F.col("tail_name")), F.lit(" (score: "), F.format_string("%.3f", F.lit(0.5)), F.lit(")"))
    return _document(_parted(spark, d), line, "Retrieved factual triples:\n")


def _subgraph_documents(spark, d):
    line = F.concat(F.lit("  • "), kg_text.triple_sentence(F.col("head_name"), F.col("relation_type"), F.col("tail_name")))
    return _document(_parted(spark, d), line, "Retrieved 3 relevant entities and their 2-hop subgraphs:\n\nKey relationships:\n")


def align_triples(spark, d):
    return align.triple_facts(_triple_documents(spark, d), "id", "doc")


def align_subgraph(spark, d):
    return align.subgraph_facts(_subgraph_documents(spark, d), "id", "doc")


def align_confidence(spark, d):
    docs = _triple_documents(spark, d)
    n = F.size(F.split("doc", "\n")) - 1
    return docs.select("id", F.round(align.alignment_confidence(F.col("doc"), n, F.lit(0.5)), 6).alias("confidence"))


def simple_alignment(spark, d):
    return _triple_documents(spark, d).select("id", F.concat(F.lit("Relevant knowledge from knowledge graph:\n"), F.substring("doc", 1, 1000)).alias("text"))


HEADING = "Relevant movie knowledge:"


def aligned_triples(spark, d):
    """The aligned text of each document of triples."""
    facts = align_triples(spark, d)
    return align.aligned_text(facts, facts.select("id").distinct().withColumn("history", F.lit("movies: none")), HEADING)


def knowledge_films(spark, d):
    """Films and their facts read back from the aligned texts."""
    return align.films_in(aligned_triples(spark, d), "id", "text")


def template_recommendation(spark, d):
    """The recommendation text made without a model, from the first five films of each aligned text."""
    films = knowledge_films(spark, d).where("film_no <= 5")
    reason = F.coalesce(templates.filled(templates.ADVICE_REASON, fact=F.col("first_fact")), templates.filled(templates.ADVICE_NO_REASON, preferences="quality films"))
    entry = F.concat(F.col("film_no").cast("string"), F.lit(". **"), "film", F.lit("**\n"), reason, F.lit("\n"))
    body = films.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("film_no", entry.alias("e")))), lambda x: x["e"]), "\n").alias("body"))
    rows = _triple_documents(spark, d).select("id").join(body, "id", "left")
    body = F.coalesce(F.concat(F.lit(templates.ADVICE_HEADING), "body"), F.lit(templates.ADVICE_NOTHING))
    return rows.select("id", templates.filled(templates.ADVICE, query="a film", body=body, user_type="movie").alias("text"))


QUERIES = {f.__name__: f for f in (align_triples, align_subgraph, align_confidence, simple_alignment, aligned_triples, knowledge_films, template_recommendation)}


def _film(ties: tuple[str, ...], fact: str = "fact") -> str:
    return "CASE " + " ".join(f"WHEN contains({fact}, '{t}') THEN trim(split_part({fact}, '{t}', 1))" for t in ties) + " END"


FACTS = """SELECT id, film_no, film, fact_no, fact FROM (SELECT *, dense_rank() OVER (PARTITION BY id ORDER BY first) AS film_no, row_number() OVER (PARTITION BY id, film ORDER BY no) AS fact_no FROM (
  SELECT *, min(no) OVER (PARTITION BY id, film) AS first FROM facts WHERE film IS NOT NULL)) WHERE film_no <= 5 AND fact_no <= {n}"""
PARTED = f"parted AS (SELECT *, ('0x' || substr(md5(relation_id), 1, 8))::bigint % greatest(1, (SELECT count(*) FROM named) // {EACH}) AS id FROM named)"
PLAIN = f"plain AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY relation_id) AS no, trim(head_name || ' ' || {PHRASE.format(c='relation_type')} || ' ' || tail_name) AS fact FROM parted)"
DOCS = "docs AS (SELECT id, count(*) AS n, 'Retrieved factual triples:' || chr(10) || string_agg('• ' || fact || ' (score: 0.500)', chr(10) ORDER BY no) AS doc FROM plain GROUP BY 1)"
TRIPLE_FACTS = ", ".join((KGE, KGR, NAMED, PARTED, PLAIN, f"facts AS (SELECT *, {_film(align.TIES)} AS film FROM plain)"))
ALIGNED = f"""shown AS ({FACTS.format(n=5)}),
aligned AS (SELECT id, 'Based on movies: none' || chr(10) || chr(10) || '{HEADING}' || chr(10) || chr(10) || string_agg('**' || film || '**:' || chr(10) || body, chr(10) || chr(10) ORDER BY film_no) AS text
  FROM (SELECT id, film_no, film, string_agg('  - ' || fact, chr(10) ORDER BY fact_no) AS body FROM shown GROUP BY 1, 2, 3) GROUP BY 1)"""
READ_BACK = r"""spread AS (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM aligned),
marked AS (SELECT id, no, trim(line) AS line, regexp_matches(trim(line), '^([1-5]\.|\*\*)') AS heading FROM spread),
counted AS (SELECT *, sum(heading::int) OVER (PARTITION BY id ORDER BY no) AS film_no FROM marked),
films AS (SELECT id, film_no::bigint AS film_no, max(CASE WHEN heading THEN trim(split_part(split_part(split_part(trim(regexp_replace(line, '[1-5]\.|\*\*|:', '', 'g')), '(Movie)', 1), '(Resource)', 1), '[score:', 1)) END) AS film,
  count(*) FILTER (NOT heading AND regexp_matches(line, '^[-•]')) AS n_facts, arg_min(trim(regexp_replace(line, '^[-•]+', '')), no) FILTER (NOT heading AND regexp_matches(line, '^[-•]')) AS first_fact FROM counted WHERE film_no > 0 GROUP BY 1, 2)"""
NOTHING = templates.ADVICE_NOTHING.replace(chr(10), "' || chr(10) || '")
SQL = {
    "align_triples": f"WITH {TRIPLE_FACTS} " + FACTS.format(n=5),
    "align_subgraph": _with(KGE, KGR, NAMED, PARTED, f"plain AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY relation_id) AS no, head_name || ' ' || {VERB.format(c='relation_type')} || ' ' || tail_name AS fact FROM parted)",
                            f"facts AS (SELECT *, {_film(align.SENTENCES)} AS film FROM plain WHERE no <= 20)") + FACTS.format(n=4),
    "align_confidence": _with(KGE, KGR, NAMED, PARTED, PLAIN, DOCS) + "SELECT id, round(greatest(0.0::double, least(1.0::double, (least(1.0::double, n / 5.0::double) + least(1.0::double, length(doc) / 200.0::double) * 0.8::double + 0.2::double + 0.5::double) / 3)), 6) AS confidence FROM docs",
    "simple_alignment": _with(KGE, KGR, NAMED, PARTED, PLAIN, DOCS) + "SELECT id, 'Relevant knowledge from knowledge graph:' || chr(10) || left(doc, 1000) AS text FROM docs",
    "aligned_triples": f"WITH {TRIPLE_FACTS}, {ALIGNED} SELECT * FROM aligned",
    "knowledge_films": f"WITH {TRIPLE_FACTS}, {ALIGNED}, {READ_BACK} SELECT * FROM films",
    "template_recommendation": f"""WITH {TRIPLE_FACTS}, {ALIGNED}, {READ_BACK} SELECT id, 'Based on your request for ''a film'', here are my personalized recommendations:' || chr(10) || chr(10) || coalesce('Recommended Movies:' || chr(10) || chr(10) || body, '{NOTHING}') || chr(10) || chr(10) ||
      'These recommendations are tailored for movie lovers.' || chr(10) || 'Let me know if you''d like more details about any of these options!' AS text FROM (SELECT DISTINCT id FROM plain) LEFT JOIN (
      SELECT id, string_agg(film_no || '. **' || film || '**' || chr(10) || coalesce('   Why: ' || first_fact, '   This movie matches your interest in quality films') || chr(10), chr(10) ORDER BY film_no) AS body FROM films WHERE film_no <= 5 GROUP BY 1) USING (id)""",
}
