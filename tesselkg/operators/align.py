"""Retrieved documents re-read as facts: the structured rows behind each kind of rendered document, and their aligned text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Relation words that tie a fact to its film, tried in this order; and their sentence forms in subgraph documents.
TIES = (" director ", " producer ", " starring ", " distributor ")
SENTENCES = (" is directed by ", " is produced by ", " starring ")
FILMS, FACTS, SUBGRAPH_FACTS, RELATIONS = 5, 5, 4, 20


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, no, line): the lines of each document in order, trimmed."""
    return docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("no", "line")).select("id", "no", F.trim("line").alias("line"))


def _subject(fact: Column, ties: tuple[str, ...]) -> Column:
    out = F.lit(None).cast("string")
    for tie in reversed(ties):
        out = F.when(F.contains(fact, F.lit(tie)), F.trim(F.substring_index(fact, tie, 1))).otherwise(out)
    return out


def _numbered(facts: DataFrame, films: int, each: int) -> DataFrame:
    """Films in the order of their first fact and their facts in order, both limited as the rendering is."""
    first = Window.partitionBy("id", "film")
    facts = facts.withColumn("first", F.min("no").over(first))
    ranked = facts.withColumn("film_no", F.dense_rank().over(Window.partitionBy("id").orderBy("first"))).withColumn("fact_no", F.row_number().over(first.orderBy("no")))
    return ranked.where((F.col("film_no") <= films) & (F.col("fact_no") <= each)).select("id", F.col("film_no").cast("long"), "film", F.col("fact_no").cast("long"), "fact")


def triple_facts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, film_no, film, fact_no, fact) of documents of scored triples: bullets without their score, by the film before the relation."""
    bullets = lines(docs, id_col, text_col).where(F.startswith("line", F.lit("•")))
    facts = bullets.select("id", "no", F.trim(F.substring_index(F.trim(F.substring("line", 2, 1 << 30)), "(score:", 1)).alias("fact"))
    return _numbered(facts.withColumn("film", _subject(F.col("fact"), TIES)).where("film is not null"), FILMS, FACTS)


def subgraph_facts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The same of subgraph documents: bullets after the relationship heading, the first twenty."""
    rows = lines(docs, id_col, text_col)
    order = Window.partitionBy("id").orderBy("no")
    heading = F.contains("line", F.lit("Key relationships:")) | F.contains("line", F.lit("Important relationships"))
    rows = rows.withColumn("after", F.max(heading.cast("int")).over(order)).where((F.col("after") == 1) & F.startswith("line", F.lit("•")))
    rows = rows.select("id", "no", F.trim(F.substring("line", 2, 1 << 30)).alias("fact"), F.row_number().over(order).alias("k")).where(F.col("k") <= RELATIONS)
    return _numbered(rows.withColumn("film", _subject(F.col("fact"), SENTENCES)).where("film is not null"), FILMS, SUBGRAPH_FACTS)


def connected_facts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, section, k, text) of connected-graph documents: seeds (first five) and relationships (first ten) without their scores."""
    rows = lines(docs, id_col, text_col)
    lower = F.lower("line")
    mark = F.when(F.contains("line", F.lit("Seed entities")), "seed").when(F.contains(lower, F.lit("important relationships")), "relationships").when(F.contains(lower, F.lit("graph statistics")), "stats")
    order = Window.partitionBy("id").orderBy("no")
    rows = rows.withColumn("mark", mark).withColumn("section", F.last("mark", ignorenulls=True).over(order)).where("mark is null and line != ''")
    seed = (F.col("section") == "seed") & F.col("line").rlike(r"^[\d-]")
    relation = (F.col("section") == "relationships") & F.col("line").rlike("^[•-]")
    text = F.when(seed, F.col("line")).when(relation, F.trim(F.substring("line", 2, 1 << 30)))
    rows = rows.where(seed | relation).select("id", "no", "section", F.trim(F.substring_index(F.substring_index(text, "[relevance:", 1), "[importance:", 1)).alias("text"))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("id", "section").orderBy("no")).cast("long"))
    return rows.where(F.col("k") <= F.when(F.col("section") == "seed", 5).otherwise(10)).select("id", "section", "k", "text")


def aligned_text(facts: DataFrame, history: DataFrame, heading: str) -> DataFrame:
    """(id, text): the facts as a text under each film, after the history (id, history) they are based on."""
    line = F.struct("film_no", "fact_no", F.concat(F.lit("  - "), "fact").alias("l"))
    films = facts.groupBy("id", "film_no", "film").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["l"]), "\n").alias("body"))
    films = films.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("film_no", F.concat(F.lit("**"), "film", F.lit("**:\n"), "body").alias("b")))), lambda x: x["b"]), "\n\n").alias("body"))
    rows = films.join(history, "id", "left")
    begin = F.when(F.coalesce("history", F.lit("")) != "", F.concat(F.lit("Based on "), "history", F.lit("\n\n"))).otherwise("")
    return rows.select("id", F.concat(begin, F.lit(heading + "\n\n"), "body").alias("text"))


def films_in(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, film_no, film, n_facts, first_fact) of aligned texts: numbered or bold lines name a film, bullets after it are its facts."""
    rows = lines(docs, id_col, text_col)
    heading = F.col("line").rlike(r"^(?:[1-5]\.|\*\*)")
    rows = rows.withColumn("heading", heading).withColumn("film_no", F.sum(heading.cast("long")).over(Window.partitionBy("id").orderBy("no")))
    name = F.trim(F.regexp_replace("line", r"[1-5]\.|\*\*|:", ""))
    for mark in ("(Movie)", "(Resource)", "[score:"):
        name = F.trim(F.substring_index(name, mark, 1))
    fact = F.when(~F.col("heading") & F.col("line").rlike("^[-•]"), F.struct("no", F.trim(F.regexp_replace("line", "^[-•]+", "")).alias("t")))
    rows = rows.where("film_no > 0").select("id", "film_no", F.when(F.col("heading"), name).alias("film"), fact.alias("f"))
    return rows.groupBy("id", "film_no").agg(F.max("film").alias("film"), F.count("f").alias("n_facts"), F.min("f").alias("f")).select("id", "film_no", "film", "n_facts", F.col("f.t").alias("first_fact"))


def alignment_confidence(text: Column, documents: Column, first_score: Column) -> Column:
    """Mean of coverage, length and the first document's score, within 0 and 1; 0 without text or documents."""
    mean = (F.least(F.lit(1.0), documents / 5.0) + F.least(F.lit(1.0), F.length(text) / 200.0) * 0.8 + 0.2 + F.coalesce(first_score, F.lit(0.5))) / 3
    return F.when((F.coalesce(text, F.lit("")) == "") | (F.coalesce(documents, F.lit(0)) == 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean)))
