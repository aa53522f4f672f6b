"""Recommendation samples: strict and tolerant readers, key aliases, synthetic samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tesselkg.functions.prompts import mentions

SAMPLE = "input string, questions string, output string, sequence_ids string"
# Names under which samples carry their parts, the first that is there holds.
QUERY, TRUTH = ("query", "input", "question"), ("answer", "label", "ground_truth")
#: Words of the generator.
KINDS = ("comedy", "drama", "thriller", "documentary", "western")
WISHES = ("for a quiet evening", "with a good score", "by a famous director", "set by the sea")
FORMS = ("Recommend a {kind} {wish}", "Which {kind} {wish} should I see?", "I would like a {kind} {wish}", "Suggest something {wish}, maybe a {kind}")
USERS = ("newcomer", "regular", "collector", "critic", "family")
MOODS = ("curious", "tired", "in a hurry", "open to anything")
FOLLOW_UPS = ("And one more like {mention}?", "Why {mention}?", "Something other than {mention}, please, {wish}")
PRODUCTS = tuple(f"{size} {thing}" for size in ("small", "large", "old", "new") for thing in ("camera", "projector", "screen", "poster", "record"))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Samples of a JSON array (or a single object, as one row) with their place as sample_idx; a missing file text that is no JSON and samples without any part give no rows."""
    try:
        rows = spark.read.schema(SAMPLE).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    except AnalysisException:
        rows = spark.createDataFrame([], SAMPLE)
    rows = rows.where(F.coalesce("input", "questions", "output", "sequence_ids").isNotNull())
    return rows.select(F.monotonically_increasing_id().alias("sample_idx"), "*")


def _first(df: DataFrame, names: tuple[str, ...], default: Column) -> Column:
    there = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*there, default)


def normalise(rows: DataFrame) -> DataFrame:
    """(query, options, ground_truth, user_context) from samples under any of the known names; choices are lettered from A."""
    lettered = F.lit(None).cast("map<string,string>")
    if "choices" in rows.columns:
        lettered = F.map_from_entries(F.transform("choices", lambda x, i: F.struct(F.char(i + 65).alias("k"), x.alias("v"))))
    options = [F.col("options")] if "options" in rows.columns else []
    context = reduce(lambda a, b: F.coalesce(a, b), [F.col(n).cast("string") for n in ("user_context", "context") if n in rows.columns], F.lit(None).cast("string"))
    empty = F.create_map().cast("map<string,string>")
    return rows.select(_first(rows, QUERY, F.lit("")).alias("query"), F.coalesce(*options, lettered, empty).alias("options"), _first(rows, TRUTH, F.lit(None).cast("string")).alias("ground_truth"), context.alias("user_context"))


def _pick(words: tuple[str, ...], seed: int, salt: int) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(len(words))) + 1).cast("int"))


def _put(form: Column, **values: Column) -> Column:
    for name, value in values.items():
        form = F.replace(form, F.lit("{" + name + "}"), value)
    return form


def generate(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """``n`` synthetic samples (sample_idx, query, user_type, mood): texts by hash, user types in turn."""
    query = _put(_pick(FORMS, seed, 0), kind=_pick(KINDS, seed, 1), wish=_pick(WISHES, seed, 2))
    user = F.element_at(F.array(*map(F.lit, USERS)), (F.col("id") % len(USERS) + 1).cast("int"))
    return spark.range(n).select(F.col("id").alias("sample_idx"), query.alias("query"), user.alias("user_type"), _pick(MOODS, seed, 3).alias("mood"))


def follow_ups(samples: DataFrame, seed: int = 0) -> DataFrame:
    """(sample_idx, follow_up): a question after each sample about its first long word, 'that' where it has none."""
    rows = samples.select(F.col("sample_idx").alias("id"), mentions(F.col("query")).alias("m"))
    return rows.select(F.col("id").alias("sample_idx"), _put(_pick(FOLLOW_UPS, seed, 4), mention=F.coalesce(F.get("m", F.lit(0)), F.lit("that")), wish=_pick(WISHES, seed, 5)).alias("follow_up"))


def generate_documents(spark: SparkSession, each: int = 5) -> DataFrame:
    """(doc_id, product, text): ``each`` documents of every product."""
    n = len(PRODUCTS)
    product = F.element_at(F.array(*map(F.lit, PRODUCTS)), (F.col("id") % n + 1).cast("int"))
    number = F.floor(F.col("id") / n) + 1
    return spark.range(n * each).select(F.col("id").alias("doc_id"), product.alias("product"), F.concat(F.lit("Review "), number.cast("string"), F.lit(" of the "), product, F.lit(".")).alias("text"))
