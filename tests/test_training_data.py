"""The general training-data operators on hand-made rows: nulls, empty tables, ties, repeats, clashing columns."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tesselkg.functions import values
from tesselkg.functions.ids import canonical_id, short_predicate
from tesselkg.operators import eager_join, orphans, packed, wide
from tesselkg.plans import training_data

T = lambda d: dt.datetime(2023, 1, d, tzinfo=dt.UTC)


@pytest.mark.parametrize(
    ("given", "plain"),
    [
        ("http://kg.example/resource/Aur%C3%A9l", "Aurél"),
        ("<http://kg.example/resource/A_(film)>", "A_(film)"),
        (" A ", "A"),
        ("A%28film%29", "A(film)"),
        ("a+b", "a+b"),
        ("100%_x", "100%_x"),
        ("Caf\\u00e9", "Café"),
        ("http://other.example/id/9", "http://other.example/id/9"),
        ("", ""),
        (None, None),
    ],
)
def test_ids(spark, given, plain):
    row = spark.createDataFrame([(given,)], "x string").select(canonical_id(F.col("x")).alias("y")).first()
    assert row["y"] == plain


def test_predicates(spark):
    rows = spark.createDataFrame([("http://kg.example/ontology/budget ",), ("<http://kg.example/property/score>",), ("dbo:x",), (None,)], "x string")
    assert [r[0] for r in rows.select(short_predicate(F.col("x"))).collect()] == ["dbo:budget", "dbp:score", "dbo:x", None]


@pytest.mark.parametrize(
    ("kind", "given", "read"),
    [
        ("date", "4 Sep 1926", "1926-09-04"), ("date", "September 4, 1926", "1926-09-04"), ("date", '"1925-06-12"^^<xsd:date>', "1925-06-12"), ("date", "19251131", None), ("date", "2001-02-03T00:00:00Z", "2001-02-03"),
        ("int", "1 h 12 min", "72"), ("int", "PT100M", "100"), ("int", "PT1H5M", "65"), ("int", "99.0", "99"), ("int", "TBA", None), ("int", '"119 min"@en', "119"),
        ("bigint", "US$ 1.4M", "1400000"), ("bigint", "$1,700,000", "1700000"), ("bigint", '"1.057000E+08"^^<xsd:double>', "105700000"), ("bigint", "0.4 million", "400000"), ("bigint", "-", None),
        ("decimal(3,1)", "9,8", "9.8"), ("decimal(3,1)", " 9.90", "9.9"), ("decimal(3,1)", "9.8 / 10", "9.8"), ("decimal(3,1)", "?", None),
        ("boolean", "Y", "true"), ("boolean", "FALSE", "false"), ("boolean", "maybe", None),
        ("string", '"Old_Ostmarkish"@en', "Old Ostmarkish"), ("string", "  Low  Torvic ", "Low Torvic"), ("string", "to be confirmed", None), ("string", "", None),
    ],
)
def test_values(spark, kind, given, read):
    t = spark.createDataFrame([(given,)], "x string").select(values.literal_text(F.col("x")).alias("t"))
    assert t.select(values.READERS[kind](F.col("t"))).first()[0] == read


COLUMNS = [("dbo:budget", "budget", "bigint"), ("dbp:color", "in_colour", "boolean")]


def _eav(spark, rows):
    e = spark.createDataFrame(rows, "entity_id string, predicate string, text string, at timestamp, row long, attr string, val string")
    return e.select("entity_id", "predicate", "text", F.struct("at", "row").alias("version"), "attr", "val")


def test_wide_table(spark):
    cols = spark.createDataFrame(COLUMNS, "predicate string, attr string, attr_type string")
    rows = [
        ("a", "dbo:budget", "1,000", T(1), 1, "x", "y"),
        ("a", "dbo:budget", "unknown", T(9), 2, None, None),  # later but not readable
        ("a", "dbo:budget", "2000", T(3), 3, None, None),
        ("a", "dbo:budget", "2000", T(3), 3, None, None),
        ("a", "dbp:color", "yes", T(1), 4, None, None),
        ("b", "dbp:color", None, T(1), 5, None, None),
        (None, "dbp:color", "no", T(1), 6, None, None),
        ("c", None, "no", T(1), 7, None, None),
        ("d", "dbp:other", "no", T(1), 8, None, None),
    ]
    w, attrs = wide.wide_table(_eav(spark, rows), cols)
    assert attrs == [("budget", "bigint"), ("in_colour", "boolean")]
    assert [tuple(r) for r in w.collect()] == [("a", "2000", "true")]
    typed = wide.typed(w, attrs)
    assert typed.dtypes == [("entity_id", "string"), ("budget", "bigint"), ("in_colour", "boolean")]
    assert sorted(map(tuple, wide.unpivot(typed, attrs).collect())) == [("a", "budget", "2000"), ("a", "in_colour", "true")]
    empty, attrs = wide.wide_table(_eav(spark, []), cols)
    assert (empty.count(), empty.columns) == (0, ["entity_id", "budget", "in_colour"])
    # a type that reads nothing, or none at all, gives way to the one found
    wrong = spark.createDataFrame([("dbo:budget", "budget", "date"), ("dbp:color", "in_colour", None)], "predicate string, attr string, attr_type string")
    assert wide.wide_table(_eav(spark, rows), wrong)[1] == [("budget", "bigint"), ("in_colour", "boolean")]


def test_discovered_types(spark):
    rows = [("a", k, v, T(1), 1, None, None) for k, v in (("n", "1,000,000"), ("n", "US$ 2M"), ("d", "2001-01-01"), ("s", "Velan"), ("s", "?"), ("b", "yes"))]
    got = {r["attr"]: (r["attr_type"], r["n"]) for r in wide.discover_attributes(_eav(spark, rows).drop("attr"), "predicate", "text").collect()}
    assert got == {"n": ("bigint", 2), "d": ("date", 1), "s": ("string", 1), "b": ("boolean", 1)}


def test_hot_keys(spark):
    rows = [("t", "h")] * 98 + [(None, "g"), ("u", None)]
    df = spark.createDataFrame(rows, "kind string, n string")
    got = {(r["field_name"], r["hot_key"], r["n"], r["total"]) for r in eager_join.hot_keys(df, ["kind", "n"], 0.02).collect()}
    assert got == {("kind", "t", 98, 100), ("n", "h", 98, 100)}
    assert eager_join.hot_keys(df.limit(0), ["kind"], 0.02).count() == 0


def test_eager_join_equals_plain_join(spark):
    left = spark.createDataFrame([("a", "x", 1.0), ("a", "x", None), ("b", "y", 2.0), (None, "y", 5.0), ("a", "y", 3.0)], "k string, kind string, v double")
    right = spark.createDataFrame([("a", "x"), ("a", "z"), ("b", "z"), (None, "z")], "k string, kind string")
    got = eager_join.eager_join_aggregate(left, right, F.col("k"), F.col("k"), ["kind"], ["kind"], ["v"])
    assert {tuple(r) for r in got.collect()} == {("x", "x", 2, 1.0, 1), ("x", "z", 2, 1.0, 1), ("y", "x", 1, 3.0, 1), ("y", "z", 2, 5.0, 2)}


def test_keys_in_any_spelling(spark, tmp_path):
    rows = [("x", "<http://kg.example/resource/A>", "B", 0.5), ("y", "http://kg.example/resource/B", " Caf%C3%A9 ", 1.0), ("y", "B", None, 2.0)]
    spark.createDataFrame(rows, "relation_type string, head_entity_id string, tail_entity_id string, confidence double").write.parquet(f"{tmp_path}/relations.parquet")
    spark.createDataFrame([("<http://kg.example/resource/B>", "Movie"), ("Café", "Genre")], "entity_id string, entity_type string").write.parquet(f"{tmp_path}/entities.parquet")
    assert {tuple(r) for r in training_data.p5_join_rollup(spark, str(tmp_path)).collect()} == {("x", "Movie", 1, 0.5, 1), ("y", "Genre", 1, 1.0, 1)}
    assert {tuple(r) for r in training_data.p5_path_counts(spark, str(tmp_path)).collect()} == {("x", "y", 2)}


def test_orphans(spark):
    parents = spark.createDataFrame([("a", T(2), T(5)), ("a", T(2), T(5)), ("a", T(8), None), ("b", T(3), None), (None, T(1), None)], "id string, since timestamp, until timestamp")
    rows = [(1, "head", "a", T(1)), (2, "head", "a", T(2)), (3, "head", "a", T(5)), (4, "head", "a", T(9)), (5, "tail", "zz", T(3)), (6, "tail", None, T(3)), (7, "tail", "b", T(3)), (8, "tail", "b", None)]
    refs = spark.createDataFrame(rows, "row_id long, side string, id string, at timestamp")
    run = lambda p, **k: {(r["row_id"], r["reason"]) for r in orphans.orphan_references(refs, p, parent_key=F.col("id"), since=F.col("since"), until=F.col("until"), **k).collect()}
    expected = {(1, "late"), (2, ""), (3, "deleted"), (4, ""), (5, "missing"), (7, ""), (8, "")}
    assert run(parents) == expected
    assert run(parents, per_batch=1) == expected  # every range is salted
    assert {r for _, r in run(parents.limit(0))} == {"missing"}
    # a parent loaded over and over gives the same answers as its merged form
    often = parents.unionByName(spark.createDataFrame([("a", T(8), None), ("a", T(9), None), ("a", T(2), T(4)), ("b", T(4), T(5))] * 50, "id string, since timestamp, until timestamp"))
    assert run(often) == expected


@pytest.mark.parametrize(
    ("text", "values"),
    [
        (None, []), ("", []), ("[]", []), ("  ", []),
        ('["a, b", "The \\"C\\" d", ""]', ["a, b", 'The "C" d']),
        ("['a', 'b, c']", ["a", "b, c"]),
        ("'a, x', 'b'", ["a, x", "b"]),
        ('"a, b";c ;"The ""C"" d";;', ["a, b", "c", 'The "C" d']),
        ("a||b||c", ["a", "b", "c"]),
        ("A/B / 1/2", ["A/B", "1/2"]),
        ("x\ty", ["x", "y"]),
        ("1. a\n2. b", ["a", "b"]),
    ],
)
def test_lattices(text, values):
    assert [p for pieces, _ in packed.parse_list(text) for p in pieces] == values


def test_options():
    assert [p[0] for p, *_ in packed.parse_options('A: "x, y", B: Great Race, The, C: z')] == ["x, y", "Great Race, The", "z"]
    assert [p[0] for p, *_ in packed.parse_options("a) x\nb) y, A\nc) z")] == ["x", "y, A", "z"]
    assert packed.parse_options(None) == []
    # a due letter that is marked twice makes a lattice over the marks
    ((pieces, _, letters),) = packed.parse_options("A: one, B: two, B: three, C: four")
    assert (pieces, letters) == (["one", "two", "three", "four"], "ABBC")
    split = lambda freq: packed.viterbi(*packed.parse_options("A: one, B: two, B: three, C: four")[0], freq, 1000.0, packed.Patterns(frozenset(), {}))
    assert split({"one": 9, "two, B: three": 9, "four": 9}) == ["one", "two, B: three", "four"]
    assert split({"one, B: two": 9, "three": 9, "four": 9}) == ["one, B: two", "three", "four"]


def test_a_value_may_hold_any_number_of_delimiters():
    letters = [chr(ord("A") + i) for i in range(20)]
    lattice = (letters, [", "] * 19, "")
    empty = packed.Patterns(frozenset(), {})
    assert packed.viterbi(*lattice, {", ".join(letters[:8]): 100_000, ", ".join(letters[8:]): 100_000}, 1e6, empty) == [", ".join(letters[:8]), ", ".join(letters[8:])]
    assert packed.viterbi(*lattice, dict.fromkeys(letters, 1000), 20_000.0, empty) == letters


def test_viterbi_is_exact():
    """Against all splits, with and without counts, under a model fitted on values with commas."""
    import itertools
    import math
    import random

    rng = random.Random(5)
    counts: dict = {}
    for v in ["Great Race, The", "Solo", "One, Two, Three", "Red Boat", "Boat, The"] * 5:
        for t in packed.trigrams(v, frozenset({",", "The"})):
            counts[t] = counts.get(t, 0) + 1
    model = packed.Patterns(frozenset({",", "The"}), counts)

    def pattern(v):
        return sum(model.log(*t) for t in packed.trigrams(v, model.kept))

    for _ in range(60):
        n = rng.randint(2, 8)
        pieces, delims = [rng.choice(["Great Race", "The", "Solo", "One", "Boat", "x9"]) for _ in range(n)], [rng.choice([", ", " | ", "; "]) for _ in range(n - 1)]
        spans = packed.candidates(pieces, delims, "", set(range(n)))
        freq = {v: rng.randint(1, 50) for v in spans if rng.random() < 0.2}
        score = lambda v: math.log(freq.get(v, 0) + packed.PRIOR * math.exp(pattern(v))) - math.log(500 + packed.PRIOR)
        best = -math.inf
        for cut in itertools.product([0, 1], repeat=n - 1):
            ends = [0, *(i + 1 for i, c in enumerate(cut) if c), n]
            best = max(best, sum(score(packed.joined(pieces, delims, "", a, b)) for a, b in itertools.pairwise(ends)))
        got = packed.viterbi(pieces, delims, "", freq, 500.0, model)
        assert math.isclose(sum(map(score, got)), best, rel_tol=1e-9)


def test_split_packed(spark):
    rows = [("h", "t", i, "list", f'["Name{i}, The", "Other of Name{i}", "The Big Name{i}"]') for i in range(200)]
    rows += [("h", "t", 1000, "list", "Name3, The -> Other of Name4 -> Solo, The"), ("h", "t", 1001, "list", "Other of Name9, The Big Name8; Name1, The"), ("h", "t", 1002, "list", None)]
    fields = spark.createDataFrame(rows, "field_name string, family string, row_id long, kind string, text string")
    got = {}
    for r in packed.split_packed(fields).where("row_id >= 1000").orderBy("row_id", "pos").collect():
        got.setdefault(r["row_id"], []).append(r["val"])
    assert got == {1000: ["Name3, The", "Other of Name4", "Solo, The"], 1001: ["Other of Name9", "The Big Name8", "Name1, The"]}
    assert packed.split_packed(fields.limit(0)).count() == 0


def test_words_are_kept_per_family(spark):
    """Seven families of very different sizes: each keeps its own frequent words."""
    rows = [("h", f"f{k}", 1000 * k + i, "list", f'["word{k}a word{k}b thing"]') for k in range(7) for i in range(1 + 100 * (k == 0))]
    certain = spark.createDataFrame([(r[1], r[4][2:-2], 1) for r in rows], "family string, val string, n long")
    models = packed._fit(certain)
    assert all(models[f"f{k}"].kept == {f"word{k}a", f"word{k}b", "thing"} for k in range(7))
