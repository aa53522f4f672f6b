"""The operators on text and vectors against brute force, exact round trips and hand-made cases."""

import random
import unicodedata

import numpy as np
import pytest

from tesselkg.llm import leaks, mojibake, neighbours, spam, truncation, word_tokens


# --- nearest vectors


def _clusters(n, seed, dims=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(2, n // 30), dims))
    x = centres[rng.integers(0, len(centres), n)] + 0.25 * rng.normal(size=(n, dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _truth(x, k):
    s = x @ x.T
    np.fill_diagonal(s, -9)
    return np.argsort(-s, axis=1)[:, :k]


def test_graph_recall():
    x = _clusters(700, 1).astype(np.float32)
    ids, _ = neighbours.shard_neighbours(x, 5)
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(ids, _truth(x, 5))]) > 0.97


def test_neighbours_over_shards(spark):
    x = _clusters(900, 2)
    rows = [(i, "a" if i % 3 else "b", v.tolist(), "extra") for i, v in enumerate(x)]
    rows += [(2000, "a", None, ""), (2001, "a", [0.0] * 16, ""), (2002, None, x[0].tolist(), ""), (2003, "a", [1.0], ""), (2004, "lone", x[0].tolist(), "")]
    df = spark.createDataFrame(rows, "vec_id long, t string, embedding array<double>, kind string")
    from pyspark.sql import functions as F

    got = neighbours.nearest_neighbours(df, kind=F.col("t"), k=5, shard=120, split=200).collect()
    assert {r["id"] for r in got} == set(range(900))
    found = {}
    for r in got:
        found.setdefault(r["id"], set()).add(r["other"])
    hits = []
    for part in ([i for i in range(900) if i % 3], [i for i in range(900) if not i % 3]):
        t = _truth(x[part], 5)
        hits += [len(found[i] & {part[j] for j in row}) / 5 for i, row in zip(part, t)]
    assert np.mean(hits) > 0.9
    assert neighbours.nearest_neighbours(df.limit(0), kind=F.col("t")).count() == 0


def test_copies_of_one_vector(spark):
    x = _clusters(60, 3)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100 + i, x[0].tolist()) for i in range(9)] + [(3, x[3].tolist())]
    got = neighbours.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5).collect()
    assert {r["other"] for r in got if r["id"] == 108} == {0, 100, 101, 102, 103}
    assert all(sum(r["id"] == i for r in got) == 5 for i in range(60))


def _recall(spark, x, k=5, **how):
    got = {}
    for r in neighbours.nearest_neighbours(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), k=k, **how).collect():
        got.setdefault(r["id"], set()).add(r["other"])
    return np.mean([len(got.get(i, set()) & set(t)) / k for i, t in enumerate(_truth(x, k))])


def test_hundreds_of_crowded_cells(spark):
    """Small shards, samples and fans: cells are divided turn after turn, each by its own centroids, and routed in blocks."""
    assert _recall(spark, _clusters(3000, 8), shard=24, split=30, sample=256, fan=64, block=50) > 0.85


def test_cells_too_dense_to_divide(spark):
    """No centroids can be fitted on so small a sample: parts by hash, every part asked."""
    assert _recall(spark, _clusters(600, 9), shard=50, split=100, sample=4) > 0.95


def test_lengths_are_kept_apart(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(_clusters(30, 1))] + [(100 + i, v.tolist()) for i, v in enumerate(_clusters(20, 2, dims=3))]
    got = neighbours.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5).collect()
    assert {r["id"] for r in got} == {*range(30), *range(100, 120)}
    assert all((r["id"] < 100) == (r["other"] < 100) for r in got)


# --- wrong decodings


def test_restores_every_pair():
    texts = ["Björvin Köre", "L’été de Midynele", "Последний Саворесо", "Mañana, Łukor", "静かな港 Gona", "Ο Δαωυλεβε", "A Canção de Tomaž"]
    counts = {}
    for t in texts * 40 + ["plain words in a sentence"] * 200:
        for c in t:
            counts[c] = counts.get(c, 0) + 1
    model = mojibake.Model(counts)
    for t in texts:
        assert mojibake.label(t, model) == (t, False)
        for true, wrong in mojibake.PAIRS:
            if true != "utf-8":
                continue
            bad = t
            for w in wrong:
                bad = mojibake.wrong(bad.encode("utf-8"), w, False)
            restored, found = mojibake.label(bad, model)
            assert found, (t, wrong)
            assert restored == t, (t, wrong, restored)
    assert mojibake.label("Aur�lke", model) == ("Aur�lke", True)
    assert mojibake.label("Ïîñëåäíèé Ñàâîðåñî", model) == ("Последний Саворесо", True)


def test_find_garbled(spark):
    rows = [("e", i, "Köre") for i in range(50)] + [("e", 100, "KÃ¶re"), ("e", 100, "KÃ¶re"), ("e", 101, None), ("e", 102, ""), ("t", 103, "SÃO PAULO"), ("t", 104, "K�re"), ("t", 105, "x" * 5000 + "Ã¶")]
    got = mojibake.find_garbled(spark.createDataFrame(rows, "tbl string, row_id long, text string")).collect()
    assert sorted((r["tbl"], r["row_id"]) for r in got) == [("e", 100), ("e", 100), ("t", 104), ("t", 105)]
    assert {r["restored"] for r in got if r["row_id"] == 100} == {"Köre"}
    assert mojibake.find_garbled(spark.createDataFrame([], "tbl string, row_id long, text string")).count() == 0


def test_alphabet_of_any_size(spark):
    """Every character of a large alphabet counts, the rare ones too."""
    wide = [chr(c) for c in range(0x3400, 0x3400 + 60_000) if not 0xD800 <= c < 0xE000]
    texts = spark.createDataFrame([("".join(wide[i : i + 1000]),) for i in range(0, len(wide), 1000)], "text string")
    assert mojibake._counts(texts) == dict.fromkeys(wide, 1.0)


# --- truncation


def test_truncation(spark):
    import json

    rng = random.Random(1)
    words = "the old pilot crossed a silent harbour while seven bright lanterns burned above every narrow street of town".split()
    def text(n):
        return " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."

    rows = []
    for i in range(400):
        t = text(rng.randint(8, 40))
        rows.append((i, "good", json.dumps({"abstract": t, "n": 1})))
    long = []
    for i in range(400, 520):
        t = text(40)
        rows.append((i, "short", json.dumps({"abstract": t[:100]})))
        if not t[:100].endswith("."):
            long.append(i)
    rows += [(900, "good", None), (901, "good", ""), (902, "good", '{"abstract": "The old pil'), (903, None, '{"abstract": " "}'), (904, "good", "no json")]
    df = spark.createDataFrame(rows, "row_id long, source string, attributes string")
    got = {r["row_id"] for r in truncation.find_truncated(df).select("row_id").distinct().collect()}
    assert got == {*long, 902}
    rates = {r["source"]: r["n_cut"] for r in truncation.truncation_rates(df).collect()}
    assert rates["short"] == len(long)
    assert truncation.find_truncated(df.limit(0)).count() == 0


def _cut_values(spark, rows):
    return {(r["row_id"], r["reason"]) for r in truncation.find_cut_values(spark.createDataFrame(rows, "row_id long, source string, col string, val string")).collect()}


def test_truncation_is_the_same_under_small_bounds(spark, monkeypatch):
    """Salted runs of words, a full bitmap and joins instead of broadcasts change nothing."""
    rng = random.Random(5)
    words = "the old pilot crossed a silent harbour while seven bright lanterns burned above every narrow street of town".split()
    rows = []
    for i in range(600):
        t = " ".join(rng.choice(words) for _ in range(rng.randint(8, 30))).capitalize() + "."
        rows.append((i, "a" if i % 2 else "b", "text", t if i % 5 else t[: len(t) - 4]))
    expected = _cut_values(spark, rows)
    assert {i for i, _ in expected} & set(range(0, 600, 5))
    for name, value in (("HOT_ASKED", 3), ("BITMAP", 64), ("MOST_COLUMNS", 0)):
        monkeypatch.setattr(truncation, name, value)
    assert _cut_values(spark, rows) == expected


def test_every_column_is_judged(spark):
    """More than ten thousand columns, and one of short texts: names cut at twelve characters by one source."""
    rng = random.Random(6)
    part = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9)))
    rows = [(i, "s", f"key{i}", "whatever stands here") for i in range(10_050)]
    cut = set()
    for i in range(20_000, 20_400):
        name = f"{part()} {part()}"
        rows.append((i, "short" if i % 2 else "full", "name", name[:12] if i % 2 else name))
        if i % 2 and len(name) > 12 and name[12] != " " and name[:12].rstrip() == name[:12]:
            cut.add(i)
    rows += [(i, "code", "id", part()[:3] + str(1000 + i)) for i in range(30_000, 30_050)]  # codes of one width are no cuts
    got = {i for i, _ in _cut_values(spark, rows)}
    assert len(cut - got) < 0.05 * len(cut)
    assert not [i for i in got if i < 20_000 or i >= 30_000 or not i % 2]


# --- tokens


@pytest.mark.parametrize("hot", [200_000, 5, 0])
def test_tokens_equal_the_tokenizer(spark, hot):
    texts = ["Hello, world! it's 2023  \n\n x", "", None, "   ", "a  b <|endoftext|> 'S Zürich 静かな港 ½", "\U0001faf8 new emoji", "y" * 3000, "Hello, world! it's 2023  \n\n x"]
    df = spark.createDataFrame([(i, t, "ids") for i, t in enumerate(texts)], "doc_id long, text string, words string")
    enc = word_tokens.encoding("byte_bpe_50k", word_tokens.VOCABULARIES, word_tokens.TOKENIZER_PATTERN)
    got = {r["doc_id"]: list(r["ids"]) for r in word_tokens.encode_corpus(df, hot_words=hot).collect()}
    assert got == {i: enc.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert word_tokens.encode_corpus(df.limit(0), hot_words=hot).count() == 0


def test_tokens_round_trip(spark):
    texts = {0: "Über den Fluß\n", 1: "", 2: "ab" * 500}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in word_tokens.decode_corpus(word_tokens.encode_corpus(df)).collect()} == texts


# --- leaks

ITEM = "After thirty evenings with Kyvelari Film which documentary or melodrama about a curious tavern would Edvin Gukerélé have inherited from the old harbour town near Wexholm in spring"


def _edited(part, rng, k, kind):
    """``part`` with ``k`` words changed, dropped or inserted, evenly spread or at random places."""
    places = [(x + 1) * len(part) // (k + 1) for x in range(k)] if kind in ("spread", "spread drop", "spread insert") else sorted(rng.sample(range(len(part)), k))
    out = part.copy()
    for place in reversed(places):
        if "drop" in kind:
            del out[place]
        elif "insert" in kind:
            out.insert(place, f"new{rng.randrange(99)}")
        else:
            out[place] = f"other{rng.randrange(99)}"
    return out


@pytest.mark.parametrize("kind", ["spread", "random", "spread drop", "random drop", "spread insert", "random insert"])
def test_every_passage_of_the_definition_is_found(kind):
    """Against the exhaustive alignment of the item with the whole text, without a candidate step: nothing is missed."""
    rng = random.Random(kind)
    items, texts = [], []
    for length in range(18, 41):
        for k in range(length // 5 + 1):
            for begin in ("start", "inside", "end"):
                item = [f"w{rng.randrange(3000)}" for _ in range(length + (0 if length < 20 and begin == "start" else 15))]
                at = {"start": 0, "inside": rng.randrange(len(item) - length + 1), "end": len(item) - length}[begin]
                part = _edited(item[at : at + length], rng, k, kind)
                items.append((len(items), " ".join(item)))
                texts.append(" ".join([f"x{i}" for i in range(30)] + part + [f"y{i}" for i in range(30)]))
    sketches = leaks.Sketches(items)
    found = {t for t, i in zip(*sketches.found_in(texts)) if t == i}
    words = [np.array([sketches.vocabulary.get(x, 0) for x in t.split()], np.int64) for t in texts]
    held = {n for n, w in enumerate(words) if leaks.aligned(sketches.words[n], w)}
    assert held == set(range(len(items)))
    assert found == held


def test_size_partitions():
    short, long = (leaks.SizePartition(*b) for b in leaks.partition_bounds(31))
    assert (short.least, short.most, short.exact, short.size, short.hits) == (18, 19, 7, 14, 4)
    assert (long.least, long.most, long.exact, long.size, long.hits) == (20, 31, 6, 15, 4)
    assert leaks.partition_bounds(70)[-1] == (64, 127)


def test_leaks(spark):
    w = ITEM.split()
    filler = "Some quite different sentence about nothing in particular stands here. " * 5
    changed = w[2:22].copy()
    for k in (3, 9, 15):
        changed[k] = "other"
    too_many = w[2:22].copy()
    for k in range(0, 20, 3):
        too_many[k] = "other"
    docs = [
        (1, filler + ITEM + filler), (2, filler + " ".join(changed) + filler), (3, filler + " ".join(too_many) + filler), (4, " ".join(w[:14])), (5, None), (6, ""),
        (7, filler + " ".join(w[5:23]).upper()), (8, "''" + " [[x|".join([" ".join(w[:6]), w[6] + "]] " + " ".join(w[7:24])]) + "<ref>note here</ref>"),
        (9, unicodedata.normalize("NFD", ITEM)), (1, filler + ITEM),
    ]
    d = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, item_id long")
    items = spark.createDataFrame([(7, ITEM), (8, "too short to leak"), (9, None)], "item_id long, item_text string")
    for block in (1, 100):
        got = [(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(d, items, block=block).collect()]
        assert sorted(got) == [(1, 7), (1, 7), (2, 7), (7, 7), (8, 7), (9, 7)]
    assert leaks.find_leaks(d.limit(0), items).count() == 0
    assert leaks.find_leaks(d, items.limit(0)).count() == 0


def test_alignment_against_brute_force():
    rng = random.Random(4)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(prev + (x != y), row[j] + 1, row[j - 1] + 1)
        return row[-1]

    for _ in range(25):
        item = [rng.randint(1, 50) for _ in range(24)]
        region = item[rng.randint(0, 4) : rng.randint(19, 24)]
        for _ in range(rng.randint(2, 6)):
            k = rng.randrange(len(region))
            region[k : k + 1] = rng.choice([[], [rng.randint(1, 50)], [region[k], 99]])
        region = [0, 0, *region, 0]
        brute = any(distance(item[i : i + n], region[a:b]) <= n * 0.2 for n in range(18, 25) for i in range(24 - n + 1) for a in range(len(region)) for b in range(a + 12, len(region) + 1))
        assert leaks.aligned(np.array(item), np.array(region)) == brute


# --- spam


def _prose(rng, nouns):
    return " ".join(f"The {rng.choice(nouns)} of the town was closed and the crew moved to the {rng.choice(nouns)} again." for _ in range(8))


def test_spam(spark):
    """Word salad, repeated keywords, tag lists and a short keyword stub against prose, lyrics, mash and redirects; the same with few broadcast counts."""
    rng = random.Random(2)
    nouns = [f"noun{c}{d}" for c in "abcdefghijklmnopqrst" for d in "xyzw"]
    keywords = ["casino", "cheap", "voucher", "replica", "torrent", "deal", "outlet", "loan", *(f"offer{c}" for c in "abcdefghijklmnopqrstuvwxyz")]
    rows = [(i, f"{_prose(rng, nouns)} No {rng.choice(keywords)} and no {rng.choice(keywords)} was seen.", "T") for i in range(1500)]
    spam_rows = [(5000 + i, " ".join(rng.choice([*keywords, "nounax", "nounax"]) for _ in range(80)), None) for i in range(12)]
    spam_rows += [(5020 + i, "The crew moved to the town again. " + " | ".join(f"{rng.choice(keywords)} {rng.choice(nouns)} {rng.choice(keywords)}" for _ in range(40)), "T") for i in range(12)]
    spam_rows += [(5040, "cheap voucher nounax cheap voucher nounax cheap voucher nounax cheap voucher", "T")]
    tags = [f"tag{c}{d}" for c in "abcdefghij" for d in "klmnop"]
    spam_rows += [(5041, " ".join(tags * 5), "T"), (5042, " ".join(tags), "T")]  # 60 tags five times: each is under a fiftieth of the page
    rows += spam_rows + [(6000, "#REDIRECT [[nounax]]", "T"), (6001, "qwlkje aslkdjq pqowie zmxnbc " * 3, "T"), (6002, None, None), (6003, "", ""), (6004, "short", "x"), (6005, _prose(rng, nouns) + " " + _prose(rng, nouns), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, title string")
    got = sorted(r[0] for r in spam.find_spam(df).collect())
    for few in (0, 20, 100):
        assert sorted(r[0] for r in spam.find_spam(df, hot_counts=few).collect()) == got
    assert not [i for i in got if i < 5000 or i >= 6000]
    assert set(range(5000, 5012)) | set(range(5020, 5032)) | {5041} <= set(got)
    assert spam.find_spam(df.limit(0)).count() == 0
    assert sorted(r[0] for r in spam.find_spam(df.drop("title")).collect())


def test_repetition_raises_the_score():
    assert min(spam.WEIGHTS) > 0
    once = "red boat near old mill by grey hill over wide lake under dark sky"
    pages = spam.Pages([once, f"{once} {once}", " ".join([once] * 4)], [None] * 3)
    held = spam.Counts(np.unique(np.concatenate([pages.word, pages.every_pair])), np.full(len(np.unique(np.concatenate([pages.word, pages.every_pair]))), 2), 1, 3)
    low, mid, high = spam.score(pages, held)
    assert max(low, mid) < high


def test_the_rule_can_be_fitted(spark):
    rng = random.Random(4)
    nouns = [f"noun{c}" for c in "abcdefghijklmnopqrst"]
    rows = [(_prose(rng, nouns), "T", False) for _ in range(80)] + [(" ".join(rng.choice(["cheap", "deal", *nouns]) for _ in range(60)), "T", True) for _ in range(20)] + [(None, None, True), ("x", None, None)]
    weights, offset = spam.fit_rule(spark.createDataFrame(rows, "text string, title string, y boolean"), "y")
    assert (weights >= 0).all() and weights[0] > 0 and offset < 0
