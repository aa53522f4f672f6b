"""Keyword-stuffed and link-list pages, by the mutual information of neighbouring words.

Corpus counts tell in how many documents each word and each pair of neighbours
stands. The mean pointwise mutual information of a page's pairs separates
sentences (pairs others write too) from word salad (pairs nobody writes); pairs
repeated within a page although hardly any other page has them, and words
likewise, mark stuffed collocations. Each of these raises the score. Mutual
information is taken within the page's own language: the count of the page's
commonest word stands for the number of pages in it. Means are drawn towards
what is usual by a few pairs' weight, so that short pages need more than one
odd pair.

The counts of frequent words and pairs are broadcast up to a bound. For the
rest they are bounded from above, which settles almost every page; pages whose
score the bounds leave open get their exact counts by a join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselkg.session import cut

#: Words, numbers, and words with digits between their letters (written so to get past filters).
TOKEN = re.compile(r"[^\W\d_]+(?:\d+[^\W\d_]+)*|\d+")
#: Characters of scripts that write no blanks; they are words of their own.
CHARACTERS = "\u3040-\u30ff\u3400-\u9fff"
CHARACTER = re.compile(f"[{CHARACTERS}]")
CHARACTER_TOKEN = re.compile(rf"[{CHARACTERS}]|[^\W\d_{CHARACTERS}]+(?:\d+[^\W\d_{CHARACTERS}]+)*|\d+")
#: Words put together in a tag are taken apart.
TAG = re.compile(r"(?<=[a-zß-ÿ])(?=[A-ZÀ-Þ])")
ENTITY = re.compile(r"&#?\w+;")
#: Most counts that are broadcast (16 bytes each).
HOT_COUNTS = 1_000_000
#: Words a worker keeps the hashes of.
MEMORY = 1_000_000
#: Times from which a pair and a word count as repeated within a page, and the share of all pages up to which they are hardly anybody else's.
PAIR_TIMES, WORD_TIMES, PAIR_BELOW, WORD_BELOW = 3, 4, 0.003, 0.06
#: Share of all pages that the counts of a pair are smoothed by: rarer pairs say little, in a corpus of any size.
SMOOTHING = 3e-5
#: The usual incoherence of a page, and the number of pairs (or words) it weighs as much as.
USUAL, PRIOR_WEIGHT = 0.63, 8
#: Share from which more repetition adds nothing: lyrics repeat as much as spam.
FULL_SHARE = 0.5
# Weights of incoherence, repeated pairs and repeated words, and the offset, as ``fit_rule`` gave them from the 5,249 noted pages of the sample sf0.1 (see the README).
WEIGHTS = (5.35, 10.15, 29.75)
OFFSET = -12.85
#: Most labelled pages that a fit reads.
MOST_LABELLED = 20_000

MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
SECOND = np.uint64(0xC2B2AE3D27D4EB4F)


class _Hashes(dict):
    """Hashes of words; numbers count by their length only."""

    def __missing__(self, word: str) -> int:
        if len(self) > MEMORY:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest("0" * len(word) if word.isdecimal() else word)
        return value


_HASHES = _Hashes()


def hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def mixed(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(31))) * MULTIPLY
    return a ^ (a >> np.uint64(29))


def tokens(text: str) -> list[str]:
    if "&" in text:
        text = ENTITY.sub(" ", text)
    if "#" in text:
        text = TAG.sub(" ", text)
    return (TOKEN if text.isascii() or not CHARACTER.search(text) else CHARACTER_TOKEN).findall(text.lower())


class Pages:
    """The words and pairs of a batch of pages as arrays; ``doc`` numbers the pages."""

    def __init__(self, texts: list[str], titles: list[str | None]) -> None:
        flat: list[str] = []
        ends = []
        for t in texts:
            flat += tokens(t)
            ends.append(len(flat))
        self.n = len(texts)
        h = hashes(flat)
        doc = np.repeat(np.arange(self.n), np.diff([0, *ends]))
        names: list[str] = []
        name_ends = []
        for t in titles:
            names += tokens(t) if isinstance(t, str) else []
            name_ends.append(len(names))
        own = np.sort(self._in_doc(hashes(names), np.repeat(np.arange(self.n), np.diff([0, *name_ends]))))
        code = self._in_doc(h, doc)
        titled = own[np.minimum(np.searchsorted(own, code), len(own) - 1)] == code if len(own) else np.zeros(len(h), bool)
        self.length = np.bincount(doc, minlength=self.n)
        self.word, self.word_doc, self.word_times, first = self._unique(h, doc, code)
        self.word_titled = titled[first]
        inside = doc[1:] == doc[:-1]
        self.all_pairs = inside
        a, b, pair_doc = h[:-1][inside], h[1:][inside], doc[1:][inside]
        named = (titled[:-1] | titled[1:])[inside]
        pair = mixed(a * MULTIPLY + mixed(b) + SECOND)
        self.every_pair = self._unique(pair, pair_doc, self._in_doc(pair, pair_doc))[0]
        keep = ~named
        pair, pair_doc, a, b = pair[keep], pair_doc[keep], a[keep], b[keep]
        self.pair, self.pair_doc, self.pair_times, first = self._unique(pair, pair_doc, self._in_doc(pair, pair_doc))
        self.left, self.right = a[first], b[first]

    @staticmethod
    def _in_doc(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
        return mixed(h ^ mixed((doc.astype(np.uint64) + np.uint64(1)) * SECOND))

    @staticmethod
    def _unique(h: np.ndarray, doc: np.ndarray, code: np.ndarray):
        """Each value once per page: value, page, times there, and a place of it."""
        order = np.argsort(code)
        code = code[order]
        start = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
        times = np.diff(np.r_[start, len(code)])
        first = order[start]
        return h[first], doc[first], times, first


def count_words(pages: DataFrame) -> DataFrame:
    """(key, n): in how many pages each word and each pair stands, over all pages; key 0 counts the pages."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = Pages(b["text"].tolist(), [None] * len(b))
            key, n = np.unique(np.concatenate([p.word, p.every_pair]), return_counts=True)
            yield pd.DataFrame({"key": np.r_[np.uint64(0), key].view(np.int64), "n": np.r_[len(b), n].astype(np.int64)})

    return pages.select("text").mapInPandas(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1 or key = 0")


class Counts:
    """Counts by binary search; a key that is not there has between 1 and ``most`` pages."""

    def __init__(self, key: np.ndarray, n: np.ndarray, most: int, total: int) -> None:
        order = np.argsort(key)
        self.key, self.n, self.most, self.total = key[order], n[order], most, total

    def of(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(at least, at most) per key."""
        if not len(self.key):
            return np.ones(len(key)), np.full(len(key), float(self.most))
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        known = self.key[at] == key
        n = self.n[at].astype(np.float64)
        return np.where(known, n, 1.0), np.where(known, n, float(self.most))


def _mean(doc: np.ndarray, x: np.ndarray, weight: np.ndarray, n: int, usual: float) -> np.ndarray:
    """Weighted mean of ``x`` per page, drawn towards the usual value."""
    return (np.bincount(doc, x * weight, n) + PRIOR_WEIGHT * usual) / (np.bincount(doc, weight, n) + PRIOR_WEIGHT)


def measures(p: Pages, counts: Counts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(incoherence, repeated pairs, repeated words) of each page, from exact counts.

    Incoherence is the mean of the negative pointwise mutual information, the page
    itself not counted; a word that no other page has says nothing about its pairs.
    """
    word, pair, a, b = (counts.of(x)[0] for x in (p.word, p.pair, p.left, p.right))
    language = np.ones(p.n)
    np.maximum.at(language, p.word_doc, word)
    own = language[p.pair_doc]
    smooth = max(0.5, SMOOTHING * counts.total)
    lost = np.log((a * b / own + smooth) / (pair - 1 + smooth))
    incoherent = _mean(p.pair_doc, lost, p.pair_times * ((a > 1) & (b > 1)), p.n, USUAL)
    pairs = _mean(p.pair_doc, ((p.pair_times >= PAIR_TIMES) & (pair <= max(2, PAIR_BELOW * counts.total))).astype(float), p.pair_times, p.n, 0.0)
    words = _mean(p.word_doc, ((p.word_times >= WORD_TIMES) & (word <= max(2, WORD_BELOW * counts.total)) & ~p.word_titled).astype(float), p.word_times, p.n, 0.0)
    return incoherent, np.minimum(pairs, FULL_SHARE), np.minimum(words, FULL_SHARE)


def score(p: Pages, counts: Counts) -> np.ndarray:
    """The score of each page; from 0 it is spam."""
    return OFFSET + sum(w * x for w, x in zip(WEIGHTS, measures(p, counts)))


def may_be_spam(p: Pages, counts: Counts) -> np.ndarray:
    """Whether a page's score can reach 0, for any counts within the bounds.

    The means are largest over those uncertain pairs that lie above the mean needed.
    """
    (word_low, _), (pair_low, _), (a_low, a_high), (b_low, b_high) = (counts.of(x) for x in (p.word, p.pair, p.left, p.right))
    language = np.ones(p.n)
    np.maximum.at(language, p.word_doc, word_low)
    pairs = _mean(p.pair_doc, ((p.pair_times >= PAIR_TIMES) & (pair_low <= max(2, PAIR_BELOW * counts.total))).astype(float), p.pair_times, p.n, 0.0)
    words = _mean(p.word_doc, ((p.word_times >= WORD_TIMES) & (word_low <= max(2, WORD_BELOW * counts.total)) & ~p.word_titled).astype(float), p.word_times, p.n, 0.0)
    needed = -(OFFSET + WEIGHTS[1] * np.minimum(pairs, FULL_SHARE) + WEIGHTS[2] * np.minimum(words, FULL_SHARE)) / WEIGHTS[0]
    smooth = max(0.5, SMOOTHING * counts.total)
    above = np.log((a_high * b_high / language[p.pair_doc] + smooth) / (pair_low - 1 + smooth)) - needed[p.pair_doc]
    certain, possible = (a_low > 1) & (b_low > 1), (a_high > 1) & (b_high > 1)
    gain = np.where(certain, above, np.where(possible, np.maximum(above, 0), 0)) * p.pair_times
    return np.bincount(p.pair_doc, gain, p.n) + PRIOR_WEIGHT * (USUAL - needed) >= -1e-9


def fit_weights(x: np.ndarray, spam: np.ndarray, rounds: int = 20_000, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """(weights, offset) of a logistic regression whose weights can't be negative, by projected gradient steps on scaled measures."""
    scale = np.r_[np.maximum(x.std(axis=0), 1e-9), 1.0]
    z = np.c_[x, np.ones(len(x))] / scale
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        w -= 2 * (z.T @ (1 / (1 + np.exp(-(z @ w))) - spam) / len(spam) + decay * np.r_[w[:-1], 0])
        w[:-1] = np.maximum(w[:-1], 0)
    w = w / scale
    return w[:-1], float(w[-1])


def fit_rule(docs: DataFrame, label: str, *, text_col: str = "text", title_col: str = "title", most: int = MOST_LABELLED) -> tuple[np.ndarray, float]:
    """The rule's weights and offset from labelled pages: ``label`` names a boolean column, null where a page has no label.

    Counts cover all of ``docs``; of the labelled pages at most ``most`` are read, chosen by hash.
    """
    pages = docs.select(F.col(text_col).alias("text"), F.col(title_col).alias("title"), F.col(label).alias("label")).where("text is not null")
    counts = count_words(pages).toPandas()
    known = Counts(counts["key"].to_numpy().view(np.uint64), counts["n"].to_numpy(), 1, int(counts.loc[counts["key"] == 0, "n"].sum()))
    rows = pages.where("label is not null").orderBy(F.xxhash64("text"), "title").limit(most).toPandas()
    x = np.stack(measures(Pages(rows["text"].tolist(), rows["title"].tolist()), known), axis=1)
    return fit_weights(x, rows["label"].to_numpy(float))


def find_spam(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", title_col: str = "title", hot_counts: int = HOT_COUNTS) -> DataFrame:
    """(doc_id) of the pages that are mainly repeated keywords, links or product tags; one row per row of ``docs``.

    Null and empty texts are no spam; a short text is if its few pairs are odd enough; a null title excuses no words.
    Counts cover all pages, whole texts. Exact copies count as pages of their
    own, as they do in the corpus. ``id_col`` should be unique where pages are
    left open by the broadcast counts.
    """
    spark = docs.sparkSession
    title = docs[title_col] if title_col in docs.columns else F.lit(None).cast("string")
    pages = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), title.alias("title")).where("text is not null")
    counts = cut(count_words(pages))
    levels = counts.groupBy(F.least("n", F.lit(1000)).alias("level")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("level")).collect()  # at most a thousand rows
    taken, least = 0, 1001
    for r in levels:
        if taken + r["k"] > hot_counts:
            break
        taken, least = taken + r["k"], r["level"]
    total_row = counts.where("key = 0").collect()
    total = total_row[0]["n"] if total_row else 0
    exact = taken == sum(r["k"] for r in levels)
    hot = counts.where((F.col("n") >= least) & (F.col("key") != 0)).toArrow()
    key = hot.column("key").to_numpy().view(np.uint64)
    number = np.minimum(hot.column("n").to_numpy(), 2**31 - 1).astype(np.int32)
    order = np.argsort(key)
    shared = spark.sparkContext.broadcast((key[order], number[order], 1 if exact else least - 1, total))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Counts(*shared.value)
        for b in batches:
            for at in range(0, len(b), 2000):
                part = b.iloc[at : at + 2000]
                p = Pages(part["text"].tolist(), part["title"].tolist())
                spam = score(p, known) >= 0 if exact else np.zeros(len(part), bool)
                left = np.zeros(len(part), bool) if exact else may_be_spam(p, known)
                ask = np.flatnonzero(left)
                wanted: list = [[] for _ in range(len(part))]
                if len(ask):
                    floor = known.most
                    for d in ask:
                        keys = np.concatenate([p.word[p.word_doc == d], p.pair[p.pair_doc == d]])
                        n_low, n_high = known.of(keys)
                        wanted[d] = keys[(n_low == 1) & (n_high == floor)].view(np.int64)
                chosen = spam | left
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[chosen], "open": left[chosen], "wanted": pd.Series([list(w) for w, c in zip(wanted, chosen) if c], dtype=object)})

    judged = pages.mapInPandas(judge, "doc_id long, open boolean, wanted array<long>")
    if exact:  # all counts are within the bound: nothing is left open
        return judged.select("doc_id")
    judged = cut(judged)
    open_pages = judged.where("open")
    found = open_pages.select("doc_id", F.explode("wanted").alias("key")).join(counts, "key").groupBy("doc_id").agg(F.collect_list(F.struct("key", "n")).alias("rare"))

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, n, _, total = shared.value
        for b in batches:
            out = []
            for d, text, name, rare in zip(b["doc_id"], b["text"], b["title"], b["rare"]):
                more = rare if rare is not None else []
                p = Pages([text], [name])
                mine = np.unique(np.concatenate([p.word, p.pair, p.left, p.right]))
                at = np.minimum(np.searchsorted(keys, mine), max(len(keys) - 1, 0))
                held = keys[at] == mine if len(keys) else np.zeros(len(mine), bool)
                own_key = np.concatenate([mine[held], np.array([x["key"] for x in more], np.int64).view(np.uint64)])
                own_n = np.concatenate([n[at[held]] if len(keys) else np.zeros(0), np.array([x["n"] for x in more], np.int64)])
                out += [d] if score(p, Counts(own_key, own_n, 1, total))[0] >= 0 else []
            yield pd.DataFrame({"doc_id": np.array(out, np.int64)})

    settled = pages.join(open_pages.select("doc_id"), "doc_id").join(found, "doc_id", "left").mapInPandas(settle, "doc_id long")
    return judged.where("not open").select("doc_id").unionByName(settled)
