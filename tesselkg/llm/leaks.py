"""Held-out evaluation texts inside a training corpus.

Short items are searched inside long documents by containment, not by the
similarity of whole texts. Items are partitioned by their size in words; of each
passage of an item (every window of the least length) a bottom-k MinHash sketch
of its word shingles is kept. The share of a sketch that a region of a document
holds estimates how much of the passage it contains, whatever the size of the
document. Each partition has its own sketch size and least share, derived from
what the definition of a passage guarantees, so no passage within the
definition falls below them. Candidates are verified by their exact shingles
and, in the end, by an exact alignment of words.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Words of a shingle. TESTDATA.md counts passages with one word in five changed, which leave no shingle of five.
SHINGLE = 3
#: Least passage in words, and the share of its words that may be changed, dropped or inserted.
LEAST_WORDS, MOST_CHANGED = 18, 0.2
#: Shingles of a passage of the least length, and the longest passage that has to be looked at: a longer one falls into two, of which one has no greater share of changes.
SPAN, LONGEST = LEAST_WORDS - SHINGLE + 1, 2 * LEAST_WORDS
#: Sketched shingles near one diagonal that make a candidate. The sketch of each size partition is as small as still guarantees so many.
LEAST_HITS = 4
#: Words that the longest passage may take in a document, and how far its edits move a diagonal.
WIDTH, DRIFT = int(LONGEST * (1 + MOST_CHANGED)) + 2, int(LONGEST * MOST_CHANGED)
#: Odd factor of the sketches' hash.
FACTOR = np.int64(0x5851F42D4C957F2D)
#: Items whose sketches are held by each task at a time; more are searched in blocks of so many.
BLOCK = 20_000

NOTE = re.compile(
    r"<ref\b[^>]*/>|<ref\b[^>]*>.*?</ref\s*>|<!--.*?-->|\{\{\s*(?:citation needed|cn|fact|efn|sfn|refn|note|clarify|who|when|by whom|dubious)\b[^{}]*\}\}|\[\d{1,3}\]",
    re.S | re.I,
)
LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]*)\]\]")
WEB_LINK = re.compile(r"\[(?:https?:)?//\S+([^\]]*)\]")
TAG = re.compile(r"</?[A-Za-z][^<>]*>")
HIDDEN = re.compile("[­​-‏⁠﻿]|'{2,}")
WORD = re.compile(r"[^\W_]+")


def plain_words(text: str) -> list[str]:
    """The words of a text without notes and markup, in one case and one encoding of accents."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text or "{{" in text or "[" in text:
        text = NOTE.sub(" ", text)
        if "[[" in text:
            text = LINK.sub(r"\1", text)
        if "//" in text:
            text = WEB_LINK.sub(r"\1", text)
        if "<" in text:
            text = TAG.sub("", text)
    text = HIDDEN.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return WORD.findall(text.lower())


def intact(words: int) -> int:
    """Shingles that the densest allowed edits leave of a passage of so many words."""
    return words - SHINGLE + 1 - SHINGLE * int(words * MOST_CHANGED)


class SizePartition:
    """Items between ``least`` and ``most`` words, with the sketch size that is enough for their passages.

    A bottom-k sketch leaves out SPAN - k shingles of each window, so of a passage
    covered by w windows at most w times as many. ``exact`` is the least number of
    whole shingles that a passage keeps, ``hits`` the least number of sketched ones.
    """

    def __init__(self, least: int, most: int) -> None:
        self.least, self.most = least, most
        lengths = range(LEAST_WORDS, min(most, LONGEST) + 1)
        self.exact = min(map(intact, lengths))
        kept = lambda left_out: min(intact(n) - left_out * -(-(n - SHINGLE + 1) // SPAN) for n in lengths)
        left_out = max(x for x in range(SPAN) if x == 0 or kept(x) >= LEAST_HITS)
        self.size, self.hits = SPAN - left_out, kept(left_out)
        self.code = self.item = self.at = np.zeros(0, np.int64)

    def fill(self, members: list[tuple[int, np.ndarray]]) -> None:
        """Sketches of the items (number, shingle codes): code -> places in the items, sorted for binary search."""
        codes, items, places = [], [], []
        for k, c in members:
            with np.errstate(over="ignore"):
                mixed = (c ^ (c >> 17)) * FACTOR
            windows = np.lib.stride_tricks.sliding_window_view(mixed ^ (mixed >> 29), SPAN)
            least = np.argsort(windows, axis=1, kind="stable")[:, : self.size] + np.arange(len(windows))[:, None]
            kept = np.unique(least)
            codes.append(c[kept])
            items.append(np.full(len(kept), k))
            places.append(kept)
        code = np.concatenate(codes)
        order = np.argsort(code, kind="stable")
        self.code, self.item, self.at = code[order], np.concatenate(items)[order], np.concatenate(places)[order]


def partition_bounds(longest: int) -> list[tuple[int, int]]:
    """The size partitions up to ``longest`` words: those too short for the densest edits, then by doubling."""
    cuts = [LEAST_WORDS, 20, 32]
    while cuts[-1] <= longest:
        cuts.append(cuts[-1] * 2)
    return [(a, b - 1) for a, b in zip(cuts, cuts[1:])]


class Sketches:
    """The sketches of a block of items, by size partition."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.ids, self.words, self.vocabulary = [], [], {}
        for item, text in items:
            w = plain_words(text or "")
            if len(w) >= LEAST_WORDS:  # a shorter item holds no passage
                self.ids.append(item)
                self.words.append(np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w], np.int64))
        self.base = len(self.vocabulary) + 1
        every = [self.codes(w) for w in self.words]
        self.whole = [np.unique(c) for c in every]
        self.partitions = []
        for least, most in partition_bounds(max(map(len, self.words), default=0)):
            members = [(k, every[k]) for k, w in enumerate(self.words) if least <= len(w) <= most]
            if members:
                self.partitions.append(SizePartition(least, most))
                self.partitions[-1].fill(members)

    def codes(self, w: np.ndarray) -> np.ndarray:
        """One integer per shingle; a word no item has makes it -1."""
        n = len(w) - SHINGLE + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        out, known = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(SHINGLE):
            part = w[k : k + n]
            known &= part > 0
            out = out * self.base + part
        return np.where(known, out, -1)

    def exact(self, k: int, code: np.ndarray) -> np.ndarray:
        """Which of the shingle codes are in item ``k`` at all, sketched or not."""
        own = self.whole[k]
        return own[np.minimum(np.searchsorted(own, code), len(own) - 1)] == code

    def found_in(self, texts: list[str]) -> tuple[list[int], list[int]]:
        """The (text number, item) pairs where the text holds a passage of the item; the texts are searched as one array."""
        flat: list[str] = []
        ends = []
        for t in texts:
            flat += plain_words(t)
            flat.append("")  # no shingle spans two texts
            ends.append(len(flat))
        if not self.partitions or not flat:
            return [], []
        w = np.fromiter(map(self.vocabulary.get, flat, repeat(0)), np.int64, len(flat))
        c = self.codes(w)
        known = np.flatnonzero(c >= 0)
        found_text, found_item = [], []
        for p in self.partitions:
            low = np.searchsorted(p.code, c[known], "left")
            some = p.code[np.minimum(low, len(p.code) - 1)] == c[known]
            at, low = known[some], low[some]
            many = np.searchsorted(p.code, c[at], "right") - low
            entry = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            item, i, j = p.item[entry], p.at[entry], np.repeat(at, many)
            text = np.searchsorted(np.array(ends), j, "right")
            group = text * len(self.ids) + item
            order = np.lexsort((i, j, group))
            group, i, j = group[order], i[order], j[order]
            first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
            last = np.r_[first[1:], len(group)] if len(first) else first
            enough = last - first >= p.hits
            for a, b in zip(first[enough], last[enough]):
                d, k = divmod(int(group[a]), len(self.ids))
                begin = ends[d - 1] if d else 0
                if self._holds(p, k, i[a:b], j[a:b] - begin, w[begin : ends[d] - 1], c[begin : ends[d] - SHINGLE]):
                    found_text.append(d)
                    found_item.append(self.ids[k])
        return found_text, found_item

    def _holds(self, p: SizePartition, k: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, code: np.ndarray) -> bool:
        """Regions that hold enough of a sketch near one diagonal, their exact shingles, then the exact alignment of the words there."""
        near = np.searchsorted(j, j + WIDTH, "right")
        regions: list[list[int]] = []
        for a in range(len(j)):
            b = near[a]
            if b - a < p.hits:
                continue
            d = j[a:b] - i[a:b]
            close = np.abs(d - d[0]) <= DRIFT
            if len(np.unique(i[a:b][close])) < p.hits:
                continue
            lo, hi = int(j[a]), int(j[a:b][close].max()) + SHINGLE
            if regions and lo <= regions[-1][1] + WIDTH:
                regions[-1][1] = max(hi, regions[-1][1])
            else:
                regions.append([lo, hi])
        for lo, hi in regions:
            lo, hi = max(0, lo - WIDTH), hi + WIDTH
            if np.count_nonzero(self.exact(k, code[lo:hi])) >= p.exact and aligned(self.words[k], w[lo:hi]):
                return True
        return False


def aligned(item: np.ndarray, region: np.ndarray) -> bool:
    """Whether some passage of at least LEAST_WORDS words of ``item`` is in ``region`` with few enough changes.

    Edit distances by words for every start in the item at once; the place in the
    region is free. Passages of up to twice the least length are enough: a longer
    one falls into two of which one has no greater share of changes.
    """
    n, m = len(item), len(region)
    if n < LEAST_WORDS or m < LEAST_WORDS * (1 - MOST_CHANGED):
        return False
    ramp = np.arange(m + 1, dtype=np.int32)
    begin = np.arange(n - LEAST_WORDS + 1)
    edits = np.zeros((len(begin), m + 1), np.int32)
    for length in range(1, min(n, 2 * LEAST_WORDS) + 1):
        new = np.empty_like(edits)
        new[:, 0] = length
        new[:, 1:] = np.minimum(edits[:, :-1] + (item[begin + length - 1][:, None] != region[None, :]), edits[:, 1:] + 1)
        edits = np.minimum.accumulate(new - ramp, axis=1) + ramp
        best = edits.min(axis=1)
        if length >= LEAST_WORDS and (best <= length * MOST_CHANGED).any():
            return True
        # starts from which no passage can stay within its share of changes are left
        alive = (best <= np.minimum(n - begin, 2 * LEAST_WORDS) * MOST_CHANGED) & (begin + length < n)
        if not alive.all():
            begin, edits = begin[alive], edits[alive]
            if not len(begin):
                return False
    return False


def find_leaks(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "item_text", block: int = BLOCK
) -> DataFrame:
    """(doc_id, item_id) for every document that holds a passage of an item, each pair once per row of ``docs``.

    Null and empty texts hold nothing; items shorter than a passage are never
    found; repeated items are reported each. Documents are read whole and never
    shuffled. The items are a stated, small set: their sketches go to the tasks
    in blocks of ``block`` items, each block a pass over the documents.
    """
    spark = docs.sparkSession
    rows = items.select(items[item_id].cast("long").alias("i"), items[item_text].alias("t")).where("i is not null and t is not null").orderBy("i")
    n = rows.count()
    corpus = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).where("text is not null")
    out = spark.createDataFrame([], "doc_id long, item_id long")
    listed = rows.toLocalIterator()
    for _ in range(0, n, block):
        part = [(r["i"], r["t"]) for _, r in zip(range(block), listed)]
        shared = spark.sparkContext.broadcast(part)  # at most ``block`` items

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            sketches = Sketches(shared.value)
            for b in batches:
                ids, texts = b["doc_id"].to_numpy(), b["text"].tolist()
                for a in range(0, len(texts), 1000):
                    place, found = sketches.found_in(texts[a : a + 1000])
                    if place:
                        yield pd.DataFrame({"doc_id": ids[a + np.array(place)], "item_id": np.array(found, np.int64)})

        out = out.unionByName(corpus.mapInPandas(search, "doc_id long, item_id long"))
    return out
