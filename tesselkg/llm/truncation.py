"""Texts that were cut: at a field limit of their source, or in mid-transfer.

Per source and column, the histograms of text lengths (in characters and in
bytes) are tested for spikes: of texts without terminal punctuation, of texts
that end in an ellipsis, and at the column's greatest length. Unfinished texts
at a spike are cut. Elsewhere, and in columns that never end in punctuation,
the end itself has to show it: its last word stands nowhere else as a whole
word, or the last words are, over all texts, practically never followed by an
end of sentence. How often a source breaks words is the prior of that test.

That evidence is asked only for the unfinished ends. A bitmap of fixed size
tells which runs of words are asked, so the counts over all texts keep only
those; an exact join follows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselkg.session import cut

TOKEN = re.compile(r"[぀-ヿ㐀-鿿]|[^\W_]+(?:[-’'][^\W_]+)*|[.!?。！？…]+|[^\w\s]")
ENDED = re.compile(r"[.!?。！？][\"”»’)\]]*$")
ELLIPSIS = re.compile(r"(?:\.\.\.|…|\[(?:\.\.\.|…)\]|\((?:more|\.\.\.|…)\))$")
#: A note after a finished sentence: a year, a reference, a signature.
NOTED = re.compile(r"[.!?。！？][\"”»’]*\s*(?:\(\d{4}\)|\[\d+\]|[–—-]\s.{1,60})$")
#: A spike: at least so many texts, and so many times the mean of the lengths around it.
LEAST_SPIKE, SPIKE_RATIO, AROUND = 5, 6.0, 12
#: A spike at the greatest length: at least so many texts and this share of the column's.
LEAST_AT_MOST, SHARE_AT_MOST = 8, 0.04
#: Width of a limit that cuts at word ends and appends an ellipsis.
ELLIPSIS_BELOW, ELLIPSIS_ABOVE = 14, 6
#: A column ends in punctuation where at least this share of its texts does.
PUNCTUATED = 0.5
#: A multi-byte character at a byte limit takes up to three bytes with it.
BYTES_LOST = 3
#: In a column with fewer words on average, a greatest length may be that of a code or a category: there the texts at it must differ, and other sources must have longer ones.
RUNNING_WORDS = 2.5
#: Bits of the bitmap of asked runs of words (16 MB), and words a worker keeps the hashes of.
BITMAP, MEMORY = 1 << 27, 1_000_000
#: Rows per (source, column) up to which their table is broadcast, and rows that ask for one run of words from which it is salted.
MOST_COLUMNS, HOT_ASKED = 100_000, 50_000
#: Sentence ends among the tokens.
STOPS = frozenset(".!?。！？…")
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def shape_of(text: str) -> str:
    """'ended', 'noted' (finished, then a note), 'ellipsis' or 'open'."""
    t = text.rstrip()
    return "ellipsis" if ELLIPSIS.search(t) else "ended" if ENDED.search(t) else "noted" if NOTED.search(t) else "open"


class _Hashes(dict):
    """64-bit hashes of tokens; the lowest bit tells an end of sentence."""

    def __missing__(self, token: str) -> int:
        if len(self) > MEMORY:
            self.clear()
        value = self[token] = (xxhash.xxh64_intdigest(token) & ~1) | (token[0] in STOPS)
        return value


_HASHES = _Hashes()


def _mixed(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(31))) * MULTIPLY
    return a ^ (a >> np.uint64(29))


class Runs:
    """The tokens of a batch of texts as one array, and the codes of the runs of words that end at given places."""

    def __init__(self, texts: list[str]) -> None:
        flat: list[str] = []
        ends = []
        for t in texts:
            flat += TOKEN.findall(t)
            ends.append(len(flat))
        self.h = np.fromiter(map(_HASHES.__getitem__, flat), np.uint64, len(flat))
        self.stop = (self.h & np.uint64(1)).astype(bool)
        self.end = np.array(ends, np.int64)
        self.begin = np.r_[0, self.end[:-1]] if ends else self.end

    def codes(self, at: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code, there) by kind and place: the word, the last two, the last three, and the two before the last two."""
        before = lambda k: self.h[np.maximum(at - k, 0)]
        word = lambda n: np.uint64(n)
        one = _mixed(before(0) + word(1))
        two = _mixed(_mixed(before(1) + word(2)) + before(0))
        three = _mixed(_mixed(_mixed(before(2) + word(3)) + before(1)) + before(0))
        four = _mixed(_mixed(before(3) + word(4)) + before(2))
        place = at - begin
        return np.stack([one, two, three, four]).view(np.int64), np.stack([place >= k for k in range(4)])


def text_values(entities: DataFrame, *, row_id: str = "row_id", source: str = "source", attributes: str = "attributes") -> DataFrame:
    """(row_id, source, col, val): the string values of valid JSON objects; null and blank values give none."""
    whole = F.when(F.json_object_keys(attributes).isNotNull(), F.from_json(attributes, "map<string,string>"))
    rows = entities.select(F.col(row_id).alias("row_id"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.explode(whole).alias("col", "val"))
    return rows.where("val is not null and trim(val) != ''")


def broken_attributes(entities: DataFrame, *, row_id: str = "row_id", source: str = "source", attributes: str = "attributes") -> DataFrame:
    """(row_id, source) of the objects that were begun and never closed."""
    text = F.rtrim(F.col(attributes))
    begun = F.ltrim(F.col(attributes)).startswith("{") & ~text.endswith("}")
    return entities.where(begun & F.json_object_keys(attributes).isNull()).select(F.col(row_id).alias("row_id"), F.coalesce(F.col(source), F.lit("")).alias("source"))


def find_cut_values(values: DataFrame) -> DataFrame:
    """(row_id, source, col, reason) of every value (row_id, source, col, val) that was cut off.

    ``reason`` is 'limit' (at a spike of its source and column), 'ellipsis' (the
    same, with an ellipsis appended) or 'transfer' (its end breaks off). Null
    and blank values are ignored; repeated rows are judged each; an empty input
    gives no rows. All counts are taken over all values, of every column.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            shapes = [shape_of(v) for v in b["val"]]
            b["shape"], b["chars"], b["bytes"] = shapes, b["val"].str.len(), [len(v.encode()) for v in b["val"]]
            b["words"] = b["val"].str.count(r"\s+") + 1
            opened = np.flatnonzero([x == "open" for x in shapes])
            runs = Runs(b["val"].iloc[opened].tolist())
            some = runs.end > runs.begin
            code, there = runs.codes(runs.end[some] - 1, runs.begin[some])
            tail = np.full(len(b), None, object)
            tail[opened[some]] = [c[t].tolist() for c, t in zip(code.T, there.T)]
            b["tail"] = tail
            yield b[["row_id", "source", "col", "val", "shape", "chars", "bytes", "tail", "words"]]

    form = "row_id long, source string, col string, val string, shape string, chars long, bytes long, tail array<long>, words long"
    seen = cut(values.mapInPandas(read, form))
    limits = cut(_limits(seen))
    if limits.count() <= MOST_COLUMNS:
        limits = F.broadcast(limits)
    at = lambda c, unit: F.coalesce(F.array_contains(c, F.col(unit)), F.lit(False))
    rows = cut(
        seen.join(limits, ["source", "col"]).select(
            "row_id", "source", "col", "val", "shape", "tail", "punctuated",
            (at("char_limits", "chars") | at("byte_limits", "bytes")).alias("at_limit"),
            F.coalesce(F.exists("byte_limits", lambda x: (F.col("bytes") < x) & (F.col("bytes") >= x - BYTES_LOST)), F.lit(False)).alias("below_limit"),
            F.coalesce((F.col("chars") >= F.col("dots_at") - ELLIPSIS_BELOW) & (F.col("chars") <= F.col("dots_at") + ELLIPSIS_ABOVE), F.lit(False)).alias("at_dots"),
        )
    )
    asked = rows.where("shape = 'open' and tail is not null and (punctuated or at_limit or below_limit)")
    asked = asked.select("row_id", "source", "col", "punctuated", "at_limit", "below_limit", F.posexplode("tail").alias("k", "code"))
    wanted = cut(asked.groupBy("code").agg(F.count(F.lit(1)).alias("n_asked")))
    evidence = _ends(rows.where("not at_limit and not below_limit and shape != 'ellipsis'").select("val", "punctuated"), wanted)
    # a run of words that very many rows ask for is split by salt, its one row of evidence repeated
    hot = wanted.where(F.col("n_asked") > HOT_ASKED).select("code", F.ceil(F.col("n_asked") / HOT_ASKED).cast("int").alias("salts"))
    if hot.count() <= MOST_COLUMNS:
        hot = F.broadcast(hot)
    salted = asked.join(hot, "code", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("row_id", "col"), "salts"), F.lit(0)).cast("int")).drop("salts")
    repeated = evidence.join(hot, "code", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    judged = salted.join(repeated, ["code", "salt"], "left").groupBy("row_id", "source", "col", "punctuated", "at_limit", "below_limit").agg(*_end_measures())
    judged = cut(judged.withColumn("broken", F.col("whole") == 0))
    # how often a source breaks words away from its limits
    prior = judged.where("punctuated and not at_limit and not below_limit").groupBy("source").agg(
        ((F.count_if("broken") + 0.02) / (F.count_if(~F.col("broken")) + 1.0)).alias("odds")
    )
    judged = judged.join(prior, "source", "left").withColumn("breaks", F.coalesce("odds", F.lit(0.02)))
    unlikely = F.coalesce("p_end", F.lit(0.5))
    off = F.when(F.col("breaks") >= 0.1, F.col("broken") | (unlikely < F.least(F.lit(0.4), F.col("breaks")))).otherwise(F.col("broken") & (F.col("breaks") >= 0.02))
    reason = (
        F.when(F.col("at_limit") & (F.col("punctuated") | F.col("broken") | (unlikely < 0.2)), "limit")
        .when(F.col("below_limit") & (F.col("broken") | (unlikely < 0.3)), "limit")
        .when(F.col("punctuated") & off, "transfer")
    )
    found = judged.select("row_id", "source", "col", reason.alias("reason")).where("reason is not null")
    dots = rows.where("shape = 'ellipsis' and at_dots").select("row_id", "source", "col", F.lit("ellipsis").alias("reason"))
    return found.unionByName(dots)


def _limits(seen: DataFrame) -> DataFrame:
    """(source, col, punctuated, char_limits, byte_limits, dots_at): the spikes of each source and column, from one histogram of lengths."""
    of = lambda *s: F.col("shape").isin(*s)
    lengths = seen.select("source", "col", "shape", "words", F.xxhash64("val").alias("h"), F.explode(F.create_map(F.lit("chars"), "chars", F.lit("bytes"), "bytes")).alias("unit", "length"))
    counted = lengths.groupBy("source", "col", "unit", "length").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(of("open")).alias("open"), F.count_if(of("ellipsis")).alias("dots"), F.count_if(of("ended", "noted")).alias("ended"),
        F.sum("words").alias("words"), F.approx_count_distinct(F.when(of("open"), F.col("h"))).alias("different"),
    )
    whole, own = Window.partitionBy("col", "unit"), Window.partitionBy("source", "col", "unit")
    near = own.orderBy("length").rangeBetween(-AROUND, AROUND)
    counted = counted.select(
        "*",
        (F.sum("ended").over(whole) >= PUNCTUATED * F.sum("total").over(whole)).alias("punctuated"),
        (F.sum("words").over(whole) >= RUNNING_WORDS * F.sum("total").over(whole)).alias("running"),
        F.coalesce(F.sum("total").over(whole.orderBy("length").rangeBetween(1, Window.unboundedFollowing)), F.lit(0)).alias("longer"),
        ((F.sum("open").over(near) - F.col("open")) / (2.0 * AROUND)).alias("open_near"),
        F.max("length").over(own).alias("longest"),
        F.sum("total").over(own).alias("all"),
        F.sum("dots").over(own).alias("all_dots"),
        F.sum("dots").over(own.orderBy("length").rangeBetween(-ELLIPSIS_BELOW, ELLIPSIS_ABOVE)).alias("dots_near"),
        F.max("dots").over(own).alias("most_dots"),
    )
    spike = (F.col("open") >= LEAST_SPIKE) & (F.col("open") >= SPIKE_RATIO * F.greatest("open_near", F.lit(0.2)))
    at_most = (F.col("length") == F.col("longest")) & (F.col("open") >= LEAST_AT_MOST) & (F.col("open") >= SHARE_AT_MOST * F.col("all"))
    at_most = at_most & (F.col("running") | ((F.col("different") >= LEAST_AT_MOST) & (F.col("longer") >= LEAST_SPIKE)))
    limit = (F.col("punctuated") & spike) | at_most
    dotted = F.col("punctuated") & (F.col("unit") == "chars") & (F.col("dots") == F.col("most_dots")) & (F.col("dots_near") >= LEAST_SPIKE) & (F.col("dots_near") >= 0.5 * F.col("all_dots"))
    lengths_of = lambda unit: F.collect_set(F.when(limit & (F.col("unit") == unit), F.col("length")))
    return counted.groupBy("source", "col").agg(
        F.first("punctuated").alias("punctuated"), lengths_of("chars").alias("char_limits"), lengths_of("bytes").alias("byte_limits"), F.max(F.when(dotted, F.col("length"))).alias("dots_at")
    )


def _ends(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(code, n, ends) of the asked runs of words: how often each stands in the texts with something after it, and how often an end of sentence.

    The bitmap has one place per code modulo its size; as it fills up it lets more
    of the other runs through, which the join drops.
    """
    place = F.col("code").bitwiseAND(BITMAP - 1)
    words = wanted.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(code & {BITMAP - 1} & 63 as int))")).alias("bits")).toArrow()  # at most BITMAP / 64 rows
    bitmap = np.zeros(BITMAP // 64, np.uint64)
    bitmap[words.column("w").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = shared.value
        for b in batches:
            runs = Runs(b["val"].tolist())
            size = runs.end - runs.begin
            text = np.repeat(np.arange(len(size)), size)
            last = np.arange(len(text)) + 1 == runs.end[text]
            after = np.r_[runs.stop[1:], False] | last
            at = np.flatnonzero(~runs.stop & ~(last & b["punctuated"].to_numpy(bool)[text]))
            code, there = runs.codes(at, runs.begin[text[at]])
            slot = (code & (BITMAP - 1)).view(np.uint64)
            there &= (held[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
            kept, number = np.unique(code[there], return_inverse=True)
            yield pd.DataFrame({"code": kept, "n": np.bincount(number, minlength=len(kept)), "ends": np.bincount(number, np.broadcast_to(after[at], there.shape)[there], len(kept)).astype(np.int64)})

    counted = texts.mapInPandas(count, "code long, n long, ends long").groupBy("code").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))
    return counted.join(wanted.select("code"), "code", "left_semi")


def _end_measures() -> list:
    """Of a tail's runs: occurrences of its last word as a whole word, and the chance that it ends a sentence."""
    of = lambda k, c: F.coalesce(F.max(F.when(F.col("k") == k, F.col(c))), F.lit(0))
    rate = lambda k: F.when(of(k, "n") >= 3, (of(k, "ends") + 0.3) / (of(k, "n") + 1.5))
    best = F.greatest(rate(2), rate(3))
    return [of(0, "n").alias("whole"), F.coalesce(best, rate(1), rate(0)).alias("p_end")]


def find_truncated(entities: DataFrame) -> DataFrame:
    """(row_id, source, col, reason) of every cut value of ``entities``; the object itself as column 'attributes', reason 'broken'."""
    broken = broken_attributes(entities).select("row_id", "source", F.lit("attributes").alias("col"), F.lit("broken").alias("reason"))
    return find_cut_values(text_values(entities)).unionByName(broken)


def truncation_rates(entities: DataFrame) -> DataFrame:
    """(source, n_rows, n_cut, rate): how often each source gives records with a cut text."""
    cut_rows = find_truncated(entities).select("row_id").distinct().withColumn("cut", F.lit(1))
    rows = entities.select("row_id", F.coalesce("source", F.lit("")).alias("source")).join(cut_rows, "row_id", "left")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.count("cut").alias("n_cut"), F.round(F.count("cut") / F.count(F.lit(1)), 4).alias("rate"))
