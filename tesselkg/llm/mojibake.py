"""Text that went through a wrong character decoding: found and, where possible, restored.

A hidden Markov model with one clean state and one state per encoding pair
(true encoding, wrong decoding) labels the characters. In a pair's state the
text emits the garbled form of a character of the column's own alphabet, with
that character's frequency; the frequencies are re-estimated from the restored
texts (expectation-maximisation over all rows). Each labelled span gets its
state's inverse.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselkg.session import cut

#: (true encoding, wrong decodings in order). UTF-8 read as something else, also twice; single-byte alphabets read as Latin.
PAIRS = (
    ("utf-8", ("cp1252",)),
    ("utf-8", ("latin-1",)),
    ("utf-8", ("cp1252", "cp1252")),
    ("utf-8", ("latin-1", "latin-1")),
    ("utf-8", ("mac_roman",)),
    ("utf-8", ("cp1251",)),
    ("utf-8", ("cp1250",)),
    ("utf-8", ("cp437",)),
    ("utf-8", ("cp850",)),
    ("utf-8", ("cp866",)),
    ("utf-8", ("koi8_r",)),
    ("utf-8", ("cp1253",)),
    ("cp1251", ("cp1252",)),
    ("koi8_r", ("cp1252",)),
    ("cp1253", ("cp1252",)),
)
#: The character that stands for bytes that are lost; such text is found but can't be restored.
LOST = "�"
#: Log-probabilities: entering a garbled span, leaving it, a byte dropped on the way, a Latin letter inside a word of another alphabet.
ENTER, LEAVE, DROPPED, FOREIGN = -6.0, -0.7, -3.0, -7.0
#: Log-probability of a character that the column doesn't show; and, per character of its garbled form, of one that only the bytes suggest.
UNSEEN, STRANGE = -16.0, -10.0


def wrong(text: bytes, decoding: str, drop: bool) -> str:
    """Bytes under a wrong decoding; bytes it does not define become control characters, or are dropped."""
    out = []
    for b in text:
        try:
            out.append(bytes([b]).decode(decoding))
        except UnicodeDecodeError:
            if not drop:
                out.append(chr(b))
    return "".join(out)


@lru_cache(maxsize=200_000)
def garbled(char: str, pair: int, drop: bool) -> str | None:
    """What becomes of a character, or None where the pair can't garble it."""
    true, decodings = PAIRS[pair]
    try:
        text = wrong(char.encode(true), decodings[0], drop)
        for d in decodings[1:]:
            text = wrong(text.encode("utf-8"), d, drop)
    except UnicodeEncodeError:
        return None
    return text if text and text != char else None


class Model:
    """Character log-probabilities and, per first character, the garbled units that may start with it."""

    def __init__(self, counts: dict[str, float]) -> None:
        total = sum(counts.values()) + 1.0
        self.log = {c: math.log(n / total) for c, n in counts.items() if n > 0}
        self.units: dict[str, list[tuple[str, int, str, float]]] = {}
        seen: dict[tuple[str, int], float] = {}
        for c, p in self.log.items():
            if ord(c) < 128 or c == LOST:
                continue
            for k in range(len(PAIRS)):
                for drop in (False, True):
                    unit = garbled(c, k, drop)
                    if unit is None or all(ord(x) < 128 for x in unit):
                        continue
                    score = p + (DROPPED if drop and unit != garbled(c, k, False) else 0.0)
                    if score > seen.get((unit, k), -math.inf):
                        seen[unit, k] = score
                        self.units.setdefault(unit[0], []).append((unit, k, c, score))

    def of(self, char: str) -> float:
        return -30.0 if char == LOST else self.log.get(char, UNSEEN)


def label(text: str, model: Model) -> tuple[str, bool]:
    """(restored text, whether anything was garbled), by the most probable path of states."""
    n = len(text)
    states = len(PAIRS) + 2  # clean, the pairs, lost
    lost = states - 1
    if not _suspect(text, model):
        return text, False
    minus = -math.inf
    best = [[minus] * states for _ in range(n + 1)]
    back: list[list[tuple[int, int, str] | None]] = [[None] * states for _ in range(n + 1)]
    best[0][0] = 0.0
    for i in range(n):
        row = best[i]
        top = max(range(1, states), key=row.__getitem__)
        # moves between states happen before a unit
        if row[top] + LEAVE > row[0]:
            row[0], back[i][0] = row[top] + LEAVE, (i, top, "")
        start = row[0] + ENTER
        c = text[i]
        p = model.of(c)
        s = row[0] + p
        if s > best[i + 1][0]:
            best[i + 1][0], back[i + 1][0] = s, (i, 0, c)
        if c == LOST:
            for s, src in ((row[lost] - 1.0, lost), (start - 1.0, 0)):
                if s > best[i + 1][lost]:
                    best[i + 1][lost], back[i + 1][lost] = s, (i, src, c)
            continue
        if ord(c) < 128:
            foreign = FOREIGN if c.isalpha() else 0.0
            for k in range(1, states):
                s = row[k] + p + (foreign if k < lost and PAIRS[k - 1][0] != "utf-8" else 0.0)
                if s > best[i + 1][k]:
                    best[i + 1][k], back[i + 1][k] = s, (i, k, c)
            continue
        for unit, k, u, score in model.units.get(c, ()):
            if text.startswith(unit, i):
                j = i + len(unit)
                for s, src in ((row[k + 1] + score, k + 1), (start + score, 0)):
                    if s > best[j][k + 1]:
                        best[j][k + 1], back[j][k + 1] = s, (i, src, u)
        for k, length, u in _generic(text, i):
            j = i + length
            score = minus if u in model.log else STRANGE * length
            for s, src in ((row[k + 1] + score, k + 1), (start + score, 0)):
                if s > best[j][k + 1]:
                    best[j][k + 1], back[j][k + 1] = s, (i, src, u)
    at, state = n, max(range(states), key=best[n].__getitem__)
    out, bad = [], False
    while at or state:
        step = back[at][state]
        if step is None:
            break
        was, src, piece = step
        bad |= state > 0 and piece != "" and (piece == LOST or ord(piece) > 127)
        out.append(piece)
        at, state = was, src
    return "".join(reversed(out)), bad


def _byte_chars(decoding: str, first: int, last: int) -> frozenset[str]:
    return frozenset(wrong(bytes([b]), decoding, False) for b in range(first, last + 1))


#: Of each single decoding of UTF-8: its number, the characters that a leading and a following byte look like, and its name.
SINGLE = tuple((k, _byte_chars(d[0], 0xC2, 0xF4), _byte_chars(d[0], 0x80, 0xBF), d[0]) for k, (true, d) in enumerate(PAIRS) if true == "utf-8" and len(d) == 1)


def _generic(text: str, i: int) -> Iterator[tuple[int, int, str]]:
    """Units of characters outside the alphabet: two to four characters whose bytes are one UTF-8 character."""
    first, second = text[i], text[i + 1 : i + 2]
    for k, leading, following, decoding in SINGLE:
        if first not in leading or second not in following:
            continue
        for length in (2, 3, 4):
            part = text[i : i + length]
            if len(part) < length:
                break
            u = _one(part, decoding)
            if u:
                yield k, length, u


@lru_cache(maxsize=200_000)
def _one(part: str, decoding: str) -> str | None:
    raw = bytearray()
    for c in part:
        try:
            raw += c.encode(decoding)
        except UnicodeEncodeError:
            if not 0x80 <= ord(c) < 0xA0:
                return None
            raw.append(ord(c))
    try:
        u = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return u if len(u) == 1 and ord(u) > 127 and u.isprintable() else None


_LATIN_RUN = re.compile("[À-ÿ¡-¿]{3,}")


def _suspect(text: str, model: Model) -> bool:
    """Whether any garbled state could explain a part of the text: a lost character, a unit of several characters, or a run of accented letters."""
    if LOST in text or _LATIN_RUN.search(text):
        return True
    for i, c in enumerate(text):
        if ord(c) > 127:
            for unit, *_ in model.units.get(c, ()):
                if len(unit) > 1 and text.startswith(unit, i):
                    return True
            if any(True for _ in _generic(text, i)):
                return True
    return False


def _counts(texts: DataFrame) -> dict[str, float]:
    """How often each character stands in the texts (column text); as many rows at most as Unicode has characters."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = Counter("".join(b["text"]))
            yield pd.DataFrame({"c": list(map(ord, n)), "n": list(n.values())})

    rows = texts.select("text").mapInPandas(count, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).toArrow()
    return {chr(c): float(n) for c, n in zip(rows.column("c").to_pylist(), rows.column("n").to_pylist())}


def find_garbled(texts: DataFrame, *, rounds: int = 2) -> DataFrame:
    """(tbl, row_id, text, restored) of every garbled text among ``texts`` (tbl, row_id, text).

    ``restored`` is the text with every labelled span inverted; where bytes are
    lost it keeps the replacement characters. Null and empty texts are clean;
    texts in ASCII can't be garbled by these pairs and are not labelled, but
    they count in the alphabet. Repeated rows are labelled each. All counts are
    taken over all texts; only the alphabet goes to the driver.
    """
    spark = texts.sparkSession
    given = texts.where("text is not null and text != ''").select("tbl", "row_id", "text")
    plain = _counts(given)
    odd = cut(given.where(F.col("text").rlike(r"[^\x00-\x7F]")))
    counts, out = plain, None
    ascii_part = {c: n for c, n in plain.items() if ord(c) < 128}
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(counts)

        def mark(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            model = Model(shared.value)
            known: dict[str, tuple[str, bool]] = {}
            for b in batches:
                if len(known) > 100_000:
                    known.clear()
                done = []
                for t in b["text"]:
                    if t not in known:
                        known[t] = label(t, model)
                    done.append(known[t])
                b["restored"], b["bad"] = [d[0] for d in done], [d[1] for d in done]
                yield b

        out = cut(odd.mapInPandas(mark, "tbl string, row_id long, text string, restored string, bad boolean"))
        again = _counts(out.select(F.col("restored").alias("text")))
        counts = {**ascii_part, **{c: n for c, n in again.items() if ord(c) > 127}}
    return out.where("bad").select("tbl", "row_id", "text", "restored")
