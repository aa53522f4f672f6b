"""Several values packed in one field: lattices of possible splits, value frequencies by EM, Viterbi.

A field is parsed into chunks. Quoted spans, JSON and list literals are atoms
whose limits are certain. A run of unquoted text with delimiters inside is a
lattice: every delimiter may or may not split. A lettered list is a lattice over
its letter marks, where only the next letter in order may follow; one that can
be read in one way only is certain. How often each value occurs in the whole
column, and which word patterns values have (a trigram model over a bounded set
of frequent words and word shapes, counted over all values whose limits are
certain), decides: expectation-maximisation re-counts the values under the best
splits, Viterbi then picks the split of each lattice. A value may hold any
number of delimiters.
"""

from __future__ import annotations

import ast
import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselkg.session import cut

#: A chunk is a list of pieces, of the delimiters between them, and of the pieces' letters in a lettered list; one piece means its limits are certain.
CHUNKS = "array<struct<pieces: array<string>, delims: array<string>, letters: string>>"
DELIMITER = re.compile(r"\s*(?:->|→|\|+|;+|,+|[\t\n\r]+|(?<=\s)/(?=\s))\s*")
QUOTED = re.compile(r'\s*"((?:[^"\\]|""|\\.)*)"\s*(?=$|->|→|[|;,\t\n\r]|/\s)', re.S)
NUMBERED = re.compile(r"^\s*\d{1,4}[.)]\s+")
OPTION = re.compile(r"(?:^|[,;|\t\n\r]\s*)\s*([A-Za-z])\s*[:.)]\s+")
SINGLE_QUOTED = re.compile(r"^'.*'$", re.S)
#: Frequent words that the pattern model keeps as they are; all others count as their shape. It bounds the model.
KEPT_WORDS = 128
#: Weight of the pattern model against the counted frequencies.
PRIOR = 50.0


def unquoted(text: str) -> str:
    """Trimmed, without enclosing straight quotes; doubled and escaped quotes resolved."""
    t = text.strip()
    if len(t) >= 2 and t[0] == t[-1] == '"':
        t = re.sub(r'""|\\"', '"', t[1:-1]).replace("\\\\", "\\")
    return t.strip()


def _listed(text: str) -> list[str] | None:
    """The strings of a JSON or Python list, or None."""
    for read in (json.loads, ast.literal_eval):
        try:
            got = read(text)
        except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
            continue
        if isinstance(got, list):
            return ["" if x is None else str(x) for x in got]
    return None


def parse_list(text: str | None) -> list[tuple[list[str], list[str]]]:
    """The chunks of a packed field; null, empty and blank texts have none. Empty pieces are no values."""
    if text is None or not text.strip():
        return []
    s = text.strip()
    if s[0] == "[" and s[-1] == "]":
        got = _listed(s)
        if got is not None:
            return [([v.strip()], []) for v in got if v.strip()]
        s = s[1:-1]
    if SINGLE_QUOTED.match(s):
        parts = re.split(r"'\s*(?:[,;|]|->)\s*'", s[1:-1])
        return [([v.strip()], []) for v in parts if v.strip()]
    numbered = bool(NUMBERED.match(s))
    chunks: list[tuple[list[str], list[str]]] = []
    run: list[str] = []
    between: list[str] = []

    def close() -> None:
        if run:
            chunks.append((run.copy(), between[: len(run) - 1]))
        run.clear()
        between.clear()

    for line in re.split(r"[\n\r]+", s) if numbered else [s]:  # numbers make each line a value of its own
        rest = NUMBERED.sub("", line) if numbered else line
        at = 0
        while at < len(rest):
            if q := QUOTED.match(rest, at):
                close()
                if value := unquoted('"' + q.group(1) + '"'):
                    chunks.append(([value], []))
                at = q.end()
                if d := DELIMITER.match(rest, at):
                    at = d.end()
                continue
            d = DELIMITER.search(rest, at)
            piece = rest[at : d.start() if d else len(rest)].strip()
            if piece:
                if run and len(between) < len(run):
                    between.append(" ")
                run.append(piece)
            if not d:
                break
            if run and len(between) < len(run):
                between.append(d.group())
            at = d.end()
            if d.end() == d.start():
                at += 1
        close()
    return chunks


def parse_options(text: str | None) -> list[tuple[list[str], list[str], str]]:
    """The chunks (pieces, delimiters, letters) of a lettered list (A: ..., B) ..., c. ...); only the next letter in order starts a new one.

    Where each due letter is marked once, its titles are certain; where one is
    marked several times, the marks and what is between them are a lattice.
    """
    if text is None or not text.strip():
        return []
    marks = list(OPTION.finditer(text))
    if not marks:
        return [(*c, "") for c in parse_list(text)]
    letters = "".join(m.group(1).upper() for m in marks)
    path, at = [0], 0
    while due := due_marks(letters, at):
        if len(due) > 1:
            bounds = [*(m.start() for m in marks[1:]), len(text)]
            return [([text[m.end() : b] for m, b in zip(marks, bounds)], [m.group() for m in marks[1:]], letters)]
        path.append(at := due[0])
    bounds = [*(marks[k].start() for k in path[1:]), len(text)]
    values = [option_title(text[marks[k].end() : b]) for k, b in zip(path, bounds)]
    return [([v], [], "") for v in values if v]


def due_marks(letters: str, at: int) -> list[int]:
    """The later places of the letter that follows the one at ``at``."""
    due = chr(ord(letters[at]) + 1)
    return [k for k in range(at + 1, len(letters)) if letters[k] == due]


def option_title(raw: str) -> str:
    return unquoted(raw.rstrip(" ,;|\t\n\r"))


def prompt_lists(text: str | None) -> tuple[str | None, str | None]:
    """The history and the options part of a stored query, without braces; None where the query has none."""
    if text is None:
        return None, None
    h, o = re.search(r"(?:Watching|Listening) history:", text), re.search(r"Options:", text)
    inner = lambda t: t[t.find("{") + 1 : t.rfind("}")] if 0 <= t.find("{") < t.rfind("}") else None
    return (inner(text[h.end() : o.start() if o and o.start() > h.end() else len(text)]) if h else None, inner(text[o.end() :]) if o else None)


# --- the pattern model


def shape(word: str, kept: frozenset[str] | dict) -> str:
    if word in kept:
        return word
    return "9" if word.isdigit() else "XX" if word.isupper() and len(word) > 1 else "Xx" if word[:1].isupper() else "xx" if word[:1].isalpha() else "."


def words(value: str) -> list[str]:
    return re.findall(r"->|[^\W_]+(?:[-’'][^\W_]+)*|[^\w\s]", value)


def trigrams(value: str, kept: frozenset[str] | dict) -> list[tuple[str, str, str]]:
    t = ["^", "^", *(shape(w, kept) for w in words(value)), "$"]
    return list(zip(t, t[1:], t[2:]))


class Patterns:
    """Interpolated trigram model; its size is bounded by the kept words, not by the data."""

    def __init__(self, kept: frozenset[str], counts: dict[tuple[str, str, str], int]) -> None:
        self.kept, self.three = kept, counts
        self.two: dict[tuple[str, str], int] = {}
        self.pair: dict[tuple[str, str], int] = {}
        self.one: dict[str, int] = {}
        for (a, b, c), n in counts.items():
            self.two[a, b] = self.two.get((a, b), 0) + n
            self.pair[b, c] = self.pair.get((b, c), 0) + n
            self.one[b] = self.one.get(b, 0) + n
        self.size = len(kept) + 8
        self.known: dict[tuple[str, str, str], float] = {}

    def log(self, a: str, b: str, c: str) -> float:
        """Log-probability of a token after the two before it."""
        known = self.known.get((a, b, c))
        if known is None:
            low = (self.pair.get((b, c), 0) + 0.02) / (self.one.get(b, 0) + 0.02 * self.size)
            known = self.known[a, b, c] = math.log((self.three.get((a, b, c), 0) + 2 * low) / (self.two.get((a, b), 0) + 2))
        return known


def steps(n: int, letters: str) -> list[list[int]] | None:
    """For each piece of a lettered list, where a value that begins with it may end; None where every end is allowed."""
    if not letters:
        return None
    return [due_marks(letters, i) or [n] for i in range(n)]


def viterbi(pieces: list[str], delims: list[str], letters: str, freq: dict[str, int], total: float, model: Patterns) -> list[str]:
    """The most probable split of one lattice into values, of all splits.

    ``freq`` holds the counted ones among its candidate values. The pattern model's
    share of a value is a difference of running sums; the search for a value's
    begin ends where no longer value can be better.
    """
    n = len(pieces)
    token: list[str] = []
    begin, end = [], []
    for i, piece in enumerate(pieces):
        begin.append(len(token))
        token += [shape(w, model.kept) for w in words(piece)]
        end.append(len(token))
        token += [shape(w, model.kept) for w in words(delims[i])] if i < n - 1 else []
    run = [0.0, 0.0]
    for k in range(2, len(token)):
        run.append(run[-1] + model.log(*token[k - 2 : k + 1]))

    def pattern(s: int, e: int) -> float:
        if e <= s:
            return model.log("^", "^", "$")
        head = model.log("^", "^", token[s])
        if e == s + 1:
            return head + model.log("^", token[s], "$")
        return head + model.log("^", token[s], token[s + 1]) + run[e - 1] - run[s + 1] + model.log(token[e - 2], token[e - 1], "$")

    allowed, prior, base = steps(n, letters), math.log(PRIOR), math.log(total + PRIOR)
    longest = max(map(len, freq), default=0)
    best: list[tuple[float, int]] = [(0.0, 0)]
    for j in range(1, n + 1):
        found, size = (-math.inf, -1), 0
        for i in range(j - 1, -1, -1):
            size += len(pieces[i])
            if (allowed is None or j in allowed[i]) and best[i][1] >= 0:
                score = prior + pattern(begin[i], end[j - 1])
                if count := freq.get(joined(pieces, delims, letters, i, j), 0) if size <= longest + 2 else 0:
                    score = math.log(count) + math.log1p(math.exp(min(score - math.log(count), 700.0)))
                found = max(found, (best[i][0] + score - base, i))
            # whatever begins earlier is longer: not counted, and no likelier than its inner tokens
            if size > longest + 2 and end[j - 1] >= begin[i] + 2 and prior - base + run[end[j - 1] - 1] - run[begin[i] + 1] < found[0]:
                break
        best.append(found)
    cuts, j = [], n
    while j:
        cuts.append((best[j][1], j))
        j = best[j][1]
    return [v for i, j in reversed(cuts) if (v := joined(pieces, delims, letters, i, j))]


def joined(pieces: list[str], delims: list[str], letters: str, i: int, j: int) -> str:
    text = "".join(p + (delims[k] if k < j - 1 else "") for k, p in enumerate(pieces[i:j], i))
    return option_title(text) if letters else text.strip()


def candidates(pieces: list[str], delims: list[str], letters: str, inside: set[int]) -> set[str]:
    """The values of a lattice that can have been counted: those with as many delimiters inside as some counted value has."""
    n = len(pieces)
    if allowed := steps(n, letters):
        return {joined(pieces, delims, letters, i, j) for i in range(n) for j in allowed[i]}
    return {joined(pieces, delims, letters, i, i + k + 1) for k in inside for i in range(n - k)}


# --- the operator


def split_packed(fields: DataFrame, *, rounds: int = 2) -> DataFrame:
    """(field_name, row_id, pos, val) of every value of ``fields`` (field_name, family, row_id, kind, text).

    ``kind`` is 'list' or 'options'; the fields of one ``family`` share their
    value frequencies. ``pos`` counts the values of a field from 1. Null, empty
    and blank texts and empty pieces give no rows; repeated rows are split each
    on its own (their (field_name, row_id) must differ). All counts cover the
    whole column.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parsed = [parse_options(t) if k == "options" else [(*c, "") for c in parse_list(t)] for k, t in zip(b["kind"], b["text"])]
            b["chunks"] = [[{"pieces": p, "delims": d, "letters": x} for p, d, x in row] for row in parsed]
            yield b[["field_name", "family", "row_id", "chunks"]]

    rows = cut(fields.where("text is not null").mapInPandas(parse, f"field_name string, family string, row_id long, chunks {CHUNKS}").where("size(chunks) > 0"))
    chunks = rows.select("field_name", "family", "row_id", F.posexplode("chunks").alias("no", "c"))
    certain = chunks.where("size(c.pieces) = 1").groupBy("family", F.col("c.pieces")[0].alias("val")).agg(F.count(F.lit(1)).alias("n"))
    lattices = chunks.where("size(c.pieces) > 1").select("field_name", "family", "row_id", "no", "c.pieces", "c.delims", "c.letters")
    models = _fit(certain)
    shared = fields.sparkSession.sparkContext.broadcast(models)

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for fam, p, d, x, f, total in zip(b["family"], b["pieces"], b["delims"], b["letters"], b["freq"], b["total"]):
                known = {x["val"]: x["n"] for x in f}
                out.append(viterbi(list(p), list(d), x, known, total or 0.0, shared.value[fam]))
            b["vals"] = out
            yield b[["field_name", "family", "row_id", "no", "vals"]]

    kept = "field_name string, family string, row_id long, no int, pieces array<string>, delims array<string>, letters string"
    counts, chosen = certain, None
    for _ in range(rounds):
        inside = _inside(counts)

        def spans(batches: Iterator[pd.DataFrame], inside=inside) -> Iterator[pd.DataFrame]:
            for b in batches:
                b["val"] = [sorted(candidates(list(p), list(d), x, inside.get(f, set()))) for f, p, d, x in zip(b["family"], b["pieces"], b["delims"], b["letters"])]
                yield b

        # the frequencies of a lattice's candidates come by a join, so no table of all values goes anywhere; a candidate of very many lattices is split by the adaptive skew join
        spread = lattices.mapInPandas(spans, kept + ", val array<string>")
        totals = counts.groupBy("family").agg(F.sum("n").cast("double").alias("total"))
        looked = spread.withColumn("val", F.explode_outer("val")).join(counts, ["family", "val"], "left")
        looked = looked.groupBy("field_name", "family", "row_id", "no").agg(
            F.first("pieces").alias("pieces"), F.first("delims").alias("delims"), F.first("letters").alias("letters"), F.collect_list(F.when(F.col("n").isNotNull(), F.struct("val", "n"))).alias("freq")
        )
        chosen = cut(looked.join(totals, "family", "left").mapInPandas(choose, "field_name string, family string, row_id long, no int, vals array<string>"))
        again = chosen.select("family", F.explode("vals").alias("val"))
        counts = certain.unionByName(again.groupBy("family", "val").agg(F.count(F.lit(1)).alias("n"))).groupBy("family", "val").agg(F.sum("n").alias("n"))
    settled = chunks.where("size(c.pieces) = 1").select("field_name", "row_id", "no", F.col("c.pieces").alias("vals")).unionByName(chosen.select("field_name", "row_id", "no", "vals"))
    whole = settled.groupBy("field_name", "row_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("no", "vals"))), lambda x: x["vals"])).alias("vals"))
    return whole.select("field_name", "row_id", F.posexplode("vals").alias("p", "val")).select("field_name", "row_id", (F.col("p") + 1).cast("long").alias("pos"), "val")


def _inside(counts: DataFrame) -> dict[str, set[int]]:
    """The numbers of delimiters inside the counted values, by family; a few small integers each."""
    number = F.size(F.regexp_extract_all("val", F.lit(DELIMITER.pattern), F.lit(0)))
    rows = counts.groupBy("family").agg(F.collect_set(number).alias("k")).collect()
    return {r["family"]: set(r["k"]) for r in rows}


def _fit(certain: DataFrame) -> dict[str, Patterns]:
    """The pattern model of each family, from the counts of all certain values; its tables are bounded by KEPT_WORDS."""
    spread = certain.select("family", "n", F.explode(F.regexp_extract_all("val", F.lit(r"[\p{L}\p{N}]+(?:[-’'][\p{L}\p{N}]+)*|[^\p{L}\p{N}_\s]"), 0)).alias("w"))
    common = spread.groupBy("family", "w").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("family").orderBy(F.desc("n"), "w"))  # each task keeps its own first ones
    kept: dict[str, list[str]] = {}
    for r in common.withColumn("place", place).where(F.col("place") <= KEPT_WORDS).select("family", "w").collect():
        kept.setdefault(r["family"], []).append(r["w"])
    fixed = {f: frozenset(w) for f, w in kept.items()}

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got: dict[tuple, int] = {}
            for fam, v, n in zip(b["family"], b["val"], b["n"]):
                for t in trigrams(v, fixed.get(fam, frozenset())):
                    got[fam, *t] = got.get((fam, *t), 0) + int(n)
            yield pd.DataFrame([(*k, n) for k, n in got.items()], columns=["family", "a", "b", "c", "n"])

    rows = certain.mapInPandas(spell, "family string, a string, b string, c string, n long").groupBy("family", "a", "b", "c").agg(F.sum("n").alias("n")).collect()
    counts: dict[str, dict] = {}
    for r in rows:
        counts.setdefault(r["family"], {})[r["a"], r["b"], r["c"]] = r["n"]
    out = {f: Patterns(fixed.get(f, frozenset()), c) for f, c in counts.items()}
    return _Models(out)


class _Models(dict):
    """Families without any certain value get an empty model."""

    def __missing__(self, family: str) -> Patterns:
        self[family] = Patterns(frozenset(), {})
        return self[family]
