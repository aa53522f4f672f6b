"""Whole-corpus encoding with a public byte-level BPE through a distinct-word table.

Spark splits the texts into words, each distinct word is encoded once, and the
ids come back by position. Words of a bounded, frequent part of the table are
looked up from a broadcast; the words beyond it come by a join, so nothing that
is broadcast grows with the corpus and no occurrence of a frequent word is
shuffled.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselkg.session import cut

#: Folder of the public vocabularies.
VOCABULARIES = "/opt/tokenizers"
# Fixed value: white space of the pattern, written out so that Java reads it as the tokenizer does.
BLANK = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# Fixed value: the word pattern of the vocabulary.
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{BLANK}\p{{L}}\p{{N}}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"
TOKENIZER_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Most words of the broadcast part of the table (a few megabytes); the rest is joined.
HOT_WORDS = 200_000


def ranks(name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> dict[bytes, int]:
    """The vocabulary's pieces and ids, from its rank file."""
    with open(f"{folder}/{name}.tiktoken", "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def encoding(vocabulary: str, folder: str, pattern: str):
    """The tokenizer without special tokens; kept per Python worker."""
    import tiktoken

    key = (vocabulary, folder, pattern)
    if key not in _ENCODINGS:
        _ENCODINGS[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks(vocabulary, folder), special_tokens={})
    return _ENCODINGS[key]


_ENCODINGS: dict = {}


def word_table(texts: DataFrame, *, vocabulary: str, folder: str) -> DataFrame:
    """(word, n, ids): each distinct word of the corpus, the number of documents that hold it, its ids."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = encoding(vocabulary, folder, r"[\s\S]+")  # a word is one piece, whatever stands in it
        for b in batches:
            b["ids"] = [whole.encode_ordinary(w) for w in b["word"]]
            yield b

    words = texts.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.mapInPandas(encode, "word string, n long, ids array<int>")


def _hot(table: DataFrame, most: int) -> tuple[pa.Table, bool]:
    """The most frequent words, at most ``most``, chosen by a threshold on the count; and whether that is all of them."""
    levels = table.groupBy(F.floor(F.log2("n")).alias("level")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("level")).collect()
    taken, least = 0, None
    for r in levels:  # one row per power of two
        if taken + r["k"] > most:
            break
        taken, least = taken + r["k"], r["level"]
    everything = taken == sum(r["k"] for r in levels)
    hot = table.where(F.floor(F.log2("n")) >= F.lit(least if least is not None else 1 << 30)).select("word", "ids")
    return hot.toArrow(), everything


def encode_corpus(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES, hot_words: int = HOT_WORDS
) -> DataFrame:
    """(doc_id, ids): the token ids of every text, without special tokens.

    Null and empty texts get an empty list; strings of special tokens are
    ordinary text; texts of any length are encoded whole; repeated rows give
    repeated results (rows beyond the broadcast words are matched by position in
    the row's own list, so ``id_col`` should be unique there). Texts with
    characters that Java's Unicode does not know yet are split by the tokenizer.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    odd = text.rlike(r"\p{Cn}")
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.when(odd, text).alias("whole"), F.when(~odd, text).alias("text"))
    texts = base.select("doc_id", "whole", F.coalesce(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.array().cast("array<string>")).alias("words"))
    table = cut(word_table(texts, vocabulary=vocabulary, folder=folder))
    hot, everything = _hot(table, hot_words)
    shared = docs.sparkSession.sparkContext.broadcast(hot.combine_chunks().to_batches() if hot.num_rows else [])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value[0] if shared.value else pa.record_batch({"word": pa.array([], pa.string()), "ids": pa.array([], pa.list_(pa.int32()))})
        known_words = known.column("word").cast(pa.string())
        lists = known.column("ids")
        starts = np.asarray(lists.offsets, dtype=np.int64)[: len(lists) + 1]
        pieces = np.asarray(lists.values, dtype=np.int32)
        lengths = np.diff(starts) if len(lists) else np.zeros(0, np.int64)
        lookup = pc.SetLookupOptions(value_set=known_words)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                b = batch.slice(at, 2000)
                words = b.column("words")
                flat = words.flatten()
                place = np.asarray(pc.fill_null(pc.index_in(flat, options=lookup), -1), dtype=np.int64)
                bounds = np.asarray(words.offsets, dtype=np.int64)
                bounds = bounds - bounds[0]
                missing = place < 0
                own = np.where(missing, 0, place)
                size = np.where(missing, 1, lengths[own] if len(lengths) else 1)
                ends = np.cumsum(size)
                first = np.where(missing, 0, starts[own] if len(lengths) else 0)
                ids = pieces[np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)] if len(pieces) else np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
                ids = ids.copy()
                ids[(ends - size)[missing]] = -1
                cuts = np.concatenate([[0], ends])[bounds].astype(np.int32)
                out = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids, pa.int32()))
                lost = np.concatenate([[0], np.cumsum(missing)])[bounds].astype(np.int32)
                rare = pa.ListArray.from_arrays(pa.array(lost, pa.int32()), flat.filter(pa.array(missing)))
                whole = b.column("whole")
                if whole.null_count < len(whole):
                    enc = encoding(vocabulary, folder, TOKENIZER_PATTERN)
                    out = pa.array([o if t is None else enc.encode_ordinary(t) for o, t in zip(out.to_pylist(), whole.to_pylist())], pa.list_(pa.int32()))
                yield pa.record_batch([b.column("doc_id"), out, rare], names=["doc_id", "ids", "rare"])

    coded = texts.mapInArrow(look_up, "doc_id long, ids array<int>, rare array<string>")
    if everything:  # the table fits its bound: no word is left over
        return coded.select("doc_id", "ids")
    coded = cut(coded)
    left = coded.where("size(rare) > 0").select("doc_id", F.posexplode("rare").alias("k", "word"))
    found = left.join(table.select("word", F.col("ids").alias("more")), "word")
    found = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("k", "more"))).alias("fill"))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = []
            for ids, more in zip(b["ids"], b["fill"]):
                out, k = [], 0
                for x in ids:
                    if x >= 0:
                        out.append(x)
                    else:
                        out.extend(more[k]["more"])
                        k += 1
                done.append(out)
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": done})

    waiting = coded.where("size(rare) > 0").select("doc_id", "ids").join(found, "doc_id")
    return coded.where("size(rare) = 0").select("doc_id", "ids").unionByName(waiting.mapInPandas(fill, "doc_id long, ids array<int>"))


def pieces_table(spark: SparkSession, *, vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(id, piece): the vocabulary as a table; its size is fixed."""
    rows = [(rank, piece.hex()) for piece, rank in ranks(vocabulary, folder).items()]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["id", "piece"])).select(F.col("id").cast("int"), "piece")


def decode_corpus(encoded: DataFrame, *, vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(doc_id, text): the ids joined to their pieces and put together in order; an empty list gives an empty text."""
    pieces = F.broadcast(pieces_table(encoded.sparkSession, vocabulary=vocabulary, folder=folder))  # fixed size: the vocabulary
    spread = encoded.select("doc_id", F.posexplode("ids").alias("pos", "id")).join(pieces, "id")
    put = spread.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("p"))
    text = F.decode(F.unhex(F.array_join(F.transform("p", lambda x: x["piece"]), "")), "UTF-8")
    return encoded.select("doc_id").join(put.select("doc_id", text.alias("text")), "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
