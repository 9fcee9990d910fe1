"""Byte-level BPE of a whole corpus with a public vocabulary, inside the JVM.

A piece of text is held as a string with one character per token: token id i is the character of code point
i + SHIFT. Merging a pair everywhere is then a plain string replacement, and the merge to make next is the smallest
character that any neighbouring pair merges to, because an id is also its merge rank. The fold runs as higher-order
functions over constant tables and nothing is shuffled. Pieces that are tokens themselves, and the most frequent other
words, are looked up instead; each of those words is folded only once.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelgraph.runtime import ship

#: Keeps ids clear of control characters; the largest id of a 50k vocabulary stays below the surrogates.
SHIFT = 256
BUCKETS = 1 << 16
#: Documents and words from which, and as which, the frequent words are remembered. They only save time: every other
#: word is folded where it stands, so the result does not depend on them.
SAMPLE_DOCUMENTS, FREQUENT_WORDS = 10_000, 30_000
#: Bytes of a document from which one with a long stretch takes the heap-based path: the fold is quadratic in a piece.
LONG_PIECE = 1024
_WS = r"\t-\r \x85\xa0  -     　"
#: The published splitting pattern of this vocabulary family, with its white space spelled out.
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"


@dataclass(frozen=True)
class Vocabulary:
    """Token bytes by id, the two parts that each token is merged from, and id by bytes."""

    tokens: tuple[bytes, ...]
    parts: tuple[tuple[int, int] | None, ...]
    rank: dict[bytes, int]
    merge: dict[tuple[int, int], int] = field(default_factory=dict)


def _split(token: bytes, rank: dict[bytes, int]) -> tuple[int, int] | None:
    """The pair whose merge makes the token: merge its bytes by rank until two parts are left."""
    word = [bytes([b]) for b in token]
    while len(word) > 2:
        pairs = [(rank.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(word, word[1:]))]
        r, i = min(pairs)
        if r >= rank[token]:
            return None
        word[i : i + 2] = [word[i] + word[i + 1]]
    return (rank[word[0]], rank[word[1]]) if len(word) == 2 else None


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """A vocabulary from a rank file (lines of base64 token and rank)."""
    with open(path, "rb") as f:
        rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    tokens = sorted(rank, key=rank.get)
    if [rank[t] for t in tokens] != list(range(len(tokens))) or len(tokens) + SHIFT > 0xD800:
        raise ValueError("the ranks must be 0, 1, 2, ... and stay below the surrogate code points")
    parts = tuple(_split(t, rank) for t in tokens)
    return Vocabulary(tuple(tokens), parts, rank, {p: i for i, p in enumerate(parts) if p})


def _constant(texts: list[str]) -> Column:
    """A constant array of strings, which the optimizer folds into one compact literal."""
    return F.split(F.lit("\x03".join(texts)), "\x03")


def _buckets(spark: SparkSession, keys: list[str], entries: list[str], head: str) -> Column:
    """A constant hash table: an array of strings, each with the entries whose keys have its hash by Spark's function."""
    places = spark.createDataFrame(pd.DataFrame({"i": range(len(keys)), "k": keys}), "i int, k string").select("i", F.pmod(F.hash("k"), F.lit(BUCKETS)).alias("h"))
    table = [head] * BUCKETS
    for r in places.collect():
        table[r.h] += entries[r.i]
    return _constant(table)


def _bucket(table: Column, key: Column) -> Column:
    return F.get(table, F.pmod(F.hash(key), F.lit(BUCKETS)))


def _behind(text: Column, mark: Column) -> Column:
    """What follows the last mark in text; all of the text if there is none."""
    return F.call_function("substring_index", text, mark, F.lit(-1))


class _Merges:
    """What a pair of token characters merges to: NONE, which is above every token, if nothing."""

    NONE = "�"

    def __init__(self, spark: SparkSession, pairs: list[str], merged: list[str]):
        # only the two characters of a pair stand side by side, so a pair is found nowhere else
        self.table = _buckets(spark, pairs, [f" {p} {m}" for p, m in zip(pairs, merged)], self.NONE * 2)

    def __call__(self, pair: Column) -> Column:
        return F.substring(_behind(_bucket(self.table, pair), pair), 2, 1)


class _Words:
    """The token characters of a known piece, and an empty string for any other."""

    def __init__(self, spark: SparkSession, known: dict[str, str]):
        known = {w: c for w, c in known.items() if not {"\x02", "\x03", "\x04"} & set(w)}
        self.table = _buckets(spark, list(known), [f"{w}\x04{c}\x02" for w, c in known.items()], "\x02")

    def __call__(self, word: Column) -> Column:
        found = _behind(_bucket(self.table, word), F.concat(F.lit("\x02"), word, F.lit("\x04")))
        return F.substring_index(found, "\x02", 1)


def _char(i: int) -> str:
    return chr(i + SHIFT)


def merge_ids(piece: bytes, v: Vocabulary) -> list[int]:
    """The token ids of one piece, in n log n steps: a heap of candidate merges over a linked list."""
    ids = [v.rank[bytes([b])] for b in piece]
    after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
    heap = [(r, i) for i in range(len(ids) - 1) if (r := v.merge.get((ids[i], ids[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        j = after[i] if ids[i] is not None else len(ids)
        if j >= len(ids) or v.merge.get((ids[i], ids[j])) != r:
            continue
        ids[i], ids[j] = r, None
        after[i] = k = after[j]
        if k < len(ids):
            before[k] = i
        for a, b in ((before[i], i), (i, k)):
            if a >= 0 and b < len(ids) and (m := v.merge.get((ids[a], ids[b]))) is not None:
                heapq.heappush(heap, (m, a))
    return [i for i in ids if i is not None]


_PATTERN = regex.compile(PIECES)


def encode_text(text: str | None, v: Vocabulary) -> list[int]:
    """The ids of one text on the plain path, for texts with very long pieces and for tests."""
    return [i for piece in _PATTERN.findall(text or "") for i in merge_ids(piece.encode(), v)]


class Encoder:
    """Column expressions for one vocabulary; the tables are constants of the plan, bounded by the vocabulary."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.vocabulary = v = vocabulary(path)
        self.latin = "".join(chr(b) for b in range(256))
        self.first = "".join(_char(v.rank[bytes([b])]) for b in range(256))
        merged = [i for i, p in enumerate(v.parts) if p]
        pair = ["".join(map(_char, p)) if p else "" for p in v.parts]
        self.merge = _Merges(spark, [pair[i] for i in merged], [_char(i) for i in merged])
        self.pair_of = _constant(pair)
        self.whole = {t.decode(): _char(i) for i, t in enumerate(v.tokens) if _is_text(t)}
        self.known = _Words(spark, self.whole)

    def fold(self, piece: Column) -> Column:
        """The token characters of a piece. Each step makes the lowest-ranked merge everywhere in the piece."""
        start = F.translate(F.decode(F.encode(piece, "UTF-8"), "ISO-8859-1"), self.latin, self.first)

        def step(s: Column, _: Column) -> Column:
            # a finished state is marked by a space in front; no token is a space
            done = F.concat(F.lit(" "), s)
            best = F.array_min(F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: self.merge(F.substring(s, i, F.lit(2)))))
            made = F.get(F.transform(F.array(best), lambda m: F.when(m == _Merges.NONE, done).otherwise(F.replace(s, F.get(self.pair_of, F.ascii(m) - SHIFT), m))), F.lit(0))
            return F.when(F.startswith(s, F.lit(" ")), s).when(F.length(s) < 2, done).otherwise(made)

        return F.ltrim(F.aggregate(F.sequence(F.lit(1), F.octet_length(piece)), start, step))

    def learn(self, documents: DataFrame, text: str) -> Encoder:
        """Remember the frequent words of a bounded sample of the documents, each folded once."""
        texts = documents.select(F.col(f"`{text}`").alias("t"))
        share = min(1.0, 1.2 * SAMPLE_DOCUMENTS / max(1, texts.count()))
        if share < 1:
            texts = texts.sample(share, seed=1)
        pieces = F.regexp_extract_all("t", F.lit(PIECES), F.lit(0))
        odd = texts.where(~_long(F.col("t"))).select(F.explode(F.filter(pieces, lambda p: self.known(p) == "")).alias("w"))
        top = odd.agg(F.expr(f"approx_top_k(w, {FREQUENT_WORDS}, {2 * FREQUENT_WORDS})").alias("top"))
        words = top.select(F.explode("top.item").alias("w")).where("w is not null").distinct().repartition(self.spark.sparkContext.defaultParallelism)
        known = dict(self.whole)
        known.update((r.w, r.c) for r in words.select("w", self.fold(F.col("w")).alias("c")).collect())  # at most FREQUENT_WORDS
        self.known = _Words(self.spark, known)
        return self

    def ids(self, text: Column) -> Column:
        """array<int> of a text's token ids; null and empty texts give an empty array, blank ones are ordinary texts."""
        pieces = F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))
        looked = F.transform(pieces, lambda p: F.struct(p.alias("p"), self.known(p).alias("c")))
        coded = F.transform(looked, lambda x: F.when(x["c"] == "", self.fold(x["p"])).otherwise(x["c"]))
        ids = F.transform(F.split(F.array_join(coded, ""), ""), lambda c: F.ascii(c) - SHIFT)
        return F.when(text != "", ids).otherwise(F.array().cast("array<int>"))

    def text(self, ids: Column) -> Column:
        """The text of token ids, the inverse of ids(): the tokens' bytes, joined and read as UTF-8."""
        pieces = _constant([t.hex() for t in self.vocabulary.tokens])
        return F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), "")), "UTF-8")


def _is_text(token: bytes) -> bool:
    try:
        token.decode()
        return True
    except UnicodeDecodeError:
        return False


def _long(text: Column) -> Column:
    """Whether a piece may be long: a stretch of LONG_PIECE / 4 bytes without a blank, or of blanks only."""
    stretch = LONG_PIECE // 4
    found = F.exists(F.split(text, " "), lambda x: F.octet_length(x) >= stretch) | F.contains(text, F.lit(" " * stretch))
    return F.coalesce((F.octet_length(text) >= LONG_PIECE) & found, F.lit(False))


def encode_corpus(documents: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(key, ids): one row for each document with the token ids of its text, without special tokens.

    Null and empty texts give an empty list, and a text that spells a special token is ordinary text. Repeated keys
    give a row each. Documents of LONG_PIECE bytes or more with a stretch that may be a long piece are encoded by the
    heap-based path in Arrow batches, with the same result; all others never leave the JVM.
    """
    spark = documents.sparkSession
    ship(spark)
    rows = documents.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("__text"))
    encoder = Encoder(spark, path).learn(documents, text)

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            ids = pa.array([encode_text(t, v) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], [key, "ids"])

    kind = rows.schema[key].dataType.simpleString()
    short = rows.where(~_long(F.col("__text"))).select(key, encoder.ids(F.col("__text")).alias("ids"))
    long = rows.where(_long(F.col("__text"))).mapInArrow(plain, f"`{key}` {kind}, ids array<int>")
    return short.unionByName(long)
