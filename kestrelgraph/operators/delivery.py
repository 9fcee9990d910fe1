"""At-least-once delivery: keep exactly one copy of each identified row.

Only the identifier, the delivery order and the row's position in its file are shuffled. The winners become one
64-bit deletion word per 64 file rows, stored by file. The (wide) payload is then read in place: each task looks up the
words of the file that it reads, so nothing is broadcast and the payload is never shuffled, at any size.
"""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrelgraph.runtime import fresh, materialize, scratch_path, ship

#: Deletion words in one stored part; a task reads those of its own file out of one part.
PART_WORDS = 1_000_000
#: Files whose words a Python worker keeps.
KEPT_FILES = 4


@dataclass
class Vectors:
    """Deletion words (f, word, bits) of one source, below path/part=<f modulo parts>, sorted by file."""

    path: str
    parts: int
    count: int


def identified(key: Column) -> Column:
    """Rows without an identifier (null or empty) are never duplicates of anything."""
    return key.isNotNull() & (key != "")


def _file() -> Column:
    return F.xxhash64(F.col("_metadata.file_path"))


def _row() -> Column:
    return F.col("_metadata.row_index")


def _bit(row: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(row, F.lit(64)).cast("int"))


def deletion_vectors(source: DataFrame, key: str, order: str, part_words: int = PART_WORDS) -> Vectors:
    """The rows of source to delete so that each identifier keeps its first delivered row.

    source must be a plain read of Parquet files. The winner is the row with the lowest order; nulls in order come
    last, and ties go to the lower file and row, so repeated rows also leave exactly one. A hot identifier is
    combined on the map side to one row per task. An empty table gives no words.
    """
    at = source.select(
        F.col(f"`{key}`").alias("k"), F.col(f"`{order}`").alias("o"), _file().alias("f"), _row().alias("r")
    ).where(identified(F.col("k")))
    winners = at.groupBy("k").agg(F.min(F.struct(F.col("o").isNull().alias("late"), "o", "f", "r")).alias("w"))
    zero = F.lit(0).cast("bigint")
    bits = at.select("f", F.expr("r div 64").alias("word"), _bit(F.col("r")).alias("held"), zero.alias("kept")).unionByName(
        winners.select(F.col("w.f").alias("f"), F.expr("w.r div 64").alias("word"), zero.alias("held"), _bit(F.col("w.r")).alias("kept"))
    )
    words = (
        bits.groupBy("f", "word")
        .agg((F.bit_or("held").bitwiseAND(F.bitwise_not(F.bit_or("kept")))).alias("bits"))
        .where("bits <> 0")
    )
    words = materialize(words)
    count = words.count()
    parts = max(1, -(-count // part_words))
    path = scratch_path(source.sparkSession)
    placed = words.withColumn("part", F.pmod("f", F.lit(parts))).repartition(min(parts, 2000), "part").sortWithinPartitions("part", "f", "word")
    placed.write.partitionBy("part").parquet(path)
    return Vectors(path, parts, count)


class _Lookup:
    """The deletion words of single files, read when a task first meets the file."""

    def __init__(self, vectors: Vectors):
        self.vectors = vectors
        self.held: OrderedDict[int, tuple[np.ndarray, np.ndarray]] = OrderedDict()

    def words(self, file: int) -> tuple[np.ndarray, np.ndarray]:
        if file in self.held:
            self.held.move_to_end(file)
            return self.held[file]
        where, path = fs.FileSystem.from_uri(self.vectors.path) if "://" in self.vectors.path else (fs.LocalFileSystem(), self.vectors.path.removeprefix("file:"))
        path = f"{path}/part={file % self.vectors.parts}"
        if where.get_file_info(path).type == fs.FileType.NotFound:
            out = np.zeros(0, np.int64), np.zeros(0, np.int64)
        else:
            t = ds.dataset(path, filesystem=where, format="parquet").to_table(columns=["word", "bits"], filter=ds.field("f") == file)
            word, bits = t["word"].to_numpy(), t["bits"].to_numpy()
            order = np.argsort(word)
            out = word[order], bits[order]
        self.held[file] = out
        if len(self.held) > KEPT_FILES:
            self.held.popitem(last=False)
        return out

    def deleted(self, file: int, row: np.ndarray) -> np.ndarray:
        word, bits = self.words(file)
        if not len(word):
            return np.zeros(len(row), bool)
        place = np.minimum(np.searchsorted(word, row // 64), len(word) - 1)
        return (word[place] == row // 64) & ((bits[place] >> (row % 64)) & 1 == 1)


_LOOKUPS: dict[str, _Lookup] = {}


def _deleted(vectors: Vectors):
    """The column function that tells from a file's hash and a row's number whether the row is deleted."""

    @F.pandas_udf("boolean")
    def deleted(file: pd.Series, row: pd.Series) -> pd.Series:
        if vectors.path not in _LOOKUPS:
            _LOOKUPS.clear()  # a worker serves one source at a time
            _LOOKUPS[vectors.path] = _Lookup(vectors)
        lookup, f, r = _LOOKUPS[vectors.path], file.to_numpy(), row.to_numpy()
        out = np.zeros(len(f), bool)
        for x in np.unique(f):
            at = f == x
            out[at] = lookup.deleted(int(x), r[at])
        return pd.Series(out)

    return deleted


def read_through(source: DataFrame, vectors: Vectors, deleted: bool = False) -> DataFrame:
    """The rows of source that the vectors keep (or, with deleted, those that they delete), in source's columns.

    Only a row's file and number go to Python; its columns stay where they were read.
    """
    if not vectors.count:
        return source.limit(0) if deleted else source
    ship(source.sparkSession)
    f, r = fresh(["file_key", "file_row"], source.columns)
    wide = source.select(*[F.col(f"`{c}`") for c in source.columns], _file().alias(f), _row().alias(r))
    gone = _deleted(vectors)(F.col(f), F.col(r))
    return wide.where(gone if deleted else ~gone).select(*[F.col(f"`{c}`") for c in source.columns])


def once(source: DataFrame, key: str, order: str, columns: list[str] | None = None) -> DataFrame:
    """source with each identified row exactly once; only the named columns are read, if given."""
    vectors = deletion_vectors(source, key, order)
    return read_through(source if columns is None else source.select(*columns), vectors)


def repeats(source: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """The rows that once() leaves out."""
    return read_through(source.select(*columns), deletion_vectors(source, key, order), deleted=True)
