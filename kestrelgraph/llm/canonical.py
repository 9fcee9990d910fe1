"""Mapping of freely entered values to a reference list.

The reference spellings form a BK-tree under the unrestricted Damerau-Levenshtein distance, a true metric, so the
triangle inequality prunes subtrees without losing an entry within the threshold. The list is cut into shards of
bounded size, whose trees are built in the tasks and broadcast; the winners of all shards are merged.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrelgraph.runtime import ship

UNMATCHED = "unmatched"
#: Reference entries per BK-tree, and trees that one scan of the values visits (together they bound a worker's memory).
SHARD_ENTRIES, SHARDS_A_SCAN = 5_000, 4
#: Share of a spelling's letters that may be edited, and the shortest cut-off beginning that still counts.
EDIT_SHARE, LEAST_PREFIX = 0.34, 5
#: Words that are put before or behind a value without being part of it. Words that deny it are not among them.
LEADING = frozenset("it he she they we you i that this which often sometimes usually always mostly generally also just really does did do has have had will would can could may might must to".split())
TRAILING = frozenset("a an the some any its their his her our your my it them this that".split())
#: Letters of other scripts that look like Latin ones, and figures written for letters.
LOOKALIKES = str.maketrans("авеёкмнорстухіјѕԁԛԝӏαβεικνορτυχ", "abeekmhopctyxijsdqwlabeikvoptux")
FIGURES = str.maketrans("013457@$", "oleastas")


def words(value: str) -> list[str]:
    """The plain lower-case words of a value, without case, accents, lookalike letters, punctuation or spacing games."""
    s = unicodedata.normalize("NFKC", value)
    s = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", s)
    s = unicodedata.normalize("NFKD", s.casefold())
    s = "".join(c for c in s if not unicodedata.combining(c) and unicodedata.category(c) != "Cf").translate(LOOKALIKES)
    out = [w.translate(FIGURES) if re.search(r"[a-z]", w) else w for w in re.split(r"[^a-z0-9@$]+", s) if w]
    return ["".join(out)] if len(out) > 2 and all(len(w) == 1 for w in out) else out


def readings(value: str) -> list[str]:
    """The squeezed spellings under which a value is looked up: as entered, and without words around it."""
    w = words(value)
    out = ["".join(w)]
    a = w
    while len(a) > 1 and a[0] in LEADING:
        a = a[1:]
        out.append("".join(a))
    b = w
    while len(b) > 1 and b[-1] in TRAILING:
        b, a = b[:-1], a[:-1] if len(a) > 1 else a
        out += ["".join(b), "".join(a)]
    return [x for x in dict.fromkeys(out) if x]


def distance(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance: insertion, deletion, substitution, transposition of neighbours.

    Unlike the restricted form it keeps the triangle inequality.
    """
    if a == b:
        return 0
    last: dict[str, int] = {}
    top = len(a) + len(b)
    d = [[top] * (len(b) + 2)] + [[top, i] + [0] * len(b) for i in range(len(a) + 1)]
    d[1][1:] = range(len(b) + 1)
    for i, x in enumerate(a, 1):
        match = 0
        row, above = d[i + 1], d[i]
        for j, y in enumerate(b, 1):
            i0, j0 = last.get(y, 0), match
            cost = 1
            if x == y:
                cost, match = 0, j
            row[j + 1] = min(above[j] + cost, row[j] + 1, above[j + 1] + 1, d[i0][j0] + (i - i0 - 1) + 1 + (j - j0 - 1))
        last[x] = i
    return d[-1][-1]


@dataclass
class BKTree:
    """Spellings under distance(); find() returns every one within a threshold. Nodes are numbered, so depth is no limit."""

    spellings: list[str] = field(default_factory=list)
    below: list[dict[int, int]] = field(default_factory=list)  # by node, its children by their distance

    def add(self, spelling: str) -> None:
        new, node = len(self.spellings), 0
        while new and (k := distance(spelling, self.spellings[node])):
            node = self.below[node].setdefault(k, new)
            if node == new:
                break
        else:
            if new:  # known already
                return
        self.spellings.append(spelling)
        self.below.append({})

    def find(self, value: str, within: int) -> list[tuple[int, str]]:
        out, todo = [], [0] if self.spellings else []
        while todo:
            node = todo.pop()
            k = distance(value, self.spellings[node])
            if k <= within:
                out.append((k, self.spellings[node]))
            todo += [child for e, child in self.below[node].items() if k - within <= e <= k + within]
        return out


@dataclass
class Lookup:
    """One shard of the reference list: its tree, what each spelling stands for, and the tree of spellings' beginnings."""

    tree: BKTree = field(default_factory=BKTree)
    entry: dict[str, set[str]] = field(default_factory=dict)
    beginnings: BKTree = field(default_factory=BKTree)
    begins: dict[str, set[str]] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: Iterable[tuple[str, Iterable[str | None]]]) -> Lookup:
        out = cls()
        for entry, spellings in rows:
            for s in [entry, *spellings]:
                key = "".join(words(s)) if s else ""
                if key:
                    out.entry.setdefault(key, set()).add(entry)
                    for n in range(LEAST_PREFIX, len(key)):
                        out.begins.setdefault(key[:n], set()).add(entry)
        for key in sorted(out.entry):
            out.tree.add(key)
        for key in sorted(out.begins):
            out.beginnings.add(key)
        return out

    def candidates(self, value: str) -> tuple[list[tuple[float, float, str]], dict[int, set[str]]]:
        """(cost, share edited, entry) of the close spellings; by reading, the entries that it is a beginning of."""
        found, cuts = [], {}
        for order, key in enumerate(readings(value)):
            if key in self.entry:  # nothing is closer than the spelling itself
                found += [(0.01 * order, 0.0, e) for e in self.entry[key]]
                break
            for k, spelling in self.tree.find(key, int(EDIT_SHARE * max(len(key), 3))):
                if k <= EDIT_SHARE * max(len(spelling), 3):
                    found += [(k + 0.01 * order, k / len(spelling), e) for e in self.entry[spelling]]
            for _, cut in self.beginnings.find(key, 0):
                cuts[order] = self.begins[cut]
        return found, cuts

    def partial(self, value: str) -> list[tuple[int, float | None, float | None, str | None]]:
        """(reading, cost, share edited, entry) of what one of several shards finds: its closest spelling as reading -1,
        and of each reading's beginnings two entries at most, as two are ambiguous already."""
        found, cuts = self.candidates(value)
        return [(-1, *min(found, default=(None, None, None)))] + [(order, _cut(order), 0.0, e) for order, cut in cuts.items() for e in sorted(cut)[:2]]


def _cut(order: int) -> float:
    """The cost of an unambiguous beginning."""
    return 0.5 + 0.01 * order


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "blob": [pickle.dumps(Lookup.of(zip(pdf["e"], pdf["s"])))]})


def canonical_map(values: DataFrame, reference: DataFrame, entry: str, spellings: list[str], shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """(value, match): each distinct value of the one-column DataFrame values with the closest entry, or "unmatched".

    An entry is matched through any of its spellings; ties in cost go to the closer spelling, then to the alphabet. A
    cut-off beginning counts if it is unambiguous among all entries, whatever shards they are in. Nulls, empty values and
    values without a letter or figure are unmatched; with an empty reference list everything is.
    """
    spark = values.sparkSession
    ship(spark)
    (column,) = values.columns
    # few bytes but much work for each value: spread over all cores
    distinct = values.select(F.col(f"`{column}`").alias("value")).where("value is not null").distinct().repartition(2 * spark.sparkContext.defaultParallelism)
    ref = reference.select(F.col(f"`{entry}`").alias("e"), F.array(*[F.col(f"`{s}`").cast("string") for s in spellings]).alias("s")).where("e is not null")
    shards = max(1, -(-ref.count() // shard_entries))
    blobs = ref.withColumn("shard", F.pmod(F.xxhash64("e"), F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(_build, "shard int, blob binary")

    def scan(held: list) -> DataFrame:
        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            lookups = [pickle.loads(h.value) for h in held]
            for pdf in batches:
                yield pd.DataFrame([(v, *c) for v in pdf["value"] for x in lookups for c in x.partial(v)], columns=["value", "reading", "cost", "share", "hit"])

        return distinct.mapInPandas(search, "value string, reading int, cost double, share double, hit string")

    held = [spark.sparkContext.broadcast(bytes(r.blob)) for r in blobs.toLocalIterator()]
    parts = [scan(held[i : i + SHARDS_A_SCAN]) for i in range(0, len(held), SHARDS_A_SCAN)]
    if not parts:
        return distinct.select("value", F.lit(UNMATCHED).alias("match"))
    best = reduce(DataFrame.unionByName, parts)
    # only here is known whether a beginning is another shard's too
    found = F.when(F.col("hit").isNotNull(), F.struct("cost", "share", "hit"))
    best = best.groupBy("value", "reading").agg(F.min(found).alias("b"), (F.min("hit") != F.max("hit")).alias("several")).select("value", F.when((F.col("reading") < 0) | ~F.col("several"), F.col("b")).alias("b"))
    return best.groupBy("value").agg(F.min("b").alias("b")).select("value", F.coalesce("b.hit", F.lit(UNMATCHED)).alias("match"))


def map_values(rows: DataFrame, column: str, reference: DataFrame, entry: str, spellings: list[str], shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """rows with a last column canonical_<column>: the value itself if it is an entry, else the entry meant, else "unmatched".

    Only distinct values are searched, so a value that fills a third of the rows costs one search; AQE splits its
    partition of the join back.
    """
    name = f"canonical_{column}"
    value = F.col(f"`{column}`")
    found = canonical_map(rows.select(value.alias("v")), reference, entry, spellings, shard_entries).select(F.col("value").alias("__value"), F.col("match").alias(name))
    out = rows.join(found, value == F.col("__value"), "left")
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce(name, F.lit(UNMATCHED)).alias(name))


def strays(rows: DataFrame, column: str, reference: DataFrame, entry: str) -> DataFrame:
    """The rows whose value is, character for character, no entry of the reference list; nulls included."""
    entries = reference.select(F.col(f"`{entry}`").alias("__entry")).distinct()
    return rows.join(entries, F.col(f"`{column}`") == F.col("__entry"), "left_anti")


def similarity(a: Column, b: Column) -> Column:
    """Levenshtein similarity of two columns, for reports."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
