"""Held-out test items that leaked into training text.

The parts of the test items (passage, question, answer) form a BM25 index over word trigrams. Every training document
is a query: it retrieves all parts whose score reaches a share THETA of the score that the part has for itself. Upper
bounds skip work as in block-max WAND, for a whole Arrow batch at a time: documents whose matched terms cannot reach
THETA at their best parts, then blocks of parts whose block maxima cannot. What is retrieved is verified: the
document's and the part's common trigrams are aligned in order, and the part's wording in that alignment is weighed.
"""

from __future__ import annotations

import html
import pickle
import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelgraph.llm.canonical import LOOKALIKES
from kestrelgraph.runtime import fresh, materialize, ship

K1, B = 1.2, 0.75
#: Share of a part's self-score from which it is retrieved; weighed share of its wording from which a passage has leaked
#: ("about half": an altered word costs its neighbours' weight too), and a question or an answer.
THETA, COVERED, ECHOED = 0.2, 0.3, 0.8
#: Words that may be altered between two runs of common wording and still be aligned with each other.
GAP = 8
#: The share of a part's trigrams, the rarest ones, whose rarity is full weight: wording that near-equal items share is as
#: rare as most of theirs, so it keeps its weight; what many items begin or end with does not.
OWN_SHARE = 0.5
BLOCK = 8
#: Parts in one index, and indexes that one scan of the documents visits (together they bound a worker's memory). The
#: statistics are those of all parts, so neither number changes a result.
ITEMS, INDEXES_A_SCAN = 5_000, 4
PARTS = ["passage", "question", "answer"]

_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"<[/a-zA-Z!][^<>\n]{0,80}>")
_BROKEN = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[ \t>]*(?=[^\W\d_])")
_ANSWER = re.compile(r"\s*(?:answer|a)\s*[:.]", re.I)


def words(text: str) -> list[str]:
    """The words of a text without letter case, width, mark-up, invisible characters, hyphenation or punctuation."""
    if "<" in text or "&" in text:
        text = html.unescape(_TAG.sub("", text))
    if "-\n" in text or "-\r" in text or "- \n" in text:
        text = _BROKEN.sub("", text)
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKC", text) if unicodedata.category(c) != "Cf").casefold().translate(LOOKALIKES)
        return _WORD.findall(text)
    return _WORD.findall(text.lower())


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"i": pdf["i"], "lines": [[x for x in (t or "").splitlines() if x.strip()] for t in pdf["t"]]})


def split_item(lines: list[str], shared: bool) -> list[tuple[int, list[str]]]:
    """(number of PARTS, words) of an item's lines: without a first line that several items begin with (shared), the
    last line is a question if it ends as one, and an answer may follow it."""
    x, out = list(lines), []
    if len(x) > 1 and shared:
        x = x[1:]
    if len(x) > 2 and x[-2].rstrip().endswith("?") and _ANSWER.match(x[-1]):
        out.append((2, _ANSWER.sub("", x.pop())))
    if len(x) > 1 and x[-1].rstrip().endswith("?"):
        out.append((1, re.sub(r"^\s*question\s*:", "", x.pop(), flags=re.I)))
    return [(p, words(t)) for p, t in [(0, "\n".join(x)), *out]]


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(i, p, w) for i, x, s in zip(pdf["i"], pdf["lines"], pdf["shared"]) for p, w in split_item(x, s) if len(w) >= 3]
        yield pd.DataFrame(rows, columns=["i", "part", "words"])


@dataclass
class Index:
    """Postings of the distinct parts of one shard; items with the same part share one entry."""

    entry: np.ndarray
    part: np.ndarray
    vocabulary: dict[str, int]
    terms: np.ndarray  # sorted trigram keys
    best: np.ndarray  # by term, the highest weight at any entry
    block_from: np.ndarray  # by term, where its (block, maximum) pairs begin
    block_of: np.ndarray
    block_max: np.ndarray
    from_: np.ndarray  # by term, where its postings begin
    passage: np.ndarray
    weight: np.ndarray  # of a posting, as a share of the entry's self-score
    word_ids: list[np.ndarray]  # by entry
    own: list[np.ndarray]  # by entry and trigram, the weight of the trigram: 1 for the part's rarer ones
    places: dict[int, dict[int, list[int]]] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: list[tuple[int, int, list[str], list[int]]], n: int, mean: float) -> Index | None:
        """rows are (entry, part, words, by trigram the number of parts that use it); n parts with mean trigrams."""
        if not rows:
            return None
        vocabulary = {w: k for k, w in enumerate(sorted({w for r in rows for w in r[2]}))}
        size = len(vocabulary)
        ids = [np.array([vocabulary[w] for w in r[2]], np.int64) for r in rows]
        grams = [((a[:-2] * size + a[1:-1]) * size + a[2:]).tolist() for a in ids]
        posted = defaultdict(list)
        for p, (x, r) in enumerate(zip(grams, rows)):
            norm = K1 * (1 - B + B * len(x) / mean)
            used = dict(zip(x, r[3]))
            w = {g: np.log(1 + (n - used[g] + 0.5) / (used[g] + 0.5)) * f * (K1 + 1) / (f + norm) for g, f in Counter(x).items()}
            whole = sum(w.values())
            for g, v in w.items():
                posted[g].append((p, v / whole))
        terms = sorted(posted)
        blocks = [sorted({p // BLOCK: max(v for q, v in posted[g] if q // BLOCK == p // BLOCK) for p, _ in posted[g]}.items()) for g in terms]
        offsets = lambda xs: np.concatenate([[0], np.cumsum([len(x) for x in xs])]).astype(np.int64)
        flat = lambda xs, k, kind: np.array([y[k] for x in xs for y in x], kind)
        post = [posted[g] for g in terms]
        return cls(
            np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int32), vocabulary, np.array(terms, np.int64), np.array([max(v for _, v in x) for x in post]),
            offsets(blocks), flat(blocks, 0, np.int64), flat(blocks, 1, float), offsets(post), flat(post, 0, np.int64), flat(post, 1, float),
            ids, [own_weights(r[3]) for r in rows],
        )

    def search(self, texts: list[list[str]]) -> list[tuple[int, int, float, float]]:
        """(text number, number of the entry, score, coverage) of all parts that leaked into the texts' words."""
        counts = np.array([len(w) + 2 for w in texts], np.int64)
        ids = self._ids(texts)
        at, term = self._known(ids)
        if not len(at):
            return []
        owner = np.repeat(np.arange(len(texts)), counts)
        both = np.unique(owner[at] * len(self.terms) + term)
        hits = self._retrieve(both // len(self.terms), both % len(self.terms), len(texts))
        starts = np.concatenate([[0], np.cumsum(counts)])
        out = []
        for doc, p, score in hits:
            lo, hi = np.searchsorted(at, starts[doc]), np.searchsorted(at, starts[doc + 1])
            share = self._aligned(p, ids[starts[doc] : starts[doc + 1]], (at[lo:hi] - starts[doc]).tolist(), self.terms[term[lo:hi]].tolist())
            if share >= (COVERED if self.part[p] == 0 else ECHOED):
                out.append((doc, p, score, share))
        return out

    def _ids(self, texts: list[list[str]]) -> np.ndarray:
        get, ids = self.vocabulary.get, []
        for w in texts:
            ids += [get(x, -1) for x in w]
            ids += (-1, -1)
        return np.array(ids, np.int64)

    def _known(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The positions at which a trigram of the index begins, and its term."""
        size = len(self.vocabulary)
        ok = np.zeros(len(a), bool)
        ok[:-2] = (a[:-2] >= 0) & (a[1:-1] >= 0) & (a[2:] >= 0)
        at = np.flatnonzero(ok)
        key = (a[at] * size + a[at + 1]) * size + a[at + 2] if len(at) else at
        place = np.minimum(np.searchsorted(self.terms, key), len(self.terms) - 1)
        known = self.terms[place] == key
        return at[known], place[known]

    def _retrieve(self, doc: np.ndarray, term: np.ndarray, n: int) -> list[tuple[int, int, float]]:
        """(text number, entry, score) of all entries that reach THETA, from the distinct (text number, term) pairs."""
        # documents that cannot reach THETA even at their terms' best entries
        doc, term = _only(np.bincount(doc, self.best[term], n)[doc] >= THETA, doc, term)
        # blocks of entries that a document cannot reach THETA in
        d, at = _spread(doc, term, self.block_from)
        blocks = int(self.block_of.max()) + 1
        key, inv = np.unique(d * blocks + self.block_of[at], return_inverse=True)
        live = key[np.bincount(inv, self.block_max[at], len(key)) >= THETA] if len(key) else key
        doc, term = _only(np.isin(doc, live // blocks), doc, term)
        # exact scores in the blocks that are left
        d, at = _spread(doc, term, self.from_)
        p = self.passage[at]
        d, p, at = _only(np.isin(d * blocks + p // BLOCK, live), d, p, at)
        count = len(self.entry)
        key, inv = np.unique(d * count + p, return_inverse=True)
        score = np.bincount(inv, self.weight[at], len(key)) if len(key) else np.zeros(0)
        key, score = _only(score >= THETA, key, score)
        return list(zip((key // count).tolist(), (key % count).tolist(), score.tolist()))

    def _aligned(self, p: int, doc: np.ndarray, at: list[int], keys: list[int]) -> float:
        """The weighed share of entry p's words in the longest common sequence of trigrams, in order.

        doc has the text's word ids, at and keys its known trigrams. A word weighs as much as the rarest trigram around
        it (own_weights), so wording that many parts share counts little unless there is nothing else. Up to GAP altered words between
        two runs are aligned word by word.
        """
        places, mine = self.places.get(p), self.word_ids[p]
        if places is None:
            places, size = defaultdict(list), len(self.vocabulary)
            for k, g in reversed(list(enumerate(((mine[:-2] * size + mine[1:-1]) * size + mine[2:]).tolist()))):
                places[g].append(k)
            self.places[p] = places = dict(places)
        chain = _longest([(d, k) for d, g in zip(at, keys) for k in places.get(g, ())])
        if not chain:
            return 0.0
        own, n = self.own[p], len(mine)
        whole, held = np.zeros(n), np.zeros(n)
        ks = np.array([k for _, k in chain])
        for s in range(3):
            np.maximum(whole[s : s + len(own)], own, out=whole[s : s + len(own)])
            held[ks + s] = np.maximum(held[ks + s], own[ks])
        for (d1, k1), (d2, k2) in zip(chain, chain[1:]):
            a, b = mine[k1 + 3 : k2], doc[d1 + 3 : d2]
            if 0 < len(a) <= GAP and 0 < len(b) <= 2 * GAP:
                for k in _common(a.tolist(), b.tolist()):
                    held[k1 + 3 + k] = whole[k1 + 3 + k]
        return float(held.sum() / whole.sum())


def own_weights(used: list[int]) -> np.ndarray:
    """By trigram of a part, from the number of parts that use it: 1 up to the median of the part, less above it."""
    u = np.array(used, float)
    return np.minimum(1.0, np.sort(u)[int(OWN_SHARE * len(u))] / u)


def _longest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs that rises in both numbers; pairs come by the first, and falling in the second."""
    tails: list[int] = []
    last: list[int] = []
    before = [-1] * len(pairs)
    for i, (_, k) in enumerate(pairs):
        j = bisect_left(tails, k)
        if j == len(tails):
            tails.append(k)
            last.append(i)
        else:
            tails[j], last[j] = k, i
        before[i] = last[j - 1] if j else -1
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def _common(a: list[int], b: list[int]) -> list[int]:
    """The positions in a of a longest common subsequence of two short lists."""
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append(i)
            i, j = i + 1, j + 1
        elif t[i + 1][j] >= t[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _only(mask: np.ndarray, *arrays: np.ndarray) -> tuple[np.ndarray, ...]:
    return tuple(a[mask] for a in arrays)


def _spread(doc: np.ndarray, term: np.ndarray, from_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair repeated for every entry of its term's list, with the entry's place."""
    n = from_[term + 1] - from_[term]
    ends = np.cumsum(n)
    return np.repeat(doc, n), np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(from_[term], n)


def item_parts(items: DataFrame, item: str, item_text: str) -> DataFrame:
    """(i, part, words): the parts of at least three words of each item. First lines are compared over all items."""
    listed = items.select(F.col(f"`{item}`").cast("bigint").alias("i"), F.col(f"`{item_text}`").alias("t")).where("i is not null")
    split = materialize(listed.mapInPandas(_lines, "i bigint, lines array<string>"))
    first = F.when(F.size("lines") > 1, F.trim(F.get("lines", F.lit(0))))
    several = split.groupBy(first.alias("first")).count().where("count > 1 and first is not null").select("first", F.lit(True).alias("shared"))
    marked = split.withColumn("first", first).join(several, "first", "left").select("i", "lines", F.coalesce("shared", F.lit(False)).alias("shared"))
    return marked.mapInPandas(_split, "i bigint, part int, words array<string>")


def build(parts: DataFrame, shard_items: int = ITEMS) -> tuple[DataFrame, DataFrame]:
    """(members, shards): members (i, part, entry) has the items of each distinct part; shards (shard, blob) the indexes.

    How many parts use a trigram, their number and mean length are counted over all parts. The indexes are made in the tasks.
    """
    parts = materialize(parts.withColumn("entry", F.xxhash64("part", "words")))
    entries = parts.select("part", "entry", "words").dropDuplicates(["part", "entry"])
    members = parts.select("i", "part", "entry").distinct()
    gram = F.transform(F.sequence(F.lit(1), F.size("words") - 2), lambda k: F.array_join(F.slice("words", k, 3), " "))
    grams = materialize(entries.select("part", "entry", F.posexplode(gram).alias("pos", "gram")))
    used = grams.select("part", "entry", "gram").distinct().groupBy("gram").agg(F.count("*").alias("used"))
    counted = grams.join(used, "gram").groupBy("part", "entry").agg(F.array_sort(F.collect_list(F.struct("pos", "used"))).alias("u"))
    total = grams.groupBy("part", "entry").count().agg(F.count("*").alias("n"), F.avg("count").alias("mean")).first()
    n, mean = total.n, total.mean or 1.0
    shards = max(1, -(-n // shard_items))
    rows = entries.join(counted, ["part", "entry"]).select("part", "entry", "words", F.transform("u", lambda x: x["used"]).alias("used"), F.pmod(F.xxhash64("part", "entry"), F.lit(shards)).cast("int").alias("shard"))

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "entry"])
        index = Index.of([(e, p, list(w), list(u)) for e, p, w, u in zip(pdf["entry"], pdf["part"], pdf["words"], pdf["used"])], n, mean)
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "blob": [pickle.dumps(index)]})

    return members, rows.groupBy("shard").applyInPandas(make, "shard int, blob binary")


def leaks(documents: DataFrame, key: str, text: str, items: DataFrame, item: str, item_text: str, shard_items: int = ITEMS) -> DataFrame:
    """(key, item, part, score, coverage): each document with every part of an item that it carries: about half or more
    of a passage's wording in order, or most of a question or an answer.

    Each copy of a document counts, and items with the same part are all reported. Null and empty texts and parts of
    less than three words give no rows; a document key that repeats gives rows for each of its texts. The documents are
    never shuffled, and read once for INDEXES_A_SCAN shards of items.
    """
    spark = documents.sparkSession
    ship(spark)
    kind = documents.schema[key].dataType.simpleString()
    members, shards = build(item_parts(items, item, item_text), shard_items)
    entry, part, score, coverage = fresh(["entry", "part", "score", "coverage"], [key, item])
    rows = documents.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias(fresh(["text"], [key])[0]))
    shape = f"`{key}` {kind}, {entry} bigint, {part} int, {score} double, {coverage} double"

    def scan(held: list) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [words(t) if t else [] for t in batch.column(1).to_pylist()]
                found = []
                for h in held:
                    index = pickle.loads(h.value) if isinstance(h.value, bytes) else h.value
                    h._value = index  # the unpickled index serves the worker's other batches
                    found += [(n, int(index.entry[p]), int(index.part[p]), s, c) for n, p, s, c in index.search(texts)]
                columns = [batch.column(0).take(pa.array([x[0] for x in found], pa.int64()))]
                columns += [pa.array([x[k] for x in found], t) for k, t in ((1, pa.int64()), (2, pa.int32()), (3, pa.float64()), (4, pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, [key, entry, part, score, coverage])

        return rows.mapInArrow(search, shape)

    out, held = None, []
    hits = lambda: scan(list(held)) if out is None else out.unionByName(scan(list(held)))
    for r in shards.toLocalIterator():  # a bounded index each; the driver passes it on
        held.append(spark.sparkContext.broadcast(bytes(r.blob)))
        if len(held) == INDEXES_A_SCAN:
            out, held = hits(), []
    if held or out is None:
        out = hits()
    m = members.select(F.col("i").alias(item), F.col("part").alias("__part"), F.col("entry").alias("__entry"))
    out = out.join(m, (F.col(entry) == F.col("__entry")) & (F.col(part) == F.col("__part")))
    return out.select(key, item, F.get(F.array(*map(F.lit, PARTS)), F.col(part)).alias(part), score, coverage)
