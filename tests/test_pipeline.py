"""Deliveries, hierarchies and trailing periods against brute force."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kestrelgraph.operators import delivery, hierarchy, rolling

TURN = "id bigint, message_id string, session_id string, file_key string, word_no int"


def turns(seed, n=400):
    rng = random.Random(seed)
    ids = rng.sample(range(10_000), n)
    return [(i, rng.choice([None, "", "hot", "hot", *[f"m{k}" for k in range(60)], "M1"]), f"s{rng.randrange(5)}", "x", i) for i in ids]


@pytest.mark.parametrize("files,part_words", [(1, 1 << 20), (5, 1 << 20), (5, 4), (3, 1)])
def test_once_keeps_the_first_delivery(parquet, files, part_words):
    rows = turns(files)
    src = parquet(rows, TURN, files)
    vectors = delivery.deletion_vectors(src, "message_id", "id", part_words)
    first = {}
    for r in sorted(rows):
        if r[1]:
            first.setdefault(r[1], r[0])
    gone = {r[0] for r in rows if r[1] and first[r[1]] != r[0]}
    assert {r.id for r in delivery.read_through(src, vectors, True).collect()} == gone
    kept = delivery.read_through(src, vectors)
    assert kept.columns == src.columns
    assert sorted(tuple(r) for r in kept.collect() if r.message_id) == sorted(r for r in rows if r[1] and r[0] not in gone)
    assert kept.count() == len(rows) - len(gone)


def test_once_with_ties_nulls_and_no_rows(parquet):
    rows = [(None, "a", None, None, None), (7, "a", None, None, None), (7, "a", None, None, None), (None, "b", None, None, None), (None, None, None, None, None), (None, "", None, None, None), (None, "", None, None, None)]
    src = parquet(rows, TURN, 2)
    kept = delivery.once(src, "message_id", "id").collect()
    assert sorted((r.message_id or "", r.id) for r in kept if r.message_id) == [("a", 7), ("b", None)]
    assert sum(not r.message_id for r in kept) == 3
    empty = parquet([], TURN, name="none")
    assert delivery.once(empty, "message_id", "id").count() == 0
    assert delivery.repeats(empty, "message_id", "id", ["id"]).count() == 0


def brute_forest(pairs):
    parent = {}
    for g, c, p in sorted(pairs, key=lambda x: (str(x[0]), x[1], x[2] or "~"), reverse=True):
        parent[(g, c)] = (g, p) if p else None
        if p:
            parent.setdefault((g, p), None)
    out = {}
    for node in parent:
        path, seen = [node], {node}
        while (up := parent.get(path[-1])) and up not in seen:
            path.append(up)
            seen.add(up)
        if up:
            ring = path[path.index(up) :]
            out[node] = (min(x[1] for x in ring), -1 if node in ring else -2, "")
        else:
            names = [x[1] for x in reversed(path)]
            out[node] = (names[0], len(names) - 1, "/".join(names))
    return out


@pytest.mark.parametrize("seed,shape,size", [(1, "bushy", 1000), (2, "bushy", 40), (3, "chain", 25), (4, "rings", 30), (5, "star", 20)])
def test_forest_matches_brute_force(spark, seed, shape, size):
    rng = random.Random(seed)
    pairs = []
    for g in ("x", "y", None):
        for i in range(120):
            if shape == "chain":
                p = f"n{i - 1:03}" if i else None
            elif shape == "star":
                p = "n000" if i else None
            elif shape == "rings":
                p = f"n{rng.randrange(120):03}"
            else:
                p = f"n{rng.randrange(max(1, i)):03}" if i and rng.random() < 0.9 else None
            pairs.append((g, f"n{i:03}", p))
    nodes = spark.createDataFrame([(g, c, p) for g, c, p in pairs], "g string, c string, p string")
    linked = hierarchy.links(nodes, F.col("g"), F.col("c"), F.col("p"))
    got = {(r.g, r.node): (r.root, r.depth, r.path) for r in hierarchy.forest(linked, size).collect()}
    assert got == brute_forest(pairs)


def test_links_clean_names_and_descendants(spark):
    rows = [("i", " Big Hall ", "the_house"), ("i", "big_hall", "The House"), ("i", "self", "self"), ("i", None, "x"), ("i", "  ", "y"), ("i", "lone", None), ("i", "cup", "BIG hall")]
    df = spark.createDataFrame(rows, "g string, c string, p string")
    trees = hierarchy.forest(hierarchy.links(df, F.col("g"), F.col("c"), F.col("p")))
    got = {r.node: (r.root, r.depth, r.path) for r in trees.collect()}
    assert got == {"big_hall": ("the_house", 1, "the_house/big_hall"), "the_house": ("the_house", 0, "the_house"), "cup": ("the_house", 2, "the_house/big_hall/cup"),
                   "self": ("self", -1, ""), "x": ("x", 0, "x"), "y": ("y", 0, "y"), "lone": ("lone", 0, "lone")}
    assert {(r.node, r.descendant, r.distance) for r in hierarchy.descendants(trees).collect()} == {("the_house", "big_hall", 1), ("the_house", "cup", 2), ("big_hall", "cup", 1)}
    assert hierarchy.forest(hierarchy.links(df.limit(0), F.col("g"), F.col("c"), F.col("p"))).count() == 0


DAY = "entity string, day date, a bigint, b bigint"


def brute_rolling(amounts, spans):
    by = defaultdict(lambda: defaultdict(lambda: [0, 0]))
    for e, d, a, b in amounts:
        by[e][d][0] += a
        by[e][d][1] += b
    out = set()
    for e, days in by.items():
        d = min(days)
        while d <= max(days):
            row = [e, d]
            for m in (0, 1):
                for s in spans:
                    row.append(sum(days[d - dt.timedelta(k)][m] for k in range(s) if d - dt.timedelta(k) in days))
            out.add(tuple(row))
            d += dt.timedelta(1)
    return out


def amounts(rng, n, entities="pqr"):
    day = dt.date(2025, 1, 1)
    return [(rng.choice(entities), day + dt.timedelta(rng.randrange(90)), rng.randrange(50), rng.randrange(50)) for _ in range(n)]


def daily(spark, rows):
    return spark.createDataFrame(rows, DAY).groupBy("entity", "day").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_versions_of_the_rolling_state(spark, tmp_path, seed):
    rng = random.Random(seed)
    spans, day = (3, 10), dt.date(2025, 1, 1)
    batches = [
        amounts(rng, 25), [], amounts(rng, 6, "pqs") + [("p", dt.date(2025, 6, 1), 5, 5), ("q", dt.date(2024, 12, 1), 7, 7)],
        [("p", day + dt.timedelta(40), -3, 2), (None, day, 1, 1), ("p", None, 1, 1), ("t", day, None, 4)], amounts(rng, 10, "pt"),
    ]
    state, sofar = rolling.State(spark, str(tmp_path), "string", ["a", "b"], spans), []
    for k, rows in enumerate(batches, 1):
        state.advance(spark.createDataFrame(rows, DAY))
        sofar += [(e, d, a or 0, b) for e, d, a, b in rows if e and d]
        got = [tuple(r) for r in state.totals().collect()]
        assert len(got) == len(set(got)) and set(got) == brute_rolling(sofar, spans)
        new = {tuple(r)[:2] for r in state.read("totals", k, k).collect()}
        reach = {(e, d + dt.timedelta(n)) for e, d, _, _ in rows if e and d for n in range(max(spans))}
        head = {(e, x) for e, x, *_ in got} - {tuple(r)[:2] for r in state.totals(k - 1).collect()}
        late = {e: [d for x, d, _, _ in rows if x == e and d] for e, _ in new}
        assert head <= new and all(e in late and min(late[e]) <= d or (e, d) in head for e, d in new) and (reach & {x[:2] for x in got}) <= new
    again = rolling.State(spark, str(tmp_path), "string", ["a", "b"], spans, version=2)
    assert {tuple(r) for r in again.totals().collect()} == brute_rolling(batches[0], spans)
    means = rolling.averages(state.totals(), ["a"], (3,)).first()
    assert means.avg_a_3 == pytest.approx(means.a_3 / 3)


def test_replay_makes_a_version_for_each_period(spark, tmp_path):
    rng = random.Random(9)
    rows = [(*r, rng.choice("xyz")) for r in amounts(rng, 60)]
    arrivals = spark.createDataFrame(rows, DAY + ", period string")
    state = rolling.replay(arrivals, "period", str(tmp_path), ["a", "b"], (3, 10))
    assert state.version == 3 and {tuple(r) for r in state.totals().collect()} == brute_rolling([r[:4] for r in rows], (3, 10))
    assert rolling.replay(arrivals.limit(0), "period", str(tmp_path / "none"), ["a", "b"]).totals().count() == 0


def test_daily_leaves_out_rows_without_entity_or_time(spark):
    at = dt.datetime(2025, 1, 1, 23, 59)
    rows = [("p", at, 1, None), ("p", at, None, None), (None, at, 1, 1), ("p", None, 1, 1)]
    df = spark.createDataFrame(rows, "entity string, day timestamp, a bigint, b bigint")
    got = rolling.daily(df, "entity", "day", {"a": "a", "b": "b"}).collect()
    assert [tuple(r) for r in got] == [("p", dt.date(2025, 1, 1), 1, 0)]
    assert rolling.daily(df.limit(0), "entity", "day", {"a": "a"}).count() == 0
