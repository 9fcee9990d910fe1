"""Parent-child links to full hierarchies: path, depth, root, descendants and cycles of a forest of unknown depth.

Each round puts nodes into fragments of bounded size, follows the parent chains inside each fragment to where they
leave it, and goes on with only those nodes at which some chain of another fragment arrives (the quotient forest).
Half of the nodes travel to their parent's fragment, so any chain shrinks by a fixed factor a round whatever the
number of fragments is. When everything has been resolved the fragment paths are expanded on the way back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrelgraph.runtime import materialize, ship

#: Nodes that one task contracts at a time.
FRAGMENT_ROWS = 50_000
#: Hot keys at most, whatever the number of nodes: what counts as hot rises with it. They are broadcast.
HOT_KEYS = 200_000
#: Parts into which the rows of a hot key are dealt for a join.
SALTS = 32

OPEN, TREE, CYCLE, INTO_CYCLE = 0, 1, -1, -2
#: Joins the names of a fragment inside the solver; it cannot be part of a cleaned name.
SEP = "\x1f"
SCHEMA = "g string, k string, t string, frag string, n bigint, low string, st int, root string"


def links(rows: DataFrame, group: Column, child: Column, parent: Column) -> DataFrame:
    """(g, k, t): one row for each node with its parent t, null for a root.

    Names differing in letter case, outer blanks, or blank for underscore are one node. A child without a name gives
    no node, a missing parent makes a root. Repeated links collapse; if a node has several parents the
    alphabetically first one holds. A null group is a group of its own.
    """
    clean = lambda c: F.when(F.trim(c) != "", F.replace(F.translate(F.lower(F.trim(c)), SEP, ""), F.lit(" "), F.lit("_")))
    pairs = rows.select(group.alias("g"), clean(child).alias("c"), clean(parent).alias("p"))
    both = F.array(F.struct(F.col("c").alias("k"), F.col("p").alias("t")), F.struct(F.col("p").alias("k"), F.lit(None).cast("string").alias("t")))
    return (
        pairs.select("g", F.explode(both).alias("x"))
        .select("g", "x.k", "x.t")
        .where("k is not null")
        .groupBy("g", "k")
        .agg(F.min("t").alias("t"))
    )


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Follow the chains of one fragment; rows that stay open point to a node of another fragment."""
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    pdf = pd.concat(parts, ignore_index=True)
    g, k, t = (pdf[c].tolist() for c in ("g", "k", "t"))
    frag, n, low, st, root = (pdf[c].tolist() for c in ("frag", "n", "low", "st", "root"))
    at = {key: i for i, key in enumerate(zip(g, k))}
    up = [at.get((g[i], t[i]), -1) if st[i] == OPEN else -1 for i in range(len(k))]
    seen = bytearray(len(k))  # 1: on the walk, 2: finished
    for start in range(len(k)):
        if seen[start]:
            continue
        walk, i = [], start
        while i >= 0 and not seen[i]:
            seen[i] = 1
            walk.append(i)
            i = up[i]
        if i >= 0 and seen[i] == 1:  # the walk ran into itself
            turn = walk[walk.index(i) :]
            first = min(low[j] for j in turn)
            for j in turn:
                st[j], root[j], t[j], frag[j], seen[j] = CYCLE, first, None, "", 2
            walk = walk[: len(walk) - len(turn)]
        for j in reversed(walk):
            seen[j] = 2
            p = up[j]
            if p < 0:
                continue
            if st[p] in (CYCLE, INTO_CYCLE):
                st[j], root[j], t[j], frag[j] = INTO_CYCLE, root[p], None, ""
            else:
                frag[j] = frag[p] + SEP + frag[j]
                n[j] += n[p]
                low[j] = min(low[j], low[p])
                st[j], root[j], t[j] = st[p], root[p], t[p]
    out = pd.DataFrame({"g": g, "k": k, "t": t, "frag": frag, "n": n, "low": low, "st": st, "root": root}, dtype=object)
    for a in range(0, len(out), 10_000):
        yield out.iloc[a : a + 10_000]


def _home(rows: DataFrame, level: int, size: int) -> Column:
    """The fragment key: a node's own hash, or its parent's if the coins fall so. Rows of a hot parent stay apart."""
    own, parent = F.xxhash64(F.lit(level), "g", "k"), F.xxhash64(F.lit(level), "g", "t")
    coin = lambda h: F.pmod(h, F.lit(2))
    return F.when(F.col("t").isNotNull() & ~F.col("hot") & (coin(own) == 0) & (coin(parent) == 1), parent).otherwise(own)


def _marked(rows: DataFrame, limit: int) -> DataFrame:
    """rows (g, t, ...) with hot: whether more than limit rows have the same t. At most HOT_KEYS keys are broadcast."""
    hot = rows.where("t is not null").groupBy("g", "t").count().where(F.col("count") > limit).select(F.col("g").alias("hg"), F.col("t").alias("ht"), F.lit(True).alias("hot"))
    marked = rows.join(F.broadcast(hot), F.col("g").eqNullSafe(F.col("hg")) & (F.col("t") == F.col("ht")), "left")
    return marked.withColumn("hot", F.coalesce("hot", F.lit(False))).drop("hg", "ht")


def _solve(rows: DataFrame, level: int, size: int) -> DataFrame:
    total = rows.count()
    fragments = -(-total // size)
    if fragments <= 1:
        placed = rows.coalesce(1)
    else:
        limit = max(2, size // 4, total // HOT_KEYS)
        placed = _marked(rows, limit)
        placed = placed.withColumn("home", _home(placed, level, size)).repartition(fragments, "home").select(*rows.columns)
    done = materialize(placed.mapInPandas(_contract, SCHEMA))
    if fragments <= 1:
        return done
    open_rows = done.where(F.col("st") == OPEN)
    exits = open_rows.select(F.col("g").alias("eg"), F.col("t").alias("ek")).distinct()
    quotient = materialize(done.join(exits, F.col("g").eqNullSafe(F.col("eg")) & (F.col("k") == F.col("ek")), "left_semi"))
    solved = _solve(quotient, level + 1, size)

    s = solved.select(F.col("g").alias("sg"), F.col("k").alias("sk"), F.col("frag").alias("sfrag"), F.col("n").alias("sn"), F.col("st").alias("sst"), F.col("root").alias("sroot"))
    # a global cycle runs through at most one chain to each exit: the longest one of a node known to be on the cycle
    turning = s.where(F.col("sst") == CYCLE).select(F.col("sg").alias("cg"), F.col("sk").alias("ck"))
    chains = (
        open_rows.join(turning, F.col("g").eqNullSafe(F.col("cg")) & (F.col("k") == F.col("ck")))
        .groupBy(F.col("g").alias("cg"), F.col("t").alias("ct"))
        .agg(F.max_by("frag", "n").alias("chain"))
    )
    s = s.join(chains, F.col("sg").eqNullSafe(F.col("cg")) & (F.col("sk") == F.col("ct")), "left").drop("cg", "ct")
    # rows that leave through a hot exit are dealt over several tasks, with a copy of the exit's solution in each
    dealt = _marked(open_rows, limit).withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("k"), F.lit(SALTS))).otherwise(0))
    hot_exits = dealt.where("hot").select(F.col("g").alias("xg"), F.col("t").alias("xk"), F.lit(SALTS - 1).alias("last")).distinct()
    s = s.join(F.broadcast(hot_exits), F.col("sg").eqNullSafe(F.col("xg")) & (F.col("sk") == F.col("xk")), "left").drop("xg", "xk")
    s = s.withColumn("ssalt", F.explode(F.sequence(F.lit(0), F.coalesce("last", F.lit(0)))))
    met = dealt.join(s, F.col("g").eqNullSafe(F.col("sg")) & (F.col("t") == F.col("sk")) & (F.col("salt") == F.col("ssalt")))
    tree = F.col("sst") == TREE
    turns = F.coalesce((F.col("sst") == CYCLE) & F.startswith(F.concat("chain", F.lit(SEP)), F.concat("frag", F.lit(SEP))), F.lit(False))
    opened = met.select(
        "g",
        "k",
        F.lit(None).cast("string").alias("t"),
        F.when(tree, F.concat("sfrag", F.lit(SEP), "frag")).otherwise("").alias("frag"),
        F.when(tree, F.col("n") + F.col("sn")).otherwise(F.col("n")).alias("n"),
        "low",
        F.when(tree, TREE).when(turns, CYCLE).otherwise(INTO_CYCLE).cast("int").alias("st"),
        F.col("sroot").alias("root"),
    )
    return done.where(F.col("st") != OPEN).unionByName(opened)


def forest(nodes: DataFrame, fragment_rows: int = FRAGMENT_ROWS) -> DataFrame:
    """(g, node, root, depth, path, trail) for each row of nodes (g, k, t), as links() gives them.

    A root has depth 0 and path runs from root to node, joined by "/"; trail holds the same names as an array. Nodes on a cycle get depth -1, nodes that lead
    into one -2; both have an empty path and, as root, the alphabetically first node of the cycle. A parent that is
    no row itself would have no end: links() gives every parent a row.
    """
    is_root = F.col("t").isNull()
    start = nodes.select(
        "g", "k", "t", F.col("k").alias("frag"), F.lit(1).cast("bigint").alias("n"), F.col("k").alias("low"),
        F.when(is_root, TREE).otherwise(OPEN).cast("int").alias("st"), F.when(is_root, F.col("k")).alias("root"),
    )
    ship(nodes.sparkSession)
    solved = _solve(materialize(start), 0, fragment_rows)
    tree = F.col("st") == TREE
    return solved.select("g", F.col("k").alias("node"), "root", F.when(tree, F.col("n") - 1).otherwise(F.col("st")).cast("bigint").alias("depth"), F.when(tree, F.replace("frag", F.lit(SEP), F.lit("/"))).otherwise("").alias("path"), F.when(tree, F.split("frag", SEP)).alias("trail"))


def descendants(trees: DataFrame) -> DataFrame:
    """(g, node, descendant, distance): each node of a tree with every node below it, from forest()'s rows.

    The number of rows is the sum of the depths. Nodes on or below a cycle have no finite set and give no rows.
    """
    up = trees.where("depth > 0").select("g", F.col("node").alias("descendant"), "depth", F.posexplode(F.slice("trail", F.lit(1), F.col("depth").cast("int"))).alias("at", "node"))
    return up.select("g", "node", "descendant", (F.col("depth") - F.col("at")).alias("distance"))
