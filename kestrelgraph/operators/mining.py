"""Patterns over edges (g, s, r, o): shared properties, signatures, gaps, coverage, bridges, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrelgraph.runtime import materialize

#: Words of 64 bits in which a holder's values are marked.
WORDS = 8


def shared_pairs(items: DataFrame, least: int, share: float = 0.0) -> DataFrame:
    """(g, a, b, shared, na, nb): the pairs a < b of holders in a group g that share at least `least` values, and with
    share, have at least that Jaccard similarity.

    items is (g, holder, value), distinct. Two holders with `least` values in common have one in common even after
    each holder's most frequent least - 1 values are set aside, so only the others generate candidates: a value that
    everybody has pairs nobody by itself. A similarity demands at least that share of the larger holder's values in
    common, which sets more of them aside. What two holders can still share after the first value in common, and the bits
    by which their hashed sets differ, leave out most of the rest inside the join. Candidates are counted over all their
    values, so no pair is lost.
    """
    freq = items.groupBy(F.col("g").alias("fg"), F.col("value").alias("fv")).agg(F.count("*").alias("f"))
    sized = items.join(freq, F.col("g").eqNullSafe(F.col("fg")) & (F.col("value") == F.col("fv")))
    w = Window.partitionBy("g", "holder")
    bit = F.pmod(F.xxhash64("value"), F.lit(64 * WORDS))
    words = [F.bit_or(F.when((bit / 64).cast("int") == i, F.expr(f"shiftleft(1L, cast(pmod(xxhash64(value), {64 * WORDS}) % 64 as int))")).otherwise(F.lit(0))).over(w).alias(f"w{i}") for i in range(WORDS)]
    ranked = materialize(sized.select("g", "holder", "value", F.row_number().over(w.orderBy("f", "value")).alias("k"), F.count("*").over(w).alias("n"), *words))
    need = F.greatest(F.lit(least), F.ceil(share * F.col("n") - 1e-9))
    lead = ranked.where(F.col("k") <= F.col("n") - need + 1)
    side = lambda p, g, h, v: lead.select(F.col("g").alias(g), F.col("holder").alias(h), F.col("value").alias(v), F.col("n").alias(f"{p}n"), F.col("k").alias(f"{p}k"), *[F.col(f"w{i}").alias(f"{p}w{i}") for i in range(WORDS)])
    x, y = side("x", "g", "a", "v"), side("y", "yg", "b", "yv")
    sized = F.least("xn", "yn") >= F.greatest("xn", "yn") * share - 1e-9
    both_need = F.greatest(F.lit(least), F.ceil((F.col("xn") + F.col("yn")) * (share / (1 + share)) - 1e-9))
    # at the first value in common the rest of the smaller side is all that can follow; bits that differ are values that differ
    follows = F.least(F.col("xn") - F.col("xk"), F.col("yn") - F.col("yk")) + 1 >= both_need
    differ = sum(F.bit_count(F.col(f"xw{i}").bitwiseXOR(F.col(f"yw{i}"))) for i in range(WORDS))
    near = F.col("xn") + F.col("yn") - differ >= 2 * both_need
    on = F.col("g").eqNullSafe(F.col("yg")) & (F.col("v") == F.col("yv")) & (F.col("a") < F.col("b")) & sized & follows & near
    # merge: a stored table's compressed size would let Spark broadcast it
    pairs = x.join(y.hint("merge"), on).select("g", "a", "b", F.col("xn").alias("na"), F.col("yn").alias("nb")).distinct()
    # the values of the smaller holder are looked up in the larger one
    few = F.col("na") <= F.col("nb")
    turned = pairs.select("*", F.when(few, F.col("a")).otherwise(F.col("b")).alias("low"), F.when(few, F.col("b")).otherwise(F.col("a")).alias("high"))
    p = ranked.select(F.col("g").alias("pg"), F.col("holder").alias("ph"), F.col("value").alias("pv"))
    q = ranked.select(F.col("g").alias("qg"), F.col("holder").alias("qh"), F.col("value").alias("qv"))
    both = turned.join(p.hint("merge"), F.col("g").eqNullSafe(F.col("pg")) & (F.col("low") == F.col("ph"))).join(q.hint("merge"), F.col("g").eqNullSafe(F.col("qg")) & (F.col("high") == F.col("qh")) & (F.col("pv") == F.col("qv")))
    out = both.groupBy("g", "a", "b").agg(F.count("*").alias("shared"), F.max("na").alias("na"), F.max("nb").alias("nb")).where(F.col("shared") >= least)
    return out.where(jaccard(out) >= share - 1e-9) if share else out


def set_classes(items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, values, members) of items (g, holder, value), distinct: holders of equal value sets are one class, named
    by its first holder. classes is (g, class, members, n), values is (g, class, value), members is (g, holder, class).

    Sets are told apart by their size and two 64-bit hashes over their values, so no holder's values are gathered.
    """
    print_ = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("value")).alias("h"), F.bit_xor(F.xxhash64(F.lit(1), "value")).alias("k")]
    sets = materialize(items.groupBy("g", "holder").agg(*print_))
    classes = materialize(sets.groupBy("g", "n", "h", "k").agg(F.min("holder").alias("class"), F.count("*").alias("members")))
    c = classes.select(F.col("g").alias("cg"), F.col("n").alias("cn"), F.col("h").alias("ch"), F.col("k").alias("ck"), "class")
    members = sets.join(c, F.col("g").eqNullSafe(F.col("cg")) & (F.col("n") == F.col("cn")) & (F.col("h") == F.col("ch")) & (F.col("k") == F.col("ck"))).select("g", "holder", "class")
    first = classes.select(F.col("g").alias("cg"), "class")
    values = items.join(first, F.col("g").eqNullSafe(F.col("cg")) & (F.col("holder") == F.col("class"))).select("g", "class", "value")
    return classes.select("g", "class", "members", "n"), values, members


def similar_classes(items: DataFrame, least: int, share: float = 0.0) -> DataFrame:
    """(g, a, b, shared, na, nb, members_a, members_b): the classes of holders that share `least` values and have at least
    the Jaccard similarity share, as pairs a < b of their first holders.

    A class with several members and enough values is a pair with itself (a = b). Every link between two holders is a
    pair of their classes, so none is lost and copies are not spelled out; set_classes() has who is in a class.
    """
    classes, values, _ = set_classes(items)
    pairs = shared_pairs(values.withColumnRenamed("class", "holder"), least, share)
    of = lambda g, k, m: classes.select(F.col("g").alias(g), F.col("class").alias(k), F.col("members").alias(m))
    apart = pairs.join(of("xg", "xk", "members_a"), F.col("g").eqNullSafe(F.col("xg")) & (F.col("a") == F.col("xk"))).join(of("yg", "yk", "members_b"), F.col("g").eqNullSafe(F.col("yg")) & (F.col("b") == F.col("yk")))
    columns = ["g", "a", "b", "shared", "na", "nb", "members_a", "members_b"]
    twice = lambda c, *names: [F.col(c).alias(n) for n in names]
    own = classes.where((F.col("members") > 1) & (F.col("n") >= least)).select("g", *twice("class", "a", "b"), *twice("n", "shared", "na", "nb"), *twice("members", "members_a", "members_b"))
    return apart.select(*columns).unionByName(own)


def jaccard(pairs: DataFrame) -> Column:
    return F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))


def signatures(edges: DataFrame, least: int = 2) -> DataFrame:
    """(g, signature, members, first): classes of subjects with the same set of at least `least` relations.
    Repeated edges count once."""
    sets = edges.groupBy("g", "s").agg(F.collect_set("r").alias("rs")).where(F.size("rs") >= least)
    return sets.select("g", "s", F.array_join(F.array_sort("rs"), "|").alias("signature")).groupBy("g", "signature").agg(F.count("*").alias("members"), F.min("s").alias("first"))


def value_classes(edges: DataFrame) -> DataFrame:
    """(g, r, o, members, first, last): the subjects that share a value, as one row for each value with several."""
    return edges.groupBy("g", "r", "o").agg(F.count("*").alias("members"), F.min("s").alias("first"), F.max("s").alias("last")).where("members >= 2")


def transitive_gaps(edges: DataFrame) -> DataFrame:
    """(g, a, r, c, via): A-B and B-C by the same relation without A-C; via is the alphabetically first B."""
    x = edges.select("g", "r", F.col("s").alias("a"), F.col("o").alias("b"))
    y = edges.select(F.col("g").alias("yg"), F.col("r").alias("yr"), F.col("s").alias("yb"), F.col("o").alias("c"))
    two = x.join(y, (F.col("g") == F.col("yg")) & (F.col("r") == F.col("yr")) & (F.col("b") == F.col("yb"))).where("a <> c and a <> b and b <> c")
    known = edges.select("g", "r", F.col("s").alias("a"), F.col("o").alias("c"))
    return two.groupBy("g", "r", "a", "c").agg(F.min("b").alias("via")).join(known, ["g", "r", "a", "c"], "left_anti")


def lonely(degrees: DataFrame, most: int = 2) -> DataFrame:
    """Nodes with at most `most` edges, and a score of 1 minus 0.3 for each."""
    n = F.col("out_degree") + F.col("in_degree")
    return degrees.where(n <= most).select("instance", "node", n.alias("edges"), F.round(1 - 0.3 * n, 6).alias("score"))


def missing_inverse(edges: DataFrame, inverse: DataFrame) -> DataFrame:
    """The reverse edges that inverse (r, back) asks for and the edges lack."""
    i = inverse.select(F.col("r").alias("ir"), "back")
    want = edges.join(i, F.col("r") == F.col("ir")).select("g", F.col("o").alias("s"), F.col("back").alias("r"), F.col("s").alias("o")).distinct()
    return want.join(edges, ["g", "s", "r", "o"], "left_anti")


def co_occurring(statements: DataFrame, least: int) -> DataFrame:
    """(g, a, b, n, confidence): unordered pairs named together in at least `least` statements (g, x, y)."""
    pairs = statements.where("x <> y").select("g", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return pairs.groupBy("g", "a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least).withColumn("confidence", F.round(F.least(F.lit(0.9), 0.4 + 0.1 * F.col("n")), 6))


def accumulated(patterns: DataFrame, start: float, least: int = 3, gate: float = 0.6) -> DataFrame:
    """Patterns (key columns, run) seen in k runs: support k, confidence start + 0.05 for each repeat up to 0.95."""
    keys = [c for c in patterns.columns if c != "run"]
    runs = patterns.distinct().groupBy(*keys).agg(F.count("*").alias("support"))
    conf = F.least(F.lit(0.95), start + 0.05 * (F.col("support") - 1))
    return runs.withColumn("confidence", F.round(conf, 6)).where((F.col("support") >= least) & (F.col("confidence") >= gate))


def coverage(members: DataFrame, properties: DataFrame) -> DataFrame:
    """(category, r, o, holders, size, ratio): how many members of each category have each property."""
    sizes = members.groupBy("category").agg(F.count("*").alias("size"))
    held = members.join(properties, members.member == properties.s).groupBy("category", "r", "o").agg(F.count("*").alias("holders"))
    return held.join(sizes, "category").withColumn("ratio", F.round(F.col("holders") / F.col("size"), 6))


def bridges(members: DataFrame) -> DataFrame:
    """(a, relation, b, shared, na, nb): how the categories of (category, member) relate by the members they share.

    Equal sets are equivalent, a proper subset is one, half of the smaller overlaps, a quarter (or two shared) is
    similar. Symmetric relations come once, a < b; a subset comes from the smaller to the larger.
    """
    items = members.select(F.col("category").alias("holder"), F.col("member").alias("value")).distinct()
    sizes = items.groupBy("holder").agg(F.count("*").alias("n"))
    # members of the same categories count together: each different set of categories makes its pairs once
    sets = items.groupBy("value").agg(F.array_sort(F.collect_list("holder")).alias("cs")).groupBy("cs").agg(F.count("*").alias("k")).where("size(cs) > 1")
    pairs = sets.select(F.explode("cs").alias("a"), "cs", "k").select("a", F.explode("cs").alias("b"), "k").where("a < b").groupBy("a", "b").agg(F.sum("k").alias("shared"))
    pairs = pairs.join(sizes.select(F.col("holder").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("holder").alias("b"), F.col("n").alias("nb")), "b")
    s, na, nb = F.col("shared"), F.col("na"), F.col("nb")
    low, high = F.least(s / na, s / nb), F.greatest(s / na, s / nb)
    kind = (
        F.when((s == na) & (s == nb), "equivalent_to").when((s == na) | (s == nb), "subset_of").when(low >= 0.5, "overlaps_with")
        .when((low >= 0.25) | (s >= 2) | (high >= 0.5), "similar_to")
    )
    turn = (s == nb) & (na > nb)
    out = pairs.withColumn("relation", kind).where("relation is not null")
    pick = lambda p, q: F.when(turn, F.col(q)).otherwise(F.col(p))
    return out.select(pick("a", "b").alias("a"), "relation", pick("b", "a").alias("b"), "shared", pick("na", "nb").alias("na"), pick("nb", "na").alias("nb"))


def components(pairs: DataFrame) -> DataFrame:
    """(node, component): connected components of undirected pairs (a, b), labelled by their smallest node.

    Alternates joining every node's neighbours to the smallest of them with doing so only for larger neighbours; the
    number of rounds grows with the logarithm of the largest component. It goes on until nothing changes. A hub's
    neighbours are only aggregated.
    """
    e = materialize(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    # whether a round changed the edges is told by their number and hashes, in one scan
    print_of = lambda rows: tuple(rows.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())
    before, now = None, print_of(e)
    while now != before:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(low, F.col("a") == F.col("k")).where("b > a").select(F.col("b").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        down = large.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        small = down.join(least, F.col("a") == F.col("k")).select(F.col("b").alias("x"), F.col("m").alias("y"))
        small = small.unionByName(least.select(F.col("k").alias("x"), F.col("m").alias("y"))).where("x <> y")
        new = materialize(small.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        e = new
        before, now = now, print_of(e)
    roots = e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return e.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))
