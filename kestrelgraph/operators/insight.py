"""What is derived when facts arrive or a graph is looked over: facets, analogies, gaps, dormancy, links, bundles.

Edges are (g, s, r, o); nothing is joined across instances.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrelgraph.operators import mining
from kestrelgraph.operators.reasoning import Rule
from kestrelgraph.runtime import materialize

# What a place's name says about who lives there, in order; words of states; names that need no cause.
FACETS = {
    "ocean": "aquatic",
    "sea": "aquatic",
    "water": "aquatic",
    "river": "aquatic",
    "lake": "aquatic",
    "land": "terrestrial",
    "forest": "terrestrial",
    "jungle": "terrestrial",
    "desert": "terrestrial",
    "savanna": "terrestrial",
    "sky": "aerial",
    "air": "aerial",
}
STATES = ["wet", "hot", "cold", "dry", "broken", "active", "full", "empty"]
BASIC = ["self", "system"]
PLACES = ["lives_in", "located_in", "found_in", "part_of"]


def facet(place: Column) -> Column:
    """The facet of the first listed word that a place's name contains; null for none."""
    return F.coalesce(*[F.when(F.contains(F.lower(place), F.lit(k)), v) for k, v in FACETS.items()])


def facets(edges: DataFrame, relations: Sequence[str] = PLACES) -> DataFrame:
    """(g, facet, s): what lives in places of each kind."""
    rows = edges.where(F.col("r").isin(list(relations))).select("g", facet(F.col("o")).alias("facet"), "s")
    return rows.where("facet is not null").distinct()


def by_context(edges: DataFrame, category: str = "is") -> DataFrame:
    """(g, category, context, s): members of a category with a context that they match: a habitat type, a place they live
    in, a property or an ability."""
    m = edges.where(F.col("r") == category).select("g", "s", F.col("o").alias("category"))
    c = edges.where(F.col("r").isin("habitat_type", "lives_in", "has_property", "can")).select("g", "s", F.col("o").alias("context"))
    return m.join(c, ["g", "s"]).select("g", "category", "context", "s").distinct()


def inverses(edges: DataFrame) -> DataFrame:
    """(g, s, r, o): what a colour, a membership and a place say the other way round, where it is not stated."""
    back = F.when(F.col("r") == "color", "is_color_of").when(F.col("r") == "is", "has_instance")
    want = edges.select("g", F.col("o").alias("s"), back.alias("r"), F.col("s").alias("o")).where("r is not null").distinct()
    return want.join(edges, ["g", "s", "r", "o"], "left_anti")


def grandparents(fresh: DataFrame, edges: DataFrame, relation: str) -> DataFrame:
    """(g, s, r, o, confidence): a fresh membership (..., confidence) also gives the category's own categories: at medium
    if it is high, else at low. What is stated is left out."""
    up = edges.where(F.col("r") == relation).select(F.col("g").alias("ug"), F.col("s").alias("us"), F.col("o").alias("grand")).distinct()
    got = fresh.where(F.col("r") == relation).join(up, (F.col("g") == F.col("ug")) & (F.col("o") == F.col("us"))).where("grand <> s")
    rows = got.groupBy("g", "s", "r", F.col("grand").alias("o")).agg(F.max((F.col("confidence") == "high").cast("int")).alias("k"))
    return rows.join(edges, ["g", "s", "r", "o"], "left_anti").select("g", "s", "r", "o", F.when(F.col("k") == 1, "medium").otherwise("low").alias("confidence"))


def on_insert(fresh: DataFrame, edges: DataFrame, membership: str = "is") -> DataFrame:
    """(kind, g, s, r, o): everything that fresh facts (g, s, r, o, confidence) give at once, next to the stored edges:
    inverses, grandparents, facets, and what a category hands to a new member."""
    known = edges.unionByName(fresh.select("g", "s", "r", "o")).distinct()
    tag = lambda rows, kind: rows.select(F.lit(kind).alias("kind"), "g", "s", "r", "o")
    back = inverses(fresh.select("g", "s", "r", "o").distinct()).join(known, ["g", "s", "r", "o"], "left_anti")
    up = grandparents(fresh, known, membership)
    where = facets(fresh).select("g", "s", F.lit("habitat_type").alias("r"), F.col("facet").alias("o")).join(known, ["g", "s", "r", "o"], "left_anti")
    new = fresh.where(F.col("r") == membership).select("g", F.col("s").alias("member"), F.col("o").alias("c"))
    props = known.where(F.col("r").isin("has", "can", "color", "size", "shape")).select(F.col("g").alias("pg"), F.col("s").alias("ps"), "r", "o")
    down = new.join(props, (F.col("g") == F.col("pg")) & (F.col("c") == F.col("ps"))).select("g", F.col("member").alias("s"), "r", "o").distinct().join(known, ["g", "s", "r", "o"], "left_anti")
    return reduce(DataFrame.unionByName, [tag(back, "inverse"), tag(up, "grandparent"), tag(where, "facet"), tag(down, "inherited")])


def path_similar(edges: DataFrame, most: int = 30) -> DataFrame:
    """(g, r, via, members, a, b, confidence): the sources that reach the same node by the same relation, a class for each
    node and relation with its two first members; the first classes by size."""
    c = edges.distinct().groupBy("g", "r", F.col("o").alias("via")).agg(F.count("*").alias("members"), F.min("s").alias("a"), F.max("s").alias("b")).where("members >= 2")
    return c.orderBy(F.desc("members"), "g", "r", "via").limit(most).select("g", "r", "via", "members", "a", "b", F.lit(0.6).alias("confidence"))


def class_members(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """(g, r, via, s): who is in each class of path_similar()."""
    return edges.distinct().join(F.broadcast(classes.select("g", "r", F.col("via").alias("o"))), ["g", "r", "o"]).select("g", "r", F.col("o").alias("via"), "s")


def analogy_facts(items: DataFrame, share: float = 0.5, least: int = 1) -> DataFrame:
    """(g, holder, value, support): values that holders at least `share` similar, with `least` values in common, have and
    a holder lacks, with how many such holders offer it.

    items is (g, holder, value), distinct. Holders of equal sets are one class, which lacks nothing that its own members
    have: only pairs of classes are compared, so a hot value costs one comparison.
    """
    classes, values, members = mining.set_classes(items)
    one = values.withColumnRenamed("class", "holder")
    pairs = mining.shared_pairs(one, least, share).select("g", "a", "b")
    both = pairs.unionByName(pairs.select("g", F.col("b").alias("a"), F.col("a").alias("b")))
    k = classes.select(F.col("g").alias("kg"), F.col("class").alias("kf"), "members")
    v = values.select(F.col("g").alias("vg"), F.col("class").alias("vf"), "value")
    weighed = both.join(k, F.col("g").eqNullSafe(F.col("kg")) & (F.col("b") == F.col("kf")))
    offers = weighed.join(v, F.col("g").eqNullSafe(F.col("vg")) & (F.col("b") == F.col("vf"))).select("g", "a", "members", "value")
    sums = offers.groupBy("g", "a", "value").agg(F.sum("members").alias("support"))
    o = one.select(F.col("g").alias("og"), F.col("holder").alias("oh"), F.col("value").alias("ov"))
    missing = sums.join(o, F.col("g").eqNullSafe(F.col("og")) & (F.col("a") == F.col("oh")) & (F.col("value") == F.col("ov")), "left_anti")
    m = members.select(F.col("g").alias("mg"), "holder", "class")
    return missing.join(m, F.col("g").eqNullSafe(F.col("mg")) & (F.col("a") == F.col("class"))).select("g", "holder", "value", "support")


def supported_facts(items: DataFrame, least: int = 2, support: int = 2) -> DataFrame:
    """(g, holder, value, support): what at least `support` holders with `least` values in common with a holder have and it
    lacks. Both are at least 2; items (g, holder, value) may repeat.

    A value that one holder has alone neither joins holders nor is offered twice, and a holder with fewer than `least`
    others is similar to none: such rows go first. The rest is compared under numbers for the names; a number is the
    least row number of its name in a stored table, so two names never share one.
    """
    if least < 2 or support < 2:
        raise ValueError("least and support are at least 2")
    numbered = lambda rows, n, *by: rows.withColumn("__row", F.monotonically_increasing_id()).select("*", F.min("__row").over(Window.partitionBy(*by)).alias(n), F.count("*").over(Window.partitionBy(*by)).alias("__n"))
    rows = numbered(items.repartition("g", "value").distinct(), "v", "g", "value").where("__n >= 2")
    shared = materialize(rows.select("g", "holder", "value", "v"))
    kept = materialize(numbered(shared.select("g", "holder", "v"), "h", "g", "holder").where(F.col("__n") >= least).select("g", "holder", "v", "h"))

    classes, values, members = mining.set_classes(kept.select(F.lit(0).alias("g"), F.col("h").alias("holder"), F.col("v").alias("value")))
    one = materialize(values.select(F.col("class").alias("h"), "value"))
    pairs = materialize(mining.shared_pairs(one.select(F.lit(0).alias("g"), F.col("h").alias("holder"), "value"), least).select("a", "b"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    weighed = both.join(classes.select(F.col("class").alias("b"), "members"), "b")
    offers = weighed.join(one.select(F.col("h").alias("b"), "value").hint("merge"), "b").groupBy("a", "value").agg(F.sum("members").alias("support"))
    lacked = offers.where(F.col("support") >= support).join(one.select(F.col("h").alias("a"), "value").hint("merge"), ["a", "value"], "left_anti")
    who = kept.select("h", "g", "holder").distinct().join(members.select(F.col("holder").alias("h"), F.col("class").alias("a")), "h")
    named = shared.groupBy(F.col("v").alias("value")).agg(F.first("value").alias("name"))
    return lacked.join(named.hint("merge"), "value").join(who.hint("merge"), "a").select("g", "holder", F.col("name").alias("value"), "support")


def sibling_analogies(categories: DataFrame, items: DataFrame, most: int = 20) -> DataFrame:
    """(g, entity, suggested, like, category, shared): "like is to category as entity is to what?": entity shares two or
    more values with like, lacks its category, and gets another category that the category's other members have.

    categories is (g, s, category), items (g, holder, value); the first by shared values.
    """
    c = categories.distinct()
    pairs = mining.shared_pairs(items.distinct(), 2).select("g", "a", "b", "shared")
    both = pairs.unionByName(pairs.select("g", F.col("b").alias("a"), F.col("a").alias("b"), "shared"))
    x = both.join(c.select("g", F.col("s").alias("a"), "category"), ["g", "a"])
    lacking = x.join(c.select("g", F.col("s").alias("b"), "category"), ["g", "b", "category"], "left_anti")
    other = c.select("g", "category", F.col("s").alias("sibling")).join(c.select("g", F.col("s").alias("sibling"), F.col("category").alias("suggested")), ["g", "sibling"]).where("suggested <> category")
    other = other.groupBy("g", "category", "suggested").agg(F.min("sibling").alias("sibling"), F.count("*").alias("siblings"))
    offers = lacking.join(other, ["g", "category"]).where("siblings > 1 or sibling <> a").select("g", F.col("b").alias("entity"), "suggested", F.col("a").alias("like"), "category", "shared").distinct()
    new = offers.join(c.select("g", F.col("s").alias("entity"), F.col("category").alias("suggested")), ["g", "entity", "suggested"], "left_anti")
    return new.select("g", "entity", "suggested", "like", "category", "shared").orderBy(F.desc("shared"), "g", "entity", "suggested", "like", "category").limit(most)


def dormant(seen: DataFrame, now: Column, days: int, accesses: int = 10) -> DataFrame:
    """(g, node): entities of (g, node, at, n) that nobody has used for some days and that few ever used."""
    idle = F.unix_micros(now) - F.unix_micros("at") >= F.lit(days * 86_400_000_000)
    return seen.where(idle & (F.col("n") < accesses)).select("g", "node")


def awake(edges: DataFrame, sleeping: DataFrame) -> DataFrame:
    """The edges of no dormant subject."""
    return edges.join(sleeping.select("g", F.col("node").alias("s")), ["g", "s"], "left_anti")


def revived(fresh: DataFrame, sleeping: DataFrame) -> DataFrame:
    """(g, node): dormant entities that fresh edges name again."""
    named = fresh.select("g", F.explode(F.array("s", "o")).alias("node")).distinct()
    return sleeping.join(named, ["g", "node"], "left_semi")


def chain_gaps(edges: DataFrame) -> DataFrame:
    """(g, node, kind): ends of chains that ask for more: a last node that names a state leads somewhere, and a first
    one, unless it is basic, comes from somewhere."""
    starts, ends = edges.select("g", F.col("s").alias("node")).distinct(), edges.select("g", F.col("o").alias("node")).distinct()
    any_of = lambda words: reduce(lambda a, b: a | b, [F.contains(F.lower("node"), F.lit(w)) for w in words])
    last = ends.join(starts, ["g", "node"], "left_anti").where(any_of(STATES)).withColumn("kind", F.lit("leads to what"))
    first = starts.join(ends, ["g", "node"], "left_anti").where(~any_of(BASIC)).withColumn("kind", F.lit("caused by what"))
    return last.unionByName(first)


def shown_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges both of whose ends are among nodes (g, node)."""
    n = nodes.select("g", "node").distinct()
    return edges.join(n.withColumnRenamed("node", "s"), ["g", "s"], "left_semi").join(n.withColumnRenamed("node", "o"), ["g", "o"], "left_semi").select("g", "s", "r", "o")


def coactivation_links(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(g, s, o, via, relation): what both ends of each pair (g, s, o) reach, and what its relations make of the link.

    One such node links the ends: it shares a category, a property or an ability with them, is a cause, or just relates.
    """
    out = edges.select("g", F.col("s").alias("x"), F.col("o").alias("via")).distinct()
    both = pairs.join(out.withColumnRenamed("x", "s"), ["g", "s"]).join(out.withColumnRenamed("x", "o"), ["g", "o", "via"]).where("via <> s and via <> o")
    has = lambda *rs: F.max(F.col("r").isin(*rs).cast("int"))
    kinds = edges.groupBy("g", F.col("s").alias("via")).agg(has("is").alias("a"), has("has").alias("b"), has("can").alias("c"), has("causes", "leads_to").alias("d"))
    named = F.when(F.col("a") == 1, "shares_category").when(F.col("b") == 1, "shares_property").when(F.col("c") == 1, "shares_ability").when(F.col("d") == 1, "causal_link").otherwise("related_through")
    return both.join(kinds, ["g", "via"], "left").select("g", "s", "o", "via", named.alias("relation"))


def cofired(components: DataFrame, active: DataFrame, amount: float = 0.3, cap: float = 2.0) -> DataFrame:
    """(node, level): levels after each active node of (node, level) gives the rest of its assembly an extra amount."""
    a = active.select("node", "level")
    firing = a.join(components, "node").groupBy("component").agg(F.count("*").alias("n"))
    own = components.join(firing, "component").join(a, "node", "left")
    extra = F.col("n") - F.col("level").isNotNull().cast("int")
    return own.select("node", F.round(F.least(F.coalesce("level", F.lit(0.0)) + amount * extra, F.lit(cap)), 6).alias("level")).where("level > 0")


def generalised(premises: Sequence[tuple[str, str, str]], conclusion: tuple[str, str, str], name: str = "learned") -> Rule:
    """A rule from an observed case: entities that occur in more than one of its facts become variables."""
    facts = [*premises, conclusion]
    count = lambda x: sum(x in (s, o) for s, _, o in facts)
    order = dict.fromkeys(x for s, _, o in facts for x in (s, o) if count(x) > 1)
    term = {x: f"?x{k}" for k, x in enumerate(order, 1)}
    case = [(term.get(s, s), r, term.get(o, o)) for s, r, o in facts]
    return Rule(name, tuple(case[:-1]), case[-1])
