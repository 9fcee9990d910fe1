"""Queries of pattern mining and reasoning, over the facts table and over the star schema's facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrelgraph.operators import hierarchy, mining, reasoning, star, store
from kestrelgraph.operators.reasoning import Rule
from kestrelgraph.runtime import materialize, table

RULES = [
    Rule("region_of_supplier", (("?x", "located_in", "?y"), ("?y", "part_of", "?z")), ("?x", "located_in", "?z")),
    Rule("home_of_customer", (("?n", "is", "nation"), ("?c", "part_of", "?n"), ("?n", "part_of", "?r")), ("?c", "lives_in", "?r")),
    Rule("segment_of_order", (("?o", "part_of", "?c"), ("?c", "has", "?g")), ("?o", "serves", "?g")),
]
#: Share of a category's members from which a property makes a rule, and from which it is expected of all.
RULE_SHARE, EXPECTED = 0.6, 0.7


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return store.edges(table(spark, d, "facts")).select(F.col("instance").alias("g"), F.col("subject").alias("s"), F.col("relation").alias("r"), F.col("object").alias("o"))


def _properties(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).select("g", F.col("s").alias("holder"), F.concat_ws("|", "r", "o").alias("value"))


def _hierarchy_edges(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "facts").where("relation = 'part_of'")
    nodes = hierarchy.links(rows, F.col("instance"), F.col("subject"), F.col("object")).where("t is not null")
    return nodes.select("g", F.col("k").alias("s"), F.lit("part_of").alias("r"), F.col("t").alias("o"))


def named(spark: SparkSession, d: str) -> DataFrame:
    """(g, s, r, o, confidence): the facts table with its names in one spelling; rows with a missing part are no facts."""
    f = table(spark, d, "facts").where("instance is not null and subject is not null and relation is not null and object is not null")
    return f.select(F.col("instance").alias("g"), star.low("subject").alias("s"), F.col("relation").alias("r"), star.low("object").alias("o"), F.coalesce("confidence", F.lit("medium")).alias("confidence")).distinct()


def property_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Classes of subjects with at least two properties in common; property_classes has who is in a class."""
    pairs = mining.similar_classes(_properties(spark, d), 2)
    return pairs.select("g", "a", "b", "shared", "members_a", "members_b", F.round(F.least(F.lit(0.8), 0.3 + 0.15 * F.col("shared")), 6).alias("confidence"))


def analogies(spark: SparkSession, d: str) -> DataFrame:
    """Classes of subjects with a property-set similarity of at least 0.3, those with one property in common included."""
    pairs = mining.similar_classes(_properties(spark, d), 1, 0.3)
    return pairs.select("g", "a", "b", "members_a", "members_b", F.round(mining.jaccard(pairs), 6).alias("similarity"))


def property_classes(spark: SparkSession, d: str) -> DataFrame:
    return mining.set_classes(_properties(spark, d))[2]


def structural_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of signature classes; each class stands for all its members. Signatures are compared under numbers."""
    f = table(spark, d, "facts").where("instance is not null and subject is not null and relation is not null and object is not null")
    found = mining.signatures(f.select(F.col("instance").alias("g"), F.col("subject").alias("s"), F.col("relation").alias("r")))
    classes = materialize(found.select("g", "signature", F.monotonically_increasing_id().alias("id")))
    items = classes.select("g", F.col("id").alias("holder"), F.explode(F.array_distinct(F.split("signature", r"\|"))).alias("value"))
    pairs = mining.shared_pairs(items, 2, 0.5)
    of = lambda i, c: classes.select(F.col("id").alias(i), F.col("signature").alias(c)).hint("merge")
    named = pairs.join(of("a", "x"), "a").join(of("b", "y"), "b")
    return named.select("g", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "shared", F.round(mining.jaccard(pairs), 6).alias("similarity"))


def co_occurrence(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "facts").select(F.col("instance").alias("g"), F.col("subject").alias("x"), F.col("object").alias("y"))
    return mining.co_occurring(rows, 3)


def pattern_accumulation(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "facts").where("created_at is not null")
    runs = rows.select("instance", "relation", "object", F.date_format("created_at", "yyyy-MM").alias("run"))
    return mining.accumulated(runs, 0.5)


def group_proposals(spark: SparkSession, d: str) -> DataFrame:
    """Customers with the same nation and segment: a proposed group for each signature of three or more members."""
    sets = star.places(spark, d).where("s like 'customer%'").groupBy("s").agg(F.array_join(F.array_sort(F.collect_set("o")), "_").alias("signature"))
    groups = sets.groupBy("signature").agg(F.count("*").alias("members"), F.min("s").alias("first")).where("members >= 3")
    return groups.select(F.concat("signature", F.lit("_group")).alias("name"), "members", "first")


def _types(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The customers of each nation that have ordered, and the priorities of their orders as their properties."""
    o = table(spark, d, "orders").select("o_custkey", star.low("o_orderpriority").alias("o")).distinct()
    home = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", star.low("n_name").alias("category"))
    members = home.join(o.select("o_custkey").distinct(), F.col("c_custkey") == F.col("o_custkey")).select("category", star.key("customer", "c_custkey").alias("member"))
    return members, o.select(star.key("customer", "o_custkey").alias("s"), F.lit("orders").alias("r"), "o")


def category_property_rules(spark: SparkSession, d: str) -> DataFrame:
    return mining.coverage(*_types(spark, d)).where((F.col("size") >= 3) & (F.col("ratio") >= RULE_SHARE))


def missing_properties(spark: SparkSession, d: str) -> DataFrame:
    """The members of a category that lack a property which is expected of it."""
    members, properties = _types(spark, d)
    want = mining.coverage(members, properties).where((F.col("size") >= 3) & (F.col("ratio") >= EXPECTED)).select("category", "r", "o", "ratio")
    return members.join(want, "category").select("category", F.col("member").alias("s"), "r", "o", "ratio").join(properties, ["s", "r", "o"], "left_anti")


def category_bridges(spark: SparkSession, d: str) -> DataFrame:
    parts = star.parts(spark, d)
    return mining.bridges(parts.select(F.col("o").alias("category"), F.col("s").alias("member")))


def components(spark: SparkSession, d: str) -> DataFrame:
    node = lambda c: F.concat_ws("/", "g", c)
    e = _hierarchy_edges(spark, d)
    return mining.components(e.select(node("s").alias("a"), node("o").alias("b")))


def _chained(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("r").isin(reasoning.TRANSITIVE) & (F.col("s") != F.col("o")))


def property_inheritance(spark: SparkSession, d: str) -> DataFrame:
    """What a customer has, as handed to the customer's orders."""
    p = star.places(spark, d)
    return reasoning.inherited(p.where("r = 'part_of'"), p.where("r = 'has'"))


def _abilities(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers' nations; what suppliers can, cannot and did deliver, and nations by their suppliers, with repetitions."""
    own = star.deliveries(spark, d).select("g", "s", "r", "o")
    home = materialize(star.places(spark, d).where("r = 'located_in'").select("g", "s", "o"))
    nation = home.select(F.col("g").alias("ng"), F.col("s").alias("supplier"), F.col("o").alias("place"))
    can = own.where("r = 'can'").join(F.broadcast(nation) if home.count() <= reasoning.FEW else nation, (F.col("g") == F.col("ng")) & (F.col("s") == F.col("supplier")))
    return home, own.unionByName(can.select("g", F.col("place").alias("s"), "r", "o"))


def gather_facts(spark: SparkSession, d: str) -> DataFrame:
    """Direct and inherited facts of every customer and order; a relation that is stated directly is not inherited."""
    p = star.places(spark, d)
    direct = p.select("g", "s", "r", "o", F.lit("direct").alias("kind")).distinct()
    got = reasoning.inherited(p.where("r = 'part_of'"), p.where("r = 'has'")).select("g", "s", "r", "o", F.lit("inherited").alias("kind"))
    back = p.where("r <> 'part_of'").select("g", F.col("o").alias("s"), "r", F.col("s").alias("o"), F.lit("reverse").alias("kind")).distinct()
    return direct.unionByName(back).unionByName(got.join(direct.select("g", "s", "r").distinct(), ["g", "s", "r"], "left_anti"))


def spread_activation(spark: SparkSession, d: str) -> DataFrame:
    """Two rounds from the three best-connected subjects of each instance; an edge weighs more the more often it was stated."""
    f = table(spark, d, "facts").where("instance is not null and subject is not null and object is not null")
    edges = f.groupBy(F.col("instance").alias("g"), F.col("subject").alias("s"), F.col("object").alias("o")).agg(F.least(F.lit(5.0), 1.0 + 0.1 * (F.count("*") - 1)).alias("weight"))
    n = edges.groupBy("g", F.col("s").alias("node")).agg(F.count("*").alias("n"))
    top = n.withColumn("k", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("n"), "node"))).where("k <= 3")
    return reasoning.spread(edges, top.select("g", "node", F.lit(1.0).alias("level")))


def incremental_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Conflicts in which the facts of open line items have part, against the stored ones of closed line items."""
    a = star.abilities(spark, d)
    return reasoning.contradictions(a.where("temporal = 'past'"), fresh=a.where("temporal = 'currently'"))


QUERIES = {
    "value_classes": lambda s, d: mining.value_classes(_edges(s, d)),
    "property_clusters": property_clusters,
    "analogies": analogies,
    "property_classes": property_classes,
    "signature_classes": lambda s, d: mining.signatures(_edges(s, d)),
    "structural_similarity": structural_similarity,
    "transitive_gaps": lambda s, d: mining.transitive_gaps(_hierarchy_edges(s, d)),
    "lonely_entities": lambda s, d: mining.lonely(store.degrees(store.edges(table(s, d, "facts")))),
    "inverse_relations": lambda s, d: mining.missing_inverse(_edges(s, d), table(s, d, "relation_defs").where("reverse is not null").selectExpr("relation as r", "reverse as back")),
    "co_occurrence": co_occurrence,
    "pattern_accumulation": pattern_accumulation,
    "group_proposals": group_proposals,
    "category_property_rules": category_property_rules,
    "missing_properties": missing_properties,
    "category_bridges": category_bridges,
    "components": components,
    "transitive_chain": lambda s, d: reasoning.chains(_chained(named(s, d))),
    "transitive_inference": lambda s, d: reasoning.inferred(_chained(named(s, d))),
    "place_chains": lambda s, d: reasoning.inferred(_chained(star.places(s, d))),
    "property_inheritance": property_inheritance,
    "contradictions": lambda s, d: reasoning.contradictions(star.abilities(s, d)),
    "incremental_conflicts": incremental_conflicts,
    "temporal_conflicts": lambda s, d: reasoning.temporal_conflicts(star.abilities(s, d)),
    "conflict_blocked_propagation": lambda s, d: reasoning.propagated(*_abilities(s, d)),
    "gather_facts": gather_facts,
    "reasoning_trace": lambda s, d: reasoning.traces(named(s, d).where("r = 'part_of' and s <> o"), named(s, d), ["mends", "echoes", "carves"]),
    "forward_chaining": lambda s, d: reasoning.forward_chain(RULES, star.places(s, d)),
    "rule_dry_run": lambda s, d: reasoning.dry_run(RULES, star.places(s, d)),
    "rule_exceptions": lambda s, d: reasoning.forward_chain(RULES, star.places(s, d), exceptions=s.createDataFrame([("lives_in", "has", "machinery")], "r string, er string, eo string")),
    "spread_activation": spread_activation,
    "coactivated": lambda s, d: reasoning.coactivated(spread_activation(s, d)),
}

_E = "e as (select distinct instance as g, subject as s, relation as r, object as o from facts where instance is not null and subject is not null and relation is not null and object is not null)"
_CLASSES = f"""{_E},
sets as (select g, s, list_sort(list(r || '|' || o)) as vs from e group by 1, 2), classes as (select g, vs, min(s) as k, count(*) as members from sets group by 1, 2),
v as (select g, k, unnest(vs) as v from classes),
apart as (select x.g, x.k as a, y.k as b, count(*) as shared from v x join v y on x.g = y.g and x.v = y.v and x.k < y.k group by 1, 2, 3),
pairs as (select p.g, a, b, shared, len(x.vs) as na, len(y.vs) as nb, x.members as members_a, y.members as members_b from apart p join classes x on x.g = p.g and x.k = a join classes y on y.g = p.g and y.k = b
  union all select g, k, k, len(vs), len(vs), len(vs), members, members from classes where members > 1)"""
_SIGNATURES = f"""{_E},
sets as (select g, s, string_agg(distinct r, '|' order by r) as signature, count(distinct r) as k from e group by 1, 2),
classes as (select g, signature, count(*) as members, min(s) as "first" from sets where k >= 2 group by 1, 2)"""
_UP = """h as (
  select g, s, min(o) as o from (select instance as g, lower(replace(trim(subject), ' ', '_')) as s, lower(replace(trim(object), ' ', '_')) as o from facts where relation = 'part_of') group by 1, 2)"""
_WEIGHT = "case confidence when 'high' then 1.0 when 'low' then 0.4 else 0.7 end"
_LABEL = "case when score >= 0.9 - 1e-9 then 'high' when score >= 0.5 - 1e-9 then 'medium' else 'low' end"
NAMED = """named as (select distinct instance as g, lower(replace(trim(subject), ' ', '_')) as s, relation as r, lower(replace(trim(object), ' ', '_')) as o, coalesce(confidence, 'medium') as confidence
  from facts where instance is not null and subject is not null and relation is not null and object is not null)"""
_CHAINED = "r in ('looks_like', 'is', 'causes', 'leads_to', 'part_of') and s <> o"
_CHAINS = lambda source: f"""steps as (select g, s, r, o, max(cast({_WEIGHT} as double)) as w from {source} where {_CHAINED} group by 1, 2, 3, 4),
walks as (select g, s, r, o, w as score, 1 as depth from steps union all
  select w.g, w.s, w.r, t.o, w.score * t.w, w.depth + 1 from walks w join steps t on t.g = w.g and t.r = w.r and t.s = w.o and t.o <> w.s where w.depth < 5),
chains as (select g, s, r, o, arg_min(depth, (-round(score, 9), depth)) as depth, round(max(score), 6) as score from walks group by 1, 2, 3, 4)"""  # noqa: E731
_INFERRED = lambda source: f"""select *, {_LABEL} as confidence from chains c
where depth > 1 and score >= 0.3 - 1e-9 and not exists (select 1 from {source} p where p.g = c.g and p.s = c.s and p.r = c.r and p.o = c.o)"""  # noqa: E731
_HELD = """props as (select distinct 'customer_' || o_custkey as s, 'orders' as r, lower(replace(trim(o_orderpriority), ' ', '_')) as o from orders),
members as (select lower(replace(n_name, ' ', '_')) as category, 'customer_' || c_custkey as member from customer join nation on c_nationkey = n_nationkey where 'customer_' || c_custkey in (select s from props)), sizes as (select category, count(*) as size from members group by 1),
cover as (select category, p.r, p.o, count(*) as holders, any_value(size) as size, round(count(*) / any_value(size), 6) as ratio from members m join props p on p.s = m.member join sizes using (category) group by 1, 2, 3)"""
_DERIVED = """one as (select s.g, s.s, 'located_in' as r, n.o from places s join places n on s.r = 'located_in' and n.r = 'part_of' and n.s = s.o),
two as (select distinct c.g, c.s, 'lives_in' as r, r.o from places n join places c on n.r = 'is' and n.o = 'nation' and c.r = 'part_of' and c.o = n.s join places r on r.r = 'part_of' and r.s = n.s),
three as (select distinct x.g, x.s, 'serves' as r, c.o from places x join places c on x.r = 'part_of' and c.r = 'has' and c.s = x.o)"""
_INHERITED = lambda source, kept, by="part_of": f"""{_CHAINS(source)},
got as (select c.g, c.s, p.r, p.o, round(max(c.score * cast({_WEIGHT} as double)), 6) as score from chains c join {source} p on p.g = c.g and c.r = '{by}' and c.depth <= 3 and {kept} and p.s = c.o group by 1, 2, 3, 4),
kept as (select * from got where score >= 0.3 - 1e-9 and not exists (select 1 from {source} p where p.g = got.g and p.s = got.s and p.r = got.r and p.o = got.o))"""  # noqa: E731
_SPREAD = """e as (select instance as g, subject as s, object as o, least(5.0, 1.0 + 0.1 * (count(*) - 1))::double as weight from facts where instance is not null and subject is not null and object is not null group by 1, 2, 3),
n as (select g, s as node, count(*) as n from e group by 1, 2), l0 as (select g, node, 1.0::double as level from n qualify row_number() over (partition by g order by n desc, node) <= 3),
m1 as (select l.g, e.o as node, l.node as source, l.level * 0.5 * weight as level from l0 l join e on e.g = l.g and e.s = l.node where l.level >= 0.1),
l1 as (select g, node, least(sum(level), 2.0) as level from (select * from l0 union all select g, node, level from m1) group by 1, 2),
m2 as (select l.g, e.o as node, l.node as source, l.level * 0.5 * weight as level from l1 l join e on e.g = l.g and e.s = l.node where l.level >= 0.1),
l2 as (select g, node, least(sum(level), 2.0) as level from (select * from l1 union all select g, node, level from m2) group by 1, 2),
c as (select g, node, count(distinct source) as sources from (select g, node, source from m1 union all select g, node, source from m2) group by 1, 2),
spread as (select g, node, round(level, 6) as level, coalesce(sources, 0) as sources from l2 left join c using (g, node))"""
SQL = {
    "value_classes": f"with {_E} select g, r, o, count(*) as members, min(s) as \"first\", max(s) as \"last\" from e group by 1, 2, 3 having count(*) >= 2",
    "property_clusters": f"with {_CLASSES} select g, a, b, shared, members_a, members_b, round(least(0.8, 0.3 + 0.15 * shared), 6)::double as confidence from pairs where shared >= 2",
    "analogies": f"with {_CLASSES} select g, a, b, members_a, members_b, round(shared / (na + nb - shared), 6) as similarity from pairs where round(shared / (na + nb - shared), 6) >= 0.3",
    "property_classes": f"with {_CLASSES} select s.g, s.s as holder, c.k as \"class\" from sets s join classes c on c.g = s.g and c.vs = s.vs",
    "signature_classes": f"with {_SIGNATURES} select * from classes",
    "structural_similarity": f"""with {_SIGNATURES}, c as (select g, signature, string_split(signature, '|') as rs from classes),
p as (select x.g, x.signature as a, y.signature as b, len(list_intersect(x.rs, y.rs)) as shared, len(x.rs) as na, len(y.rs) as nb from c x join c y on x.g = y.g and x.signature < y.signature)
select g, a, b, shared, round(shared / (na + nb - shared), 6) as similarity from p where shared >= 2 and round(shared / (na + nb - shared), 6) >= 0.5""",
    "transitive_gaps": f"""with {_UP} select x.g, 'part_of' as r, x.s as a, y.o as c, min(x.o) as via from h x join h y on y.g = x.g and y.s = x.o
where x.s <> y.o and x.s <> x.o and x.o <> y.o and not exists (select 1 from h z where z.g = x.g and z.s = x.s and z.o = y.o) group by 1, 2, 3, 4""",
    "lonely_entities": f"""with {_E}, n as (select g, s as node from e union all select g, o from e)
select g as instance, node, count(*) as edges, round(1 - 0.3 * count(*), 6)::double as score from n group by 1, 2 having count(*) <= 2""",
    "inverse_relations": f"""with {_E} select distinct e.g, e.o as s, d.reverse as r, e.s as o from e join relation_defs d on d.relation = e.r and d.reverse is not null
where not exists (select 1 from e b where b.g = e.g and b.s = e.o and b.r = d.reverse and b.o = e.s)""",
    "co_occurrence": "select instance as g, least(subject, object) as a, greatest(subject, object) as b, count(*) as n, round(least(0.9, 0.4 + 0.1 * count(*)), 6)::double as confidence from facts where subject <> object group by 1, 2, 3 having count(*) >= 3",
    "pattern_accumulation": """select instance, relation, object, count(distinct strftime(created_at, '%Y-%m')) as support, round(least(0.95, 0.5 + 0.05 * (count(distinct strftime(created_at, '%Y-%m')) - 1)), 6)::double as confidence
from facts where created_at is not null group by 1, 2, 3 having support >= 3 and confidence >= 0.6""",
    "group_proposals": f"""with {star.PLACES_SQL}, x as (select s, string_agg(distinct o, '_' order by o) as signature from places where s like 'customer%' group by 1)
select signature || '_group' as name, count(*) as members, min(s) as "first" from x group by signature having count(*) >= 3""",
    "category_property_rules": f"with {_HELD} select * from cover where size >= 3 and ratio >= {RULE_SHARE}",
    "missing_properties": f"""with {_HELD} select c.category, m.member as s, c.r, c.o, c.ratio from cover c join members m on m.category = c.category
where size >= 3 and ratio >= {EXPECTED} and not exists (select 1 from props p where p.s = m.member and p.r = c.r and p.o = c.o)""",
    "category_bridges": f"""with {star.PARTS_SQL}, m as (select distinct o as category, s as member from parts),
z as (select category, count(*) as n from m group by 1),
p as (select x.category as a, y.category as b, count(*) as shared from m x join m y on x.member = y.member and x.category < y.category group by 1, 2),
q as (select p.*, u.n as na, v.n as nb from p join z u on u.category = a join z v on v.category = b),
k as (select *, case when shared = na and shared = nb then 'equivalent_to' when shared = na or shared = nb then 'subset_of' when least(shared / na, shared / nb) >= 0.5 then 'overlaps_with'
  when least(shared / na, shared / nb) >= 0.25 or shared >= 2 or greatest(shared / na, shared / nb) >= 0.5 then 'similar_to' end as relation, shared = nb and na > nb as turn from q)
select case when turn then b else a end as a, relation, case when turn then a else b end as b, shared, case when turn then nb else na end as na, case when turn then na else nb end as nb from k where relation is not null""",
    "components": f"""with recursive {_UP}, x as (select g || '/' || s as a, g || '/' || o as b from h where s <> o), u as (select a, b from x union select b, a from x),
n as (select a as node from u), reach as (select node, node as other from n union select r.node, u.b from reach r join u on u.a = r.other)
select node, min(other) as component from reach group by 1""",
    "transitive_chain": f"with recursive {NAMED}, {_CHAINS('named')} select * from chains",
    "transitive_inference": f"with recursive {NAMED}, {_CHAINS('named')} {_INFERRED('named')}",
    "property_inheritance": f"""with recursive {star.PLACES_SQL}, {_INHERITED('places', "p.r = 'has'")} select *, {_LABEL} as confidence from kept""",
    "contradictions": f"with {star.ABILITIES_SQL} select distinct x.g, x.s, 'can' as positive, x.o from abilities x join abilities y on x.g = y.g and x.r = 'can' and y.r = 'cannot' and x.s = y.s and x.o = y.o",
    "conflict_blocked_propagation": f"""with {star.PLACES_SQL}, {star.ABILITIES_SQL}, home as (select s, o as place from places where r = 'located_in'),
common as (select distinct place, o from home join abilities a using (s) where a.r = 'can'), down as (select h.s, c.o from home h join common c using (place))
select 'supply' as g, s, 'can' as r, o, 'low' as confidence from down d where not exists (select 1 from abilities a where a.s = d.s and a.o = d.o and a.r in ('can', 'cannot'))""",
    "gather_facts": f"""with recursive {star.PLACES_SQL}, {_INHERITED('places', "p.r = 'has'")}, direct as (select distinct g, s, r, o from places)
select g, s, r, o, 'direct' as kind from direct union all select distinct g, o, r, s, 'reverse' from places where r <> 'part_of' union all select g, s, r, o, 'inherited' from kept k where not exists (select 1 from direct d where d.s = k.s and d.r = k.r)""",
    "reasoning_trace": f"""with recursive {NAMED}, held as (select distinct g, s, r, o from named where r in ('mends', 'echoes', 'carves')), e as (select distinct g, s, o from named where r = 'part_of' and s <> o),
start as (select g, s from held union select g, s from e), up as (select g, s, s as at_, s as path, 0 as steps from start union all select u.g, u.s, e.o, u.path || '>' || e.o, steps + 1 from up u join e on e.g = u.g and e.s = u.at_ where steps < 4)
select u.g, u.s, p.r, p.o, arg_min(steps, (steps, path)) as steps, arg_min(path, (steps, path)) as path from up u join held p on p.g = u.g and p.s = u.at_ group by 1, 2, 3, 4""",
    "forward_chaining": f"with {star.PLACES_SQL}, {_DERIVED} select g, s, r, o, 1 as round from (select * from one union select * from two union select * from three) x where not exists (select 1 from places p where p.s = x.s and p.r = x.r and p.o = x.o)",
    "rule_dry_run": f"""with {star.PLACES_SQL}, {_DERIVED}, x as (select distinct 'region_of_supplier' as rule, * from one union all select 'home_of_customer', * from two union all select 'segment_of_order', * from three)
select rule, g, s, r, o, exists (select 1 from places p where p.s = x.s and p.r = x.r and p.o = x.o) as known from x""",
    "rule_exceptions": f"""with {star.PLACES_SQL}, {_DERIVED} select g, s, r, o, 1 as round from (select * from one union select * from two union select * from three) x
where not exists (select 1 from places p where p.s = x.s and p.r = x.r and p.o = x.o) and not (r = 'lives_in' and s in (select s from places where r = 'has' and o = 'machinery'))""",
    "spread_activation": f"with {_SPREAD} select * from spread",
    "place_chains": f"with recursive {star.PLACES_SQL}, {_CHAINS('places')} {_INFERRED('places')}",
    "incremental_conflicts": f"""with {star.ABILITIES_SQL} select distinct x.g, x.s, 'can' as positive, x.o from abilities x join abilities y on x.g = y.g and x.r = 'can' and y.r = 'cannot' and x.s = y.s and x.o = y.o
where x.temporal = 'currently' or y.temporal = 'currently'""",
    "temporal_conflicts": f"""with {star.ABILITIES_SQL} select distinct x.g, x.s, x.o from abilities x join abilities y on x.g = y.g and x.r = 'can' and y.r = 'cannot' and x.s = y.s and x.o = y.o
where x.temporal in ('always', 'currently') and y.temporal in ('always', 'currently')""",
    "coactivated": f"with {_SPREAD} select * from spread where sources >= 2 and level >= 0.3",
}
