"""Queries of what is derived from arriving facts and from looking a graph over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrelgraph.functions import text as T
from kestrelgraph.operators import insight, mining, star, store
from kestrelgraph.plans import graph
from kestrelgraph.runtime import table

NOW = "2025-09-15 00:00:00"


def _edges(s: SparkSession, d: str) -> DataFrame:
    return graph.named(s, d).select("g", "s", "r", "o").distinct()


def _world(s: SparkSession, d: str) -> DataFrame:
    return star.world(s, d).select("g", "s", "r", "o").distinct()


def _fresh(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The packs as arriving facts, and everything else as stored."""
    w = star.world(s, d)
    return w.where("g = 'packs'"), w.where("g <> 'packs'").select("g", "s", "r", "o").distinct()


def _seen(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "facts").where("instance is not null and created_at is not null")
    return f.select(F.col("instance").alias("g"), F.explode(F.array("subject", "object")).alias("node"), F.col("created_at").cast("timestamp").alias("at")).where("node is not null").groupBy("g", "node").agg(F.max("at").alias("at"), F.count("*").alias("n"))


def _sleeping(s: SparkSession, d: str) -> DataFrame:
    return insight.dormant(_seen(s, d), F.lit(NOW).cast("timestamp"), 60)


def _plain(s: SparkSession, d: str) -> DataFrame:
    return graph._edges(s, d)


def active_facts(s: SparkSession, d: str) -> DataFrame:
    return insight.awake(_plain(s, d), _sleeping(s, d)).groupBy("g", "r").agg(F.count("*").alias("facts"), F.min("s").alias("first"))


def revived(s: SparkSession, d: str) -> DataFrame:
    """Entities that would sleep in the middle of July, and are named again by a later fact."""
    f = table(s, d, "facts").where("instance is not null and created_at is not null and subject is not null and object is not null")
    early = F.col("created_at").cast("timestamp") < F.lit("2025-07-15").cast("timestamp")
    named = f.where(early).select(F.col("instance").alias("g"), F.explode(F.array("subject", "object")).alias("node"), F.col("created_at").cast("timestamp").alias("at"))
    sleeping = insight.dormant(named.groupBy("g", "node").agg(F.max("at").alias("at"), F.count("*").alias("n")), F.lit("2025-07-15").cast("timestamp"), 60)
    return insight.revived(f.where(~early).select(F.col("instance").alias("g"), F.col("subject").alias("s"), F.col("object").alias("o")), sleeping)


def path_members(s: SparkSession, d: str) -> DataFrame:
    return insight.class_members(_edges(s, d), insight.path_similar(_edges(s, d)))


def _balances(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(categories, items) of nations: their region and whether their customers are rich, and the segments of customers
    with balances in a class."""
    home = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.lit("supply").alias("g"), star.low("n_name").alias("s"), "n_regionkey", "c_acctbal", star.low("c_mktsegment").alias("segment"))
    items = home.select("g", F.col("s").alias("holder"), F.concat_ws("|", "segment", F.floor(F.col("c_acctbal") / 1000).cast("string")).alias("value")).distinct()
    rich = home.groupBy("g", "s").agg(F.when(F.avg("c_acctbal") >= 4500, "rich").otherwise("poor").alias("category"))
    return home.select("g", "s", F.concat(F.lit("region_"), "n_regionkey").alias("category")).distinct().unionByName(rich), items


def sibling_analogies(s: SparkSession, d: str) -> DataFrame:
    return insight.sibling_analogies(*_balances(s, d))


def shown_edges(s: SparkSession, d: str) -> DataFrame:
    e = _edges(s, d)
    n = e.groupBy("g", F.col("s").alias("node")).agg(F.count("*").alias("n"))
    top = n.withColumn("k", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("n"), "node"))).where("k <= 200")
    return insight.shown_edges(e, top)


def coactivation_links(s: SparkSession, d: str) -> DataFrame:
    w = _world(s, d)
    pairs = mining.value_classes(w.where("g = 'packs'")).select("g", F.col("first").alias("s"), F.col("last").alias("o")).distinct()
    return insight.coactivation_links(w, pairs)


def cofired(s: SparkSession, d: str) -> DataFrame:
    """Assemblies of packs' entities that are linked three times or more by name, fired from those that are animals."""
    w = _world(s, d).where("g = 'packs'")
    parts = mining.components(w.where("r = 'is'").select(F.col("s").alias("a"), F.col("o").alias("b")))
    active = w.where("r = 'is' and o = 'mammals'").select(F.col("s").alias("node"), F.lit(1.0).alias("level")).distinct()
    return insight.cofired(parts, active)


def node_layout(s: SparkSession, d: str) -> DataFrame:
    """The picture's first positions: nodes of an instance by their edges on a spiral of equal turns, with colours by name."""
    e = _edges(s, d)
    n = e.select("g", F.explode(F.array("s", "o")).alias("node")).groupBy("g", "node").agg(F.count("*").alias("edges"))
    top = n.withColumn("i", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("edges"), "node")) - 1).where("i < 200")
    angle, radius = F.col("i") * 2.4, 30 * F.sqrt("i")
    return top.select("g", "node", "i", F.round(radius * F.cos(angle), 3).alias("x"), F.round(radius * F.sin(angle), 3).alias("y"), T.hue(F.col("node")).alias("hue"), T.html_escaped(T.pretty(F.col("node"))).alias("label"))


def discovery_stats(s: SparkSession, d: str) -> DataFrame:
    """One row: how many value classes, transitive gaps, lonely entities and missing inverses there are."""
    e = graph._edges(s, d)
    n = lambda rows, name: rows.agg(F.count("*").alias("n")).withColumn("what", F.lit(name))
    inverse = table(s, d, "relation_defs").where("reverse is not null").selectExpr("relation as r", "reverse as back")
    rows = n(mining.value_classes(e), "classes").unionByName(n(mining.transitive_gaps(graph._hierarchy_edges(s, d)), "gaps"))
    rows = rows.unionByName(n(mining.lonely(store.degrees(store.edges(table(s, d, "facts")))), "lonely")).unionByName(n(mining.missing_inverse(e, inverse), "inverses"))
    pick = lambda k: F.max(F.when(F.col("what") == k, F.col("n"))).alias(k)
    return rows.agg(pick("classes"), pick("gaps"), pick("lonely"), pick("inverses"))


def pattern_families(s: SparkSession, d: str) -> DataFrame:
    """All kinds of patterns in one table (family, g, a, b, support, confidence)."""
    e, h = graph._edges(s, d), graph._hierarchy_edges(s, d)
    row = lambda rows, family, a, b, support, conf: rows.select(F.lit(family).alias("family"), "g", F.col(a).alias("a"), F.col(b).alias("b"), support.cast("bigint").alias("support"), F.round(conf.cast("double"), 6).alias("confidence"))
    one, gap = F.lit(1), F.lit(0.75)
    co = graph.co_occurrence(s, d)
    lonely = mining.lonely(store.degrees(store.edges(table(s, d, "facts")))).withColumnRenamed("instance", "g").withColumn("none", F.lit(None).cast("string"))
    out = row(mining.transitive_gaps(h), "transitive_gap", "a", "c", one, gap)
    out = out.unionByName(row(co, "co_occurrence", "a", "b", F.col("n"), F.col("confidence")))
    out = out.unionByName(row(lonely, "lonely", "node", "none", F.col("edges"), F.col("score")))
    return out.unionByName(row(mining.value_classes(e), "class", "first", "last", F.col("members"), F.least(F.lit(0.8), 0.3 + 0.15 * F.col("members"))))


def visual_bundle(s: SparkSession, d: str) -> DataFrame:
    """What the picture of a graph shows of each family: the best 50, 20 or 30 patterns, in order."""
    caps = F.when(F.col("family") == "co_occurrence", 50).when(F.col("family") == "class", 20).otherwise(30)
    rows = pattern_families(s, d).where("confidence >= 0.5")
    place = F.row_number().over(Window.partitionBy("family").orderBy(F.desc("support"), "g", "a", F.coalesce("b", F.lit(""))))
    return rows.withColumn("place", place).where("place <= 50").where(F.col("place") <= caps)


QUERIES = {
    "location_facets": lambda s, d: insight.facets(_edges(s, d)),
    "context_members": lambda s, d: insight.by_context(_world(s, d)),
    "inverse_facts": lambda s, d: insight.inverses(_world(s, d)).groupBy("g", "s", "r").agg(F.count("*").alias("objects"), F.min("o").alias("first")),
    "insert_grandparents": lambda s, d: insight.grandparents(star.world(s, d), _world(s, d), "is"),
    "insert_triggers": lambda s, d: insight.on_insert(*_fresh(s, d)),
    "path_similarity": lambda s, d: insight.path_similar(_edges(s, d)),
    "path_members": path_members,
    "analogy_inference": lambda s, d: insight.analogy_facts(_balances(s, d)[1]),
    "sibling_analogies": sibling_analogies,
    "dormant_entities": _sleeping,
    "active_facts": active_facts,
    "revived_entities": revived,
    "chain_gaps": lambda s, d: insight.chain_gaps(graph._hierarchy_edges(s, d)),
    "shown_edges": shown_edges,
    "coactivation_links": coactivation_links,
    "cofired_assemblies": cofired,
    "discovery_stats": discovery_stats,
    "node_layout": node_layout,
    "pattern_families": pattern_families,
    "visual_bundle": visual_bundle,
}

_FACET = lambda c: "case " + " ".join(f"when contains(lower({c}), '{k}') then '{v}'" for k, v in insight.FACETS.items()) + " end"
_BARE = "n as (select distinct g, s, r, o from named)"
_W = f"{star.WORLD_SQL}, w as (select distinct g, s, r, o from world)"
_NOT = lambda x, w="w": f"not exists (select 1 from {w} k where k.g = {x}.g and k.s = {x}.s and k.r = {x}.r and k.o = {x}.o)"
_BACK = "select distinct g, o as s, case r when 'color' then 'is_color_of' else 'has_instance' end as r, s as o from {} where r in ('color', 'is')"
_SEEN = """seen as (select g, node, max(at_) as at_, count(*) as n from (select instance as g, unnest([subject, object]) as node, created_at as at_ from facts where instance is not null and created_at is not null {}) where node is not null group by 1, 2)"""
_SLEEP = "select g, node from seen where epoch_us(timestamp '{}') - epoch_us(at_) >= 60 * 86400000000 and n < 10"
_E = graph._E
_FAMILIES = f"""{_E}, {graph._UP},
gaps as (select x.g, x.s as a, y.o as c from h x join h y on y.g = x.g and y.s = x.o where x.s <> y.o and x.s <> x.o and x.o <> y.o and not exists (select 1 from h z where z.g = x.g and z.s = x.s and z.o = y.o) group by 1, 2, 3),
lone as (select g, node, count(*) as edges from (select g, s as node from e union all select g, o from e) group by 1, 2 having count(*) <= 2),
classes as (select g, min(s) as a, max(s) as b, count(*) as n from e group by g, r, o having count(*) >= 2),
co as (select instance as g, least(subject, object) as a, greatest(subject, object) as b, count(*) as n from facts where subject <> object group by 1, 2, 3 having count(*) >= 3),
families as (select 'transitive_gap' as family, g, a, c as b, 1::bigint as support, 0.75::double as confidence from gaps union all select 'co_occurrence', g, a, b, n, round(least(0.9, 0.4 + 0.1 * n), 6)::double from co
  union all select 'lonely', g, node, null, edges, round(1 - 0.3 * edges, 6)::double from lone union all select 'class', g, a, b, n, round(least(0.8, 0.3 + 0.15 * n), 6)::double from classes)"""
SQL = {
    "location_facets": f"with {graph.NAMED}, {_BARE} select distinct g, {_FACET('o')} as facet, s from n where r in ('lives_in', 'located_in', 'found_in', 'part_of') and {_FACET('o')} is not null",
    "context_members": f"with {_W} select distinct m.g, m.o as category, c.o as context, m.s from w m join w c on c.g = m.g and c.s = m.s and m.r = 'is' and c.r in ('habitat_type', 'lives_in', 'has_property', 'can')",
    "inverse_facts": f"with {_W}, x as ({_BACK.format('w')}) select g, s, r, count(*) as objects, min(o) as \"first\" from x where {_NOT('x')} group by 1, 2, 3",
    "insert_grandparents": f"""with {_W}, x as (select f.g, f.s, 'is' as r, u.o, max((f.confidence = 'high')::int) as k from world f join w u on u.g = f.g and u.r = 'is' and u.s = f.o and f.r = 'is' and u.o <> f.s group by 1, 2, 3, 4)
select g, s, r, o, case when k = 1 then 'medium' else 'low' end as confidence from x where {_NOT('x')}""",
    "insert_triggers": f"""with {_W}, f as (select * from packed), b as ({_BACK.format('f')}), u as (select distinct f.g, f.s, 'is' as r, y.o from f join w y on y.g = f.g and y.r = 'is' and y.s = f.o and f.r = 'is' and y.o <> f.s),
c as (select distinct g, s, 'habitat_type' as r, {_FACET('o')} as o from f where r in ('lives_in', 'located_in', 'found_in', 'part_of') and {_FACET('o')} is not null),
i as (select distinct f.g, f.s, p.r, p.o from f join w p on p.g = f.g and p.s = f.o and f.r = 'is' and p.r in ('has', 'can', 'color', 'size', 'shape'))
select 'inverse' as kind, * from b where {_NOT('b')} union all select 'grandparent', * from u where {_NOT('u')} union all select 'facet', * from c where {_NOT('c')} union all select 'inherited', * from i where {_NOT('i')}""",
    "path_similarity": f"""with {graph.NAMED}, {_BARE} select g, r, o as via, count(*) as members, min(s) as a, max(s) as b, 0.6::double as confidence from n group by 1, 2, 3 having count(*) >= 2 order by members desc, g, r, via limit 30""",
    "path_members": f"""with {graph.NAMED}, {_BARE}, c as (select g, r, o, count(*) as members from n group by 1, 2, 3 having count(*) >= 2 order by members desc, g, r, o limit 30)
select n.g, n.r, n.o as via, n.s from n join c using (g, r, o)""",
    "analogy_inference": """with i as (select distinct 'supply' as g, lower(replace(trim(n_name), ' ', '_')) as holder, lower(replace(trim(c_mktsegment), ' ', '_')) || '|' || floor(c_acctbal / 1000)::bigint as value from customer join nation on c_nationkey = n_nationkey),
z as (select holder, count(*) as n from i group by 1), p as (select x.holder as a, y.holder as b, count(*) as k from i x join i y on x.value = y.value and x.holder <> y.holder group by 1, 2),
q as (select a, b from p join z x on x.holder = a join z y on y.holder = b where k / (x.n + y.n - k) >= 0.5 - 1e-9)
select 'supply' as g, a as holder, i.value, count(*) as support from q join i on i.holder = q.b where not exists (select 1 from i m where m.holder = q.a and m.value = i.value) group by 1, 2, 3""",
    "sibling_analogies": """with h as (select lower(replace(trim(n_name), ' ', '_')) as s, n_regionkey, c_acctbal, lower(replace(trim(c_mktsegment), ' ', '_')) || '|' || floor(c_acctbal / 1000)::bigint as v from customer join nation on c_nationkey = n_nationkey),
c as (select distinct s, 'region_' || n_regionkey as category from h union all select s, case when avg(c_acctbal) >= 4500 then 'rich' else 'poor' end from h group by 1), i as (select distinct s, v from h),
p as (select x.s as a, y.s as b, count(*) as shared from i x join i y on x.v = y.v and x.s <> y.s group by 1, 2 having count(*) >= 2)
select distinct 'supply' as g, p.b as entity, t.category as suggested, p.a as "like", c.category, shared from p join c on c.s = p.a join c sib on sib.category = c.category and sib.s <> p.a join c t on t.s = sib.s and t.category <> c.category
where not exists (select 1 from c k where k.s = p.b and k.category = c.category) and not exists (select 1 from c k where k.s = p.b and k.category = t.category) order by shared desc, g, entity, suggested, "like", category limit 20""",
    "dormant_entities": f"with {_SEEN.format('')} {_SLEEP.format(NOW)}",
    "active_facts": f"with {_SEEN.format('')}, z as ({_SLEEP.format(NOW)}), {_E} select g, r, count(*) as facts, min(s) as \"first\" from e where not exists (select 1 from z where z.g = e.g and z.node = e.s) group by 1, 2",
    "revived_entities": f"""with {_SEEN.format("and created_at < timestamp '2025-07-15 00:00:00' and subject is not null and object is not null")}, z as ({_SLEEP.format('2025-07-15 00:00:00')}),
l as (select instance as g, unnest([subject, object]) as node from facts where instance is not null and created_at >= timestamp '2025-07-15 00:00:00' and subject is not null and object is not null) select g, node from z where exists (select 1 from l where l.g = z.g and l.node = z.node)""",
    "chain_gaps": f"""with {graph._UP} select distinct g, o as node, 'leads to what' as kind from h where not exists (select 1 from h x where x.g = h.g and x.s = h.o) and regexp_matches(lower(o), '{"|".join(insight.STATES)}')
union all select distinct g, s, 'caused by what' from h where not exists (select 1 from h x where x.g = h.g and x.o = h.s) and not regexp_matches(lower(s), '{"|".join(insight.BASIC)}')""",
    "shown_edges": f"""with {graph.NAMED}, {_BARE}, t as (select g, s as node from n group by 1, 2 qualify row_number() over (partition by g order by count(*) desc, s) <= 200)
select n.* from n where exists (select 1 from t where t.g = n.g and t.node = n.s) and exists (select 1 from t where t.g = n.g and t.node = n.o)""",
    "coactivation_links": f"""with {_W}, p as (select distinct g, s, o from (select g, min(s) as s, max(s) as o from w where g = 'packs' group by g, r, w.o having count(*) >= 2)), x as (select distinct g, s, o as via from w),
k as (select g, s as via, bool_or(r = 'is') as a, bool_or(r = 'has') as b, bool_or(r = 'can') as c, bool_or(r in ('causes', 'leads_to')) as d from w group by 1, 2)
select p.g, p.s, p.o, x.via, case when a then 'shares_category' when b then 'shares_property' when c then 'shares_ability' when d then 'causal_link' else 'related_through' end as relation
from p join x on x.g = p.g and x.s = p.s join x y on y.g = p.g and y.s = p.o and y.via = x.via left join k on k.g = p.g and k.via = x.via where x.via <> p.s and x.via <> p.o""",
    "cofired_assemblies": f"""with recursive {_W}, x as (select s as a, o as b from w where g = 'packs' and r = 'is'), u as (select a, b from x union select b, a from x), reach as (select a as node, a as other from u union select r.node, u.b from reach r join u on u.a = r.other),
c as (select node, min(other) as component from reach group by 1), act as (select distinct a as node from x where b = 'mammals'), f as (select component, count(*) as n from act join c using (node) group by 1)
select c.node, round(least(case when a.node is null then 0 else 1 end + 0.3 * (n - case when a.node is null then 0 else 1 end), 2.0), 6)::double as level from c join f using (component) left join act a on a.node = c.node""",
    "node_layout": f"""with {graph.NAMED}, {_BARE}, c as (select g, node, count(*) as edges from (select g, s as node from n union all select g, o from n) group by 1, 2),
i as (select g, node, row_number() over (partition by g order by edges desc, node)::int - 1 as i from c qualify i < 200)
select g, node, i, round(30 * sqrt(i) * cos(i * 2.4), 3) as x, round(30 * sqrt(i) * sin(i * 2.4), 3) as y,
  (list_reduce(list_prepend(5381::bigint, list_transform(string_split(node, ''), lambda c: unicode(c)::bigint)), lambda a, b: (a * 33 + b) % 4294967296) % 360)::int as hue,
  replace(replace(replace(replace(replace(replace(node, '_', ' '), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;') as label from i""",
    "discovery_stats": f"""with {_FAMILIES}, i as (select distinct e.g, e.o as s, d.reverse as r, e.s as o from e join relation_defs d on d.relation = e.r and d.reverse is not null)
select (select count(*) from classes) as classes, (select count(*) from gaps) as gaps, (select count(*) from lone) as lonely, (select count(*) from i where not exists (select 1 from e b where b.g = i.g and b.s = i.s and b.r = i.r and b.o = i.o)) as inverses""",
    "pattern_families": f"with {_FAMILIES} select * from families",
    "visual_bundle": f"""with {_FAMILIES}, p as (select *, row_number() over (partition by family order by support desc, g, a, coalesce(b, ''))::int as place from families where confidence >= 0.5)
select * from p where place <= case family when 'co_occurrence' then 50 when 'class' then 20 else 30 end""",
}
