"""Queries of the question surface, over the star schema's facts and the built-in packs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrelgraph.operators import questions, star
from kestrelgraph.runtime import table

#: Free questions for the routed answers.
TEXTS = [
    "What color is grass?", "Where do penguins live?", "what do cats have?", "What can birds do?", "What causes rain?", "what happens when it rain?", "What eats seeds", "what needs water?",
    "What is a dog?", "where is the eiffel tower?", "What are examples of mammals?", "What characteristics do birds have?", "What lives in water?", "Tell me a story", "what is a zyzzyva", "what has wings?",
]
THINGS = ["legs", "eyes", "wings"]


def _world(s: SparkSession, d: str) -> DataFrame:
    return star.world(s, d)


def is_with_cwa(s: SparkSession, d: str) -> DataFrame:
    """Each category or property of the packs, asked of its own subject and of the next one by name; and of nobody known."""
    rows = _world(s, d).where("g = 'packs' and r in ('is', 'has_property')").select("g", "s", "o").distinct()
    w = Window.partitionBy("g").orderBy("s", "o")
    nxt = rows.select("g", "s", F.lead("o", 3).over(w).alias("o")).where("o is not null")
    up = rows.select("g", F.col("o").alias("m"), "s").join(rows.select(F.col("s").alias("m"), "o"), "m").select("g", "s", "o")
    none = rows.select("g", F.concat("s", F.lit("_zz")).alias("s"), "o")
    asked = rows.unionByName(nxt).unionByName(up).unionByName(none).distinct().withColumn("id", F.concat_ws("|", "g", "s", "o"))
    return questions.is_verdicts(_world(s, d), asked)


def routed(s: SparkSession, d: str) -> DataFrame:
    return questions.routed(s.createDataFrame(list(enumerate(TEXTS)), "id int, text string"), _world(s, d))


def superlatives(s: SparkSession, d: str) -> DataFrame:
    """The dearest and the cheapest part of each brand, the richest and the poorest customer of each segment."""
    p = table(s, d, "part").select(F.lit("catalog").alias("g"), star.low("p_brand").alias("category"), star.key("part", "p_partkey").alias("s"), F.col("p_retailprice").alias("value"))
    c = table(s, d, "customer").select(F.lit("supply").alias("g"), star.low("c_mktsegment").alias("category"), star.key("customer", "c_custkey").alias("s"), F.col("c_acctbal").alias("value"))
    return questions.superlatives(p.unionByName(c))


QUERIES = {
    "template_answers": lambda s, d: questions.answered(_world(s, d)),
    "is_with_cwa": is_with_cwa,
    "category_ability": lambda s, d: questions.category_abilities(_world(s, d)),
    "category_places": lambda s, d: questions.living(_world(s, d)),
    "currently": lambda s, d: questions.currently(star.abilities(s, d)),
    "how_many": lambda s, d: questions.how_many(_world(s, d), THINGS),
    "superlatives": superlatives,
    "routed_answers": routed,
}

_TEMPLATES = "templates(template, relation, rank, rev, ranked, most) as (values " + ", ".join(f"('{t.name}', '{r}', {k}, {str(t.reverse).lower()}, {str(t.ranked).lower()}, {t.most})" for t in questions.TEMPLATES for k, r in enumerate(t.relations)) + ")"
_ANSWERED = f"""{_TEMPLATES},
hits as (select template, g, case when rev then o else s end as asked, case when rev then s else o end as answer, min(rank) as rank, any_value(ranked) as ranked, any_value(most) as most from world join templates on r = relation group by 1, 2, 3, 4),
kept as (select * from hits qualify not ranked or rank = min(rank) over (partition by template, g, asked)),
placed as (select *, row_number() over (partition by template, g, asked order by rank, answer) as k, count(*) over (partition by template, g, asked) as n from kept),
answered as (select template, g, asked, string_agg(answer, ', ' order by k) as answers, any_value(n) as n from placed where k <= most group by 1, 2, 3)"""
_CASE = lambda f: "case " + " ".join(f"when regexp_matches(t, '{p.replace(chr(39), chr(39) * 2)}') then {f(p, k)}" for p, k in questions.ROUTES) + " end"
SQL = {
    "template_answers": f"with {star.WORLD_SQL}, {_ANSWERED} select * from answered",
    "is_with_cwa": f"""with recursive {star.WORLD_SQL}, r as (select distinct g, s, o from world where g = 'packs' and r in ('is', 'has_property')),
nxt as (select g, s, lead(o, 3) over (partition by g order by s, o) as o from r),
q as (select *, g || '|' || s || '|' || o as id from (select * from r union select * from nxt where o is not null union select x.g, x.s, y.o from r x join r y on y.s = x.o union select g, s || '_zz', o from r)),
up as (select g, s, o, 1 as depth from world where r = 'is' and s <> o union select u.g, u.s, w.o, depth + 1 from up u join world w on w.g = u.g and w.r = 'is' and w.s = u.o and w.o <> u.s and w.s <> w.o where depth < 5),
f as (select g, s, o, 0 as k from world where r = 'is' union select g, s, o, 1 from up union select u.g, u.s, p.o, 2 from up u join world p on p.g = u.g and p.s = u.o and p.r = 'has_property'
  union select g, s, o, 3 from world where r = 'has_property' union select g, s, o, 4 from world where r = 'can_be' union select g, s, o, 5 from world where r = 'is_not' union select g, s, o, 6 from world where r in ('is', 'has_property')),
h as (select id, k, f.o as via from q join f on f.g = q.g and f.s = q.s and (k = 6 or contains(f.o, q.o) or (k < 5 and contains(q.o, f.o)))),
b as (select id, min(k) as k, arg_min(via, (k, via)) as via from h group by 1)
select distinct q.id, (['{"', '".join(questions.VERDICTS)}'])[coalesce(k, 7) + 1] as verdict, case when k < 6 then via end as via from q left join b using (id)""",
    "category_ability": f"with {star.WORLD_SQL} select distinct m.g, m.o as category, a.r as relation, a.o as ability, m.s from world m join world a on a.g = m.g and a.s = m.s and m.r = 'is' and a.r in ('can', 'cannot')",
    "category_places": f"with {star.WORLD_SQL} select distinct m.g, m.o as category, a.o as place, m.s from world m join world a on a.g = m.g and a.s = m.s and m.r = 'is' and a.r = 'lives_in'",
    "currently": f"""with {star.ABILITIES_SQL}, x as (select distinct g, s, r, o from abilities where temporal = 'currently' and r in ('is', 'does', 'lives_in', 'can', 'has')),
k as (select *, row_number() over (partition by g, s, r order by o) as k, count(*) over (partition by g, s, r) as n from x)
select g, s, r as relation, string_agg(o, ', ' order by o) as answers, any_value(n) as n from k where k <= 5 group by 1, 2, 3""",
    "how_many": f"""with {star.WORLD_SQL}, x as (select g, s, regexp_extract(o, '([0-9]+|one|two|three|four|five|six|seven|eight|nine|ten)_([A-Za-z0-9_]+)', 1) as n, regexp_extract(o, '([0-9]+|one|two|three|four|five|six|seven|eight|nine|ten)_([A-Za-z0-9_]+)', 2) as thing
  from world where r in ('has', 'is', 'can', 'has_property', 'height'))
select g, s, thing, max(coalesce(list_position(['one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten'], n), try_cast(n as int)))::int as amount from x where thing in ('legs', 'eyes', 'wings') group by 1, 2, 3""",
    "superlatives": """with v as (select 'catalog' as g, lower(replace(trim(p_brand), ' ', '_')) as category, 'part_' || p_partkey as s, p_retailprice as value from part
union all select 'supply', lower(replace(trim(c_mktsegment), ' ', '_')), 'customer_' || c_custkey, c_acctbal from customer)
select g, category, arg_min(s, (-value, s)) as most, arg_min(s, (value, s)) as least from v group by 1, 2""",
    "routed_answers": f"""with {star.WORLD_SQL}, {_ANSWERED}, q(id, text) as (values {", ".join(map(str, enumerate(TEXTS)))}),
t as (select id, regexp_replace(trim(lower(text)), '[?.!]+$', '') as t from q),
r as (select id, {_CASE(lambda p, k: f"'{k}'")} as template, replace({_CASE(lambda p, k: f"regexp_extract(t, '{p.replace(chr(39), chr(39) * 2)}', 1)")}, ' ', '_') as name from t),
s as (select id, template, name as spelling, 0 as rank from r union all select id, template, name || 's', 1 from r union all select id, template, regexp_replace(name, 's$', ''), 2 from r)
select id, a.g, any_value(a.template) as template, arg_min(a.asked, rank) as asked, arg_min(a.answers, rank) as answers, arg_min(a.n, rank) as n from s join answered a on a.template = s.template and a.asked = s.spelling group by 1, 2""",
}
