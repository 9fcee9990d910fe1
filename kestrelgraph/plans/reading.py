"""Queries of simplified and encyclopedic sentences, rules, commands, small talk, name resolution and question sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelgraph.operators import grammar, insight, language, questions, reading, star, state
from kestrelgraph.plans import graph, statements
from kestrelgraph.runtime import table

#: Encyclopedic sentences that the documents do not have, by number.
SENTENCES = [
    "Dolphins communicate using clicks and whistles.", "Otters are commonly found in rivers and lakes.", "Mammals, such as whales, can live in water.", "Most birds can fly.", "Whales give birth to calves and feed them milk.",
    "Reptiles and most fish lay eggs.", "Beavers use mud to build dams.", "Animals range from the tiny shrew to the huge whale.", "Bees play a vital role in pollination.", "All plants depend on sunlight and water.",
    "Cats are hunters, while cows are grazers.", "Animals are classified into groups such as mammals, birds and fish.", "For example, penguins are birds.", "Fish breathe through gills.", "Dogs are known for their loyalty.",
    "The fox, a clever hunter, sleeps by day.", "In summer, the bear eats berries and catches fish.", "Owls, hawks, and eagles are predators.", "The river, which crosses the valley, feeds the lake.", "The sun is hot, but the moon is cold.",
]
CONSOLE = ["/help", "/show dogs", "/load-all", "/load data/animals.json", "/forget rex ", "show dogs", "/unknown", "/chain dogs is", "/stats  ", "/forget-all"]
TALK = ["Hello there", "how are you?", "Thank you!", "bye", "What is your name?", "who are you", "what are you", "ok", "Dogs bark", "Yes.", "hi"]


def _sentences(s: SparkSession, d: str) -> DataFrame:
    own = s.createDataFrame([(-1 - i, 0, x) for i, x in enumerate(SENTENCES)], "doc_id bigint, at int, x string")
    rows = table(s, d, "documents").where("text is not null").select("doc_id", F.posexplode(language.sentences(F.col("text"))).alias("at", "x"))
    return rows.unionByName(own)


def encyclopedic(s: SparkSession, d: str) -> DataFrame:
    return _sentences(s, d).select("doc_id", "at", F.explode_outer(reading.encyclopedic(F.col("x"))).alias("f")).where("f is not null").select("doc_id", "at", "f.*")


def simplified(s: SparkSession, d: str) -> DataFrame:
    return _sentences(s, d).select("doc_id", "at", F.posexplode(reading.simplified(F.col("x"))).alias("part", "sentence"))


def first_verbs(s: SparkSession, d: str) -> DataFrame:
    return _sentences(s, d).select("doc_id", "at", reading.any_statement(F.col("x")).alias("f")).where("f is not null").select("doc_id", "at", "f.*")


def console(s: SparkSession, d: str) -> DataFrame:
    rows = s.createDataFrame(list(enumerate(CONSOLE)), "id int, text string")
    return rows.select("id", reading.command(F.col("text")).alias("c")).where("c is not null").select("id", "c.*")


def small_talk(s: SparkSession, d: str) -> DataFrame:
    rows = s.createDataFrame(list(enumerate(TALK)), "id int, text string")
    return rows.select("id", reading.small_talk(F.col("text")).alias("reply"))


def clarifications(s: SparkSession, d: str) -> DataFrame:
    """Routed questions that nobody's facts answer: what is noted as open about them."""
    texts = s.createDataFrame([(i, f"What {x}?") for i, x in enumerate(["is a zyzzyva", "causes drought", "do unicorns eat", "is a dog", "can yetis do"])], "id int, text string")
    known = questions.routed(texts, star.world(s, d)).select("id").distinct()
    t = F.regexp_replace(F.trim(F.lower("text")), r"[?.!]+$", "")
    topic = F.coalesce(*[F.when(F.rlike(t, F.lit(p)), F.regexp_extract(t, p, 1)) for p, _ in questions.ROUTES])
    kind = F.coalesce(*[F.when(F.rlike(t, F.lit(p)), F.lit(k)) for p, k in questions.ROUTES])
    return texts.join(known, "id", "left_anti").select("id", topic.alias("s"), F.lit("has_open_question").alias("r"), kind.alias("o"))


def resolved_phrases(s: SparkSession, d: str) -> DataFrame:
    """Names as people write them: as they stand, with the first word as an owner, by the last word, by an alias."""
    e = graph.named(s, d).select("g", F.col("s").alias("name")).distinct()
    spoken = F.array(F.replace("name", F.lit("_"), F.lit(" ")), F.concat(F.substring_index("name", "_", 1), F.lit("'s "), F.replace(F.expr("substring(name, length(substring_index(name, '_', 1)) + 2)"), F.lit("_"), F.lit(" "))), F.concat(F.lit("odd "), F.element_at(F.split("name", "_"), -1)), F.concat("name", F.lit("_alias")), F.concat("name", F.lit("zz")))
    phrases = e.where(F.contains("name", F.lit("_"))).select("g", F.posexplode(spoken).alias("k", "phrase"), "name").select(F.concat_ws("|", "g", "name", "k").alias("id"), "g", "phrase")
    aliases = e.select("g", F.concat("name", F.lit("_alias")).alias("alias"), "name")
    return reading.resolved(phrases, e, aliases)


def collectors(s: SparkSession, d: str) -> DataFrame:
    """All sources of questions in one table (kind, g, topic, priority): a topic's relations raise its priority."""
    e, f = graph.named(s, d), table(s, d, "facts").where("instance is not null and subject is not null")
    topic = star.low("subject").alias("topic")
    h = graph._hierarchy_edges(s, d)
    gaps = insight.chain_gaps(h)
    review = f.where("context = 'review'").groupBy(F.col("instance").alias("g"), topic, "relation").agg(F.count_distinct("object").alias("n")).where("n > 1")
    part = lambda rows, kind: rows.select(F.lit(kind).alias("kind"), "g", "topic").distinct()
    whole = e.where("r = 'part_of'").select("g", F.col("o").alias("topic")).distinct().join(e.select("g", F.col("s").alias("topic")).distinct(), ["g", "topic"], "left_anti")
    sources = [
        part(whole, "open"), part(review, "contradiction"), part(gaps.where("kind = 'leads to what'").withColumnRenamed("node", "topic"), "chain_gap"), part(gaps.where("kind = 'caused by what'").withColumnRenamed("node", "topic"), "origin"),
        part(f.where("source_type in ('inference', 'inheritance', 'rule', 'discovery')").select(F.col("instance").alias("g"), topic), "inference"),
        part(f.where("confidence = 'low'").select(F.col("instance").alias("g"), topic), "low_confidence"),
        part(f.where("rule_id is not null").select(F.col("instance").alias("g"), topic), "rule"),
    ]
    degree = e.groupBy("g", F.col("s").alias("topic")).agg(F.count_distinct("r").alias("n"))
    rows = reduce(DataFrame.unionByName, sources).join(degree, ["g", "topic"], "left")
    return rows.select("kind", "g", "topic", F.round(state.priority(F.col("kind"), F.coalesce("n", F.lit(0)), F.lit(0)), 6).alias("priority"))


def grammar_facts(s: SparkSession, d: str) -> DataFrame:
    """Facts of the recursive grammar, by relation."""
    defs = table(s, d, "relation_defs").select(F.explode(F.array("relation", "base_verb", "past", "present_s", "present_p")).alias("form")).where("form is not null and not contains(form, ' ')")
    return grammar.read(table(s, d, "documents").where("text is not null"), "doc_id", "text", defs)


QUERIES = {
    "grammar_facts": grammar_facts,
    "encyclopedic": encyclopedic,
    "simplified": simplified,
    "first_verbs": first_verbs,
    "statement_pipeline": lambda s, d: reading.pipeline(_sentences(s, d), "doc_id", "x").groupBy("reader", "relation").agg(F.count("*").alias("facts")),
    "rule_lifecycle": lambda s, d: reading.rule_lifecycle(table(s, d, "documents").where("text is not null").unionByName(s.createDataFrame([(t,) for t in ["If a bird has wings then it can fly."] * 4 + ["If a cat has fur then it is warm."]], "text string"), True), "text"),
    "slash_commands": console,
    "small_talk": small_talk,
    "clarifications": clarifications,
    "resolved_phrases": resolved_phrases,
    "question_collectors": collectors,
}

_Q = lambda p: p.replace("'", "''")
_OWN = ", ".join(f"({-1 - i}, 0, '{_Q(x)}')" for i, x in enumerate(SENTENCES))
_ROWS = f"""own(doc_id, pos, x) as (values {_OWN}), d as (select doc_id, {statements.SENTENCES_SQL} as ss from documents where text is not null),
sen as (select doc_id, unnest(range(len(ss)))::int as pos, unnest(ss) as x from d union all select * from own)"""
_CLEAN = "regexp_replace(regexp_replace(lower(trim(x)), '[.!?]+$', ''), '^(however|also|because of this|in fact|therefore),? ', '')"
_NAME = lambda x: f"regexp_replace(trim(regexp_replace(trim({x}), '^(the|a|an) ', '')), '[ ]+', '_', 'g')"
_GROUP = lambda p, g, t="t": f"'{g}'" if isinstance(g, str) else f"regexp_extract({t}, '{_Q(p)}', {g})"
_ENC = " union all ".join(
    f"select doc_id, pos, '{r}' as relation, {_NAME(_GROUP(p, s))} as subject, {_GROUP(p, o)} as o from fit where k = {k}" for k, (p, facts) in enumerate(reading.ENCYCLOPEDIC) for r, s, o in facts
)
_FIT = "case " + " ".join(f"when regexp_matches(t, '{_Q(p)}') then {k}" for k, (p, _) in enumerate(reading.ENCYCLOPEDIC)) + " end"


def _made(pattern: str, shape: str) -> str:
    return " || ".join(f"regexp_extract(t, '{_Q(pattern)}', {x})" if x.isdigit() else f"'{x}'" for x in shape.replace("{", "|").replace("}", "|").split("|") if x)


_SIMPLE = "case " + " ".join(f"when regexp_matches(t, '{_Q(p)}') then [{', '.join(_made(p, shape) for (shape,) in made)}]" for p, made in reading._SHAPES) + " else [t] end"
_ANY = r"^(?:the |a |an )?([a-z]+) ([a-z]+(?:s|ed)) (?:the |a |an )?([a-z0-9 ]+)$"
_RULE = r"^if (?:an? |the )?([A-Za-z0-9_]+) (is|are|has|have|can|eats?|needs?|causes?) (?:an? |the )?(.+?),? then (?:it|they|(?:an? |the )?([A-Za-z0-9_]+)) (is|are|has|have|can|eats?|needs?|causes?) (?:an? |the )?(.+)$"
_VERB = lambda i: f"case regexp_extract(t, '{_RULE}', {i}) when 'are' then 'is' when 'have' then 'has' when 'eat' then 'eats' when 'need' then 'needs' when 'cause' then 'causes' else regexp_extract(t, '{_RULE}', {i}) end"
_COMMAND = rf"^/({'|'.join(sorted(reading.COMMANDS, key=lambda c: (-len(c), c)))})(?:\s+(.*))?$"
SQL = {
    "encyclopedic": f"""with {_ROWS}, fit as (select doc_id, pos, {_CLEAN} as t, {_FIT.replace('(t,', f'({_CLEAN},')} as k from sen), f as ({_ENC}), i as (select * exclude (o), unnest(list_filter(string_split_regex(o, ', and |, | and '), lambda y: trim(y) <> '')) as o from f)
select doc_id, pos as "at", subject, relation, {_NAME('o')} as object from i""",
    "simplified": f"""with {_ROWS}, m as (select doc_id, pos, regexp_replace(regexp_replace(lower(trim(regexp_replace(x, '{reading.SPACES}', ' ', 'g'))), '[.!?]+$', ''), '{reading.FRONTED}', '') as t from sen), p as (select doc_id, pos, list_filter({_SIMPLE}, lambda y: y <> '') as ps from m)
select doc_id, pos as "at", unnest(range(len(ps)))::int as part, unnest(ps) as sentence from p""",
    "first_verbs": f"""with {_ROWS}, m as (select doc_id, pos, {_CLEAN} as t from sen) select doc_id, pos as "at", regexp_extract(t, '{_ANY}', 1) as subject, regexp_extract(t, '{_ANY}', 2) as relation, {_NAME(f"regexp_extract(t, '{_ANY}', 3)")} as object from m where regexp_matches(t, '{_ANY}')""",
    "rule_lifecycle": f"""with d as (select unnest({statements.SENTENCES_SQL}) as s from documents where text is not null union all select unnest(['If a bird has wings then it can fly.', 'If a bird has wings then it can fly.', 'If a bird has wings then it can fly.', 'If a bird has wings then it can fly.', 'If a cat has fur then it is warm.'])),
t as (select regexp_replace(trim(lower(s)), '[.!]+$', '') as t from d),
r as (select replace(regexp_extract(t, '{_RULE}', 1), ' ', '_') as subject, {_VERB(2)} as relation, replace(regexp_extract(t, '{_RULE}', 3), ' ', '_') as object, {_VERB(5)} as then_relation, replace(regexp_extract(t, '{_RULE}', 6), ' ', '_') as then_object
  from t where regexp_matches(t, '{_RULE}') and regexp_extract(t, '{_RULE}', 4) in ('', regexp_extract(t, '{_RULE}', 1)))
select *, count(*) as support, round(least(0.9, 0.7 + 0.1 * greatest(count(*) - 2, 0)), 6)::double as confidence, case when count(*) >= 3 then 'active' else 'candidate' end as status from r group by all""",
    "slash_commands": f"""with q(id, text) as (values {", ".join(map(str, enumerate(CONSOLE)))}) select id, regexp_extract(trim(text), '{_COMMAND}', 1) as name, trim(regexp_extract(trim(text), '{_COMMAND}', 2)) as argument from q where regexp_matches(trim(text), '{_COMMAND}')""",
    "small_talk": f"""with q(id, text) as (values {", ".join(map(str, enumerate(TALK)))}) select id, case {" ".join(f"when regexp_matches(lower(trim(text)), '{_Q(p)}') then '{r}'" for p, r in reading.SMALL_TALK)} end as reply from q""",
    "clarifications": "select * from (values (0, 'zyzzyva', 'has_open_question', 'what'), (1, 'drought', 'has_open_question', 'what_causes'), (2, 'unicorns', 'has_open_question', 'eats'), (4, 'yetis', 'has_open_question', 'can')) x(id, s, r, o)",
    "resolved_phrases": f"""with {graph.NAMED}, n as (select distinct g, s as name from named), m as (select g, name, split_part(name, '_', 1) as head, name[len(split_part(name, '_', 1)) + 2:] as rest, split_part(name, '_', -1) as word from n where contains(name, '_')),
q as (select g || '|' || name || '|0' as id, g, name as p, false as owned from m union all select g || '|' || name || '|1', g, head || '_' || rest, true from m union all select g || '|' || name || '|2', g, 'odd_' || word, false from m
  union all select g || '|' || name || '|3', g, name || '_alias', false from m union all select g || '|' || name || '|4', g, name || 'zz', false from m),
w as (select g, split_part(name, '_', -1) as word, arg_min(name, (length(name), name)) as name from n where contains(name, '_') group by 1, 2),
c as (select q.id, q.g, case when owned then 1 else 0 end as k, p as entity from q join n on n.g = q.g and n.name = q.p union all select q.id, q.g, 2, n.name from q join n on n.g = q.g and n.name || '_alias' = q.p
  union all select q.id, q.g, 3, w.name from q join w on w.g = q.g and w.word = split_part(q.p, '_', -1)),
b as (select id, min(k) as k, arg_min(entity, (k, entity)) as entity from c group by 1)
select q.id, q.g, coalesce(b.entity, q.p) as entity, coalesce((['exact', 'possessive', 'alias', 'suffix'])[b.k + 1], 'new') as how from q left join b using (id)""",
    "question_collectors": f"""with {graph.NAMED}, {graph._UP}, f as (select instance as g, lower(replace(trim(subject), ' ', '_')) as topic, * from facts where instance is not null and subject is not null), n as (select g, s as topic, count(distinct r) as n from named group by 1, 2),
u as (select 'open' as kind, g, o as topic from named x where r = 'part_of' and not exists (select 1 from named k where k.g = x.g and k.s = x.o)
  union select 'contradiction', g, topic from f where context = 'review' group by g, topic, relation having count(distinct object) > 1
  union select 'chain_gap', g, o from h where not exists (select 1 from h x where x.g = h.g and x.s = h.o) and regexp_matches(lower(o), '{"|".join(insight.STATES)}')
  union select 'origin', g, s from h where not exists (select 1 from h x where x.g = h.g and x.o = h.s) and not regexp_matches(lower(s), '{"|".join(insight.BASIC)}')
  union select 'inference', g, topic from f where source_type in ('inference', 'inheritance', 'rule', 'discovery') union select 'low_confidence', g, topic from f where confidence = 'low' union select 'rule', g, topic from f where rule_id is not null)
select kind, g, topic, round(case kind when 'open' then 10.0 when 'contradiction' then 6.0 when 'chain_gap' then 5.0 when 'origin' then 4.0 when 'inference' then 3.0 when 'low_confidence' then 3.0 else 1.0 end + least(2.0, 0.1 * coalesce(n, 0)), 6)::double as priority from u left join n using (g, topic)""",
}
