"""Queries of the question surface, corrections, curiosity, dialogue and sentence structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrelgraph.functions import confidence as C
from kestrelgraph.functions import text as T
from kestrelgraph.operators import answers, hierarchy, insight, language, mining, reasoning, star, store
from kestrelgraph.plans.graph import _hierarchy_edges, _properties
from kestrelgraph.plans.store import _forms
from kestrelgraph.runtime import table

TEMPLATES = ["Noted: {}", "I will remember that {}", "So {}", "Good to know that {}", "Got it, {}"]
RULE_TEXTS = ["If a bird has wings then it can fly.", "if the dogs are mammals, then they have fur", "if x then y", "Cats can climb."]


def _e(s: SparkSession, d: str) -> DataFrame:
    return store.edges(table(s, d, "facts"))


def _stated(s: SparkSession, d: str) -> DataFrame:
    """The edges as they are stated, with their repetitions."""
    return table(s, d, "facts").select(*store.KEY).where(" and ".join(f"{c} is not null" for c in store.KEY))


def _asked(s: SparkSession, d: str) -> DataFrame:
    """A question about every fact whose id is divisible by 100, by the base verb of its relation: a query set, answered
    from all facts of its instance."""
    base = table(s, d, "relation_defs").select(F.col("relation").alias("br"), "base_verb")
    f = table(s, d, "facts").where("fact_id % 100 = 0 and instance is not null and subject is not null and relation is not null and object is not null")
    rows = f.join(base, F.col("relation") == F.col("br"), "left")
    return rows.select(F.col("fact_id").cast("string").alias("id"), "instance", "subject", F.coalesce("base_verb", "relation").alias("relation"), "object")


def yesno(s: SparkSession, d: str) -> DataFrame:
    """The same questions as asked, about the next subject's object (mostly no), and about an unknown subject."""
    a = _asked(s, d)
    other = a.select(F.concat("id", F.lit("|other")).alias("id"), "instance", "subject", "relation", F.reverse("object").alias("object"))
    none = a.select(F.concat("id", F.lit("|none")).alias("id"), "instance", F.concat("subject", F.lit("_zz")).alias("subject"), "relation", "object")
    return answers.verdicts(_e(s, d), a.unionByName(other).unionByName(none), _forms(s, d))


def corrected_facts(s: SparkSession, d: str) -> DataFrame:
    """The facts left when every value that a later row corrected is taken back."""
    f = table(s, d, "facts")
    wrong = f.where("corrected_by is not null and original_value is not null").select("instance", "subject", "relation", F.col("original_value").alias("object")).distinct()
    return store.edges(f).join(wrong, store.KEY, "left_anti").groupBy("instance", "relation").agg(F.count("*").alias("facts"), F.min("subject").alias("first"))


def curiosity(s: SparkSession, d: str) -> DataFrame:
    """Open topics (review items that nobody contradicts or confirms) and their state: by attempts, then by age."""
    f = table(s, d, "facts").where("context = 'review'")
    n = f.groupBy("instance", "subject", "relation").agg(F.count_distinct("object").alias("values"), F.count("*").alias("attempts"), F.max(F.col("created_at").cast("timestamp")).alias("seen"))
    age = (F.unix_micros(F.lit("2025-09-15 00:00:00").cast("timestamp")) - F.unix_micros("seen")) / 1e6
    status = F.when(F.col("values") > 1, "hypothesizing").when(F.col("attempts") >= 5, "expired").when(age > 90 * 86400, "expired").when(F.col("attempts") > 1, "resolved").otherwise("active")
    return n.select("instance", "subject", "relation", "attempts", status.alias("status"))


def hypotheses(s: SparkSession, d: str) -> DataFrame:
    """Properties that at least two entities similar to a topic have and the topic lacks."""
    n = insight.supported_facts(_stated(s, d).select(F.col("instance").alias("g"), F.col("subject").alias("holder"), F.concat_ws("|", "relation", "object").alias("value")))
    return n.select("g", "holder", "value", "support", F.round(F.least(F.lit(0.9), 0.2 * F.col("support")), 6).alias("confidence"))


def differences(s: SparkSession, d: str) -> DataFrame:
    """How the two best-known subjects of each instance differ."""
    e = _e(s, d)
    n = e.groupBy("instance", "subject").agg(F.count("*").alias("n"))
    top = n.withColumn("k", F.row_number().over(Window.partitionBy("instance").orderBy(F.desc("n"), "subject"))).where("k <= 2")
    pairs = top.groupBy("instance").agg(F.max(F.when(F.col("k") == 1, F.col("subject"))).alias("a"), F.max(F.when(F.col("k") == 2, F.col("subject"))).alias("b")).select("instance", "a", "b")
    return answers.difference(e, pairs)


def graph_limits(s: SparkSession, d: str) -> DataFrame:
    """The twenty best connected subjects of each instance with five edges each."""
    e = _e(s, d)
    n = e.groupBy("instance", "subject").agg(F.count("*").alias("n"))
    top = n.withColumn("place", F.row_number().over(Window.partitionBy("instance").orderBy(F.desc("n"), "subject"))).where("place <= 20")
    shown = e.join(top.select("instance", "subject", "place"), ["instance", "subject"])
    return shown.withColumn("edge", F.row_number().over(Window.partitionBy("instance", "subject").orderBy("relation", "object"))).where("edge <= 5")


def conjunctive(s: SparkSession, d: str) -> DataFrame:
    """Subjects that have one relation and also another."""
    e = _e(s, d)
    right = e.where("relation = 'tickles'").select("instance", "subject").distinct()
    return e.where("relation = 'borrows_from'").select("instance", "subject").distinct().join(right, ["instance", "subject"], "left_semi")


def copied_properties(s: SparkSession, d: str) -> DataFrame:
    """What customers would take over from those who share their nation and segment is what their parts lack: here, the
    properties handed across the symmetric relation "same name" of parts."""
    parts = star.parts(s, d)
    sized = table(s, d, "part").select(star.key("part", "p_partkey").alias("s"), star.low("p_name").alias("name"), star.low("p_brand").alias("brand"))
    by_name = sized.groupBy("name", "brand").agg(F.count("*").alias("parts"))
    lacking = sized.select("s", "name").join(by_name.select("name", "brand"), "name").select("s", F.lit("has").alias("r"), F.col("brand").alias("o"))
    return lacking.distinct().join(parts.select("s", "r", "o"), ["s", "r", "o"], "left_anti")


def grandparents(s: SparkSession, d: str) -> DataFrame:
    e = _hierarchy_edges(s, d)
    up = e.select("g", F.col("s").alias("m"), F.col("o").alias("grand"))
    two = e.join(up.withColumnRenamed("g", "ug"), (F.col("g") == F.col("ug")) & (F.col("o") == F.col("m"))).where("grand <> s")
    return two.select("g", "s", F.lit("part_of").alias("r"), F.col("grand").alias("o"), F.lit("medium").alias("confidence")).distinct()


def instances_of(s: SparkSession, d: str) -> DataFrame:
    """The parts of each category, by either of the relations that make a member."""
    parts = star.parts(s, d).where("r = 'is'")
    back = parts.select(F.col("o").alias("s"), F.lit("has_instance").alias("r"), F.col("s").alias("o"))
    return parts.select(F.col("o").alias("category"), F.col("s").alias("member")).unionByName(back.select(F.col("s").alias("category"), F.col("o").alias("member"))).distinct()


def bridge_instances(s: SparkSession, d: str) -> DataFrame:
    """Members that a category has through an equivalent or a smaller category."""
    members = star.parts(s, d).where("r in ('is', 'size', 'color')").select(F.col("o").alias("category"), F.col("s").alias("member")).distinct()
    b = mining.bridges(members).where("relation in ('equivalent_to', 'subset_of')")
    through = b.select(F.col("b").alias("category"), F.col("a").alias("via")).unionByName(b.where("relation = 'equivalent_to'").select(F.col("a").alias("category"), F.col("b").alias("via")))
    return members.unionByName(through.join(members.select(F.col("category").alias("via"), "member"), "via").select("category", "member")).distinct()


def tenants(s: SparkSession, d: str) -> DataFrame:
    users = table(s, d, "user_stats").groupBy("instance").agg(F.count("*").alias("users"), F.coalesce(F.sum("message_count"), F.lit(0)).alias("messages"))
    facts = table(s, d, "facts").groupBy("instance").agg(F.count("*").alias("facts"), F.count_distinct("context").alias("contexts"))
    return facts.join(users, "instance", "left").select("instance", T.slug(F.col("instance")).alias("slug"), "facts", "contexts", F.coalesce("users", F.lit(0)).alias("users"), F.coalesce("messages", F.lit(0)).alias("messages"))


def sentence_structure(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "eval_items").select("item_id", F.posexplode(F.split("text", "\n")).alias("at", "x"))
    return rows.select("item_id", "at", *[c.alias(n) for n, c in language.structure(F.col("x")).items()], language.act(F.col("x")).alias("act"))


def dialogue(s: SparkSession, d: str) -> DataFrame:
    return language.dialogue(table(s, d, "documents").where("text is not null"), "doc_id", "text").select("doc_id", "turn", "speaker", "named", "topic")


def weak_entities(s: SparkSession, d: str) -> DataFrame:
    """Entities of few edges, and whom they share their values with: how many others for each value, and one of them.

    A value's holders are only aggregated, never paired.
    """
    props = _properties(s, d)
    deg = store.degrees(_e(s, d)).where("out_degree + in_degree < 3").select(F.col("instance").alias("wg"), F.col("node").alias("wx"))
    groups = props.groupBy("g", "value").agg(F.count("*").alias("n"), F.min("holder").alias("low"), F.max("holder").alias("high")).where("n >= 2")
    mine = props.join(deg, (F.col("g") == F.col("wg")) & (F.col("holder") == F.col("wx"))).join(groups, ["g", "value"])
    other = F.when(F.col("holder") == F.col("low"), F.col("high")).otherwise(F.col("low"))
    return mine.groupBy("g", F.col("holder").alias("x")).agg(F.sum(F.col("n") - 1).alias("links"), F.round(F.least(F.lit(0.9), 0.5 + 0.1 * F.count("*")), 6).alias("confidence"), F.min(other).alias("first"))


def acknowledgements(s: SparkSession, d: str) -> DataFrame:
    text = F.concat_ws(" ", T.pretty(F.col("subject")), T.pretty(F.col("relation")), T.pretty(F.col("object")))
    return _e(s, d).select(text.alias("statement")).distinct().select("statement", F.replace(answers.choice(F.col("statement"), TEMPLATES), F.lit("{}"), F.col("statement")).alias("reply"))


def parsed_rules(s: SparkSession, d: str) -> DataFrame:
    rows = s.createDataFrame(list(enumerate(RULE_TEXTS)), "id int, text string")
    return rows.select("id", answers.rule_of(F.col("text")).alias("q")).where("q is not null").select("id", "q.*")


def hierarchy_depths(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "facts").where("relation = 'part_of'")
    trees = hierarchy.forest(hierarchy.links(rows, F.col("instance"), F.col("subject"), F.col("object")))
    return trees.groupBy(F.col("g").alias("instance"), "root").agg(F.count("*").alias("nodes"), F.max("depth").alias("deepest"))


def chain_labels(s: SparkSession, d: str) -> DataFrame:
    far = reasoning.chains(star.places(s, d).where("r = 'part_of'"))
    return far.groupBy("depth", C.label(F.col("score")).alias("confidence"), (F.col("score") >= C.KEPT_FROM - C.SLACK).alias("kept")).agg(F.count("*").alias("n"))


def assigned_confidence(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "facts")
    level = C.assigned(F.col("confidence"), F.col("source_type"), F.size("conditions") > 0)
    return f.select("fact_id", level.alias("confidence")).groupBy("confidence").agg(F.count("*").alias("facts"), F.min("fact_id").alias("first"))


def chain_ends(s: SparkSession, d: str) -> DataFrame:
    """Where the part_of chains begin and end: nodes that are only ever a part, or only ever a whole."""
    e = _hierarchy_edges(s, d)
    low, high = e.select("g", F.col("s").alias("node")).distinct(), e.select("g", F.col("o").alias("node")).distinct()
    first = low.join(high, ["g", "node"], "left_anti").withColumn("kind", F.lit("only a part"))
    return first.unionByName(high.join(low, ["g", "node"], "left_anti").withColumn("kind", F.lit("only a whole")))


def strong_connections(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "facts").where("context <> 'review' and relation <> 'part_of'")
    return f.groupBy(*store.KEY).agg(F.count("*").alias("times")).orderBy(F.desc("times"), *store.KEY).limit(10)


def recent_average(s: SparkSession, d: str) -> DataFrame:
    """Each event with the mean value of its user's last twenty events."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-19, 0)
    return table(s, d, "events").select("event_id", F.round(F.avg("value").over(w), 6).alias("recent"))


def topic_changes(s: SparkSession, d: str) -> DataFrame:
    """Turns of dialogues at which the topic changes, with the topic that is left and how many names came before."""
    t = language.dialogue(table(s, d, "documents").where("text is not null"), "doc_id", "text")
    before = Window.partitionBy("doc_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = t.withColumn("earlier", F.count("named").over(before))
    return rows.where("named is not null and topic is not null and named <> topic").select("doc_id", "turn", F.col("named").alias("topic"), F.col("topic").alias("was"), "earlier")


def gated_rules(s: SparkSession, d: str) -> DataFrame:
    """Rules "members of a category have a property": support, confidence, and lift over the property's base rate."""
    parts = star.parts(s, d)
    members = parts.where("r = 'is'").select(F.col("o").alias("category"), F.col("s").alias("member"))
    props = parts.where("r <> 'is'").select("s", "r", "o")
    total = members.select(F.count_distinct("member").alias("total"))
    base = props.groupBy("r", "o").agg(F.count("*").alias("all")).join(F.broadcast(total))  # one row
    rules = mining.coverage(members, props).join(base, ["r", "o"])
    rate = F.col("all") / F.col("total")
    out = rules.select("category", "r", "o", "holders", "ratio", F.round(rate, 6).alias("base_rate"), F.round(F.col("ratio") / rate, 6).alias("lift"))
    return out.where("holders >= 3 and base_rate <= 0.8 and lift >= 1.2")


QUERIES = {
    "assigned_confidence": assigned_confidence,
    "chain_ends": chain_ends,
    "strong_connections": strong_connections,
    "recent_average": recent_average,
    "topic_changes": topic_changes,
    "gated_rules": gated_rules,
    "answers_forward": lambda s, d: answers.forward(_e(s, d), _asked(s, d), _forms(s, d)),
    "answers_reverse": lambda s, d: answers.reverse(_stated(s, d), _asked(s, d), _forms(s, d)),
    "answers_yesno": yesno,
    "composed_answers": lambda s, d: answers.sentences(_e(s, d), table(s, d, "relation_defs").selectExpr("relation", "present_s as verb")),
    "corrected_facts": corrected_facts,
    "curiosity_states": curiosity,
    "hypotheses": hypotheses,
    "differences": differences,
    "graph_limits": graph_limits,
    "conjunctive_filter": conjunctive,
    "copied_properties": copied_properties,
    "grandparents": grandparents,
    "instances_of": instances_of,
    "bridge_instances": bridge_instances,
    "tenant_catalog": tenants,
    "sentence_structure": sentence_structure,
    "dialogue_turns": dialogue,
    "sentence_links": lambda s, d: language.sentence_links(table(s, d, "documents"), "doc_id", "text"),
    "weak_entities": weak_entities,
    "acknowledgements": acknowledgements,
    "parsed_rules": parsed_rules,
    "hierarchy_depths": hierarchy_depths,
    "chain_labels": chain_labels,
}

_E = "e as (select distinct instance, subject, relation, object from facts where instance is not null and subject is not null and relation is not null and object is not null)"
_ASK = f"""{_E}, forms as (select distinct relation, unnest([relation, base_verb, past, present_s, present_p]) as form from relation_defs),
asked as (select cast(fact_id as varchar) as id, f.instance, f.subject, coalesce(d.base_verb, f.relation) as relation, f.object
  from facts f left join relation_defs d on d.relation = f.relation where fact_id % 100 = 0 and f.instance is not null and f.subject is not null and f.relation is not null and f.object is not null),
meant as (select a.*, a.relation as meant from asked a union select a.*, f.relation from asked a join forms f on f.form = a.relation)"""
_UP = """h as (
  select g, s, min(o) as o from (select instance as g, lower(replace(trim(subject), ' ', '_')) as s, lower(replace(trim(object), ' ', '_')) as o from facts where relation = 'part_of') group by 1, 2)"""
_PROPS = f"{_E}, p as (select instance as g, subject as holder, relation || '|' || object as value from e)"
_PRETTY = lambda c: f"replace({c}, '_', ' ')"
_TOP = f"{_E}, n as (select instance, subject, count(*) as n from e group by 1, 2), top as (select *, row_number() over (partition by instance order by n desc, subject)::int as k from n)"
_ACT = "case " + " ".join(f"when regexp_matches(lower(x), '{p}') then '{n}'" for n, p in language.ACTS) + " else 'chatting' end"
_TURNS = r"""l as (select doc_id, unnest(string_split_regex(text, '\r?\n')) as line, unnest(range(len(string_split_regex(text, '\r?\n'))))::int as turn from documents where text is not null),
t as (select doc_id, turn, regexp_extract(line, '^(User|System|Teacher|Speaker \d+): (.+)$', 2) as said from l where regexp_matches(line, '^(User|System|Teacher|Speaker \d+): (.+)$')),
n as (select *, nullif(regexp_extract(regexp_replace(said, '^\S+', ''), '\b([A-Z][a-z]{3,})\b', 1), '') as named from t)"""
SQL = {
    "parsed_rules": "select * from (values (0, 'bird', 'has', 'wings', 'can', 'fly'), (1, 'dogs', 'is', 'mammals', 'has', 'fur')) x(id, subject, relation, object, then_relation, then_object)",
    "assigned_confidence": """select coalesce(confidence, case when len(conditions) > 0 then 'low' when source_type is null or source_type in ('user', 'clarification') then 'high' when source_type in ('inference', 'inheritance') then 'medium' else 'low' end) as confidence,
  count(*) as facts, min(fact_id) as "first" from facts group by 1""",
    "chain_ends": f"""with {_UP} select distinct g, s as node, 'only a part' as kind from h where not exists (select 1 from h x where x.g = h.g and x.o = h.s)
union all select distinct g, o, 'only a whole' from h where not exists (select 1 from h x where x.g = h.g and x.s = h.o)""",
    "strong_connections": "select instance, subject, relation, object, count(*) as times from facts where context <> 'review' and relation <> 'part_of' group by 1, 2, 3, 4 order by times desc, 1, 2, 3, 4 limit 10",
    "recent_average": "select event_id, round(avg(value) over (partition by user_id order by ts, event_id rows between 19 preceding and current row), 6) as recent from events",
    "topic_changes": f"""with {_TURNS}, w as (select doc_id, turn, named, last_value(named ignore nulls) over k as was, count(named) over k as earlier from n
window k as (partition by doc_id order by turn rows between unbounded preceding and 1 preceding))
select doc_id, turn, named as topic, was, earlier from w where named is not null and was is not null and named <> was""",
    "gated_rules": f"""with {star.PARTS_SQL}, m as (select o as category, s as member from parts where r = 'is'), z as (select category, count(*) as size from m group by 1), t as (select count(distinct member) as total from m),
b as (select r, o, count(*) as n from parts where r <> 'is' group by 1, 2),
c as (select m.category, p.r, p.o, count(*) as holders, round(count(*) / any_value(size), 6) as ratio from m join parts p on p.s = m.member and p.r <> 'is' join z using (category) group by 1, 2, 3)
select category, c.r, c.o, holders, ratio, round(n / total, 6) as base_rate, round(ratio / (n / total), 6) as lift from c join b on b.r = c.r and b.o = c.o, t where holders >= 3 and round(n / total, 6) <= 0.8 and round(ratio / (n / total), 6) >= 1.2""",
    "answers_forward": f"with {_ASK} select distinct id, e.object as answer from meant m join e on e.instance = m.instance and e.subject = m.subject and e.relation = m.meant",
    "answers_reverse": f"with {_ASK} select distinct id, e.subject as answer from meant m join e on e.instance = m.instance and e.relation = m.meant and (contains(e.object, m.object) or contains(m.object, e.object))",
    "answers_yesno": f"""with {_ASK}, q as (select id, instance, subject, relation, object from asked union all select id || '|other', instance, subject, relation, reverse(object) from asked union all select id || '|none', instance, subject || '_zz', relation, object from asked),
m as (select q.*, q.relation as meant from q union select q.*, f.relation from q join forms f on f.form = q.relation), known as (select instance, subject as x from e union select instance, object from e),
hit as (select distinct id from m join e on e.instance = m.instance and e.subject = m.subject and e.relation = m.meant and e.object = m.object)
select id, case when id in (select id from hit) then 'yes' when (instance, subject) in (select (instance, x) from known) then 'no' else 'unknown' end as verdict from q""",
    "composed_answers": f"""with {_E}, x as (select instance, subject, relation, list_sort(list(distinct {_PRETTY('object')}))[1:5] as o from e group by 1, 2, 3)
select instance, subject, x.relation, 'The ' || {_PRETTY('subject')} || ' ' || coalesce(d.present_s, {_PRETTY('x.relation')}) || ' ' || case len(o) when 1 then o[1] when 2 then o[1] || ' and ' || o[2] else array_to_string(o[:-2], ', ') || ', and ' || o[-1] end || '.' as sentence
from x left join relation_defs d on d.relation = x.relation""",
    "corrected_facts": f"""with {_E} select instance, relation, count(*) as facts, min(subject) as "first" from e
where not exists (select 1 from facts c where c.corrected_by is not null and c.instance = e.instance and c.subject = e.subject and c.relation = e.relation and c.original_value = e.object) group by 1, 2""",
    "curiosity_states": """with n as (select instance, subject, relation, count(distinct object) as v, count(*) as attempts, max(created_at) as seen from facts where context = 'review' group by 1, 2, 3)
select instance, subject, relation, attempts, case when v > 1 then 'hypothesizing' when attempts >= 5 then 'expired' when epoch_us(timestamp '2025-09-15 00:00:00') - epoch_us(seen) > 90 * 86400 * 1000000::bigint then 'expired' when attempts > 1 then 'resolved' else 'active' end as status from n""",
    "hypotheses": f"""with {_PROPS}, pairs as (select x.g, x.holder as a, y.holder as b from p x join p y on x.g = y.g and x.value = y.value and x.holder <> y.holder group by 1, 2, 3 having count(*) >= 2),
n as (select q.g, q.a as holder, p.value, count(distinct q.b) as support from pairs q join p on p.g = q.g and p.holder = q.b group by 1, 2, 3)
select n.*, round(least(0.9, 0.2 * support), 6)::double as confidence from n where support >= 2 and not exists (select 1 from p where p.g = n.g and p.holder = n.holder and p.value = n.value)""",
    "differences": f"""with {_TOP}, pairs as (select x.instance, x.subject as a, y.subject as b from top x join top y using (instance) where x.k = 1 and y.k = 2)
select p.instance, a, b, relation, object, a as only from pairs p join e on e.instance = p.instance and e.subject = a where not exists (select 1 from e y where y.instance = p.instance and y.subject = b and y.relation = e.relation and y.object = e.object)
union all select p.instance, a, b, relation, object, b from pairs p join e on e.instance = p.instance and e.subject = b where not exists (select 1 from e y where y.instance = p.instance and y.subject = a and y.relation = e.relation and y.object = e.object)""",
    "graph_limits": f"""with {_TOP} select instance, subject, relation, object, k as place, row_number() over (partition by instance, subject order by relation, object)::int as edge
from e join (select instance, subject, k from top where k <= 20) using (instance, subject) qualify edge <= 5""",
    "conjunctive_filter": f"with {_E} select distinct instance, subject from e where relation = 'borrows_from' and exists (select 1 from e x where x.instance = e.instance and x.subject = e.subject and x.relation = 'tickles')",
    "copied_properties": f"""with {star.PARTS_SQL}, z as (select 'part_' || p_partkey as s, lower(replace(trim(p_name), ' ', '_')) as name, lower(replace(trim(p_brand), ' ', '_')) as brand from part),
l as (select distinct z.s, y.brand as o from z join z y on y.name = z.name)
select s, 'has' as r, o from l where not exists (select 1 from parts p where p.s = l.s and p.r = 'has' and p.o = l.o)""",
    "grandparents": f"with {_UP} select distinct x.g, x.s, 'part_of' as r, y.o, 'medium' as confidence from h x join h y on y.g = x.g and y.s = x.o where y.o <> x.s",
    "instances_of": f"with {star.PARTS_SQL} select distinct o as category, s as member from parts where r = 'is'",
    "bridge_instances": f"""with {star.PARTS_SQL}, m as (select distinct o as category, s as member from parts where r in ('is', 'size', 'color')), z as (select category, count(*) as n from m group by 1),
b as (select x.category as a, y.category as b, count(*) as k from m x join m y on x.member = y.member and x.category <> y.category group by 1, 2),
v as (select b.b as category, b.a as via from b join z on z.category = b.a where b.k = z.n)
select category, member from m union select v.category, m.member from v join m on m.category = v.via""",
    "tenant_catalog": """with u as (select instance, count(*) as users, coalesce(sum(message_count), 0)::bigint as messages from user_stats group by 1),
f as (select instance, count(*) as facts, count(distinct context) as contexts from facts group by 1)
select f.instance, regexp_replace(regexp_replace(lower(f.instance), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug, facts, contexts, coalesce(users, 0) as users, coalesce(messages, 0) as messages from f left join u using (instance)""",
    "sentence_structure": f"""with l as (select item_id, unnest(string_split(text, '\n')) as x, unnest(range(len(string_split(text, '\n'))))::int as pos from eval_items)
select item_id, pos as at, regexp_matches(lower(x), '{language.HEDGES}') as hedged, regexp_extract(lower(x), '{language.FREQUENCIES}', 1) as frequency,
  replace(regexp_extract(lower(x), '{language.QUANTITY}', 1), ',', '') as quantity, regexp_extract(lower(x), '{language.QUANTITY}', 2) as unit, {_ACT} as act from l""".replace("pos as at", 'pos as "at"'),
    "dialogue_turns": r"""with l as (select doc_id, unnest(string_split_regex(text, '\r?\n')) as line, unnest(range(len(string_split_regex(text, '\r?\n'))))::int as turn from documents where text is not null),
t as (select doc_id, turn, regexp_extract(line, '^(User|System|Teacher|Speaker \d+): (.+)$', 1) as speaker, regexp_extract(line, '^(User|System|Teacher|Speaker \d+): (.+)$', 2) as said from l where regexp_matches(line, '^(User|System|Teacher|Speaker \d+): (.+)$')),
n as (select *, nullif(regexp_extract(regexp_replace(said, '^\S+', ''), '\b([A-Z][a-z]{3,})\b', 1), '') as named from t)
select doc_id, turn, speaker, named, last_value(named ignore nulls) over (partition by doc_id order by turn rows between unbounded preceding and 1 preceding) as topic from n""",
    "weak_entities": f"""with {_PROPS}, w as (select instance as g, x from (select instance, subject as x from e union all select instance, object from e) group by 1, 2 having count(*) < 3),
v as (select g, value, count(*) as n, min(holder) as low, max(holder) as high from p group by 1, 2 having count(*) >= 2)
select p.g, p.holder as x, sum(v.n - 1)::bigint as links, round(least(0.9, 0.5 + 0.1 * count(*)), 6)::double as confidence, min(case when p.holder = low then high else low end) as "first"
from p join w on w.g = p.g and w.x = p.holder join v on v.g = p.g and v.value = p.value group by 1, 2""",
    "acknowledgements": f"""with {_E}, s as (select distinct {_PRETTY('subject')} || ' ' || {_PRETTY('relation')} || ' ' || {_PRETTY('object')} as statement from e)
select statement, replace(({TEMPLATES}::varchar[])[('0x' || substr(md5(statement), 1, 8))::bigint % {len(TEMPLATES)} + 1], '{{}}', statement) as reply from s""",
    "hierarchy_depths": f"""with recursive {_UP}, nodes as (select g, s as node from h union select g, o from h),
w as (select g, node, node as top, 0 as depth, [node] as trail, false as turned from nodes union all
  select w.g, w.node, h.o, w.depth + 1, list_append(w.trail, h.o), list_contains(w.trail, h.o) from w join h on h.g = w.g and h.s = w.top where not w.turned),
ends as (select w.g, w.node, w.top as root, w.depth from w left join h on h.g = w.g and h.s = w.top where h.s is null union all
  select g, node, list_min(trail[list_position(trail, top):]), case when list_position(trail, top) = 1 then -1 else -2 end from w where turned)
select g as instance, root, count(*) as nodes, max(depth)::bigint as deepest from ends group by 1, 2""",
    "chain_labels": f"""with recursive {star.PLACES_SQL}, steps as (select s, o, max(cast(case confidence when 'high' then 1.0 when 'low' then 0.4 else 0.7 end as double)) as w from places where r = 'part_of' group by 1, 2),
walks as (select s, o, w as score, 1 as depth from steps union all select w.s, t.o, w.score * t.w, w.depth + 1 from walks w join steps t on t.s = w.o and t.o <> w.s where w.depth < 5),
best as (select s, o, arg_min(depth, (-round(score, 9), depth)) as depth, round(max(score), 6) as score from walks group by 1, 2)
select depth, case when score >= 0.9 - 1e-9 then 'high' when score >= 0.5 - 1e-9 then 'medium' else 'low' end as confidence, score >= 0.3 - 1e-9 as kept, count(*) as n from best group by 1, 2, 3""",
}
