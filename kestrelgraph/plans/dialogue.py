"""Queries of conversations, style, word forms, phrasing and changes of single facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrelgraph.functions import confidence as C
from kestrelgraph.operators import context, language, mining, reasoning, star, store
from kestrelgraph.plans import graph, statements
from kestrelgraph.runtime import materialize, table


def _turns(s: SparkSession, d: str) -> DataFrame:
    return language.dialogue(table(s, d, "documents").where("text is not null"), "doc_id", "text")


def _lines(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "eval_items").select("item_id", F.posexplode(language.sentences(F.col("text"))).alias("at", "x"))


def relevance(s: SparkSession, d: str) -> DataFrame:
    """The first and the last member of each class of the packs, and what arrived about both."""
    w = star.world(s, d).where("g = 'packs'").select("g", "s", "r", "o").distinct()
    pairs = mining.value_classes(w).select("g", F.col("first").alias("a"), F.col("last").alias("b")).unionByName(w.where("r = 'is'").select("g", F.col("s").alias("a"), F.col("o").alias("b")))
    return context.relevance(w, pairs, w.where("r = 'eats'"))


def style(s: SparkSession, d: str) -> DataFrame:
    """Documents that somebody signed count as liked, those that nobody did as disliked."""
    return context.style_scores(table(s, d, "documents").where("text is not null"), "text", F.when(F.col("speaker_id").isNull(), "dislike").otherwise("like"))


def pool(s: SparkSession, d: str) -> DataFrame:
    now = F.lit("2025-09-06 00:00:00").cast("timestamp")
    rows = context.context_pool(table(s, d, "turns"), "session_id", "timestamp", now, 24 * 30)
    return rows.select("session_id", "turns", F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last"), "evicted")


def inflected(s: SparkSession, d: str) -> DataFrame:
    """Forms of all nouns of part names and of the last words of subjects, and of verbs with them."""
    words = table(s, d, "part").select(F.element_at(F.split(star.low("p_name"), "_"), -1).alias("word")).unionByName(table(s, d, "facts").select(F.element_at(F.split("subject", "_"), -1).alias("word")))
    w = F.col("word")
    return words.where("word is not null and word <> ''").distinct().select(
        "word", context.plural(w).alias("plural"), context.singular(w).alias("singular"), context.is_plural(w).alias("many"), context.is_adjective(w).alias("adjective"), context.article(w).alias("article"), context.verb_form(w, F.lit("has")).alias("has"), context.verb_form(w, F.lit("runs")).alias("runs")
    )


def refinements(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "documents").where("text is not null").select("doc_id", F.posexplode(language.sentences(F.col("text"))).alias("at", "x"))
    return rows.select("doc_id", "at", context.refined(F.col("x")).alias("q")).where("q is not null").select("doc_id", "at", "q.*")


def structural_extras(s: SparkSession, d: str) -> DataFrame:
    return _lines(s, d).select("item_id", "at", F.explode(context.extras(F.col("x"))).alias("e")).select("item_id", "at", "e.*")


def templates(s: SparkSession, d: str) -> DataFrame:
    """Slot templates of sentences that name two things: how often each is used."""
    rows = table(s, d, "documents").where("text is not null").select(F.explode(language.sentences(F.col("text"))).alias("x"))
    names = F.regexp_extract_all("x", F.lit(language.NAME), F.lit(1))
    t = rows.select(context.template(F.col("x"), F.get(names, 0), F.get(names, 1)).alias("template")).where("template is not null")
    return t.groupBy("template").agg(F.count("*").alias("uses"))


def constraints(s: SparkSession, d: str) -> DataFrame:
    """The conditions of each quad over all its rows, each once."""
    return table(s, d, "facts").select(*store.KEY, F.explode("conditions").alias("condition")).distinct()


def fact_metadata(s: SparkSession, d: str) -> DataFrame:
    """The latest row of each quad and context, with what is known about it."""
    f = table(s, d, "facts")
    keep = ["fact_id", "confidence", "temporal", "scope", "source_type", "rule_id", "derivation_id"]
    best = f.groupBy(*store.KEY, "context").agg(F.max_by(F.struct(*keep), "fact_id").alias("m"))
    return best.select(*store.KEY, "context", "m.*")


def subject_profile(s: SparkSession, d: str) -> DataFrame:
    """Each subject's relations with the number of their objects and the first three."""
    e = store.edges(table(s, d, "facts"))
    n = e.groupBy("instance", "subject", "relation").agg(F.count("*").alias("n"))
    k = F.row_number().over(Window.partitionBy("instance", "subject", "relation").orderBy("object"))
    top = e.withColumn("k", k).where("k <= 3").groupBy("instance", "subject", "relation").agg(F.array_join(F.array_sort(F.collect_list("object")), ", ").alias("objects"))
    return n.join(top, ["instance", "subject", "relation"])


def usage_filtered(s: SparkSession, d: str) -> DataFrame:
    """Usage of the last thirty days of the table by model; a row without a model is of an unknown one."""
    t = table(s, d, "turns").where("timestamp is not null")
    last = t.agg(F.max(F.to_date("timestamp")).alias("last"))
    rows = t.join(F.broadcast(last), F.to_date("timestamp") > F.date_sub("last", 30))  # one row
    return rows.groupBy(F.coalesce("model", F.lit("unknown")).alias("model")).agg(F.count("*").alias("turns"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output"))


def usage_table(s: SparkSession, d: str) -> DataFrame:
    """The twenty sessions with most output, as the table of sessions is sorted by a column."""
    rows = table(s, d, "sessions").select("session_id", "project_name", "turn_count", F.coalesce("total_output_tokens", F.lit(0)).alias("output"))
    return rows.orderBy(F.desc("output"), "session_id").limit(20)


def activated(s: SparkSession, d: str) -> DataFrame:
    """Levels of users' event types after one activation an event, with their sources and last time."""
    e = table(s, d, "events")
    n = e.groupBy("event_type", F.col("user_id").alias("node")).agg(F.least(F.lit(2.0), F.count("*") * 0.3).alias("level"), F.max("ts").alias("at"))
    return n.select("event_type", "node", F.round("level", 6).alias("level"), F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


def activation_snapshot(s: SparkSession, d: str) -> DataFrame:
    """The five highest levels of each instance."""
    k = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("level"), "node"))
    return graph.spread_activation(s, d).withColumn("place", k).where("place <= 5")


def dependency_closure(s: SparkSession, d: str) -> DataFrame:
    """How many facts depend on each cited fact, directly or not, found upwards from the facts that cite."""
    f = table(s, d, "facts")
    e = store.premise_edges(f)
    key = lambda *cs: F.concat_ws("|", "instance", *cs)
    pairs = e.select(key("ps", "pr", "po").alias("base"), key("s", "r", "o").alias("fact")).distinct()
    step, done = pairs, pairs
    while True:
        step = materialize(step.join(pairs.select(F.col("base").alias("fact"), F.col("fact").alias("next")), "fact").select("base", F.col("next").alias("fact")).distinct().join(done, ["base", "fact"], "left_anti"))
        if step.isEmpty():
            break
        done = done.unionByName(step)
    return done.groupBy("base").agg(F.count("*").alias("dependents"))


def chain_trace(s: SparkSession, d: str) -> DataFrame:
    """What follows from each region's nations and customers along part_of, with the steps."""
    far = reasoning.chains(graph._chained(star.places(s, d).where("s not like 'order%'")))
    return far.select("g", "s", "r", "o", "depth", F.when(F.col("depth") == 1, "stated").otherwise("inferred").alias("kind"))


def phrased(s: SparkSession, d: str) -> DataFrame:
    """Questions about review items: with the most frequent value as a guess, if it was stated more than once."""
    f = table(s, d, "facts").where("context = 'review'")
    n = f.groupBy("instance", "subject", "relation", "object").agg(F.count("*").alias("n"))
    best = n.groupBy("instance", "subject", "relation").agg(F.min(F.struct((-F.col("n")).alias("k"), "object")).alias("b"))
    guess = F.when(F.col("b.k") <= -2, F.col("b.object"))
    return best.select("instance", "subject", "relation", context.asked_about(F.col("subject"), F.col("relation"), guess).alias("question"))


def open_questions(s: SparkSession, d: str) -> DataFrame:
    """Subjects that have parts and no property: facts that note what is to be asked about them."""
    e = graph.named(s, d)
    whole = e.where("r = 'part_of'").select("g", F.col("o").alias("s")).distinct()
    return whole.join(e.select("g", "s").distinct(), ["g", "s"], "left_anti").select("g", "s", F.lit("has_open_question").alias("r"), F.lit("location").alias("o"))


def spoken_levels(s: SparkSession, d: str) -> DataFrame:
    """Events as segments that were heard with a confidence: their value as a share of their kind's highest."""
    e = table(s, d, "events")
    top = e.groupBy("event_type").agg(F.max("value").alias("top"))
    return e.join(top, "event_type").select("event_type", C.heard(F.try_divide("value", "top")).alias("level")).groupBy("event_type", "level").agg(F.count("*").alias("n"))


QUERIES = {
    "spoken_levels": spoken_levels,
    "topic_stack": lambda s, d: context.topic_stack(_turns(s, d), "doc_id"),
    "topic_relevance": relevance,
    "antecedents": lambda s, d: context.antecedents(_turns(s, d), "doc_id", "said"),
    "recent_statements": lambda s, d: context.recent_statements(_turns(s, d), "doc_id"),
    "context_pool": pool,
    "style_scores": style,
    "style_templates": templates,
    "inflected": inflected,
    "refinements": refinements,
    "structural_extras": structural_extras,
    "constraints_get": constraints,
    "fact_metadata": fact_metadata,
    "subject_profile": subject_profile,
    "usage_filtered": usage_filtered,
    "usage_table": usage_table,
    "activated": activated,
    "activation_snapshot": activation_snapshot,
    "dependency_closure": dependency_closure,
    "chain_trace": chain_trace,
    "phrased_questions": phrased,
    "open_questions": open_questions,
    "knowledge_sufficiency": lambda s, d: context.sufficient(graph.named(s, d)),
    "node_views": lambda s, d: context.node_view(graph.named(s, d)),
    "corrections_per_concept": lambda s, d: store.corrections(table(s, d, "facts")).groupBy("instance", F.col("subject").alias("concept")).agg(F.count("*").alias("corrections")),
    "folded_facts": lambda s, d: context.folded(table(s, d, "facts").select("instance", "subject", "relation", "object")).groupBy("instance", "relation").agg(F.count("*").alias("facts")),
}

_N = statements._DIALOGUE
_QUADS = "e as (select distinct instance, subject, relation, object from facts where instance is not null and subject is not null and relation is not null and object is not null)"
_PRETTY = lambda c: f"replace({c}, '_', ' ')"
_FIRST = lambda rows, c: "case " + " ".join(f"when regexp_matches({c}, '{p}') then '{k}'" for p, k in rows) + " end"
_SENTENCES = statements.SENTENCES_SQL
_W = f"{star.WORLD_SQL}, w as (select distinct g, s, r, o from world where g = 'packs')"
_IRREG, _IRREG_BACK = (f"map {{{', '.join(f'{chr(39)}{a}{chr(39)}: {chr(39)}{b}{chr(39)}' for a, b in pairs)}}}" for pairs in (context.IRREGULAR.items(), ((v, k) for k, v in context.IRREGULAR.items())))
_MANY = f"(word in ('they', 'them', 'we', 'us', 'these', 'those', {', '.join(repr(v) for v in context.IRREGULAR.values())}) or (word like '%s' and word not like '%ss' and word not in ('this', 'is', 'was', 'has', 'does', 'goes')))"
_REFINE = r"^(.+?),? (" + "|".join(context.REFINING) + r") (.+)$"
_LOW = lambda c: f"regexp_replace(lower(trim({c})), '[.!?]+$', '')"
_QUANTITY = language.QUANTITY
_CMP, _AIM = r"\b(?:more|less|[a-z]+er) (?:[a-z]+ )?than (?:the |a |an )?([a-z ]+)$", r"\b(?:in order to|so that|to) ([a-z]+ .+)$"
SQL = {
    "spoken_levels": "with t as (select event_type, max(value) as top from events group by 1) select event_type, case when value / top >= 0.9 then 'high' when value / top >= 0.7 then 'medium' else 'low' end as level, count(*) as n from events join t using (event_type) group by 1, 2",
    "topic_stack": f"with {_N}, l2 as (select doc_id, named as name, max(turn) as turn from n where named is not null group by 1, 2) select doc_id, row_number() over (partition by doc_id order by turn desc, name)::int as place, name, turn from l2 qualify place <= 5",
    "topic_relevance": f"""with {_W}, p as (select g, min(s) as a, max(s) as b from w group by g, r, o having count(*) >= 2 union select g, s, o from w where r = 'is'),
k as (select g, a, b, 0.0 as k from p union all select distinct p.g, a, b, 0.5 from p join w on w.g = p.g and w.s = a and contains(w.o, b) union all select distinct p.g, a, b, 0.5 from p join w on w.g = p.g and w.s = b and contains(w.o, a)
  union all select distinct p.g, a, b, 0.3 from p join w x on x.s = a and x.r in ('is', 'is_a', 'type_of', 'kind_of') join w y on y.s = b and y.r in ('is', 'is_a', 'type_of', 'kind_of') and y.o = x.o
  union all select p.g, a, b, least(0.2, 0.05 * count(distinct x.r)) from p join w x on x.s = a and x.r not in ('is', 'is_a', 'type_of') join w y on y.s = b and y.r = x.r group by 1, 2, 3
  union all select p.g, a, b, 0.3 from p where exists (select 1 from w where r = 'eats' and ((s = a and o = b) or (s = b and o = a))))
select g, a, b, round(case when a = b then 1.0 else least(1.0, sum(k)) end, 6)::double as score from k group by 1, 2, 3""",
    "antecedents": f"""with {_N}, x as (select doc_id, turn, regexp_extract(lower(said), '(?:^|[^\\p{{L}}\\p{{N}}_])(he|she|it|they|them|him|her)(?:$|[^\\p{{L}}\\p{{N}}_])', 1) as pronoun,
  last_value(case when named like '%s' then turn end ignore nulls) over k as pt, last_value(case when named like '%s' then named end ignore nulls) over k as pn,
  last_value(case when named not like '%s' then turn end ignore nulls) over k as st, last_value(case when named not like '%s' then named end ignore nulls) over k as sn from n
  window k as (partition by doc_id order by turn rows between unbounded preceding and 1 preceding)),
y as (select *, case when pn is not null then 3 - 0.3 * (turn - pt) + (pronoun in ('they', 'them'))::int end as pk, case when sn is not null then 3 - 0.3 * (turn - st) + (pronoun not in ('they', 'them'))::int end as sk from x where pronoun <> '')
select doc_id, turn, pronoun, case when sn is null or round(pk, 6) > round(sk, 6) or (round(pk, 6) = round(sk, 6) and pn > sn) then pn else sn end as antecedent from y where pn is not null or sn is not null""",
    "recent_statements": f"""with {_N}, e as (select doc_id, arg_max(named, turn) filter (named is not null) as topic from n group by 1), h as (select doc_id, turn, named from n qualify row_number() over (partition by doc_id order by turn desc) <= 10)
select h.doc_id, row_number() over (partition by h.doc_id order by turn desc)::int as place, turn, topic from h join e using (doc_id) where named = topic qualify place <= 3""",
    "context_pool": """select session_id, count(*) as turns, strftime(max("timestamp"), '%Y-%m-%d %H:%M:%S') as "last", epoch_us(timestamp '2025-09-06 00:00:00') - epoch_us(max("timestamp")) > 720 * 3600000000 as evicted from turns where "timestamp" is not null group by 1""",
    "style_scores": f"""with x as (select speaker_id is not null as liked, unnest({_SENTENCES}) as s from documents where text is not null), y as (select liked, lower(trim(s)) as t from x),
m as (select liked, 'opener' as kind, {_FIRST(context.OPENERS, 't')} as value from y union all select liked, 'connective', {_FIRST(context.CONNECTIVES, 't')} from y),
c as (select kind, value, count(*) as uses, count(*) filter (liked) as likes, count(*) filter (not liked) as dislikes from m where value is not null group by 1, 2)
select *, uses + 2 * likes - dislikes as score, round((likes - dislikes) / (likes + dislikes), 6) as balance from c""",
    "style_templates": f"""with x as (select unnest({_SENTENCES}) as x from documents where text is not null), y as (select x, regexp_extract_all(x, '{language.NAME}', 1) as ns from x)
select replace(replace(x, ns[1], '{{subject}}'), ns[2], '{{object}}') as template, count(*) as uses from y where len(ns) >= 2 and ns[1] <> ns[2] and len(string_split_regex(trim(x), '\\s+')) between 4 and 25 and not regexp_matches(x, '\\d') group by 1""",
    "inflected": f"""with x as (select distinct word from (select split_part(lower(replace(trim(p_name), ' ', '_')), '_', -1) as word from part union all select split_part(subject, '_', -1) from facts) where word is not null and word <> ''),
v as (select word as shown, lower(trim(word)) as word from x)
select shown as word, coalesce({_IRREG}[word], case when {_MANY} then word when regexp_matches(word, '[^aeiou]y$') then word[:-2] || 'ies' when regexp_matches(word, '(s|sh|ch|x|z)$') then word || 'es' when word like '%fe' then word[:-3] || 'ves' when word like '%f' then word[:-2] || 'ves' else word || 's' end) as plural,
  coalesce({_IRREG_BACK}[word], case when word like '%ies' then word[:-4] || 'y' when word like '%ves' then word[:-4] || 'f' when word like '%es' then word[:-3] when word like '%s' and word not like '%ss' then word[:-2] else word end) as singular,
  {_MANY} as many, regexp_matches(word, '({"|".join(context.ADJECTIVE_ENDINGS)})$') as adjective, case when regexp_matches(word, '^(uni|eu)') then 'a' when regexp_matches(word, '^(hour|honest|[aeiou])') then 'an' else 'a' end as article,
  case when {_MANY} then 'have' else 'has' end as has, case when {_MANY} then 'run' else 'runs' end as runs from v""",
    "refinements": f"""with d as (select doc_id, {_SENTENCES} as ss from documents where text is not null), x as (select doc_id, {_LOW('unnest(ss)')} as t, unnest(range(len(ss)))::int as pos from d)
select doc_id, pos as "at", regexp_extract(t, '{_REFINE}', 1) as statement, regexp_extract(t, '{_REFINE}', 2) as connective, regexp_extract(t, '{_REFINE}', 3) as condition from x where regexp_matches(t, '{_REFINE}')""",
    "structural_extras": f"""with d as (select item_id, {_SENTENCES} as ss from eval_items), x as (select item_id, {_LOW('unnest(ss)')} as t, unnest(range(len(ss)))::int as pos from d)
select item_id, pos as "at", 'quantity' as kind, regexp_extract(t, '{_QUANTITY}', 2) || ':' || replace(regexp_extract(t, '{_QUANTITY}', 1), ',', '') as value from x where regexp_matches(t, '{_QUANTITY}')
union all select item_id, pos, 'comparison', regexp_extract(t, '{_CMP}', 1) from x where regexp_matches(t, '{_CMP}') union all select item_id, pos, 'purpose', regexp_extract(t, '{_AIM}', 1) from x where regexp_matches(t, '{_AIM}')""",
    "constraints_get": "select distinct instance, subject, relation, object, unnest(conditions) as condition from facts",
    "fact_metadata": "select instance, subject, relation, object, context, fact_id, confidence, temporal, scope, source_type, rule_id, derivation_id from facts qualify row_number() over (partition by instance, subject, relation, object, context order by fact_id desc) = 1",
    "subject_profile": f"with {_QUADS}, x as (select *, row_number() over (partition by instance, subject, relation order by object) as k, count(*) over (partition by instance, subject, relation) as n from e) select instance, subject, relation, any_value(n) as n, string_agg(object, ', ' order by object) as objects from x where k <= 3 group by 1, 2, 3",
    "usage_filtered": """select coalesce(model, 'unknown') as model, count(*) as turns, coalesce(sum(input_tokens), 0)::bigint as "input", coalesce(sum(output_tokens), 0)::bigint as "output" from turns where cast("timestamp" as date) > (select max(cast("timestamp" as date)) from turns) - 30 group by 1""",
    "usage_table": 'select session_id, project_name, turn_count, coalesce(total_output_tokens, 0) as "output" from sessions order by "output" desc, session_id limit 20',
    "activated": "select event_type, user_id as node, round(least(2.0, count(*) * 0.3), 6)::double as level, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as \"at\" from events group by 1, 2",
    "activation_snapshot": f"with {graph._SPREAD} select *, row_number() over (partition by g order by level desc, node)::int as place from spread qualify place <= 5",
    "dependency_closure": """with recursive p as (select distinct instance || '|' || x.subject || '|' || x.relation || '|' || x.object as base, instance || '|' || subject || '|' || relation || '|' || object as fact from (select instance, subject, relation, object, unnest(premises) as x from facts)),
c as (select base, fact from p union select c.base, p.fact from c join p on p.base = c.fact) select base, count(*) as dependents from c group by 1""",
    "chain_trace": f"with recursive {star.PLACES_SQL}, near as (select * from places where s not like 'order%'), {graph._CHAINS('near')} select g, s, r, o, depth, case when depth = 1 then 'stated' else 'inferred' end as kind from chains",
    "phrased_questions": f"""with n as (select instance, subject, relation, object, count(*) as n from facts where context = 'review' group by 1, 2, 3, 4), b as (select instance, subject, relation, max(n) as n, arg_min(object, (-n, object)) as o from n group by 1, 2, 3)
select instance, subject, relation, case when n >= 2 then 'I think ' || {_PRETTY('subject')} || ' might ' || {_PRETTY('relation')} || ' ' || {_PRETTY('o')} || '. Is that right?' else 'I don''t know about ''' || {_PRETTY('subject')} || '''. Can you tell me about it?' end as question from b""",
    "open_questions": f"with {graph.NAMED} select distinct g, o as s, 'has_open_question' as r, 'location' as o from named n where r = 'part_of' and not exists (select 1 from named k where k.g = n.g and k.s = n.o)",
    "knowledge_sufficiency": f"with {graph.NAMED} select g, s, count(*) as facts, bool_or(confidence <> 'low') as sufficient from named group by 1, 2",
    "node_views": f"""with {graph.NAMED}, n as (select distinct g, s, r, o from named), k as (select *, row_number() over (partition by g, s, r order by o) as k from n),
l as (select g, s, '  ' || {_PRETTY('r')} || ': ' || string_agg({_PRETTY('o')}, ', ' order by {_PRETTY('o')}) as line from k where k <= 5 group by g, s, r) select g, s, {_PRETTY('s')} || chr(10) || string_agg(line, chr(10) order by line) as view from l group by 1, 2""",
    "corrections_per_concept": """with h as (select instance, subject, relation, object, unnest(correction_history) as x from facts), c as (select instance, subject, relation, object, lower(trim(x.corrected_by)) as by_, x.original_value as was from h
union select instance, subject, relation, object, lower(trim(corrected_by)), original_value from facts where corrected_by is not null) select instance, subject as concept, count(*) as corrections from c group by 1, 2""",
    "folded_facts": "select instance, relation, count(*) as facts from (select distinct instance, subject, case relation when 'have' then 'has' when 'are' then 'is' else relation end as relation, object from facts) group by 1, 2",
}
