"""Queries of the fact store over the facts and user_stats tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelgraph.functions import text as T
from kestrelgraph.operators import store
from kestrelgraph.runtime import table

#: Questions of the variant lookup: (id, subject, relation as asked).
ASKED = [(1, "the_idle_toad", "varnish"), (2, "maranlor", "varnished"), (3, "swift_crabs", "mends"), (4, "mirror_newts", "greet"), (5, "nobody_known", "greets")]
RETRACTED_RULE = "rule_0%"


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "facts")


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    defs = table(spark, sf_dir, "relation_defs")
    return defs.select("relation", F.explode(F.array_distinct(F.array("relation", "base_verb", "past", "present_s", "present_p"))).alias("form")).where("form is not null").distinct()


def variant_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame(ASKED, "id int, subject string, relation string")
    return store.variants(_facts(spark, sf_dir), asked, _forms(spark, sf_dir))


def dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many facts cite each fact as a premise, whether it is still stored or not."""
    cites = store.premise_edges(_facts(spark, sf_dir))
    return cites.groupBy("instance", F.col("ps").alias("subject"), F.col("pr").alias("relation"), F.col("po").alias("object")).agg(F.count("*").alias("dependents"))


def cascade_retraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _facts(spark, sf_dir)
    seeds = facts.where(F.col("rule_id").like(RETRACTED_RULE)).selectExpr("instance", "subject as s", "relation as r", "object as o")
    return store.retract(facts, seeds)


def entity_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _facts(spark, sf_dir)
    names = facts.select(F.explode(F.array("subject", "object")).alias("name")).distinct().where("name is not null")
    return names.select("name", T.valid_entity(F.col("name")).alias("valid"), T.valid_discovery(F.col("name")).alias("discoverable"))


def normalize_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "eval_items")
    # line by line: each line of an evaluation item is a phrase
    lines = items.select("item_id", F.posexplode(F.split("text", r"(?<=[.?])\s+")).alias("line", "phrase"))
    return lines.select("item_id", "line", T.normalize(F.col("phrase")).alias("key"))


def junk_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects that only have reverse relations and at most two edges, or several words and at most one edge."""
    e = store.edges(_facts(spark, sf_dir))
    defs = table(spark, sf_dir, "relation_defs").where("reverse is not null").select(F.col("reverse").alias("relation"), F.lit(True).alias("back")).distinct()
    n = e.join(defs, "relation", "left").groupBy("instance", "subject").agg(F.count("*").alias("edges"), F.bool_and(F.coalesce("back", F.lit(False))).alias("only_reverse"))
    words = F.size(F.split(F.replace("subject", F.lit("_"), F.lit(" ")), r"\s+"))
    return n.where((F.col("only_reverse") & (F.col("edges") <= 2)) | ((words >= 2) & (F.col("edges") <= 1))).select("instance", "subject", "edges")


def known_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name anybody has used, so that a new nickname can be refused whatever its letter case."""
    name = lambda c: F.lower(F.trim(F.col(c)))
    facts, users = _facts(spark, sf_dir), table(spark, sf_dir, "user_stats")
    taught = facts.where("speaker_id is not null").select("instance", name("speaker_id").alias("speaker")).distinct().withColumn("taught", F.lit(True))
    known = users.select("instance", name("user_name").alias("speaker")).distinct().withColumn("known", F.lit(True))
    both = taught.join(known, ["instance", "speaker"], "full")
    return both.select("instance", "speaker", F.coalesce("taught", F.lit(False)).alias("taught"), F.coalesce("known", F.lit(False)).alias("known"))


def temporal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _facts(spark, sf_dir)
    return facts.select(*store.KEY, "temporal").distinct().groupBy("instance", "temporal", "relation").agg(F.count("*").alias("facts"), F.min("subject").alias("first_subject"))


def search_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _facts(spark, sf_dir).select(F.explode(F.array("subject", "object")).alias("node")).distinct()
    return nodes.where(F.contains(F.lower("node"), F.lit("kettle"))).orderBy(F.length("node"), "node").limit(8)


def lookup_with_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _facts(spark, sf_dir).where("relation = 'mends'")
    return f.select("instance", "subject", "object", "context", F.coalesce("confidence", F.lit("medium")).alias("confidence"), "temporal", "scope", F.array_join("conditions", "; ").alias("conditions")).distinct()


def staged_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of the facts that arrived from the middle of July on, next to those before: counts by outcome."""
    f = _facts(spark, sf_dir)
    late = F.coalesce(F.col("created_at").cast("timestamp") >= F.lit("2025-07-15").cast("timestamp"), F.lit(False))
    rows = store.staged(f.where(~late), f.where(late))
    return rows.groupBy("instance", "outcome", "confidence").agg(F.count("*").alias("facts"), F.min("subject").alias("first"))


def derivation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived facts with what derived them and from how many premises, each derivation once."""
    f = _facts(spark, sf_dir).where("source_type in ('inference', 'inheritance', 'rule', 'discovery')")
    return f.select(*store.KEY, "source_type", "rule_id", F.coalesce(F.size("premises"), F.lit(0)).alias("depth")).distinct()


def contributor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who taught and who corrected facts about each subject, a row for each; a hub is not gathered."""
    f = _facts(spark, sf_dir)
    role = lambda c, r: f.select("instance", F.col("subject").alias("node"), F.lit(r).alias("role"), F.lower(F.trim(F.col(c))).alias("person")).where("person <> ''")
    return role("speaker_id", "creator").unionByName(role("corrected_by", "corrector")).distinct()


def reverse_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subjects that have each relation to an object, where several have."""
    e = store.edges(_facts(spark, sf_dir))
    return e.join(store.reverse(_facts(spark, sf_dir)).where("subjects > 1").select("instance", "relation", "object"), ["instance", "relation", "object"])


QUERIES = {
    "staged_facts": staged_facts,
    "contributor_rows": contributor_rows,
    "derivation_log": derivation_log,
    "reverse_members": reverse_members,
    "adjacency": lambda s, d: store.adjacency(_facts(s, d)).select("instance", "subject", "relation", F.array_join("objects", "|").alias("objects")),
    "point_lookup": lambda s, d: store.lookup(_facts(s, d), "part_of", instance="tidewell").select("subject", "object"),
    "lookup_with_properties": lookup_with_properties,
    "temporal_views": lambda s, d: store.views(_facts(s, d), ["currently", "past", "sometimes", "future"]),
    "variant_lookup": variant_lookup,
    "reverse_lookup": lambda s, d: store.reverse(_facts(s, d)),
    "source_type_split": lambda s, d: store.by_source(_facts(s, d)),
    "confidence_get": lambda s, d: store.confidences(_facts(s, d)),
    "dependents": dependents,
    "cascade_retraction": cascade_retraction,
    "entity_names": entity_names,
    "normalize_keys": normalize_keys,
    "junk_entities": junk_entities,
    "known_speakers": known_speakers,
    "temporal_summary": temporal_summary,
    "search_nodes": search_nodes,
    "store_stats": lambda s, d: store.stats(_facts(s, d)),
    "leaderboards": lambda s, d: store.leaderboards(_facts(s, d), table(s, d, "user_stats")),
    "leaderboard": lambda s, d: store.leaderboard(_facts(s, d), table(s, d, "user_stats")),
    "contributors": lambda s, d: store.contributors(_facts(s, d)).select("instance", "node", F.array_join("creators", "|").alias("creators"), F.array_join("correctors", "|").alias("correctors")),
    "degree_centrality": lambda s, d: store.degrees(store.edges(_facts(s, d))),
    "fact_consensus": lambda s, d: store.consensus(_facts(s, d)),
    "correction_history": lambda s, d: store.corrections(_facts(s, d)),
}

_E = "e as (select distinct instance, subject, relation, object from facts where instance is not null and subject is not null and relation is not null and object is not null)"
_RANK = "case confidence when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 2 end"
_ANY = lambda words, shape: shape.format("|".join(words))
_IN = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _normalize_sql(text: str) -> str:
    s = f"trim(lower({text}))"
    for w in T.REMOVED:
        s = f"regexp_replace({s}, '\\b{w}\\b\\s*', '', 'g')"
    s = f"regexp_replace({s}, '^so ', '')"
    return f"trim(replace(replace({s}, 'ocean water', 'ocean_water'), 'water ocean', 'ocean_water'))"


_NAMES_SQL = f"""with n as (select subject as name from facts where subject is not null union select object from facts where object is not null),
w as (select name, trim(lower(name)) as low, list_filter(string_split_regex(replace(trim(lower(name)), '_', ' '), '\\s+'), lambda x: x <> '') as words, string_split_regex(replace(name, '_', ' '), '\\s+') as plain from n)
select name,
  not (length(name) < 2 or length(name) > 50 or regexp_matches(name, '[.,]') or len(words) > 4 or (len(words) > 1 and len(list_distinct(words)) < len(words))
    or regexp_matches(low, '{_ANY(T.BAD_STARTS, "^(?:{})_")}') or regexp_matches(low, '{_ANY(T.BAD_ENDS, "_(?:{})$")}') or low in {_IN(T.PRONOUNS)}
    or regexp_matches(low, '{_ANY(T.INNER_VERBS, "_(?:{})_")}') or coalesce(words[1] in {_IN(T.FIRST_WORDS)}, false) or coalesce(words[-1] in {_IN(T.LAST_WORDS)}, false)
    or (len(words) = 1 and words[1] in {_IN(T.SINGLE_WORDS)}) or (len(words) >= 2 and list_has_any(words, {list(T.COMPOUND_VERBS)}))) as valid,
  len(plain) <= 5 and len(list_distinct(plain)) = len(plain) and length(name) <= 50 and not regexp_matches(name, '[.,]')
    and not (contains(name, 'group') and length(name) - length(replace(name, '_', '')) > 2) as discoverable
from w"""
SQL = {
    "adjacency": f"with {_E} select instance, subject, relation, string_agg(object, '|' order by object) as objects from e group by 1, 2, 3",
    "point_lookup": f"with {_E} select subject, object from e where relation = 'part_of' and instance = 'tidewell'",
    "lookup_with_properties": "select distinct instance, subject, object, context, coalesce(confidence, 'medium') as confidence, temporal, scope, array_to_string(conditions, '; ') as conditions from facts where relation = 'mends'",
    "temporal_views": """select distinct v as "view", instance, subject, relation, object from facts, (values ('currently'), ('past'), ('sometimes'), ('future')) q(v)
where temporal = 'always' or temporal = v or (v = 'sometimes' and temporal = 'currently')""",
    "variant_lookup": f"""with {_E},
asked(id, subject, relation) as (values {", ".join(map(str, ASKED))}),
forms as (select distinct relation, unnest([relation, base_verb, past, present_s, present_p]) as form from relation_defs),
tried as (
  select id, relation, subject, 0 as srank from asked union all select id, relation, regexp_replace(subject, 's$', ''), 1 from asked
  union all select id, relation, subject || 's', 2 from asked union all select id, relation, regexp_replace(subject, '^(the|a|an)_', ''), 3 from asked),
spelled as (
  select t.id, t.subject, f.relation, min(t.srank) as srank, case when t.relation = f.relation then 0 else 1 end as rrank
  from tried t join forms f on f.form = t.relation group by t.id, t.subject, f.relation, t.relation),
hits as (select s.id, e.*, dense_rank() over (partition by s.id order by s.rrank, s.srank, e.subject, e.relation) as place from e join spelled s on s.subject = e.subject and s.relation = e.relation)
select id, instance, subject, relation, object from hits where place = 1""",
    "reverse_lookup": f"with {_E} select instance, relation, object, count(*) as subjects, min(subject) as \"first\" from e group by 1, 2, 3",
    "source_type_split": "select instance, source_type, count(*) as facts, count(*) filter (source_type in ('inference', 'inheritance')) as inferred from facts group by 1, 2",
    "confidence_get": f"""with b as (select instance, subject, relation, object, max({_RANK}) as k from facts group by 1, 2, 3, 4)
select instance, subject, relation, object, case k when 3 then 'high' when 2 then 'medium' else 'low' end as confidence, case k when 3 then 1.0 when 2 then 0.7 else 0.4 end::double as weight from b""",
    "dependents": """with c as (select distinct instance, subject, relation, object, unnest(premises) as p from facts)
select instance, p.subject as subject, p.relation as relation, p.object as object, count(*) as dependents from c group by 1, 2, 3, 4""",
    "cascade_retraction": f"""with recursive c as (select distinct instance, subject as s, relation as r, object as o, unnest(premises) as p from facts),
gone as (
  select distinct instance, subject as s, relation as r, object as o, 0 as step from facts where rule_id like '{RETRACTED_RULE}'
  union select c.instance, c.s, c.r, c.o, g.step + 1 from c join gone g on g.instance = c.instance and g.s = c.p.subject and g.r = c.p.relation and g.o = c.p.object where g.step < 60)
select instance, s, r, o, min(step) as step from gone group by 1, 2, 3, 4""",
    "entity_names": _NAMES_SQL,
    "staged_facts": f"""with f as (select *, coalesce(created_at >= timestamp '2025-07-15 00:00:00', false) as late, relation = 'can' and regexp_matches(object, '^be[ _].') as maybe from facts where instance is not null and subject is not null and relation is not null and object is not null),
old as (select distinct instance, subject, relation, object from f where not late),
a as (select instance, subject, case when maybe then 'can_be' else relation end as relation, case when maybe then regexp_replace(object, '^be[ _]+', '') else object end as object,
  max(case coalesce(confidence, case when len(conditions) > 0 then 'low' when source_type is null or source_type in ('user', 'clarification') then 'high' when source_type in ('inference', 'inheritance') then 'medium' else 'low' end) when 'high' then 3 when 'low' then 1 else 2 end) as k from f where late group by 1, 2, 3, 4),
names as ({_NAMES_SQL}),
o as (select a.*, case when not x.valid or not y.valid then 'invalid' when exists (select 1 from old where old.instance = a.instance and old.subject = a.subject and old.relation = a.relation and old.object = a.object) then 'repeated' else 'new' end as outcome
  from a join names x on x.name = a.subject join names y on y.name = a.object)
select instance, outcome, case k when 3 then 'high' when 2 then 'medium' else 'low' end as confidence, count(*) as facts, min(subject) as "first" from o group by 1, 2, 3""",
    "derivation_log": "select distinct instance, subject, relation, object, source_type, rule_id, coalesce(len(premises), 0)::int as depth from facts where source_type in ('inference', 'inheritance', 'rule', 'discovery')",
    "contributor_rows": """select distinct instance, node, role, person from (select instance, subject as node, 'creator' as role, lower(trim(speaker_id)) as person from facts union all select instance, subject, 'corrector', lower(trim(corrected_by)) from facts) where person <> ''""",
    "reverse_members": f"with {_E} select instance, relation, object, subject from e qualify count(*) over (partition by instance, relation, object) > 1",
    "normalize_keys": f"""with l as (select item_id, unnest(string_split_regex(regexp_replace(text, '([.?])\\s+', '\\1\x01', 'g'), '\x01')) as phrase, unnest(range(len(string_split_regex(regexp_replace(text, '([.?])\\s+', '\\1\x01', 'g'), '\x01')))) as line from eval_items),
n as (select item_id, line, list_filter(string_split_regex({_normalize_sql("phrase")}, '\\s+'), lambda x: x <> '') as words from l),
c as (select item_id, line, words, list_min(list_filter(list_transform({T.ENDING}, lambda x: list_position(words, x)), lambda p: p > 0)) as cut from n),
k as (select item_id, line, words[1:greatest(coalesce(cut - 1, len(words)), 1)] as words from c)
select item_id, cast(line as int) as line, regexp_replace(array_to_string(list_transform(words, lambda w: case
  when contains(w, '_') or w in {_IN(T.PROTECTED)} or regexp_matches(w, '(ves|ies|gs)$') or (length(w) > 3 and regexp_matches(w, '[chxsz]es$')) then w
  when length(w) > 3 and regexp_matches(w, '[^siu]s$') then w[:-2] else w end), '_'), '^_+|_+$', '', 'g') as key from k""",
    "junk_entities": f"""with {_E}, b as (select distinct reverse from relation_defs where reverse is not null),
n as (select instance, subject, count(*) as edges, bool_and(b.reverse is not null) as back from e left join b on b.reverse = e.relation group by 1, 2)
select instance, subject, edges from n where (back and edges <= 2) or (len(string_split_regex(replace(subject, '_', ' '), '\\s+')) >= 2 and edges <= 1)""",
    "known_speakers": """with t as (select distinct instance, lower(trim(speaker_id)) as speaker, true as taught from facts where speaker_id is not null),
u as (select distinct instance, lower(trim(user_name)) as speaker, true as known from user_stats)
select instance, speaker, coalesce(taught, false) as taught, coalesce(known, false) as known from t full join u using (instance, speaker)""",
    "temporal_summary": "select instance, temporal, relation, count(*) as facts, min(subject) as first_subject from (select distinct instance, subject, relation, object, temporal from facts) group by 1, 2, 3",
    "search_nodes": "select node from (select subject as node from facts union select object from facts) where contains(lower(node), 'kettle') order by length(node), node limit 8",
    "store_stats": """with n as (select instance, count(*) as nodes from (select instance, subject as x from facts where subject is not null union select instance, object from facts where object is not null) group by 1),
r as (select instance, subject, relation, object, max(coalesce(source_type in ('inference', 'inheritance', 'rule', 'discovery'), false)::int) as d from facts group by 1, 2, 3, 4),
f as (select instance, count(*) as facts, coalesce(sum(d), 0)::bigint as inferred from r group by 1),
w as (select instance, count(distinct lower(trim(speaker_id))) as speakers from facts where speaker_id is not null and trim(speaker_id) <> '' group by 1)
select f.instance, nodes, facts, inferred, coalesce(speakers, 0) as speakers from f left join n using (instance) left join w using (instance)""",
    "leaderboards": """with t as (select lower(trim(speaker_id)) as speaker, 'taught' as board, count(*) as value from facts where speaker_id is not null and trim(speaker_id) <> '' group by 1
union all select lower(trim(corrected_by)), 'corrected', count(*) from facts where corrected_by is not null and trim(corrected_by) <> '' group by 1
union all select lower(trim(user_name)), 'messages', coalesce(sum(message_count), 0)::bigint from user_stats where user_name is not null and trim(user_name) <> '' group by 1)
select board, row_number() over (partition by board order by value desc, speaker)::int as place, speaker, value from t where value > 0 qualify place <= 20""",
    "leaderboard": """with t as (select lower(trim(speaker_id)) as speaker, count(*) as taught from facts where speaker_id is not null and trim(speaker_id) <> '' group by 1),
c as (select lower(trim(corrected_by)) as speaker, count(*) as corrected from facts where corrected_by is not null and trim(corrected_by) <> '' group by 1),
m as (select lower(trim(user_name)) as speaker, coalesce(sum(message_count), 0)::bigint as messages from user_stats where user_name is not null and trim(user_name) <> '' group by 1)
select speaker, coalesce(taught, 0) as taught, coalesce(corrected, 0) as corrected, coalesce(messages, 0) as messages
from t full join c using (speaker) full join m using (speaker) order by 2 desc, 3 desc, 4 desc, 1 limit 20""",
    "contributors": """select instance, subject as node, coalesce(string_agg(distinct nullif(lower(trim(speaker_id)), ''), '|' order by nullif(lower(trim(speaker_id)), '')), '') as creators,
  coalesce(string_agg(distinct nullif(lower(trim(corrected_by)), ''), '|' order by nullif(lower(trim(corrected_by)), '')), '') as correctors from facts group by 1, 2""",
    "degree_centrality": f"""with {_E}, b as (select instance, subject as node, 1 as o, 0 as i, relation from e union all select instance, object, 0, 1, null from e)
select instance, node, sum(o)::bigint as out_degree, sum(i)::bigint as in_degree, count(distinct relation) as relations from b group by 1, 2""",
    "fact_consensus": f"""with b as (select instance, subject, relation, object, count(*) as n, count(distinct nullif(lower(trim(speaker_id)), '')) as speakers, max({_RANK}) as k from facts group by 1, 2, 3, 4)
select instance, subject, relation, object, n - 1 as agreement_count, speakers, case least(k + n - 1, 3) when 3 then 'high' when 2 then 'medium' else 'low' end as confidence from b""",
    "correction_history": """with h as (select instance, subject, relation, object, unnest(correction_history) as x from facts)
select instance, subject, relation, object, lower(trim(x.corrected_by)) as by, x.original_value as was from h
union select instance, subject, relation, object, lower(trim(corrected_by)), original_value from facts where corrected_by is not null""",
}
