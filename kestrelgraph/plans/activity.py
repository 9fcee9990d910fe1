"""Queries of usage analytics, time-driven state, frames and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrelgraph.functions import text as T
from kestrelgraph.operators import frames, language, star, state, store, usage
from kestrelgraph.plans.statements import SENTENCES_SQL
from kestrelgraph.runtime import table

NOW = "2024-01-31 00:00:00"
ASKED = ["who founded valdoria?", "what is cheese made from?", "is mount velar a volcano?", "what does the river flow through?", "can penguins fly?", "what celebrates the ocean?", "where did golf originate?", "tell me more"]


def _turns(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "turns")


def _text_cast(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in columns})


def dedup_last(s: SparkSession, d: str) -> DataFrame:
    """The last row of each message within its delivering file."""
    w = Window.partitionBy("batch_path", "message_id").orderBy(F.desc("id"))
    rows = _turns(s, d).where("message_id is not null and message_id <> ''").select("id", "batch_path", "message_id")
    return rows.withColumn("k", F.row_number().over(w)).where("k = 1").select("id", "batch_path", "message_id")


def incremental_scan(s: SparkSession, d: str) -> DataFrame:
    """Files to read again if every file delivered in August had changed since."""
    done = table(s, d, "processed_files")
    listed = _turns(s, d).select(F.col("batch_path").alias("path")).distinct().join(done.select("path", "mtime"), "path", "left")
    listed = listed.select("path", F.when(F.contains("path", F.lit("/2025-08-")), F.col("mtime") + 60).otherwise(F.col("mtime")).alias("mtime"))
    return usage.pending_files(listed, done)


def json_props(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return e.groupBy("event_type", F.from_json("props", "k int").k.alias("k")).agg(F.count("*").alias("n"))


def _events(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events")


def activation_decay(s: SparkSession, d: str) -> DataFrame:
    """Each user's activation a number of hours after their last event, one tick an hour, and an edge's weight after as many."""
    last = _events(s, d).groupBy("user_id").agg(F.max("ts").alias("at"))
    ticks = F.floor((F.unix_micros(F.lit(NOW).cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))) / 3.6e9)
    return last.select("user_id", ticks.alias("ticks"), F.round(state.decayed(F.lit(1.0), ticks), 6).alias("level"), F.round(state.weakened(F.lit(1.0), ticks), 6).alias("weight"))


def staleness(s: SparkSession, d: str) -> DataFrame:
    last = _events(s, d).groupBy(F.concat_ws("/", "user_id", "event_type").alias("entity")).agg(F.max(F.col("ts").cast("timestamp")).alias("at"), F.count("*").alias("accesses"))
    level = F.when(F.col("accesses") >= 20, "high").when(F.col("accesses") >= 5, "medium").otherwise("low")
    return state.staleness(last.withColumn("level", level), F.lit(NOW).cast("timestamp"))


def bursts(s: SparkSession, d: str) -> DataFrame:
    e = _events(s, d).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return state.bursts(e, "user_id", "ts", 6 * 3600).groupBy("entity").agg(F.count("*").alias("bursts"), F.max("events").alias("longest"), F.sum("events").alias("events"))


def hebbian_weights(s: SparkSession, d: str) -> DataFrame:
    """The edges from each user to the event types, as often as they were used; users are what instances are elsewhere."""
    return state.edge_weights(_events(s, d), "user_id", "event_type", "event_id")


def question_queue(s: SparkSession, d: str) -> DataFrame:
    """Questions that the review facts raise, by priority: contradicted items and facts of low confidence."""
    f = table(s, d, "facts").where("context = 'review'")
    items = f.groupBy("instance", "subject", "relation").agg(F.count_distinct("object").alias("values"), F.count_distinct("speaker_id").alias("relations"), F.min(F.when(F.col("confidence") == "low", 0).otherwise(1)).alias("sure"))
    kind = F.when(F.col("values") > 1, "contradiction").when(F.col("sure") == 0, "low_confidence")
    asked = items.withColumn("kind", kind).where("kind is not null")
    return asked.select("instance", "subject", "relation", "kind", F.round(state.priority(F.col("kind"), F.col("relations"), F.lit(0)), 6).alias("priority")).orderBy(F.desc("priority"), "instance", "subject", "relation").limit(20)


def question_limits(s: SparkSession, d: str) -> DataFrame:
    """The three best-supported contradicted items of each instance and relation."""
    f = table(s, d, "facts").where("context = 'review'")
    items = f.groupBy("instance", "relation", "subject").agg(F.count_distinct("object").alias("values"), F.count("*").alias("n")).where("values > 1")
    w = Window.partitionBy("instance", "relation").orderBy(F.desc("n"), "subject")
    return items.withColumn("place", F.row_number().over(w)).where("place <= 3")


def _frames(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Frames of part names; their categories are the types that parts of a name come in, and what the name is by its first word."""
    parts = table(s, d, "part").select(star.low("p_name").alias("name"), star.low("p_type").alias("type"), star.low("p_brand").alias("brand"), "p_size")
    words = F.split("name", "_")
    slot = F.when(words[0].isin(star.SIZES), "size").when(words[0].isin(star.COLORS), "color").otherwise("has_property")
    sure = F.when(F.col("p_size") > 10, "high").otherwise("low")
    facts = F.array(F.struct(slot.alias("r"), words[0].alias("o"), sure.alias("c")), F.struct(F.lit("has").alias("r"), words[1].alias("o"), F.lit("high").alias("c")), F.struct(F.lit("can").alias("r"), F.concat(F.lit("be_"), "brand").alias("o"), F.lit("high").alias("c")))
    rows = parts.select(F.col("name").alias("s"), F.explode(facts).alias("f")).select("s", "f.r", "f.o", F.col("f.c").alias("confidence"))
    wide = parts.select(F.explode(F.array("type", F.concat(words[0], F.lit("_things")))).alias("category"), F.col("name").alias("member")).distinct()
    return frames.slots(rows), wide


def frame_write_back(s: SparkSession, d: str) -> DataFrame:
    """Similar nations, as facts: by the segments of their customers with whether these are in debt, and by their region."""
    home = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    debt = F.when(F.col("c_acctbal") < 0, "has_property").otherwise("has")
    facts = home.select(star.low("n_name").alias("s"), debt.alias("r"), star.low("c_mktsegment").alias("o"), F.lit("high").alias("confidence")).distinct()
    regions = home.select(F.concat(F.lit("region_"), "n_regionkey").alias("category"), star.low("n_name").alias("member")).distinct()
    return frames.written_back(frames.similarity(frames.slots(facts), regions), facts)


def graph_payload(s: SparkSession, d: str) -> DataFrame:
    """The nodes of the graph view as JSON: label, kind, degree."""
    n = store.degrees(store.edges(table(s, d, "facts")))
    kind = F.when(F.col("out_degree") == 0, "leaf").when(F.col("in_degree") == 0, "root").otherwise("inner")
    return n.select("instance", "node", F.to_json(F.struct(F.initcap(T.pretty(F.col("node"))).alias("label"), kind.alias("kind"), (F.col("out_degree") + F.col("in_degree")).alias("degree"))).alias("payload"))


def classified(s: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(s, d, "documents").select("doc_id", T.context_of(t).alias("context"), T.temporal_of(t).alias("temporal"), T.scope_of(t).alias("scope")).where("text is not null")


def parsed_questions(s: SparkSession, d: str) -> DataFrame:
    asked = s.createDataFrame([(i, q) for i, q in enumerate(ASKED)], "id int, text string")
    items = table(s, d, "eval_items").select(F.col("item_id").cast("int").alias("id"), F.regexp_replace(F.element_at(F.split("text", "\n"), -1), "^Question: ", "").alias("text"))
    return asked.unionByName(items).select("id", language.question(F.col("text")).alias("q")).where("q is not null").select("id", "q.*")


def text_to_facts(s: SparkSession, d: str) -> DataFrame:
    defs = table(s, d, "relation_defs").select("relation", F.explode(F.array("relation", "base_verb", "past", "present_s")).alias("form")).where("form is not null")
    return language.statements(table(s, d, "documents").where("text is not null"), "doc_id", "text", defs)


def event_windows(s: SparkSession, d: str) -> DataFrame:
    e = _events(s, d).groupBy(F.window("ts", "1 day", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", "total")


def formatted(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "facts").groupBy("instance", "relation").agg(F.slice(F.array_sort(F.collect_set("context")), 1, 5).alias("contexts"), F.count("*").alias("n"))
    return f.select("instance", "relation", T.listed(F.col("contexts")).alias("contexts"), T.slug(F.concat_ws(" & ", "instance", "relation")).alias("slug"), T.compact(F.col("n") * 1000).alias("compact"))


QUERIES = {
    "usage_sessions": lambda s, d: _text_cast(usage.by_session(_turns(s, d)), "first_timestamp", "last_timestamp"),
    "usage_by_model": lambda s, d: usage.by_model(_turns(s, d)),
    "usage_daily": lambda s, d: _text_cast(usage.by_day(_turns(s, d)), "day"),
    "usage_daily_avg": lambda s, d: usage.day_average(_turns(s, d)),
    "usage_projects": lambda s, d: usage.by_project(_turns(s, d), table(s, d, "sessions")),
    "usage_top_projects": lambda s, d: usage.by_project(_turns(s, d), table(s, d, "sessions"), 5),
    "usage_recomputed": lambda s, d: usage.recomputed(table(s, d, "sessions"), _turns(s, d)),
    "usage_durations": lambda s, d: usage.durations(table(s, d, "sessions")),
    "usage_calendar": lambda s, d: _text_cast(usage.calendar(_turns(s, d)), "day"),
    "usage_dedup_last": dedup_last,
    "incremental_scan": incremental_scan,
    "json_props": json_props,
    "activation_decay": activation_decay,
    "access_core": lambda s, d: state.access(_events(s, d), "user_id"),
    "staleness_demotion": staleness,
    "priming_bursts": bursts,
    "hebbian_weights": hebbian_weights,
    "question_queue": question_queue,
    "question_limits": question_limits,
    "frame_slots": lambda s, d: _frames(s, d)[0],
    "frame_similarity": lambda s, d: frames.similarity(_frames(s, d)[0]),
    "frame_category_similarity": lambda s, d: frames.similarity(*_frames(s, d)),
    "frame_write_back": frame_write_back,
    "frame_text": lambda s, d: frames.described(_frames(s, d)[0]),
    "attribute_bridges": lambda s, d: frames.bridges(_frames(s, d)[0]),
    "prototypes": lambda s, d: frames.prototypes(*reversed(_frames(s, d))),
    "clusters": lambda s, d: frames.clusters(_frames(s, d)[1]),
    "frame_propagation": lambda s, d: frames.propagation(frames.similarity(_frames(s, d)[0]), _frames(s, d)[1]),
    "graph_payload": graph_payload,
    "doc_themes": lambda s, d: language.themes(table(s, d, "documents"), "doc_id", "text"),
    "discourse_links": lambda s, d: language.discourse(table(s, d, "documents").where("text is not null"), "doc_id", "text"),
    "statement_classes": classified,
    "parse_question": parsed_questions,
    "text_to_facts": text_to_facts,
    "event_windows": event_windows,
    "formatted_labels": formatted,
}

_SUM = 'coalesce(sum(input_tokens), 0)::bigint as "input", coalesce(sum(output_tokens), 0)::bigint as "output", coalesce(sum(cache_read_tokens), 0)::bigint as cache_read, coalesce(sum(cache_creation_tokens), 0)::bigint as cache_creation'
_PATH = "list_filter(string_split(replace(cwd, '\\', '/'), '/'), lambda x: x <> '')"
_PROJECT = f"case when cwd is null or len({_PATH}) < 1 then 'unknown' else array_to_string({_PATH}[-2:], '/') end"
_BY_PROJECT = f"""select coalesce(s.project_name, 'unknown') as project, {_SUM}, count(*) as turns, count(distinct t.session_id) as sessions from turns t left join sessions s on s.session_id = t.session_id group by 1"""
_TICKS = f"floor((epoch_us(timestamp '{NOW}') - epoch_us(last_at)) / 3.6e9)::bigint"
_FRAMES = """p as (select lower(replace(trim(p_name), ' ', '_')) as name, lower(replace(trim(p_type), ' ', '_')) as type, lower(replace(trim(p_brand), ' ', '_')) as brand, p_size from part),
f as (
  select name as concept, case when split_part(name, '_', 1) in ('small', 'large') then 'size' when split_part(name, '_', 1) in ('red', 'blue', 'green') then 'color' else 'traits' end as attribute, split_part(name, '_', 1) as value, p_size > 10 as sure from p
  union all select name, 'body_parts', split_part(name, '_', 2), true from p union all select name, 'traits', brand, false from p),
slots as (select concept, attribute, value, bool_or(sure) as confirmed from f group by 1, 2, 3),
members as (select type as category, name as member from p union select split_part(name, '_', 1) || '_things', name from p)"""
_SHARED = """shared as (select x.concept as a, y.concept as b, attribute, count(*) as k, count(*) filter (x.confirmed and y.confirmed) as cc, count(*) filter (not x.confirmed and not y.confirmed) as pp, count(*) filter (x.confirmed <> y.confirmed) as cp
  from slots x join slots y using (attribute, value) where x.concept < y.concept group by 1, 2, 3)"""
_SIMILAR = f"""{_SHARED}, sizes as (select concept, attribute, count(*) as n from slots group by 1, 2),
similar_ as (select p.a, p.b, round((sum(coalesce(s.cc + 0.5 * s.pp + 0.3 * s.cp, 0))::double / sum(x.n + y.n - coalesce(s.k, 0))), 6) as similarity
  from (select distinct a, b from shared) p join sizes x on x.concept = p.a join sizes y on y.concept = p.b and y.attribute = x.attribute left join shared s on s.a = p.a and s.b = p.b and s.attribute = x.attribute group by 1, 2)"""
_BLENDED = """c as (select member, count(*) as n from members group by 1), k as (select x.member as a, y.member as b, count(*) as k from members x join members y using (category) group by 1, 2),
blended as (select s.a, s.b, round(0.7 * s.x + 0.3 * coalesce(k, 0) / (x.n + y.n - coalesce(k, 0)), 6) as similarity from (
  select p.a, p.b, sum(coalesce(s.cc + 0.5 * s.pp + 0.3 * s.cp, 0))::double / sum(x.n + y.n - coalesce(s.k, 0)) as x
  from (select distinct a, b from shared) p join sizes x on x.concept = p.a join sizes y on y.concept = p.b and y.attribute = x.attribute left join shared s on s.a = p.a and s.b = p.b and s.attribute = x.attribute group by 1, 2) s
  join c x on x.member = s.a join c y on y.member = s.b left join k on k.a = s.a and k.b = s.b)"""
_CLASS = lambda families, default: "case " + " ".join(f"when regexp_matches(lower(text), '{p}') then '{n}'" for n, p in families) + f" else '{default}' end"
_T = "t as (select id, regexp_replace(trim(lower(text)), '[?.]+$', '') as t from q)"
_SHAPE = lambda f: "case " + " ".join(f"when regexp_matches(t, '{x[0]}') then {f(x)}" for x in language.SHAPES) + " end"
_PART = lambda x, g: f"regexp_extract(t, '{x[0]}', {g})" if g else "null"
_RELATION = lambda x: x[3] if x[3][0] == "'" else f"{_PART(x, 2)} || '_' || {_PART(x, 3)}" if x[3] == "23" else _PART(x, int(x[3]))
SQL = {
    "hebbian_weights": """with recursive e as (select user_id, event_type as edge, row_number() over (partition by user_id order by event_id) as k from events), n as (select user_id, max(k) as n from e group by 1),
f as (select user_id, 0::bigint as k, []::struct(edge varchar, w double, n bigint)[] as st from n union all
  select f.user_id, f.k + 1, list_append(list_filter(st, lambda x: x.edge <> e.edge), {'edge': e.edge, 'w': least(5.0, c.w + 0.2 * case when c.w > 0.8 * coalesce(list_avg(list_transform(st, lambda x: x.w)), 1.0) then 0.5 else 1.5 end), 'n': c.n + 1})
  from f join e on e.user_id = f.user_id and e.k = f.k + 1, lateral (select coalesce(list_filter(st, lambda x: x.edge = e.edge)[1], {'edge': e.edge, 'w': 1.0::double, 'n': 0::bigint}) as c))
select f.user_id as "group", x.edge, round(x.w, 6) as weight, x.n as uses from (select f.user_id, unnest(st) as x from f join n on n.user_id = f.user_id and n.n = f.k) f""",
    "graph_payload": """with e as (select distinct instance, subject, relation, object from facts where instance is not null and subject is not null and relation is not null and object is not null),
n as (select instance, node, sum(o)::bigint as o, sum(i)::bigint as i from (select instance, subject as node, 1 as o, 0 as i from e union all select instance, object, 0, 1 from e) group by 1, 2)
select instance, node, '{"label":"' || array_to_string(list_transform(string_split(replace(node, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || '","kind":"' || case when o = 0 then 'leaf' when i = 0 then 'root' else 'inner' end || '","degree":' || (o + i) || '}' as payload from n""",
    "parse_question": f"""with q as (select * from (values {", ".join(f"({i}, '{q}')" for i, q in enumerate(ASKED))}) v(id, text) union all select item_id::int, regexp_replace(string_split(text, chr(10))[-1], '^Question: ', '') from eval_items), {_T}
select id, {_SHAPE(lambda x: f"'{x[1]}'")} as kind, {_SHAPE(lambda x: _PART(x, x[2]))} as subject, {_SHAPE(_RELATION)} as relation, {_SHAPE(lambda x: _PART(x, x[4]))} as object, {_SHAPE(lambda x: f"'{x[5]}'")} as direction from t where {_SHAPE(lambda x: "true")}""",
    "text_to_facts": f"""with d as (select doc_id, {SENTENCES_SQL} as ss from documents where text is not null), x as (select doc_id, unnest(range(len(ss)))::int as pos, unnest(ss) as s from d),
w as (select doc_id, pos, string_split_regex(regexp_replace(lower(s), '[^a-z0-9 _-]+', '', 'g'), '\\s+') as w from x),
v as (select form, min(relation) as relation from (select relation, unnest([relation, base_verb, past, present_s]) as form from relation_defs) where form is not null and not contains(form, ' ') group by 1),
t as (select doc_id, pos, w, unnest(w) as form, unnest(range(len(w))) as i from w),
h as (select doc_id, pos, w, i, relation from t join v using (form) where i > 0 and i < len(w) - 1 qualify row_number() over (partition by doc_id, pos order by i) = 1),
f as (select doc_id, pos, relation, w[:i] as before, w[i + 2:] as after from h)
select * from (select doc_id, pos as "at", array_to_string(list_filter(before, lambda y: y not in ('the', 'a', 'an', 'does', 'do', 'did', 'not', 'never')), '_') as subject, relation,
  array_to_string(list_filter(after, lambda y: y not in ('the', 'a', 'an')), '_') as object, list_has_any(before, ['not', 'never']) as negated from f) where subject <> '' and object <> ''""",
    "usage_sessions": f"""select session_id, {_SUM}, count(*) as turns, strftime(min("timestamp"), '%Y-%m-%d') as first_timestamp, strftime(max("timestamp"), '%Y-%m-%d') as last_timestamp,
  arg_max(model, id) filter (model is not null) as model, arg_min({_PROJECT}, id) filter (cwd is not null) as project from turns group by 1""",
    "usage_by_model": f"select coalesce(model, 'unknown') as model, {_SUM}, count(*) as turns, count(distinct session_id) as sessions from turns group by 1",
    "usage_daily": f"select strftime(\"timestamp\", '%Y-%m-%d') as day, coalesce(model, 'unknown') as model, {_SUM}, count(*) as turns from turns where \"timestamp\" is not null group by 1, 2",
    "usage_daily_avg": f"""with x as (select cast("timestamp" as date) as day, {_SUM}, count(*) as turns from turns where "timestamp" is not null group by 1)
select count(*) as days, round(avg("input"), 6) as avg_input, round(avg("output"), 6) as avg_output, round(avg(cache_read), 6) as avg_cache_read, round(avg(cache_creation), 6) as avg_cache_creation, round(avg(turns), 6) as avg_turns from x""",
    "usage_projects": _BY_PROJECT,
    "usage_top_projects": f'select * from ({_BY_PROJECT}) order by "input" + "output" desc, project limit 5',
    "usage_recomputed": f"""with t as (select session_id, {_SUM}, count(*) as turns from turns group by 1),
x as (select s.session_id, total_input_tokens as stored_input, total_output_tokens as stored_output, turn_count as stored_turns, coalesce("input", 0) as "input", coalesce("output", 0) as "output", coalesce(turns, 0) as turns from sessions s left join t on t.session_id = s.session_id)
select *, not (stored_input is not distinct from "input" and stored_output is not distinct from "output" and stored_turns is not distinct from turns) as differs from x""",
    "usage_durations": "select session_id, coalesce(round((epoch_us(last_timestamp) - epoch_us(first_timestamp)) / 6e7, 1), 0.0) as minutes from sessions",
    "usage_calendar": f"""with x as (select strftime("timestamp", '%Y-%m-%d') as day, coalesce(model, 'unknown') as model, * exclude (model) from turns where "timestamp" is not null)
select day, model, grouping(day, model)::int as level, {_SUM}, count(*) as turns from x group by cube (day, model)""",
    "usage_dedup_last": "select max(id) as id, batch_path, message_id from turns where message_id is not null and message_id <> '' group by batch_path, message_id",
    "incremental_scan": """select distinct t.batch_path as path, coalesce(lines, 0) as skip_lines from turns t left join processed_files f on f.path = t.batch_path where f.path is null or contains(t.batch_path, '/2025-08-')""",
    "json_props": "select event_type, cast(json_extract(props, '$.k') as int) as k, count(*) as n from events group by 1, 2",
    "activation_decay": f"""with l as (select user_id, max(ts) as last_at from events group by 1), t as (select user_id, {_TICKS} as ticks from l)
select user_id, ticks, case when pow(0.88, ticks) >= 0.01 then round(pow(0.88, ticks), 6) end as level, round(greatest(1.0 - 0.05 * ticks, 0.1), 6)::double as weight from t""",
    "access_core": "select user_id as entity, count(*) as accesses, floor(count(*) / 5)::bigint as reinforcements, count(*) >= 20 as core from events group by 1",
    "staleness_demotion": f"""with l as (select user_id || '/' || event_type as entity, max(ts) as last_at, count(*) as accesses from events group by 1),
x as (select entity, accesses, (epoch_us(timestamp '{NOW}') - epoch_us(last_at)) / 3.6e9 as idle, case when accesses >= 20 then 'high' when accesses >= 5 then 'medium' else 'low' end as level from l)
select entity, floor(idle)::bigint as idle_hours, case when idle >= 24 and accesses < 10 then case level when 'high' then 'medium' else 'low' end else level end as level, idle >= 24 and accesses < 10 and level <> 'low' as demoted from x""",
    "priming_bursts": """with x as (select user_id, ts, case when epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts)) <= 21600000000 then 0 else 1 end as fresh from events),
r as (select user_id, sum(fresh) over (partition by user_id order by ts) as run from x), n as (select user_id, run, count(*) as events from r group by 1, 2)
select user_id as entity, count(*) as bursts, max(events) as longest, sum(events)::bigint as events from n group by 1""",
    "question_queue": """with i as (select instance, subject, relation, count(distinct object) as v, count(distinct speaker_id) as k, bool_or(coalesce(confidence = 'low', false)) as unsure from facts where context = 'review' group by 1, 2, 3),
q as (select *, case when v > 1 then 'contradiction' when unsure then 'low_confidence' end as kind from i)
select instance, subject, relation, kind, round(case kind when 'contradiction' then 6.0 else 3.0 end + least(2.0, 0.1 * k), 6)::double as priority from q where kind is not null order by priority desc, instance, subject, relation limit 20""",
    "question_limits": """with i as (select instance, relation, subject, count(distinct object) as "values", count(*) as n from facts where context = 'review' group by 1, 2, 3 having count(distinct object) > 1)
select *, row_number() over (partition by instance, relation order by n desc, subject)::int as place from i qualify place <= 3""",
    "frame_slots": f"with {_FRAMES} select * from slots",
    "frame_similarity": f"with {_FRAMES}, {_SIMILAR} select * from similar_",
    "frame_category_similarity": f"with {_FRAMES}, {_SIMILAR}, {_BLENDED} select * from blended",
    "frame_write_back": """with h as (select distinct lower(replace(trim(n_name), ' ', '_')) as s, case when c_acctbal < 0 then 'traits' else 'body_parts' end as a, lower(replace(trim(c_mktsegment), ' ', '_')) as v, n_regionkey as k from customer join nation on c_nationkey = n_nationkey),
n as (select s, a, count(*) as n from h group by 1, 2), c as (select x.s as x, y.s as y, x.a, count(*) as k from h x join h y on x.a = y.a and x.v = y.v and x.s < y.s group by 1, 2, 3),
p as (select distinct x, y from c), t as (select p.x, p.y, sum(coalesce(c.k, 0))::double / sum(u.n + v.n - coalesce(c.k, 0)) as z from p join n u on u.s = p.x join n v on v.s = p.y and v.a = u.a left join c on c.x = p.x and c.y = p.y and c.a = u.a group by 1, 2),
r as (select distinct s, k from h), w as (select t.x, t.y from t join r a on a.s = t.x join r b on b.s = t.y where round(0.7 * z + 0.3 * case when a.k = b.k then 1 else 0 end, 6) >= 0.7)
select x as s, 'similar_to' as r, y as o, 'medium' as confidence from w union all select y, 'similar_to', x, 'medium' from w""",
    "frame_text": f"""with {_FRAMES}, x as (select concept, attribute, string_agg(value || case when confirmed then '' else '?' end, ', ' order by not confirmed, value || case when confirmed then '' else '?' end) as vs from slots group by 1, 2)
select concept, string_agg(attribute || ': ' || vs, '; ' order by attribute || ': ' || vs) as text from x group by 1""",
    "attribute_bridges": f"with {_FRAMES}, {_SHARED} select a, b, attribute, cc as confirmed, pp as potential, cp as cross_tier, round(cc + 0.5 * pp + 0.3 * cp, 6)::double as strength from shared",
    "prototypes": f"""with {_FRAMES}, z as (select category, count(*) as n from members group by 1)
select m.category, s.attribute, s.value, count(*) as holders from members m join slots s on s.concept = m.member and s.confirmed join z on z.category = m.category group by 1, 2, 3, z.n having count(*) >= 0.5 * z.n""",
    "clusters": f"with {_FRAMES} select category, count(*) as members, round(least(1.0, 0.2 * count(*)), 6)::double as confidence from members group by 1 having count(*) >= 2",
    "frame_propagation": f"""with {_FRAMES}, {_SIMILAR}, b as (select a as x, b as y, similarity from similar_ union all select b, a, similarity from similar_)
select x as concept, category, max(similarity) as similarity from b join members m on m.member = b.y where similarity >= 0.4 and not exists (select 1 from members k where k.member = b.x and k.category = m.category) group by 1, 2""",
    "doc_themes": f"""with w as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) as word, unnest(range(len(regexp_extract_all(lower(text), '[a-z]+')))) as pos from documents),
n as (select doc_id, word, count(*) as uses, min(pos) as pos from w where length(word) > 2 and word not in {tuple(language.STOP)} group by 1, 2)
select doc_id, arg_max(word, (uses, -pos)) as theme, max(uses) as uses from n group by 1""",
    "statement_classes": f"select doc_id, {_CLASS(T.CONTEXTS, 'general')} as context, {_CLASS(T.TEMPORAL, 'always')} as temporal, {_CLASS(T.SCOPES, 'universal')} as scope from documents where text is not null",
    "event_windows": """with x as (select event_type, value, unnest([0, 6, 12, 18]) as back, ts from events),
w as (select event_type, value, time_bucket(interval 6 hours, ts, timestamp '1970-01-01') - to_hours(back) as start from x)
select strftime(start, '%Y-%m-%d %H:%M') as start, event_type, count(*) as n, round(sum(value), 4) as total from w group by 1, 2""",
    "formatted_labels": """with x as (select instance, relation, list_sort(list(distinct context))[1:5] as c, count(*) * 1000 as n from facts group by 1, 2)
select instance, relation, case len(c) when 0 then '' when 1 then c[1] when 2 then c[1] || ' and ' || c[2] else array_to_string(c[:-2], ', ') || ', and ' || c[-1] end as contexts,
  regexp_replace(regexp_replace(lower(instance || ' & ' || relation), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug,
  case when n >= 1000000 then printf('%.1fM', n / 1000000) when n >= 1000 then printf('%.1fK', n / 1000) else cast(n as varchar) end as compact from x""",
}
