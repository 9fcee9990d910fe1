"""Queries of statement reading, clauses, openers, salience, upserts and name resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelgraph.operators import language, statements, store
from kestrelgraph.runtime import table


def _prose(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("text is not null")


def resolved_names(s: SparkSession, d: str) -> DataFrame:
    """The entity that a bare last word means in each instance: the shortest name that ends with it."""
    e = store.edges(table(s, d, "facts"))
    names = e.select("instance", F.col("subject").alias("name")).where("contains(subject, '_')").distinct()
    word = F.element_at(F.split("name", "_"), -1)
    return names.groupBy("instance", word.alias("word")).agg(F.min_by("name", F.struct(F.length("name"), F.col("name"))).alias("entity"), F.count("*").alias("candidates"))


def session_state(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "turns").select("session_id", "id", "model", "cwd")
    return statements.last_wins(rows, ["session_id"], "id")


QUERIES = {
    "statement_patterns": lambda s, d: statements.read(_prose(s, d), "doc_id", "text"),
    "clauses": lambda s, d: statements.clauses(table(s, d, "eval_items"), "item_id", "text"),
    "style_openers": lambda s, d: statements.openers(_prose(s, d), "lang", "text"),
    "salience": lambda s, d: statements.salience(language.dialogue(_prose(s, d), "doc_id", "text"), "doc_id"),
    "session_state": session_state,
    "resolved_names": resolved_names,
}

_DIALOGUE = r"""l as (select doc_id, unnest(string_split_regex(text, '\r?\n')) as line, unnest(range(len(string_split_regex(text, '\r?\n'))))::int as turn from documents where text is not null),
t as (select doc_id, turn, regexp_extract(line, '^(User|System|Teacher|Speaker \d+): (.+)$', 2) as said from l where regexp_matches(line, '^(User|System|Teacher|Speaker \d+): (.+)$')),
n as (select *, nullif(regexp_extract(regexp_replace(said, '^\S+', ''), '\b([A-Z][a-z]{3,})\b', 1), '') as named from t)"""
_Q = lambda p: p.replace("'", "''")
SENTENCES_SQL = rf"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '{_Q(language.ABBREVIATIONS)}', '\1\x01', 'g'), '([.!?])\s+([A-Z])', '\1\x02\2', 'g'), '\x02'), lambda x: trim(replace(x, '\x01', '.'))), lambda x: x <> '')""".replace("\\x01", "\x01").replace("\\x02", "\x02")
_FIT = lambda f: "case " + " ".join(f"when regexp_matches(t, '{_Q(p[0])}') then {f(p)}" for p in statements.PATTERNS) + " end"
_KEY = lambda x: f"regexp_replace(trim(regexp_replace({x}, '^(the|a|an) ', '')), '[ ]+', '_', 'g')"
_GROUP = lambda p, i: f"regexp_extract(t, '{_Q(p[0])}', {i})" if i else "'user'"
_FIRST = "regexp_extract(lower(c), '^([a-z]+) ', 1)"
SQL = {
    "statement_patterns": f"""with d as (select doc_id, {SENTENCES_SQL} as ss from documents where text is not null),
x as (select doc_id, unnest(ss) as s, unnest(range(len(ss)))::int as pos from d),
c as (select doc_id, pos, regexp_replace(regexp_replace(lower(trim(s)), '[.!?]+$', ''), '^(however|also|because of this|in fact|therefore),? ', '') as t from x),
f as (select doc_id, pos, t, {_FIT(lambda p: f"'{p[1]}'")} as relation, {_FIT(lambda p: _KEY(_GROUP(p, p[2])) if p[2] else "'user'")} as subject, {_FIT(lambda p: _GROUP(p, p[3]))} as o, {_FIT(lambda p: str(p[2] > 0).lower())} as named from c),
i as (select * exclude (o), unnest(list_filter(string_split_regex(o, ', and |, | and '), lambda x: trim(x) <> '')) as o from f where relation is not null)
select doc_id, pos as "at", subject, relation, {_KEY('o')} as object from i
union all select doc_id, pos, {_KEY('o')}, 'has_instance', subject from i where relation = 'is' and named and regexp_matches(t, ' (?:is|are) (?:a|an|a kind of) ')""",
    "clauses": f"""with d as (select item_id, {SENTENCES_SQL} as ss from eval_items), x as (select item_id, unnest(ss) as s, unnest(range(len(ss)))::int as pos from d),
y as (select item_id, pos, string_split(regexp_replace(s, ', ({"|".join(statements.CONNECTORS)}) ', '\x02\\1 ', 'g'), '\x02') as cs from x),
z as (select item_id, pos, unnest(cs) as c, unnest(range(len(cs)))::int as part from y)
select item_id, pos as "at", part, case when part = 0 then 'nucleus' {" ".join(f"when {_FIRST} = '{k}' then '{v}'" for k, v in statements.CONNECTORS.items())} else 'statement' end as kind, c as clause from z""",
    "discourse_links": f"""with d as (select doc_id, {SENTENCES_SQL} as ss from documents where text is not null), x as (select doc_id, ss, unnest(ss) as s, unnest(range(len(ss)))::int as pos from d),
m as (select doc_id, pos, case {" ".join(f"when regexp_matches(lower(s), '^{k}\\b') then '{language.DISCOURSE[k]}'" for k in sorted(language.DISCOURSE, key=lambda k: (-len(k), k)))} end as relation, case when pos = 0 then '' else ss[pos] end as before from x)
select doc_id, pos as "at", relation, before from m where relation is not null""",
    "sentence_links": f"""with d as (select doc_id, {SENTENCES_SQL} as ss from documents where text is not null),
n as (select doc_id, list_transform(ss, lambda s: list_distinct(regexp_extract_all(regexp_replace(s, '^\\S+', ''), '{language.NAME}', 1))) as ns from d),
p as (select ns[i] as x, ns[i - 1] as y from (select ns, unnest(range(2, len(ns) + 1)) as i from n)), q as (select unnest(x) as x, y from p), r as (select x, unnest(y) as y from q)
select least(x, y) as a, greatest(x, y) as b, count(*) as n from r where x <> y group by 1, 2""",
    "style_openers": f"""with x as (select lang, unnest({SENTENCES_SQL}) as s from documents where text is not null),
n as (select lang as "group", regexp_extract(lower(s), '^([a-z]+ [a-z]+)', 1) as opener, count(*) as uses from x group by 1, 2 having opener <> '')
select *, row_number() over (partition by "group" order by uses desc, opener)::int as place from n qualify place <= 5""",
    "salience": f"""with {_DIALOGUE}, z as (select doc_id, max(turn) as last_turn from n group by 1)
select n.doc_id, named as name, count(*) as mentions, round(greatest(0.1, 3 - 0.3 * (any_value(last_turn) - max(turn))), 6)::double as salience from n join z on z.doc_id = n.doc_id where named is not null group by 1, 2""",
    "session_state": "select session_id, id, model, cwd from turns qualify row_number() over (partition by session_id order by id desc) = 1",
    "resolved_names": r"""with e as (select distinct instance, subject as name from facts where instance is not null and relation is not null and object is not null and contains(subject, '_'))
select instance, split_part(name, '_', -1) as word, arg_min(name, (length(name), name)) as entity, count(*) as candidates from e group by 1, 2""",
}
