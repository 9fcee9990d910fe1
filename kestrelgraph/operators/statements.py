"""Plain English statements to facts by an ordered table of patterns; clauses, openers, salience and hypotheticals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrelgraph.operators import language

_N = r"((?:(?:the|a|an) )?[a-z][a-z' -]*?)"
_O = r"(?:(?:the|a|an) )?([a-z0-9][a-z0-9', -]*)"
#: Fixed values: (pattern, relation, subject group, object group) tried in order on the lower-cased sentence; group 0 as
#: subject stands for the speaker.
PATTERNS = [
    (r"^my name is ([a-z]+)$", "name", 0, 1),
    (r"^i live in (?:the )?([a-z ]+)$", "lives_in", 0, 1),
    (r"^i (?:like|love|enjoy) (?:the )?([a-z ]+)$", "likes", 0, 1),
    (r"^i(?:'m| am) (?:a |an )?([a-z ]+)$", "is", 0, 1),
    (r"^if (.+?),? then (.+)$", "causes", 1, 2),
    (rf"^{_N} (?:is|are) not {_O}$", "is_not", 1, 2),
    (rf"^{_N} (?:cannot|can not|can't) {_O}$", "cannot", 1, 2),
    (rf"^{_N} (?:does not|do not|doesn't|don't) have {_O}$", "has_not", 1, 2),
    (rf"^{_N} (?:is|are) part of {_O}$", "part_of", 1, 2),
    (rf"^{_N} (?:is|are) found in {_O}$", "found_in", 1, 2),
    (rf"^{_N} (?:is|are) made (?:of|from) {_O}$", "made_of", 1, 2),
    (rf"^{_N} (?:is|are) a kind of {_O}$", "is", 1, 2),
    (rf"^{_N} lives? (?:in|on|under|along|near|inside|above|below|behind|beside|beyond) {_O}$", "lives_in", 1, 2),
    (rf"^{_N} (?:may|might|could|can) be {_O}$", "can_be", 1, 2),
    (rf"^{_N} can {_O}$", "can", 1, 2),
    (rf"^{_N} becomes? {_O}$", "leads_to", 1, 2),
    (rf"^{_N} (?:eats?|feeds on) {_O}$", "eats", 1, 2),
    (rf"^{_N} needs? {_O}$", "needs", 1, 2),
    (rf"^{_N} causes? {_O}$", "causes", 1, 2),
    (rf"^{_N} (?:has|have) {_O}$", "has", 1, 2),
    (rf"^{_N} (?:is|are) {_O}$", "is", 1, 2),
]
#: What any sentence has that fits a pattern: its letters (an "if" may have others), and its opening or its verb.
LETTERS = r"^(?:[a-z0-9', -]+$|if )"
CUES = r"^(?:my|i|i'm|if) | (?:is|are|cannot|can|can't|do|does|don't|doesn't|lives?|may|might|could|becomes?|eats?|feeds|needs?|causes?|has|have) "
#: What joins two clauses, and what kind of clause follows.
CONNECTORS = {"because": "cause", "so": "effect", "but": "contrast", "though": "contrast", "yet": "contrast", "which": "relative", "who": "relative", "and": "addition"}
CLAUSE = r", (?=(?:" + "|".join(CONNECTORS) + r") )"
HYPOTHETICAL = r"\b(suppose|imagine|what if|hypothetically|assume)\b"


def cleaned(sentence: Column) -> Column:
    """A sentence as the patterns take it: lower case, without what opens or ends it."""
    low = F.lower(F.trim(sentence))
    return F.regexp_replace(F.regexp_replace(low, r"[.!?]+$", ""), r"^(however|also|because of this|in fact|therefore),? ", "")


def _key(name: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(name, r"^(the|a|an) ", "")), r"[ ]+", "_")


def _each(items: Column, subject: Column, relation: str) -> Column:
    return F.transform(items, lambda x: F.struct(subject.alias("subject"), F.lit(relation).alias("relation"), _key(x).alias("object")))


def _instances(items: Column, subject: Column) -> Column:
    return F.transform(items, lambda x: F.struct(_key(x).alias("subject"), F.lit("has_instance").alias("relation"), subject.alias("object")))


def facts_of(sentence: Column) -> Column:
    """array<struct<subject, relation, object>>: the fact of the first pattern that fits, one for each listed object.

    "A is a B" also gives (B, has_instance, A); "a, b and c" in the object gives a fact each. No fit gives an empty array.
    """
    return _facts(cleaned(sentence))


def _facts(t: Column) -> Column:
    empty = F.array().cast("array<struct<subject:string,relation:string,object:string>>")
    branches = []
    for pattern, relation, s, o in PATTERNS:
        subject = _key(F.regexp_extract(t, pattern, s)) if s else F.lit("user")
        items = F.filter(F.split(F.regexp_extract(t, pattern, o), r", and |, | and "), lambda x: F.trim(x) != "")
        facts = _each(items, subject, relation)
        if relation == "is" and s:
            member = F.rlike(t, F.lit(r" (?:is|are) (?:a|an|a kind of) "))
            facts = F.when(member, F.concat(facts, _instances(items, subject))).otherwise(facts)
        branches.append(F.when(F.rlike(t, F.lit(pattern)), facts))
    return F.coalesce(*branches, empty)


def read(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, at, subject, relation, object): the facts of all sentences of the texts."""
    rows = texts.select(F.col(key).alias(key), F.posexplode(F.transform(language.sentences(F.col(text)), cleaned)).alias("at", "t"))
    rows = rows.where(F.rlike("t", F.lit(LETTERS)) & F.rlike("t", F.lit(CUES)))
    # the outer form, as for the plain one all patterns would be tried twice: once in a filter that Spark adds
    return rows.select(key, "at", F.explode_outer(_facts(F.col("t"))).alias("f")).where("f is not null").select(key, "at", "f.*")


def clauses(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, at, part, kind, clause): sentences split before a comma and a connector, with what the connector says."""
    rows = texts.select(F.col(key).alias(key), F.posexplode(language.sentences(F.col(text))).alias("at", "s"))
    parts = rows.select(key, "at", F.posexplode(F.split("s", CLAUSE)).alias("part", "clause"))
    first = F.regexp_extract(F.lower("clause"), r"^([a-z]+) ", 1)
    kind = F.coalesce(*[F.when(first == c, k) for c, k in CONNECTORS.items()], F.lit("statement"))
    return parts.select(key, "at", "part", F.when(F.col("part") == 0, "nucleus").otherwise(kind).alias("kind"), "clause")


def openers(texts: DataFrame, group: str, text: str, top: int = 5) -> DataFrame:
    """(group, opener, uses, place): the commonest first two words of sentences in each group."""
    s = texts.select(F.col(group).alias("group"), F.explode(language.sentences(F.col(text))).alias("s"))
    n = s.select("group", F.regexp_extract(F.lower("s"), r"^([a-z]+ [a-z]+)", 1).alias("opener")).where("opener <> ''").groupBy("group", "opener").agg(F.count("*").alias("uses"))
    w = Window.partitionBy("group").orderBy(F.desc("uses"), "opener")
    return n.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def salience(turns: DataFrame, key: str) -> DataFrame:
    """(key, name, mentions, salience): how present each name still is at a dialogue's end: 3, less 0.3 a turn, at least 0.1."""
    ends = turns.groupBy(key).agg(F.max("turn").alias("end"))
    last = turns.where("named is not null").groupBy(key, F.col("named").alias("name")).agg(F.count("*").alias("mentions"), F.max("turn").alias("at"))
    return last.join(ends, key).select(key, "name", "mentions", F.round(F.greatest(F.lit(0.1), 3 - 0.3 * (F.col("end") - F.col("at"))), 6).alias("salience"))


def hypothetical(turns: DataFrame, key: str, said: str, lasts: int = 3) -> DataFrame:
    """turns with a last column held: whether a statement falls to a hypothetical one within the last turns."""
    w = Window.partitionBy(key).orderBy("turn").rowsBetween(-lasts, 0)
    return turns.withColumn("held", F.coalesce(F.max(F.rlike(F.lower(F.col(said)), F.lit(HYPOTHETICAL))).over(w), F.lit(False)))


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key: what an upsert leaves. One aggregation, so a hot key is combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("r"))
    return best.select(*keys, "r.*").select(*rows.columns)
