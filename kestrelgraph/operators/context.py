"""Conversations: topics, antecedents, recent statements, style and feedback; words' forms and phrasing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrelgraph.functions import text as T
from kestrelgraph.operators import language

PARENTS = ["is", "is_a", "type_of", "kind_of"]
STACK, RING = 5, 10
# How sentences open and how clauses join, in order.
OPENERS = [
    (r"^unlike\s+(\w+)", "contrast_opener"),
    (r"^most\s+(\w+)", "quantifier_most"),
    (r"^some\s+(\w+)", "quantifier_some"),
    (r"^all\s+(\w+)", "quantifier_all"),
    (r"^despite\s+(\w+)", "despite_opener"),
    (r"^although\s+(\w+)", "although_opener"),
    (r"^while\s+(\w+)", "while_opener"),
    (r"^in\s+(\w+)", "locative_opener"),
    (r"^during\s+(\w+)", "temporal_opener"),
    (r"^when\s+(\w+)", "when_opener"),
    (r"^if\s+(\w+)", "conditional_opener"),
    (r"^because\s+(\w+)", "causal_opener"),
]
CONNECTIVES = [
    (r",\s+but\s+", "contrast_but"),
    (r",\s+which\s+", "relative_which"),
    (r",\s+that\s+", "relative_that"),
    (r",\s+however,\s+", "however"),
    (r",\s+therefore,?\s+", "therefore"),
    (r",\s+so\s+that\s+", "purpose"),
    (r",\s+because\s+", "causal"),
    (r",\s+and\s+also\s+", "also"),
    (r";\s+", "semicolon"),
    (r"\s+—\s+", "em_dash"),
]
# Nouns with a plural of their own, and endings that make an adjective.
IRREGULAR = {
    "child": "children",
    "person": "people",
    "man": "men",
    "woman": "women",
    "foot": "feet",
    "tooth": "teeth",
    "mouse": "mice",
    "goose": "geese",
    "ox": "oxen",
    "fish": "fish",
    "sheep": "sheep",
    "deer": "deer",
    "species": "species",
    "series": "series",
}
ADJECTIVE_ENDINGS = ["ed", "ing", "ful", "less", "ous", "ive", "able", "ible", "al", "ic", "ary", "ory", "ant", "ent"]
#: What a preposition behind a verb makes of the relation.
PREPOSITIONS = {"on": "located_on", "at": "located_at", "with": "has", "from": "originates_from", "by": "by_agent", "for": "used_for", "of": "part_of"}
REFINING = ["only when", "only if", "except when", "except if", "but not if", "but not when", "unless", "as long as", "provided that"]


def topic_stack(turns: DataFrame, key: str, size: int = STACK) -> DataFrame:
    """(key, place, name, turn): the last names that a dialogue came to, the latest first; what its topic stack holds."""
    last = turns.where("named is not null").groupBy(key, F.col("named").alias("name")).agg(F.max("turn").alias("turn"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("turn"), "name"))
    return last.withColumn("place", place).where(F.col("place") <= size).select(key, "place", "name", "turn")


def relevance(edges: DataFrame, pairs: DataFrame, recent: DataFrame) -> DataFrame:
    """(g, a, b, score): how close topic a is to topic b: half a point for each that names the other, 0.3 for a common
    category, 0.05 for each relation both have (0.2 at most), 0.3 if a recent statement (g, s, o) joined them; 1 at most."""
    p = pairs.select("g", "a", "b").distinct()
    names = edges.select("g", "s", F.col("o").alias("named")).distinct()
    says = lambda x, y: p.join(names.withColumnRenamed("s", x), ["g", x]).where(F.contains("named", F.col(y))).select("g", "a", "b").distinct().select("g", "a", "b", F.lit(0.5).alias("k"))
    up = edges.where(F.col("r").isin(PARENTS)).select("g", "s", "o").distinct()
    both = lambda rows, v: p.join(rows.withColumnRenamed("s", "a"), ["g", "a"]).join(rows.withColumnRenamed("s", "b"), ["g", "b", v])
    parents = both(up, "o").select("g", "a", "b").distinct().select("g", "a", "b", F.lit(0.3).alias("k"))
    rel = edges.where(~F.col("r").isin("is", "is_a", "type_of")).select("g", "s", "r").distinct()
    shared = both(rel, "r").groupBy("g", "a", "b").agg(F.least(F.lit(0.2), 0.05 * F.count("*")).alias("k"))
    said = recent.select("g", F.col("s").alias("a"), F.col("o").alias("b"))
    said = said.unionByName(said.select("g", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    joined = p.join(said, ["g", "a", "b"], "left_semi").select("g", "a", "b", F.lit(0.3).alias("k"))
    parts = reduce(DataFrame.unionByName, [p.select("g", "a", "b", F.lit(0.0).alias("k")), says("a", "b"), says("b", "a"), parents, shared, joined])
    total = parts.groupBy("g", "a", "b").agg(F.sum("k").alias("k"))
    return total.select("g", "a", "b", F.round(F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.least(F.lit(1.0), F.col("k"))), 6).alias("score"))


def antecedents(turns: DataFrame, key: str, said: str) -> DataFrame:
    """(key, turn, pronoun, antecedent): whom the first pronoun of a turn means among the names before it.

    A name counts 3, less 0.3 a turn since it was last said, and 1 more if its number is the pronoun's. Only the last
    name of either number can win, so the turns before are never gathered.
    """
    pronoun = F.regexp_extract(F.lower(F.col(said)), r"\b(he|she|it|they|them|him|her)\b", 1)
    many = F.endswith("named", F.lit("s"))
    before = Window.partitionBy(key).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda test: F.last(F.when(F.col("named").isNotNull() & test, F.struct("turn", "named")), True).over(before)
    rows = turns.select(key, "turn", pronoun.alias("pronoun"), last(many).alias("p"), last(~many).alias("s")).where("pronoun <> ''")
    plural = F.col("pronoun").isin("they", "them")
    score = lambda c, fits: F.when(F.col(c).isNotNull(), F.struct((3 - 0.3 * (F.col("turn") - F.col(f"{c}.turn")) + fits.cast("int")).alias("k"), F.col(f"{c}.named").alias("n")))
    best = F.greatest(score("p", plural), score("s", ~plural))
    return rows.select(key, "turn", "pronoun", best["n"].alias("antecedent")).where("antecedent is not null")


def recent_statements(turns: DataFrame, key: str, ring: int = RING, most: int = 3) -> DataFrame:
    """(key, place, turn): the newest statements of a dialogue's last ones that name what it last named."""
    ends = turns.groupBy(key).agg(F.max("turn").alias("end"), F.max_by("named", F.when(F.col("named").isNotNull(), F.col("turn"))).alias("topic"))
    held = turns.select(key, "turn", "named").withColumn("back", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("turn")))).where(F.col("back") <= ring)
    about = held.join(ends, key).where("named = topic")
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("turn")))
    return about.withColumn("place", place).where(F.col("place") <= most).select(key, "place", "turn", "topic")


def context_pool(turns: DataFrame, key: str, at: str, now: Column, hours: float = 2) -> DataFrame:
    """(key, turns, last, evicted): each conversation's snapshot, and whether it has been idle too long to be kept."""
    n = turns.where(F.col(at).isNotNull()).groupBy(key).agg(F.count("*").alias("turns"), F.max(F.col(at).cast("timestamp")).alias("last"))
    return n.select(key, "turns", "last", (F.unix_micros(now) - F.unix_micros("last") > F.lit(int(hours * 3.6e9))).alias("evicted"))


def markers(sentence: Column) -> Column:
    """array<struct<kind, value>>: the first opener of a sentence that fits, and the first connective."""
    low = F.lower(F.trim(sentence))
    first = lambda table: F.coalesce(*[F.when(F.rlike(low, F.lit(p)), F.lit(k)) for p, k in table])
    pair = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    return F.filter(F.array(pair("opener", first(OPENERS)), pair("connective", first(CONNECTIVES))), lambda x: x["value"].isNotNull())


def style_scores(texts: DataFrame, text: str, rating: Column) -> DataFrame:
    """(kind, value, uses, likes, dislikes, score, balance): style patterns over all sentences, with the ratings
    (like, dislike or null) of the texts they are in: score is uses plus 2 a like minus 1 a dislike, balance their share."""
    rows = texts.select(rating.alias("rating"), F.explode(language.sentences(F.col(text))).alias("s")).select("rating", F.explode(markers(F.col("s"))).alias("m"))
    n = rows.groupBy("m.kind", "m.value").agg(F.count("*").alias("uses"), F.count_if(F.col("rating") == "like").alias("likes"), F.count_if(F.col("rating") == "dislike").alias("dislikes"))
    score, balance = F.col("uses") + 2 * F.col("likes") - F.col("dislikes"), F.try_divide(F.col("likes") - F.col("dislikes"), F.col("likes") + F.col("dislikes"))
    return n.select("*", score.alias("score"), F.round(F.coalesce(balance, F.lit(0.0)), 6).alias("balance"))


def template(sentence: Column, subject: Column, obj: Column) -> Column:
    """A sentence with its subject and object as slots, if both occur, it has 4 to 25 words and no figure; else null."""
    n = F.size(F.split(F.trim(sentence), r"\s+"))
    good = F.contains(sentence, subject) & F.contains(sentence, obj) & n.between(4, 25) & ~F.rlike(sentence, F.lit(r"\d")) & (subject != obj)
    return F.when(good, F.replace(F.replace(sentence, subject, F.lit("{subject}")), obj, F.lit("{object}")))


def plural(word: Column) -> Column:
    """The plural of a noun, by its ending; a word that looks plural stays."""
    w = F.lower(F.trim(word))
    own = F.coalesce(*[F.when(w == k, v) for k, v in IRREGULAR.items()])
    end = lambda *xs: reduce(lambda a, b: a | b, [F.endswith(w, F.lit(x)) for x in xs])
    cut = lambda k, tail: F.concat(F.substring(w, F.lit(1), F.length(w) - k), F.lit(tail))
    plain = F.when(is_plural(word), w).when(F.rlike(w, F.lit("[^aeiou]y$")), cut(1, "ies")).when(end("s", "sh", "ch", "x", "z"), cut(0, "es")).when(end("fe"), cut(2, "ves")).when(end("f"), cut(1, "ves"))
    return F.coalesce(own, plain.otherwise(cut(0, "s")))


def singular(word: Column) -> Column:
    w = F.lower(F.trim(word))
    own = F.coalesce(*[F.when(w == v, k) for k, v in IRREGULAR.items()])
    end = lambda x: F.endswith(w, F.lit(x))
    cut = lambda k, tail="": F.concat(F.substring(w, F.lit(1), F.length(w) - k), F.lit(tail))
    return F.coalesce(own, F.when(end("ies"), cut(3, "y")).when(end("ves"), cut(3, "f")).when(end("es"), cut(2)).when(end("s") & ~end("ss"), cut(1)).otherwise(w))


def is_plural(word: Column) -> Column:
    w = F.lower(F.trim(word))
    listed = w.isin("they", "them", "we", "us", "these", "those", *IRREGULAR.values())
    return listed | (F.endswith(w, F.lit("s")) & ~F.endswith(w, F.lit("ss")) & ~w.isin("this", "is", "was", "has", "does", "goes"))


def is_adjective(word: Column) -> Column:
    w = F.lower(F.trim(word))
    return reduce(lambda a, b: a | b, [F.endswith(w, F.lit(x)) for x in ADJECTIVE_ENDINGS])


def article(word: Column) -> Column:
    w = F.lower(F.trim(word))
    return F.when(F.rlike(w, F.lit("^(uni|eu)")), "a").when(F.rlike(w, F.lit("^(hour|honest|[aeiou])")), "an").otherwise("a")


def verb_form(subject: Column, verb: Column) -> Column:
    """A verb's present form for a subject's number."""
    many = F.when(verb == "is", "are").when(verb == "was", "were").when(verb == "has", "have").when(F.endswith(verb, F.lit("s")) & (F.length(verb) > 2), F.substring(verb, F.lit(1), F.length(verb) - 1))
    one = F.when(verb == "are", "is").when(verb == "were", "was").when(verb == "have", "has")
    return F.coalesce(F.when(is_plural(subject), many).otherwise(one), verb)


def preposition_relation(preposition: Column, verb: Column) -> Column:
    """The relation of a verb with a preposition; "in" means living for a living verb, and a place for any other."""
    home = F.when(preposition == "in", F.when(verb.isin("live", "lives", "found"), "lives_in").otherwise("located_in"))
    return F.coalesce(home, *[F.when(preposition == k, v) for k, v in PREPOSITIONS.items()], preposition)


def refined(sentence: Column) -> Column:
    """struct(statement, connective, condition) of a sentence that limits what it says; null for any other."""
    low = F.regexp_replace(F.lower(F.trim(sentence)), r"[.!?]+$", "")
    shape = r"^(.+?),? (" + "|".join(REFINING) + r") (.+)$"
    return F.when(F.rlike(low, F.lit(shape)), F.struct(F.regexp_extract(low, shape, 1).alias("statement"), F.regexp_extract(low, shape, 2).alias("connective"), F.regexp_extract(low, shape, 3).alias("condition")))


def extras(sentence: Column) -> Column:
    """array<struct<kind, value>>: a sentence's amount as unit:number, what it compares with, and its purpose."""
    low = F.regexp_replace(F.lower(F.trim(sentence)), r"[.!?]+$", "")
    amount = F.concat(F.regexp_extract(low, language.QUANTITY, 2), F.lit(":"), F.replace(F.regexp_extract(low, language.QUANTITY, 1), F.lit(","), F.lit("")))
    pick = lambda kind, value, test: F.when(test, F.struct(F.lit(kind).alias("kind"), value.alias("value")))
    shape, aim = r"\b(?:more|less|[a-z]+er) (?:[a-z]+ )?than (?:the |a |an )?([a-z ]+)$", r"\b(?:in order to|so that|to) ([a-z]+ .+)$"
    found = F.array(
        pick("quantity", amount, F.rlike(low, F.lit(language.QUANTITY))), pick("comparison", F.regexp_extract(low, shape, 1), F.rlike(low, F.lit(shape))),
        pick("purpose", F.regexp_extract(low, aim, 1), F.rlike(low, F.lit(aim))),
    )
    return F.array_compact(found)


def folded(facts: DataFrame) -> DataFrame:
    """(key..., relation, object): facts with have and has, are and is taken for one, each once."""
    r = F.col("relation")
    return facts.withColumn("relation", F.when(r == "have", "has").when(r == "are", "is").otherwise(r)).distinct()


def sufficient(edges: DataFrame) -> DataFrame:
    """(g, s, facts, sufficient): whether enough is known about a subject to answer: anything that is not of low confidence."""
    return edges.groupBy("g", "s").agg(F.count("*").alias("facts"), F.bool_or(F.coalesce("confidence", F.lit("high")) != "low").alias("sufficient"))


def node_view(edges: DataFrame, most: int = 5) -> DataFrame:
    """(g, s, view): a subject as text: a line for each relation with its first objects."""
    rows = edges.select("g", "s", "r", "o").distinct()
    k = F.row_number().over(Window.partitionBy("g", "s", "r").orderBy("o"))
    lines = rows.withColumn("k", k).where(F.col("k") <= most).groupBy("g", "s", "r").agg(F.concat(F.lit("  "), T.pretty(F.col("r")), F.lit(": "), F.array_join(F.array_sort(F.collect_list(T.pretty(F.col("o")))), ", ")).alias("line"))
    return lines.groupBy("g", "s").agg(F.concat_ws("\n", T.pretty(F.col("s")), F.array_join(F.array_sort(F.collect_list("line")), "\n")).alias("view"))


def asked_about(topic: Column, relation: Column, value: Column) -> Column:
    """The question about a topic: whether a guess is right, or for anything at all where there is no guess."""
    t = T.pretty(topic)
    return F.when(value.isNotNull(), F.concat(F.lit("I think "), t, F.lit(" might "), T.pretty(relation), F.lit(" "), T.pretty(value), F.lit(". Is that right?"))).otherwise(F.concat(F.lit("I don't know about '"), t, F.lit("'. Can you tell me about it?")))
