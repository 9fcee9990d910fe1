"""The question surface over (g, s, r, o, confidence): templates as joins, verdicts by ranked branches, routed texts.

g is the instance of a fact; a question is only ever answered from its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrelgraph.operators import reasoning
from kestrelgraph.runtime import materialize

MOST = 5


@dataclass(frozen=True)
class Template:
    """A kind of question: the relations that answer it, in order. ranked takes the first relation that has an answer,
    reverse asks for the subject; at most `most` answers are named."""

    name: str
    relations: tuple[str, ...]
    reverse: bool = False
    ranked: bool = False
    most: int = MOST


# Which relations answer which kind of question, in order.
TEMPLATES = [
    Template("color", ("color",), most=1),
    Template("where", ("located_in", "lives_in", "found_in", "can_live", "can_live_in", "runs_on"), ranked=True),
    Template("where_all", ("found_in", "lives_in", "located_in")),
    Template("made_of", ("made_of",)),
    Template("part_of", ("part_of",)),
    Template("parts", ("part_of",), reverse=True),
    Template("has", ("has",)),
    Template("what_has", ("has",), reverse=True),
    Template("eats", ("eats",)),
    Template("what_eats", ("eats",), reverse=True),
    Template("can", ("can",)),
    Template("cannot", ("cannot",)),
    Template("what_can", ("can",), reverse=True),
    Template("needs", ("needs",)),
    Template("what_needs", ("needs",), reverse=True),
    Template("what_causes", ("causes",), reverse=True, most=3),
    Template("effects", ("causes",), most=3),
    Template("what_lives_in", ("lives_in",), reverse=True),
    Template("lays_eggs", ("produces", "lays", "reproduction"), reverse=True),
    Template("produces", ("produces",)),
    Template("what_protects", ("protects",), reverse=True),
    Template("protects", ("protects",)),
    Template("food_for", ("food_for",), reverse=True),
    Template("threatened_by", ("threatened_by",)),
    Template("communicates", ("communicates_using",)),
    Template("detects", ("can_detect",)),
    Template("provides", ("provides",)),
    Template("related", ("related_to",)),
    Template("regenerates", ("can_regenerate",)),
    Template("immune", ("immune_to",)),
    Template("reproduces", ("reproduction", "reproduces_by")),
    Template("breathes", ("breathes_through", "breathes_with", "breathes"), ranked=True),
    Template("classified", ("classified_into", "divided_into"), ranked=True),
    Template("varies", ("varies_in",)),
    Template("examples", ("example", "has_instance")),
    Template("instances", ("is",), reverse=True),
    Template("characteristics", ("has_property", "has", "can", "needs")),
    Template("what", ("is", "has_property", "differs_from"), ranked=True),
    Template("size", ("height", "size"), ranked=True),
]


def answered(edges: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """(template, g, asked, answers, n): every question that a template makes of the edges, with its first answers in the
    order of relations and the alphabet, joined by a comma, and how many there are.

    The templates are a constant table. A hub's answers are counted in an aggregation; only the first are kept, by a
    limit inside each group that is applied before the shuffle.
    """
    spark = edges.sparkSession
    rows = [(t.name, r, k, t.reverse, t.ranked, t.most) for t in templates for k, r in enumerate(t.relations)]
    table = spark.createDataFrame(rows, "template string, relation string, rank int, reverse boolean, ranked boolean, most int")
    key = ["template", "g", "asked"]
    side = lambda a, b: F.when(F.col("reverse"), F.col(a)).otherwise(F.col(b))
    hits = edges.join(F.broadcast(table), F.col("r") == F.col("relation")).select("template", "g", side("o", "s").alias("asked"), side("s", "o").alias("answer"), "rank", "ranked", "most")
    hits = hits.groupBy(*key, "answer", "ranked", "most").agg(F.min("rank").alias("rank"))
    low = hits.where("ranked").groupBy(*key).agg(F.min("rank").alias("low"))
    kept = hits.join(low, key, "left").where("low is null or rank = low")
    n = kept.groupBy(*key).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("rank", "answer"))
    top = kept.select(*key, "rank", "answer", "most", place.alias("k")).where(F.col("k") <= max(t.most for t in templates)).where("k <= most")
    named = top.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "answer"))), lambda x: x["answer"]), ", ").alias("answers"))
    return named.join(n, key)


def near(a: Column, b: Column) -> Column:
    """Either name contains the other."""
    return F.contains(a, b) | F.contains(b, a)


#: What a yes-or-no question comes to, in the order in which it is looked for.
VERDICTS = ["yes", "yes, through what it is", "yes, inherited", "yes, as a property", "some", "no", "no, as far as is known", "unknown"]


def is_verdicts(edges: DataFrame, asked: DataFrame, depth: int = 5) -> DataFrame:
    """(id, verdict, via) of "is S an O?" questions (id, g, s, o): the first branch that finds something decides.

    A stated category that contains the name or is part of it; one that is reached over categories; a property of such a
    category; an own property; a possibility; a denial; a subject about which something is known has no other (closed
    world); anybody else is unknown. via is the alphabetically first category or property that decided.
    """
    edges = materialize(edges.where("r in ('is', 'has_property', 'can_be', 'is_not')").select("g", "s", "r", "o", "confidence"))
    q = asked.select("id", F.col("g").alias("qg"), F.col("s").alias("qs"), F.col("o").alias("qo")).distinct()
    own = lambda r: edges.where(F.col("r") == r).select("g", "s", "o").distinct()

    def branch(rows: DataFrame, place: int, test=near) -> DataFrame:
        return q.join(rows, (F.col("qg") == F.col("g")) & (F.col("qs") == F.col("s"))).where(test(F.col("o"), F.col("qo"))).select("id", F.lit(place).alias("k"), F.col("o").alias("via"))

    up = reasoning.chains(edges.where("r = 'is' and s <> o"), depth).select("g", "s", "o")
    prop = own("has_property")
    passed = up.select("g", "s", F.col("o").alias("c")).join(prop.select(F.col("g").alias("pg"), F.col("s").alias("ps"), "o"), (F.col("g") == F.col("pg")) & (F.col("c") == F.col("ps"))).select("g", "s", "o").distinct()
    denied = lambda o, asked_: F.contains(o, asked_)
    known = edges.where("r in ('is', 'has_property')").select("g", "s", "o")
    hits = branch(own("is"), 0).unionByName(branch(up, 1)).unionByName(branch(passed, 2)).unionByName(branch(prop, 3)).unionByName(branch(own("can_be"), 4)).unionByName(branch(own("is_not"), 5, denied)).unionByName(branch(known, 6, lambda o, x: F.lit(True)))
    best = hits.groupBy("id").agg(F.min(F.struct("k", "via")).alias("b"))
    out = asked.select("id").distinct().join(best, "id", "left")
    return out.select("id", F.get(F.array(*map(F.lit, VERDICTS)), F.coalesce("b.k", F.lit(len(VERDICTS) - 1))).alias("verdict"), F.when(F.col("b.k") < 6, F.col("b.via")).alias("via"))


def category_abilities(edges: DataFrame, category: str = "is") -> DataFrame:
    """(g, category, relation, ability, s): which members of a category can, or cannot, do something."""
    m = edges.where(F.col("r") == category).select("g", "s", F.col("o").alias("category")).distinct()
    a = edges.where("r in ('can', 'cannot')").select("g", "s", F.col("r").alias("relation"), F.col("o").alias("ability")).distinct()
    return m.join(a, ["g", "s"]).select("g", "category", "relation", "ability", "s")


def living(edges: DataFrame) -> DataFrame:
    """(g, category, place, s): which members of a category live where."""
    m = edges.where("r = 'is'").select("g", "s", F.col("o").alias("category")).distinct()
    return m.join(edges.where("r = 'lives_in'").select("g", "s", F.col("o").alias("place")).distinct(), ["g", "s"]).select("g", "category", "place", "s")


NOW_RELATIONS = ["is", "does", "lives_in", "can", "has"]


def currently(facts: DataFrame, relations: Sequence[str] = NOW_RELATIONS) -> DataFrame:
    """(g, s, relation, answers, n): what a subject is and does now, from facts (..., temporal) that hold only currently."""
    rows = facts.where(F.col("r").isin(list(relations)) & (F.col("temporal") == "currently")).select("g", "s", "r", "o").distinct()
    n = rows.groupBy("g", "s", "r").agg(F.count("*").alias("n"))
    top = rows.withColumn("k", F.row_number().over(Window.partitionBy("g", "s", "r").orderBy("o"))).where(F.col("k") <= MOST)
    named = top.groupBy("g", "s", "r").agg(F.array_join(F.array_sort(F.collect_list("o")), ", ").alias("answers"))
    return named.join(n, ["g", "s", "r"]).withColumnRenamed("r", "relation")


def how_many(edges: DataFrame, things: Sequence[str]) -> DataFrame:
    """(g, s, thing, amount): the number, as figure or word, before the name of a thing in what a subject has."""
    words = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]
    number = F.regexp_extract("o", rf"(\d+|{'|'.join(words)})_(\w+)", 1)
    thing = F.regexp_extract("o", rf"(\d+|{'|'.join(words)})_(\w+)", 2)
    figure = F.coalesce(*[F.when(number == w, i + 1) for i, w in enumerate(words)], F.try_to_number(number, F.lit("999999999")).cast("int"))
    rows = edges.where(F.col("r").isin("has", "is", "can", "has_property", "height")).select("g", "s", thing.alias("thing"), figure.alias("amount")).where(F.col("thing").isin(list(things)))
    return rows.groupBy("g", "s", "thing").agg(F.max("amount").alias("amount"))


def superlatives(values: DataFrame) -> DataFrame:
    """(g, category, most, least): the members with the highest and the lowest value of (g, category, s, value)."""
    return values.groupBy("g", "category").agg(F.min(F.struct((-F.col("value")).alias("v"), "s")).alias("hi"), F.min(F.struct("value", "s")).alias("lo")).select("g", "category", F.col("hi.s").alias("most"), F.col("lo.s").alias("least"))


# What a question looks like, tried in order, with the template that answers it and where its name stands.
ROUTES = [
    (r"^what colou?r (?:is|are) (?:an? |the )?(.+)$", "color"),
    (r"^where (?:is|are|do|does|can) (?:an? |the )?(.+?)(?: live| found| be found| located| run| grow)?$", "where"),
    (r"^what (?:is|are) (?:an? |the )?(.+?) made (?:of|from)$", "made_of"),
    (r"^what (?:is|are) (?:an? |the )?(.+?) (?:a )?part of$", "part_of"),
    (r"^what (?:characteristics|traits|properties|features) (?:do|does) (?:an? |the )?(.+?) have$", "characteristics"),
    (r"^what (?:are )?(?:some )?examples of (.+)$", "instances"),
    (r"^what causes? (?:an? |the )?(.+)$", "what_causes"),
    (r"^what happens when (?:an? |the |it )?(.+)$", "effects"),
    (r"^what (?:do|does) (?:an? |the )?(.+?) eats?$", "eats"),
    (r"^what (?:do|does) (?:an? |the )?(.+?) need$", "needs"),
    (r"^what (?:do|does) (?:an? |the )?(.+?) have$", "has"),
    (r"^what (?:do|does) (?:an? |the )?(.+?) produce$", "produces"),
    (r"^what can (?:an? |the )?(.+?) do$", "can"),
    (r"^what (?:can't|cannot) (?:an? |the )?(.+?) do$", "cannot"),
    (r"^what (?:has|have) (?:an? |the )?(.+)$", "what_has"),
    (r"^what eats? (?:an? |the )?(.+)$", "what_eats"),
    (r"^what needs? (?:an? |the )?(.+)$", "what_needs"),
    (r"^what lives? (?:in|on) (?:the )?(.+)$", "what_lives_in"),
    (r"^what can (.+)$", "what_can"),
    (r"^what (?:is|are) (?:an? |the )?(.+)$", "what"),
]


def routed(questions: DataFrame, edges: DataFrame, forms: Column | None = None) -> DataFrame:
    """(id, template, asked, g, answers, n): free questions (id, text) answered by the template of the first shape that
    fits. A name is tried as it stands, and with and without a plural "s"; the first of these that is known counts."""
    t = F.regexp_replace(F.trim(F.lower("text")), r"[?.!]+$", "")
    template = F.coalesce(*[F.when(F.rlike(t, F.lit(p)), F.lit(k)) for p, k in ROUTES])
    name = F.replace(F.coalesce(*[F.when(F.rlike(t, F.lit(p)), F.regexp_extract(t, p, 1)) for p, _ in ROUTES]), F.lit(" "), F.lit("_"))
    asked = questions.select("id", template.alias("qt"), name.alias("name")).where("qt is not null")
    tried = F.array_distinct(F.array("name", F.concat("name", F.lit("s")), F.regexp_replace("name", "s$", "")))
    spelled = asked.select("id", "qt", F.posexplode(tried).alias("rank", "spelling"))
    hits = spelled.join(answered(edges), (F.col("qt") == F.col("template")) & (F.col("spelling") == F.col("asked")))
    first = hits.groupBy("id", "g").agg(F.min(F.struct("rank", "template", "asked", "answers", "n")).alias("b"))
    return first.select("id", "b.template", "b.asked", "g", "b.answers", "b.n")
