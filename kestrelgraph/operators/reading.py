"""More ways to read a text: simpler sentences, encyclopedic statements, any subject and verb, rules, commands, small talk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrelgraph.operators import answers, language, statements

#: (pattern, facts) tried in order on the cleaned sentence; a fact is (relation, subject, object): a group's number, or a
#: word that stands for itself. Lists in an object give a fact each.
ENCYCLOPEDIC = [
    (r"^(.+?) can be found in (.+?), including (.+)$", [("found_in", 1, 2), ("found_in", 1, 3)]),
    (r"^(.+?) (?:is|are) (?:[a-z]+ly )?found in (.+)$", [("found_in", 1, 2)]),
    (r"^(?:many |most |some |all )?(.+?) communicates? (?:through|via|using|by) (.+)$", [("communicates_using", 1, 2)]),
    (r"^(.+?) plays? (?:an? )?(?:[a-z]+ )?roles? in (.+)$", [("plays_role_in", 1, 2)]),
    (r"^(.+?) (?:ranges?|ranging) from (?:the )?(.+?) to (?:the )?(.+)$", [("ranges_from", 1, 2), ("ranges_to", 1, 3)]),
    (r"^(?:all )?(.+?) shares? [a-z ]+: (.+)$", [("shares", 1, 2)]),
    (r"^for example,? (.+?) (?:is|are) (.+)$", [("is", 1, 2)]),
    (r"^(.+?) differs? (?:greatly )?in (.+)$", [("differs_in", 1, 2)]),
    (r"^(.+?) (?:is|are) (?:classified|divided) into (.+?) such as (.+)$", [("classified_into", 1, 3)]),
    (r"^(.+?),? (?:like|such as) (.+?), (?:do|does) not have (.+)$", [("has_instance", 1, 2), ("has_not", 1, 3)]),
    (r"^(.+?),? (?:like|such as) (.+?), (?:is|are) (?:known|admired|famous|noted) for (?:their |its )?(.+)$", [("has_instance", 1, 2), ("known_for", 1, 3)]),
    (r"^(.+?),? (?:like|such as) (.+?), (?:can )?lives? (?:both )?in (.+)$", [("has_instance", 1, 2), ("lives_in", 1, 3)]),
    (r"^(.+?),? (?:like|such as) (.+?), can (.+)$", [("has_instance", 1, 2), ("can", 1, 3)]),
    (r"^(.+?),? (?:like|such as) (.+?), (?:has|have) (.+)$", [("has_instance", 1, 2), ("has", 1, 3)]),
    (r"^(.+?),? (?:like|such as) (.+?), (?:is|are) (.+)$", [("has_instance", 1, 2), ("is", 1, 3)]),
    (r"^(.+?) (?:is|are) (?:known|admired|famous|noted) for (?:their |its )?(.+)$", [("known_for", 1, 2)]),
    (r"^(.+?) (?:is|are) adapted to (.+)$", [("adapted_to", 1, 2)]),
    (r"^(.+?) gives? birth to (.+?) and feeds? (?:them|their young) (?:with |on )?(.+)$", [("gives_birth_to", 1, 2), ("feeds_young", 1, 3)]),
    (r"^(.+?) gives? birth to (.+)$", [("gives_birth_to", 1, 2)]),
    (r"^(.+?) and (?:most )?(.+?) lay eggs?$", [("lays", 1, "eggs"), ("lays", 2, "eggs")]),
    (r"^(?:most |many |some |all )?(.+?) lays? eggs?$", [("lays", 1, "eggs")]),
    (r"^(.+?) breathes? (?:through|with|by) (.+)$", [("breathes_through", 1, 2)]),
    (r"^(?:most|many|some|all) (.+?) can (.+)$", [("can", 1, 2)]),
    (r"^(.+?) uses? (.+?) to (.+)$", [("uses", 1, 2), ("uses_for", 1, 3)]),
    (r"^(.+?) (?:also )?var(?:y|ies) in (.+)$", [("varies_in", 1, 2)]),
    (r"^(?:all )?(.+?) depends? on (.+)$", [("depends_on", 1, 2)]),
    (r"^(.+?),? whose (.+?) (?:shelters?|sheltered|protects?|protected|feeds?|fed|supports?|supported) (.+)$", [("has", 1, 2), ("protects", 2, 3)]),
    (r"^(.+?) (?:consists? of|(?:is|are) made up of) (.+)$", [("made_of", 1, 2)]),
    (r"^(.+?) (?:is|are) (.+?),? (?:while|whereas) (.+?) (?:is|are) (.+)$", [("is", 1, 2), ("is", 3, 4)]),
    (r"^(.+?) (?:has|have) (.+?),? (?:while|whereas) (.+?) (?:has|have) (.+)$", [("has", 1, 2), ("has", 3, 4)]),
]
#: What every sentence has that fits an encyclopedic pattern: one cheap test before all of them.
CUES = r"\b(?:found|communicates?|roles?|ranges?|ranging|shares?|for example|differs?|classified|divided|like|such as|known|admired|famous|noted|adapted|birth|lays?|breathes?|most|many|some|all|uses?|vary|varies|depends?|whose|consists?|made up|while|whereas)\b"
SPACES = r"[\s\p{Z}\x{0b}\x{85}]+"
SPLIT = r", and |, | and "
#: What stands in front of a sentence's main clause and is set aside.
FRONTED = r"^(?:in|on|at|during|after|before|under|over|near|along|with|without) [^,]+, "
_SHAPES = [
    (r"^(.+?), (an? [^,]+|the [^,]+), (.+)$", [("{1} is {2}",), ("{1} {3}",)]),
    (r"^(.+?), (?:which|who) ([^,]+), (.+)$", [("{1} {2}",), ("{1} {3}",)]),
    (r"^(.+?), but (.+)$", [("{1}",), ("{2}",)]),
    (r"^([^,]+), ([^,]+),? and ([^,]+?) (are|have|can) (.+)$", [("{1} {4} {5}",), ("{2} {4} {5}",), ("{3} {4} {5}",)]),
    (r"^((?:the |a |an )?[a-z]+) ([a-z]+s) (.+?) and ([a-z]+s) (.+)$", [("{1} {2} {3}",), ("{1} {4} {5}",)]),
]
# Commands of the console, and what small talk is answered with, in order.
COMMANDS = "help about show stats weights activation procedures neuron frame bridges clusters analogies train load load-all forget forget-all compact inferences conflicts context chain entities verbose".split()
SMALL_TALK = [
    (r"^(?:hi|hello|hey)\b", "Hello!"),
    (r"^how are you\b", "I am well. What would you like to teach me?"),
    (r"^(?:thanks|thank you)\b", "You are welcome."),
    (r"^(?:bye|goodbye|see you)\b", "Goodbye!"),
    (r"^(?:what is|what's) your name\b|^who are you\b", "I am a graph of what I was taught."),
    (r"^what are you\b", "A system that learns facts and reasons with them."),
    (r"^(?:ok|okay|yes|no|sure)\b[.!]?$", "Go on."),
]


def _key(name: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.trim(name), r"^(the|a|an) ", "")), r"[ ]+", "_")


def _each(subject: Column, relation: str, listed: Column) -> Column:
    items = F.filter(F.split(listed, SPLIT), lambda x: F.trim(x) != "")
    return F.transform(items, lambda x: F.struct(_key(subject).alias("subject"), F.lit(relation).alias("relation"), _key(x).alias("object")))


def encyclopedic(sentence: Column) -> Column:
    """array<struct<subject, relation, object>> of the first encyclopedic pattern that a sentence fits; empty for none."""
    t = statements.cleaned(sentence)
    empty = F.array().cast("array<struct<subject:string,relation:string,object:string>>")
    out = []
    for pattern, facts in ENCYCLOPEDIC:
        part = lambda g, p=pattern: F.lit(g) if isinstance(g, str) else F.regexp_extract(t, p, g)
        each = [_each(part(s), relation, part(o)) for relation, s, o in facts]
        out.append(F.when(F.rlike(t, F.lit(pattern)), F.concat(*each)))
    return F.when(F.rlike(t, F.lit(CUES)), F.coalesce(*out, empty)).otherwise(empty)


def simplified(sentence: Column) -> Column:
    """array<string>: a sentence as simpler ones: appositions, relative clauses, contrasts, listed subjects and two verbs
    of one subject become sentences of their own; a fronted circumstance is left out."""
    line = F.trim(F.regexp_replace(sentence, SPACES, " "))
    low = F.regexp_replace(F.lower(line), r"[.!?]+$", "")
    main = F.regexp_replace(low, FRONTED, "")
    out = []
    for pattern, made in _SHAPES:
        texts = []
        for (shape,) in made:
            pieces = [F.regexp_extract(main, pattern, int(x)) if x.isdigit() else F.lit(x) for x in shape.replace("{", "|").replace("}", "|").split("|") if x]
            texts.append(F.concat(*pieces))
        out.append(F.when(F.rlike(main, F.lit(pattern)), F.array(*texts)))
    return F.filter(F.coalesce(*out, F.array(main)), lambda x: x != "")


def any_statement(sentence: Column) -> Column:
    """struct(subject, relation, object): the plainest reading of a sentence, its first word, verb and rest; null if the
    second word has no verb's ending."""
    t = statements.cleaned(sentence)
    shape = r"^(?:the |a |an )?([a-z]+) ([a-z]+(?:s|ed)) (?:the |a |an )?([a-z0-9 ]+)$"
    return F.when(F.rlike(t, F.lit(shape)), F.struct(F.regexp_extract(t, shape, 1).alias("subject"), F.regexp_extract(t, shape, 2).alias("relation"), _key(F.regexp_extract(t, shape, 3)).alias("object")))


def pipeline(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, at, part, reader, subject, relation, object): all facts of a text: each sentence is simplified, and each part
    read by the encyclopedic patterns, else by the plain ones, else by its first verb."""
    rows = texts.select(F.col(key).alias(key), F.posexplode(language.sentences(F.col(text))).alias("at", "s"))
    parts = rows.select(key, "at", F.posexplode(simplified(F.col("s"))).alias("part", "x"))
    x = F.col("x")
    t = statements.cleaned(x)
    plain = F.when(F.rlike(t, F.lit(statements.LETTERS)) & F.rlike(t, F.lit(statements.CUES)), statements.facts_of(x)).otherwise(F.array().cast("array<struct<subject:string,relation:string,object:string>>"))
    # behind a generator, so that each reader runs once for a part
    each = F.explode_outer(F.array(F.struct(encyclopedic(x).alias("e"), plain.alias("p"), any_statement(x).alias("a")))).alias("z")
    read = parts.select(key, "at", "part", each).select(key, "at", "part", "z.*")
    found = F.when(F.size("e") > 0, F.lit("encyclopedic")).when(F.size("p") > 0, "plain").when(F.col("a").isNotNull(), "first verb")
    facts = F.when(F.size("e") > 0, F.col("e")).when(F.size("p") > 0, F.col("p")).otherwise(F.array("a"))
    return read.select(key, "at", "part", found.alias("reader"), F.explode_outer(facts).alias("f")).where("reader is not null and f is not null").select(key, "at", "part", "reader", "f.*")


def rule_lifecycle(texts: DataFrame, text: str) -> DataFrame:
    """(subject, relation, object, then_relation, then_object, support, confidence, status): the rules that texts state.

    A rule begins as a candidate of confidence 0.7; from its third statement on each adds 0.1, 0.9 at most, and it is
    active.
    """
    rules = texts.select(F.explode(language.sentences(F.col(text))).alias("s")).select(answers.rule_of(F.col("s")).alias("q")).where("q is not null").select("q.*")
    n = rules.groupBy(*rules.columns).agg(F.count("*").alias("support"))
    confidence = F.least(F.lit(0.9), 0.7 + 0.1 * F.greatest(F.col("support") - 2, F.lit(0)))
    return n.select("*", F.round(confidence, 6).alias("confidence"), F.when(F.col("support") >= 3, "active").otherwise("candidate").alias("status"))


def decided(rules: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """rules with their status after decisions (keys, verdict, at): the last of confirm and reject holds."""
    last = decisions.groupBy(*keys).agg(F.max_by("verdict", "at").alias("verdict"))
    status = F.when(F.col("verdict") == "confirm", "active").when(F.col("verdict") == "reject", "rejected").otherwise(F.col("status"))
    return rules.join(last, keys, "left").select(*[c for c in rules.columns if c != "status"], status.alias("status"))


def command(text: Column) -> Column:
    """struct(name, argument) of a slash command, null for other texts; the longest name that fits counts."""
    names = "|".join(sorted(COMMANDS, key=lambda c: (-len(c), c)))
    shape = rf"^/({names})(?:\s+(.*))?$"
    t = F.trim(text)
    return F.when(F.rlike(t, F.lit(shape)), F.struct(F.regexp_extract(t, shape, 1).alias("name"), F.trim(F.regexp_extract(t, shape, 2)).alias("argument")))


def small_talk(text: Column) -> Column:
    """The reply to small talk; null for anything else."""
    low = F.lower(F.trim(text))
    return F.coalesce(*[F.when(F.rlike(low, F.lit(p)), reply) for p, reply in SMALL_TALK])


def resolved(phrases: DataFrame, names: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, g, entity, how): the entity that a phrase (id, g, phrase) means among the names (g, name) of its instance.

    Tried in order: the name itself; "X's Y" as x_y; an alias (g, alias, name); its last word as the end of the shortest
    name. A phrase that means none is a new entity, named by itself.
    """
    clean = F.regexp_replace(F.replace(F.lower(F.trim("phrase")), F.lit("'s "), F.lit("_")), r"\s+", "_")
    p = phrases.select("id", "g", clean.alias("p"), F.contains(F.lower("phrase"), F.lit("'s ")).alias("owned"))
    n = names.select("g", "name").distinct()
    exact = p.join(n.withColumnRenamed("name", "p"), ["g", "p"], "left_semi").select("id", "g", F.when(F.col("owned"), 1).otherwise(0).alias("k"), F.col("p").alias("entity"))
    alias = p.join(aliases.select("g", F.col("alias").alias("p"), "name").distinct(), ["g", "p"]).groupBy("id", "g").agg(F.min("name").alias("entity")).select("id", "g", F.lit(2).alias("k"), "entity")
    ends = n.where(F.contains("name", F.lit("_"))).groupBy("g", F.element_at(F.split("name", "_"), -1).alias("word")).agg(F.min(F.struct(F.length("name").alias("l"), "name")).alias("b"))
    suffix = p.select("id", "g", F.element_at(F.split("p", "_"), -1).alias("word")).join(ends, ["g", "word"]).select("id", "g", F.lit(3).alias("k"), F.col("b.name").alias("entity"))
    best = exact.unionByName(alias).unionByName(suffix).groupBy("id", "g").agg(F.min(F.struct("k", "entity")).alias("b"))
    how = F.get(F.array(*map(F.lit, ["exact", "possessive", "alias", "suffix"])), F.col("b.k"))
    return p.join(best, ["id", "g"], "left").select("id", "g", F.coalesce("b.entity", "p").alias("entity"), F.coalesce(how, F.lit("new")).alias("how"))
