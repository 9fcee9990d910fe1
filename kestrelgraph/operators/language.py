"""Texts to units and facts: sentences, themes, connected sentences, discourse markers, parsed questions and statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that are no theme, and what a marker says about the sentence before it.
STOP = "the and for are but not you all can had her was one our out has him his how its may new now old see two way who did get use she they this that with have from been were will would there their what about which when make like time just know take people into year your good some could them other than then look only come over think also back after first well even want because any these give most said each whether yet though along near under above behind beside beyond inside".split()
DISCOURSE = {"because": "causes", "so": "causes", "but": "contrasts_with", "however": "contrasts_with", "although": "contrasts_with", "though": "contrasts_with", "unlike": "contrasts_with", "if": "depends_on", "when": "occurs_with", "after": "follows", "before": "precedes", "for example": "example_of"}
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z])"
ABBREVIATIONS = r"\b(Mr|Mrs|Ms|Dr|Prof|Sr|Jr|vs|etc|e\.g|i\.e|St)\."


def sentences(text: Column) -> Column:
    """array<string>: split behind . ! ? before white space and a capital; abbreviations do not end a sentence."""
    held = F.regexp_replace(text, ABBREVIATIONS, "$1\x01")
    return F.filter(F.transform(F.split(held, SENTENCE_END), lambda x: F.trim(F.replace(x, F.lit("\x01"), F.lit(".")))), lambda x: x != "")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def themes(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, theme, uses): each document's most frequent word of more than two letters; the first seen wins a tie."""
    w = documents.select(F.col(key).alias(key), F.posexplode(words(F.col(text))).alias("at", "word")).where((F.length("word") > 2) & ~F.col("word").isin(STOP))
    n = w.groupBy(key, "word").agg(F.count("*").alias("uses"), F.min("at").alias("at"))
    best = n.groupBy(key).agg(F.max_by("word", F.struct("uses", -F.col("at"))).alias("theme"), F.max("uses").alias("uses"))
    return best


def marker(sentence: Column) -> Column:
    """The relation that a sentence's opening marker stands for, longest marker first; null without one."""
    low = F.lower(sentence)
    order = sorted(DISCOURSE, key=lambda m: (-len(m), m))
    return F.coalesce(*[F.when(F.rlike(low, F.lit(rf"^{m}\b")), F.lit(DISCOURSE[m])) for m in order])


def discourse(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, at, relation, before): sentences that open with a marker, and the sentence they follow (empty for none)."""
    s = documents.select(F.col(key).alias(key), sentences(F.col(text)).alias("s"))
    rows = s.select(key, F.posexplode(F.transform("s", lambda x, i: F.struct(x.alias("x"), F.coalesce(F.get("s", i - 1), F.lit("")).alias("b")))).alias("at", "p"))
    return rows.select(key, "at", marker(F.col("p.x")).alias("relation"), F.col("p.b").alias("before")).where("relation is not null")


_PREP = "in|on|at|to|from|with|of|for|by|through|into|about|over|under"
#: Question shapes, tried in order: (pattern, kind, subject group, relation, object group, direction); a relation in
#: quotes stands for itself, "23" for the second and third group.
SHAPES = [
    (r"^what (?:is|are) (.+?) made (?:from|of|out of)$", "what", 1, "'made_of'", None, "forward"),
    (r"^what (?:is|are) (.+)$", "what_is", 1, "'is'", None, "forward"),
    (rf"^what (?:does|do) (.+) (\w+) ({_PREP})$", "what", 1, "23", None, "forward"),
    (r"^what (?:does|do) (.+) (\w+)$", "what", 1, "2", None, "forward"),
    (r"^what did (.+?) (\w+)$", "what", 1, "2", None, "forward"),
    (r"^who (?:is|are|was|were) (.+)$", "who", 1, "'is'", None, "forward"),
    (r"^who (\w+) (.+)$", "who", None, "1", 2, "reverse"),
    (rf"^where (?:does|do) (.+?) (\w+) ({_PREP})$", "where", 1, "23", None, "forward"),
    (r"^where (?:does|do|did) (.+?) (\w+)$", "where", 1, "2", None, "forward"),
    (r"^when (?:does|do|did) (.+?) (\w+)$", "when", 1, "2", None, "forward"),
    (r"^how (?:does|do|can) (.+?) (\w+)$", "how", 1, "2", None, "forward"),
    (r"^can (.+?) (\w+) (.+)$", "can", 1, "'can'", 3, "yesno"),
    (r"^can (.+?) (\w+)$", "can", 1, "'can'", 2, "yesno"),
    (r"^(?:is|are) (.+?) an? (.+)$", "is", 1, "'is'", 2, "yesno"),
    (r"^(?:is|are) (.+?) (\w+)$", "is", 1, "'is'", 2, "yesno"),
    (r"^what (\w+(?:es|ed|s)) (.+)$", "what", None, "1", 2, "reverse"),
]


def question(text: Column) -> Column:
    """struct(kind, subject, relation, object, direction) of a question, or null if it has none of the known shapes.

    Shapes are tried in order. "who VERB X" and "what VERBs X" ask for the subject, "is X Y" and "can X VERB Y" for
    yes or no, everything else for the object.
    """
    t = F.regexp_replace(F.trim(F.lower(text)), r"[?.]+$", "")
    none = F.lit(None).cast("string")
    out = []
    for pattern, kind, subject, relation, obj, direction in SHAPES:
        part = lambda i, p=pattern: F.regexp_extract(t, p, i) if i else none
        rel = F.lit(relation.strip("'")) if relation[0] == "'" else F.concat_ws("_", part(2), part(3)) if relation == "23" else part(int(relation))
        out.append(F.when(F.rlike(t, F.lit(pattern)), F.struct(F.lit(kind).alias("kind"), part(subject).alias("subject"), rel.alias("relation"), part(obj).alias("object"), F.lit(direction).alias("direction"))))
    return F.coalesce(*out)


def statements(texts: DataFrame, key: str, text: str, verbs: DataFrame) -> DataFrame:
    """(key, at, subject, relation, object, negated): plain "SUBJECT VERB OBJECT" facts of a text's sentences.

    verbs (relation, form) lists how relations are spelled; it is a dimension. A sentence gives the fact of its first
    listed verb that has words on both sides; "does not" and "never" before the verb negate it.
    """
    rows = texts.select(F.col(key).alias(key), F.posexplode(sentences(F.col(text))).alias("at", "s"))
    tokens = rows.select(key, "at", F.split(F.regexp_replace(F.lower("s"), r"[^a-z0-9 _-]+", ""), r"\s+").alias("w"))
    one = tokens.select(key, "at", "w", F.posexplode("w").alias("i", "form"))
    lookup = verbs.where(~F.contains("form", F.lit(" "))).select("form", "relation").groupBy("form").agg(F.min("relation").alias("relation"))
    hit = one.join(lookup, "form").where((F.col("i") > 0) & (F.col("i") < F.size("w") - 1))
    first = Window.partitionBy(key, "at").orderBy("i")
    hit = hit.withColumn("k", F.row_number().over(first)).where("k = 1")
    before = F.slice("w", F.lit(1), F.col("i"))
    bare = F.filter(before, lambda x: ~x.isin("the", "a", "an", "does", "do", "did", "not", "never"))
    after = F.filter(F.slice("w", F.col("i") + 2, F.size("w")), lambda x: ~x.isin("the", "a", "an"))
    negated = F.arrays_overlap(before, F.array(F.lit("not"), F.lit("never")))
    return hit.select(key, "at", F.array_join(bare, "_").alias("subject"), "relation", F.array_join(after, "_").alias("object"), negated.alias("negated")).where("subject <> '' and object <> ''")


# How a sentence's certainty, frequency and amounts show, and how a message acts.
HEDGES = r"\b(maybe|perhaps|possibly|probably|might|i think|seems?|seemed|apparently)\b"
FREQUENCIES = r"\b(always|usually|often|sometimes|rarely|seldom|never)\b"
QUANTITY = r"\b(\d[\d,]*) ([a-z]+)"
ACTS = [("correcting", r"\b(no,|wrong|not right|actually|corrected)"), ("questioning", r"(\?\s*$|^(what|who|where|when|why|how|is|are|does|do|can)\b)"), ("teaching", r"\b(is|are|has|have|can|means|taught)\b")]
NAME = r"\b([A-Z][a-z]{3,})\b"


def structure(sentence: Column) -> dict[str, Column]:
    """hedged, frequency, quantity and unit of a sentence; empty where it has none."""
    low = F.lower(sentence)
    return {
        "hedged": F.rlike(low, F.lit(HEDGES)), "frequency": F.regexp_extract(low, FREQUENCIES, 1),
        "quantity": F.replace(F.regexp_extract(low, QUANTITY, 1), F.lit(","), F.lit("")), "unit": F.regexp_extract(low, QUANTITY, 2),
    }


def act(text: Column) -> Column:
    low = F.lower(text)
    return F.coalesce(*[F.when(F.rlike(low, F.lit(p)), F.lit(n)) for n, p in ACTS], F.lit("chatting"))


def dialogue(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, turn, speaker, said, named, topic): the turns "Name: text" of dialogues.

    named is the first capitalised name of the turn behind its first word; topic is the last name before the turn,
    which is what a pronoun in it means.
    """
    lines = documents.select(F.col(key).alias(key), F.posexplode(F.split(F.col(text), r"\r?\n")).alias("turn", "line"))
    shape = r"^(User|System|Teacher|Speaker \d+): (.+)$"
    said = F.regexp_extract("line", shape, 2)
    rows = lines.where(F.rlike("line", F.lit(shape))).select(key, "turn", F.regexp_extract("line", shape, 1).alias("speaker"), said.alias("said"))
    named = F.nullif(F.regexp_extract(F.regexp_replace("said", r"^\S+", ""), NAME, 1), F.lit(""))
    before = Window.partitionBy(key).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("named", named).select("*", F.last("named", True).over(before).alias("topic"))


def sentence_links(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(a, b, n): names of neighbouring sentences of a document, as unordered pairs with their number."""
    s = documents.select(F.col(key).alias(key), F.transform(sentences(F.col(text)), lambda x: F.array_distinct(F.regexp_extract_all(F.regexp_replace(x, r"^\S+", ""), F.lit(NAME), F.lit(1)))).alias("names"))
    steps = s.select(F.explode(F.transform("names", lambda x, i: F.struct(x.alias("x"), F.coalesce(F.get("names", i - 1), F.array().cast("array<string>")).alias("y")))).alias("p")).where("size(p.x) > 0 and size(p.y) > 0")
    pairs = steps.select(F.explode("p.x").alias("x"), "p.y").select("x", F.explode("y").alias("y")).where("x <> y")
    return pairs.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("n"))
