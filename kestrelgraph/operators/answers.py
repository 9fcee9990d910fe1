"""Answers to parsed questions, and the sentences that state them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrelgraph.functions import text as T
from kestrelgraph.runtime import materialize

YES, NO, UNKNOWN = "yes", "no", "unknown"
#: Letters of a name's beginning, and bits of a bitmap (512 KB).
LETTERS, BITS = 8, 1 << 22


def _spelled(asked: DataFrame, forms: DataFrame) -> DataFrame:
    """asked with the stored relations that its relation may mean: itself, and those with it among their spellings."""
    f = forms.select(F.col("form"), F.col("relation").alias("meant"))
    own = asked.select("*", F.col("relation").alias("meant"))
    return own.unionByName(asked.join(f, F.col("relation") == F.col("form")).select(*asked.columns, "meant")).distinct()


def forward(edges: DataFrame, asked: DataFrame, forms: DataFrame) -> DataFrame:
    """(id, answer): what the subject of each question (id, instance, subject, relation) has by the relation."""
    q = _spelled(asked.select("id", F.col("instance").alias("qi"), F.col("subject").alias("qs"), "relation"), forms)
    e = edges.select("instance", "subject", F.col("relation").alias("er"), "object")
    return q.join(e, (F.col("qi") == F.col("instance")) & (F.col("qs") == F.col("subject")) & (F.col("meant") == F.col("er"))).select("id", F.col("object").alias("answer")).distinct()


def _cut(name: str, n: str) -> Column:
    """All stretches of n letters of a name that has at least as many."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(name) - F.col(n) + 1), lambda i: F.substring(F.col(name), i, F.col(n))))


def _place(*parts: str) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(BITS))


def _marked(keys: DataFrame) -> DataFrame:
    """One row with a bitmap of fixed size of the places k that are among the keys."""
    words = keys.groupBy((F.col("k") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(k % 64 as int))")).alias("bits"))
    all_ = keys.sparkSession.range(0, BITS // 64, 1, 1).join(words, F.col("id") == F.col("w"), "left").select("id", F.coalesce("bits", F.lit(0)).alias("bits"))
    return all_.agg(F.array_sort(F.collect_list(F.struct("id", "bits"))).alias("words")).select(F.col("words.bits").alias("words"))


def _among(rows: DataFrame, marks: DataFrame, *parts: str) -> DataFrame:
    """The rows whose place is marked: all that have a partner, and few others."""
    k = _place(*parts)
    return rows.join(F.broadcast(marks), F.getbit(F.get("words", (k / 64).cast("int")), (k % 64).cast("int")) == 1).drop("words")


def reverse(edges: DataFrame, asked: DataFrame, forms: DataFrame) -> DataFrame:
    """(id, answer): who has the relation to a thing that is, contains or is part of the name asked for. Repeated edges
    count once; an empty name is part of every other.

    Names are compared once for each instance and relation, not for each edge and question. One name contains another
    only if one of its stretches is the other's beginning, of eight letters or of all that it has: stretches of the
    lengths that occur are joined with beginnings, and what they bring together is then compared. Before they are
    shuffled, a bitmap of fixed size drops what has no partner. Only questions that several things answer can give an
    answer twice.
    """
    q = materialize(_spelled(asked.select("id", F.col("instance").alias("qi"), "relation", F.col("object").alias("qo")), forms).select("id", "qi", "meant", "qo").distinct())
    e = edges.select("instance", "subject", F.col("relation").alias("er"), "object")
    same = (F.col("qi") == F.col("instance")) & (F.col("meant") == F.col("er"))
    begun = lambda rows, c: rows.withColumn("n", F.least(F.length(c), F.lit(LETTERS))).withColumn("x", F.substring(F.col(c), F.lit(1), F.col("n")))
    alike = same & (F.col("n") == F.col("yn")) & (F.col("x") == F.col("yx"))
    as_y = lambda rows: rows.withColumnsRenamed({"n": "yn", "x": "yx"})
    wanted, things = q.select("qi", "meant", "qo").distinct(), e.select("instance", "er", "object").distinct()

    heads = begun(wanted, "qo")
    marks = _marked(heads.select(F.explode(F.array(_place("qi", "meant", "n"), _place("qi", "meant", "n", "x"))).alias("k")))
    sized = _among(things.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(LETTERS)))).where(F.col("n") <= F.length("object")), marks, "instance", "er", "n")
    pieces = _among(sized.withColumn("x", F.explode(_cut("object", "n"))), marks, "instance", "er", "n", "x")
    holds = pieces.join(as_y(heads), alike).where(F.contains("object", F.col("qo")))

    lengths = things.select("instance", "er", F.least(F.length("object"), F.lit(LETTERS)).alias("n")).distinct()
    parts = materialize(wanted.join(lengths, same).where(F.col("n") <= F.length("qo")).select("qi", "meant", "qo", "n", F.explode(_cut("qo", "n")).alias("x")))
    first = _among(begun(things, "object"), _marked(parts.select(_place("qi", "meant", "n", "x").alias("k"))), "instance", "er", "n", "x")
    held = first.join(as_y(parts), alike).where(F.contains("qo", F.col("object")))

    hits = holds.select("qi", "meant", "qo", "object").unionByName(held.select("qi", "meant", "qo", "object")).distinct()
    rows = q.join(hits, ["qi", "meant", "qo"]).select("id", "qi", "meant", F.col("object").alias("thing"))
    rows = materialize(rows.withColumn("alone", F.count("*").over(Window.partitionBy("id")) == 1))
    who = e.repartition("instance", "er", "object").distinct()
    out = lambda some: rows.where(some).join(who, same & (F.col("thing") == F.col("object"))).select("id", F.col("subject").alias("answer"))
    return out(F.col("alone")).unionByName(out(~F.col("alone")).distinct())


def verdicts(edges: DataFrame, asked: DataFrame, forms: DataFrame) -> DataFrame:
    """(id, verdict) of yes-or-no questions (id, instance, subject, relation, object): a subject that its instance knows
    without the fact means no, an unknown one unknown."""
    q = _spelled(asked.select("id", F.col("instance").alias("qi"), F.col("subject").alias("qs"), "relation", F.col("object").alias("qo")), forms)
    e = edges.select("instance", "subject", F.col("relation").alias("er"), "object", F.lit(True).alias("hit"))
    on = (F.col("qi") == F.col("instance")) & (F.col("qs") == F.col("subject")) & (F.col("meant") == F.col("er")) & (F.col("qo") == F.col("object"))
    stated = q.join(e, on).select("id", "hit").distinct()
    known = edges.select("instance", "subject").unionByName(edges.select("instance", F.col("object").alias("subject"))).distinct().withColumn("known", F.lit(True))
    out = asked.select("id", "instance", "subject").join(stated, "id", "left").join(known, ["instance", "subject"], "left")
    return out.select("id", F.when(F.col("hit"), YES).when(F.col("known"), NO).otherwise(UNKNOWN).alias("verdict"))


def sentences(edges: DataFrame, verbs: DataFrame, most: int = 5) -> DataFrame:
    """(instance, subject, relation, sentence): "The x verbs a, b, and c." over the first objects of each relation.

    verbs (relation, verb) has the present form; a relation without one is spelled as it is.
    """
    key = ["instance", "subject", "relation"]
    each = edges.select(*key, T.pretty(F.col("object")).alias("named")).distinct()
    top = each.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("named"))).where(F.col("k") <= most)
    groups = top.groupBy(*key).agg(F.array_sort(F.collect_list("named")).alias("all"))
    v = verbs.select(F.col("relation").alias("vr"), "verb")
    rows = groups.join(v, F.col("relation") == F.col("vr"), "left")
    verb = F.coalesce("verb", T.pretty(F.col("relation")))
    return rows.select("instance", "subject", "relation", F.concat(F.lit("The "), T.pretty(F.col("subject")), F.lit(" "), verb, F.lit(" "), T.listed(F.col("all")), F.lit(".")).alias("sentence"))


def choice(seed: Column, templates: list[str]) -> Column:
    """A template by the hash of a text: the same text always gets the same one."""
    at = F.conv(F.substring(F.md5(seed), 1, 8), 16, 10).cast("bigint") % len(templates)
    return F.get(F.array(*map(F.lit, templates)), at.cast("int"))


def difference(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(instance, a, b, relation, object, only): what one of the subjects of each pair has and the other lacks."""
    e = edges.select("instance", "subject", "relation", "object").distinct()
    key = ["instance", "a", "b", "relation", "object"]
    x = pairs.join(e.withColumnRenamed("subject", "a"), ["instance", "a"]).select(*key, F.lit(True).alias("ina"))
    y = pairs.join(e.withColumnRenamed("subject", "b"), ["instance", "b"]).select(*key, F.lit(True).alias("inb"))
    both = x.join(y, key, "full")
    return both.where("ina is null or inb is null").select(*key, F.when(F.col("ina"), F.col("a")).otherwise(F.col("b")).alias("only"))


def rule_of(text: Column) -> Column:
    """struct(subject, relation, object, then_relation, then_object) of "if X verb Y then X verb Z", else null."""
    t = F.regexp_replace(F.trim(F.lower(text)), r"[.!]+$", "")
    shape = r"^if (?:an? |the )?(\w+) (is|are|has|have|can|eats?|needs?|causes?) (?:an? |the )?(.+?),? then (?:it|they|(?:an? |the )?\1) (is|are|has|have|can|eats?|needs?|causes?) (?:an? |the )?(.+)$"
    verb = lambda i: F.coalesce(*[F.when(F.regexp_extract(t, shape, i) == k, v) for k, v in (("are", "is"), ("have", "has"), ("eat", "eats"), ("need", "needs"), ("cause", "causes"))], F.regexp_extract(t, shape, i))
    name = lambda i: F.replace(F.regexp_extract(t, shape, i), F.lit(" "), F.lit("_"))
    return F.when(F.rlike(t, F.lit(shape)), F.struct(name(1).alias("subject"), verb(2).alias("relation"), name(3).alias("object"), verb(4).alias("then_relation"), name(5).alias("then_object")))
