"""The fact store: scans, lookups, statistics, consensus and changes of (instance, subject, relation, object) rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrelgraph.functions import confidence as C
from kestrelgraph.functions import text as T
from kestrelgraph.operators import reasoning
from kestrelgraph.runtime import materialize

KEY = ["instance", "subject", "relation", "object"]


def edges(facts: DataFrame) -> DataFrame:
    """The distinct quads without context; rows with a missing part are no facts."""
    return facts.select(*KEY).where(" and ".join(f"{c} is not null" for c in KEY)).distinct()


def adjacency(facts: DataFrame) -> DataFrame:
    """(instance, subject, relation, objects): the sorted objects of each subject and relation."""
    return edges(facts).groupBy("instance", "subject", "relation").agg(F.array_sort(F.collect_list("object")).alias("objects"))


def lookup(facts: DataFrame, relation: str, subject: str | None = None, obj: str | None = None, instance: str | None = None) -> DataFrame:
    """The distinct quads that match the given parts; the filters reach the scan."""
    out = edges(facts.where(F.col("relation") == relation))
    for c, v in (("subject", subject), ("object", obj), ("instance", instance)):
        if v is not None:
            out = out.where(F.col(c) == v)
    return out


def views(facts: DataFrame, queries: Sequence[str]) -> DataFrame:
    """(view, quad): the facts that each temporal query sees, in one scan."""
    seen = F.array_compact(F.array(*[F.when(C.visible(F.col("temporal"), q), F.lit(q)) for q in queries]))
    return facts.select(F.explode(seen).alias("view"), *KEY).distinct()


def variants(facts: DataFrame, asked: DataFrame, forms: DataFrame) -> DataFrame:
    """The first hit of each question (id, subject, relation) among spellings of its parts.

    asked is a small table of questions (it is what gets broadcast, if anything); forms (relation, form) lists the
    spellings of relations. Subjects are tried as asked, with and without an "s", and without an article; spellings
    are ranked, and all objects of the best-ranked spelling are returned.
    """
    s = F.col("subject")
    subjects = F.array_distinct(F.array(s, F.regexp_replace(s, "s$", ""), F.concat(s, F.lit("s")), F.regexp_replace(s, "^(the|a|an)_", "")))
    tried = asked.select("id", F.posexplode(subjects).alias("srank", "subject"), F.col("relation").alias("asked"))
    spelled = tried.join(forms, tried.asked == forms.form).select("id", "srank", "subject", forms.relation, F.when(F.col("asked") == forms.relation, 0).otherwise(1).alias("rrank"))
    hits = edges(facts).join(spelled, ["subject", "relation"])
    best = Window.partitionBy("id").orderBy("rrank", "srank", "subject", "relation")
    return hits.withColumn("place", F.dense_rank().over(best)).where("place = 1").select("id", *KEY)


def reverse(facts: DataFrame) -> DataFrame:
    """(instance, relation, object, subjects, first): how many subjects have each relation to an object."""
    return edges(facts).groupBy("instance", "relation", "object").agg(F.count("*").alias("subjects"), F.min("subject").alias("first"))


def by_source(facts: DataFrame) -> DataFrame:
    inferred = F.col("source_type").isin("inference", "inheritance")
    return facts.groupBy("instance", "source_type").agg(F.count("*").alias("facts"), F.count_if(inferred).alias("inferred"))


def confidences(facts: DataFrame) -> DataFrame:
    """The best confidence of each quad, medium where none is given, and its weight."""
    best = facts.groupBy(*KEY).agg(F.max(C.rank(F.col("confidence"))).alias("r"))
    return best.select(*KEY, C.level(F.col("r")).alias("confidence"), C.weight(C.level(F.col("r"))).alias("weight"))


def premise_edges(facts: DataFrame) -> DataFrame:
    """(instance, s, r, o, ps, pr, po): each fact with each fact it cites."""
    cited = facts.select("instance", F.col("subject").alias("s"), F.col("relation").alias("r"), F.col("object").alias("o"), F.explode("premises").alias("p"))
    return cited.select("instance", "s", "r", "o", F.col("p.subject").alias("ps"), F.col("p.relation").alias("pr"), F.col("p.object").alias("po")).distinct()


def stats(facts: DataFrame) -> DataFrame:
    """One row for each instance: entities, distinct facts, inferred facts, speakers."""
    nodes = facts.select("instance", F.explode(F.array("subject", "object")).alias("node")).where("node is not null").distinct().groupBy("instance").agg(F.count("*").alias("nodes"))
    derived = F.col("source_type").isin("inference", "inheritance", "rule", "discovery")
    rows = facts.groupBy("instance", "subject", "relation", "object").agg(F.max(derived.cast("int")).alias("d"))
    counts = rows.groupBy("instance").agg(F.count("*").alias("facts"), F.coalesce(F.sum("d"), F.lit(0)).alias("inferred"))
    who = facts.where("speaker_id is not null and trim(speaker_id) <> ''").groupBy("instance").agg(F.count_distinct(F.lower(F.trim("speaker_id"))).alias("speakers"))
    return counts.join(nodes, "instance", "left").join(who, "instance", "left").select("instance", "nodes", "facts", "inferred", F.coalesce("speakers", F.lit(0)).alias("speakers"))


def leaderboards(facts: DataFrame, users: DataFrame, top: int = 20) -> DataFrame:
    """(board, place, speaker, value): the first speakers by each of the three counts; who has none is on no board."""
    counts = ["taught", "corrected", "messages"]
    boards = F.array(*[F.struct(F.lit(c).alias("board"), F.col(c).alias("value")) for c in counts])
    rows = activity(facts, users).select("speaker", F.explode(boards).alias("b")).select("b.board", "speaker", "b.value").where("value > 0")
    place = F.row_number().over(Window.partitionBy("board").orderBy(F.desc("value"), "speaker"))
    return rows.withColumn("place", place).where(F.col("place") <= top).select("board", "place", "speaker", "value")


def activity(facts: DataFrame, users: DataFrame) -> DataFrame:
    """(speaker, taught, corrected, messages): facts taught, corrections made, messages sent; a full outer join of the three counts."""
    name = lambda c: F.lower(F.trim(F.col(c)))
    named = lambda c: F.col(c).isNotNull() & (F.trim(F.col(c)) != "")
    taught = facts.where(named("speaker_id")).groupBy(name("speaker_id").alias("speaker")).agg(F.count("*").alias("taught"))
    fixed = facts.where(named("corrected_by")).groupBy(name("corrected_by").alias("speaker")).agg(F.count("*").alias("corrected"))
    sent = users.where(named("user_name")).groupBy(name("user_name").alias("speaker")).agg(F.coalesce(F.sum("message_count"), F.lit(0)).alias("messages"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return taught.join(fixed, "speaker", "full").join(sent, "speaker", "full").select("speaker", zero("taught"), zero("corrected"), zero("messages"))


def leaderboard(facts: DataFrame, users: DataFrame, top: int = 20) -> DataFrame:
    """The most active speakers, by what they taught."""
    return activity(facts, users).orderBy(F.desc("taught"), F.desc("corrected"), F.desc("messages"), "speaker").limit(top)


def contributors(facts: DataFrame) -> DataFrame:
    """(instance, node, creators, correctors): who taught and who corrected facts about each subject."""
    people = lambda c: F.array_sort(F.collect_set(F.nullif(F.lower(F.trim(F.col(c))), F.lit(""))))
    return facts.groupBy("instance", F.col("subject").alias("node")).agg(people("speaker_id").alias("creators"), people("corrected_by").alias("correctors"))


def degrees(e: DataFrame) -> DataFrame:
    """(instance, node, out_degree, in_degree, relations) over distinct edges."""
    out = e.select("instance", F.col("subject").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"), "relation")
    into = e.select("instance", F.col("object").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"), F.lit(None).cast("string").alias("relation"))
    both = out.unionByName(into)
    return both.groupBy("instance", "node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.count_distinct("relation").alias("relations"))


def consensus(facts: DataFrame) -> DataFrame:
    """How often each quad was stated again, and by how many different speakers."""
    who = F.nullif(F.lower(F.trim(F.col("speaker_id"))), F.lit(""))
    return facts.groupBy(*KEY).agg((F.count("*") - 1).alias("agreement_count"), F.count_distinct(who).alias("speakers"), C.repeated(C.level(F.max(C.rank(F.col("confidence")))), F.count("*")).alias("confidence"))


def corrections(facts: DataFrame) -> DataFrame:
    """The correction log: the inline history and the row's own correction, without double entries."""
    past = facts.select(*KEY, F.explode("correction_history").alias("h")).select(*KEY, F.lower(F.trim("h.corrected_by")).alias("by"), F.col("h.original_value").alias("was"))
    own = facts.where("corrected_by is not null").select(*KEY, F.lower(F.trim("corrected_by")).alias("by"), F.col("original_value").alias("was"))
    return past.unionByName(own).distinct()


def retract(facts: DataFrame, seeds: DataFrame) -> DataFrame:
    """(instance, s, r, o, step): the seed facts and everything that cites a retracted fact, directly or not.

    A fixpoint over the cited premises: each round joins only what the round before found, so mutual premises end. It
    goes on until a round finds nothing; it always ends, as every round but the last adds facts.
    """
    cites = materialize(premise_edges(facts))
    gone = seeds.select("instance", "s", "r", "o").distinct().withColumn("step", F.lit(0))
    gone = materialize(gone)
    delta, done = gone, gone
    for step in count(1):
        d = delta.select(F.col("instance").alias("di"), F.col("s").alias("ds"), F.col("r").alias("dr"), F.col("o").alias("do"))
        found = cites.join(d, (F.col("instance") == F.col("di")) & (F.col("ps") == F.col("ds")) & (F.col("pr") == F.col("dr")) & (F.col("po") == F.col("do"))).select("instance", "s", "r", "o").distinct()
        delta = materialize(found.join(done, ["instance", "s", "r", "o"], "left_anti").withColumn("step", F.lit(step)))
        if delta.isEmpty():
            break
        done = done.unionByName(delta)
        if step % 20 == 0:  # one table again, so that a long chain does not grow the plan
            done = materialize(done)
    return done


def upsert(stored: DataFrame, arriving: DataFrame) -> DataFrame:
    """Insert new quads and lift the confidence of repeated ones, as one aggregation over both tables."""
    both = stored.select(*KEY, "confidence").unionByName(arriving.select(*KEY, "confidence"))
    return both.groupBy(*KEY).agg(C.repeated(C.level(F.max(C.rank(F.col("confidence")))), F.count("*")).alias("confidence"), (F.count("*") - 1).alias("agreement_count"))


def insert_new(stored: DataFrame, arriving: DataFrame) -> DataFrame:
    """The arriving quads that are not stored yet, once each."""
    return edges(arriving).join(edges(stored), KEY, "left_anti")


def staged(stored: DataFrame, arriving: DataFrame) -> DataFrame:
    """(KEY, confidence, outcome): what becomes of each arriving quad (KEY, confidence, source_type, conditions).

    "X can be Y" is taken as a possibility (can_be). A quad with a name that is none is invalid, one that is stored
    already is repeated and lifts the stored confidence, any other is new, at the confidence that its source gives it.
    """
    possible = (F.col("relation") == "can") & F.rlike("object", F.lit("^be[ _]."))
    level = C.assigned(F.col("confidence"), F.col("source_type"), F.size("conditions") > 0)
    rows = arriving.select(
        "instance", "subject", F.when(possible, "can_be").otherwise(F.col("relation")).alias("relation"), F.when(possible, F.regexp_replace("object", "^be[ _]+", "")).otherwise(F.col("object")).alias("object"), C.rank(level).alias("k"),
    )
    rows = rows.where(" and ".join(f"{c} is not null" for c in KEY)).groupBy(*KEY).agg(F.max("k").alias("k"))
    known = edges(stored).withColumn("known", F.lit(True))
    valid = T.valid_entity(F.col("subject")) & T.valid_entity(F.col("object"))
    outcome = F.when(~valid, "invalid").when(F.col("known"), "repeated").otherwise("new")
    return rows.join(known, KEY, "left").select(*KEY, C.level(F.col("k")).alias("confidence"), outcome.alias("outcome"))


def add_facts(stored: DataFrame, arriving: DataFrame) -> dict[str, DataFrame]:
    """The whole insertion of a batch: "facts" after it (quads with confidence and agreement), the "conflicts" with what
    is stored, and the "outcomes" of staged()."""
    outcomes = materialize(staged(stored, arriving))
    taken = outcomes.where("outcome <> 'invalid'")
    plain = lambda rows: rows.select(F.col("instance").alias("g"), F.col("subject").alias("s"), F.col("relation").alias("r"), F.col("object").alias("o"))
    return {"facts": upsert(stored, taken), "conflicts": reasoning.contradictions(plain(edges(stored)), fresh=plain(taken)), "outcomes": outcomes}


def forget(facts: DataFrame, speaker: str | None = None, entity: str | None = None, instance: str | None = None) -> DataFrame:
    """facts without those of a speaker, about an entity as subject, or of an instance; all given parts must hold.

    With nothing given no fact is left.
    """
    parts = {"speaker": F.lower(F.trim("speaker_id")) == (speaker or "").strip().lower(), "entity": F.col("subject") == entity, "instance": F.col("instance") == instance}
    given = [parts[k] for k, v in (("speaker", speaker), ("entity", entity), ("instance", instance)) if v is not None]
    return without(facts, reduce(lambda a, b: a & b, given)) if given else facts.limit(0)


def constrained(facts: DataFrame, refinements: DataFrame) -> DataFrame:
    """facts with the conditions of refinements (KEY, condition) added to theirs, each once."""
    more = refinements.where("condition is not null").groupBy(*KEY).agg(F.array_sort(F.collect_set("condition")).alias("__more"))
    joined = facts.join(more, KEY, "left")
    empty = F.array().cast("array<string>")
    return joined.withColumn("conditions", F.array_union(F.coalesce("conditions", empty), F.coalesce("__more", empty))).select(*facts.columns)


def without(facts: DataFrame, condition: Column) -> DataFrame:
    """facts without the rows of a condition; rows for which it is unknown stay."""
    return facts.where(~F.coalesce(condition, F.lit(False)))
