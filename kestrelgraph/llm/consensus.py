"""Consensus labels, agreement and annotator reliability from votes that disagree.

Two annotators agree by chance to a known degree. Over the items both labelled, their centred agreement S is about the
overlap O times the product of their reliabilities. With D the overlap of each annotator with all others, the leading
eigenvector u of D^-1/2 S D^-1/2 is, up to its length, D^1/2 times the reliabilities; one least-squares factor gives the
length. The matrix is never built: each power step sums over an item's votes and back (two sparse joins), so an item
with many votes emits no pairs. The votes are stored bucketed by item once; a step moves the annotators' vector only.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from kestrelgraph.runtime import materialize, scratch_path

#: Power steps after which the iteration is given up with an error, and from which it is shifted, as two eigenvalues of
#: opposite sign and equal size would alternate for ever; residual, as a share of the eigenvalue, at which it ends.
STEPS, SHIFT_FROM, TOLERANCE = 200, 30, 0.005
#: Votes of one item from which it is hot: dealt over several buckets and pre-aggregated instead of summed in one task.
HOT_ITEM = 100_000
SALTS = 64
#: Votes in one bucket.
BUCKET_VOTES = 500_000
#: Reliability of somebody who shares no item with anyone.
UNKNOWN = 0.5
#: Accuracy is held inside these bounds, so no annotator decides an item alone.
LEAST_ACCURACY, MOST_ACCURACY = 0.02, 0.99
#: Weight of a supporter that is only counted, not named, against a named one of average accuracy.
UNNAMED = 0.25


def person(name: Column) -> Column:
    """A speaker's name without letter case and outer blanks; null for no name."""
    return F.when(F.trim(name) != "", F.lower(F.trim(name)))


def review_votes(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(votes, claims) of the review facts.

    votes (g, s, r, label, who): who stated label for the item (g, s, r). A row's speaker, or else its corrector,
    and everyone in agreed_by state its object; the original speaker stated original_value. Naming somebody twice, or
    the speaker among those who agree, gives one vote. claims (g, s, r, label, unnamed) has every value that occurs,
    with the number of supporters that agreement_count has beyond the named ones.
    """
    rows = facts.where("context = 'review'").select(
        F.col("instance").alias("g"), F.col("subject").alias("s"), F.col("relation").alias("r"), "object", "original_value", "agreement_count",
        F.coalesce(person(F.col("speaker_id")), person(F.col("corrected_by"))).alias("who"), person(F.col("original_speaker_id")).alias("was"),
        F.array_distinct(F.transform(F.coalesce("agreed_by", F.array().cast("array<string>")), person)).alias("others"),
    )
    said = F.transform(F.array_union(F.array("who"), F.col("others")), lambda w: F.struct(F.col("object").alias("label"), w.alias("who")))
    before = F.array(F.struct(F.col("original_value").alias("label"), F.col("was").alias("who")))
    votes = rows.select("g", "s", "r", F.explode(F.concat(said, before)).alias("v")).select("g", "s", "r", "v.label", "v.who")
    votes = votes.where("label is not null and who is not null").distinct()
    extra = F.greatest(F.coalesce("agreement_count", F.lit(0)) - F.size("others"), F.lit(0))
    claims = rows.select(
        "g", "s", "r", F.explode(F.array(F.struct(F.col("object").alias("label"), extra.alias("unnamed")), F.struct(F.col("original_value").alias("label"), F.lit(0).cast("bigint").alias("unnamed")))).alias("c")
    ).select("g", "s", "r", "c.*").where("label is not null")
    return votes, claims.groupBy("g", "s", "r", "label").agg(F.max("unnamed").alias("unnamed"))


def weigh(votes: DataFrame) -> DataFrame:
    """votes with share (1/k for an annotator who stated k labels of an item) and the chance agreement and number of
    labels of the item's relation."""
    item = Window.partitionBy("g", "s", "r", "who")
    votes = votes.withColumn("share", 1.0 / F.count("*").over(item))
    freq = votes.groupBy(F.col("r").alias("cr"), "label").count()
    chance = freq.groupBy("cr").agg((F.sum(F.col("count") * F.col("count")) / (F.sum("count") * F.sum("count"))).alias("chance"), F.count("*").alias("labels"))
    return votes.join(chance, F.col("r").eqNullSafe(F.col("cr"))).drop("cr")


def _bucketed(weighted: DataFrame) -> tuple[str, bool]:
    """(table, whether there are hot items): the votes stored in buckets by item and salt, so that sums by item need no
    shuffle. The votes of a hot item are dealt over SALTS buckets."""
    rows = weighted.select(F.xxhash64("g", "s", "r").alias("item"), F.xxhash64("label").alias("claim"), "who", "share", "chance")
    counts = rows.groupBy("item").count().where(F.col("count") > HOT_ITEM).select("item", F.lit(True).alias("hot"))
    hot_items = materialize(counts)  # few: votes / HOT_ITEM
    any_hot = not hot_items.isEmpty()
    if any_hot:
        rows = rows.join(hot_items, "item", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("who"), F.lit(SALTS))).otherwise(0).cast("int"))
    else:
        rows = rows.withColumn("salt", F.lit(0))
    rows = rows.select("item", "salt", "claim", "who", "share", "chance", (F.col("hot") if any_hot else F.lit(False)).alias("hot"))
    spark = rows.sparkSession
    buckets = max(spark.sparkContext.defaultParallelism, -(-weighted.count() // BUCKET_VOTES))
    name = f"kestrel_votes_{uuid.uuid4().hex}"
    placed = rows.repartition(buckets, "item", "salt")
    placed.write.bucketBy(buckets, "item", "salt").sortBy("item", "salt", "claim").option("path", scratch_path(spark)).saveAsTable(name)
    return name, any_hot


def _sums(v: DataFrame, any_hot: bool) -> DataFrame:
    """v with cy, iy and iyy: the sums of share times y by claim and by item, and of share times y squared by item.

    Ordinary items are summed inside their bucket. A hot item's sums by salt are added up and dealt to its salts again,
    so no task gets all votes of one.
    """
    key = ["item", "salt"]
    wy, wyy = F.col("share") * F.col("y"), F.col("share") * F.col("y") * F.col("y")
    item, claim = Window.partitionBy(*key), Window.partitionBy(*key, "claim")
    out = v.select("*", F.sum(wy).over(claim).alias("cy"), F.sum(wy).over(item).alias("iy"), F.sum(wyy).over(item).alias("iyy"))
    if not any_hot:
        return out
    cold, hot = out.where("coalesce(hot, false) = false"), v.where("hot")
    claims = hot.groupBy("item", "claim").agg(F.sum(wy).alias("cy"), F.sum(wyy).alias("cyy"))
    whole = claims.groupBy("item").agg(F.sum("cy").alias("iy"), F.sum("cyy").alias("iyy"))
    dealt = claims.join(whole, "item").select("item", "claim", "cy", "iy", "iyy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return cold.unionByName(hot.join(dealt, ["item", "claim", "salt"]).select(*out.columns))


def reliability(weighted: DataFrame) -> DataFrame:
    """(who, accuracy, reliability, votes) by power iteration from the all-equal vector.

    It ends when the residual of the eigenvector is below TOLERANCE of its eigenvalue, and raises if it does not in STEPS.
    Where nobody agrees beyond chance everybody is at chance. reliability is 1 for always right, 0 for chance, below 0
    for worse than chance.
    """
    name, any_hot = _bucketed(weighted)
    votes = weighted.sparkSession.table(name)
    guess = weighted.groupBy("who").agg(F.sum("share").alias("votes"), F.avg(F.lit(1.0) / F.col("labels")).alias("guess"))
    agree = F.col("share") * (F.col("cy") - F.col("share") * F.col("y")) - F.col("share") * F.col("chance") * (F.col("iy") - F.col("share") * F.col("y"))
    # the overlap with others, weighed by y squared at both ends
    over = F.col("share") * (1 - F.col("chance")) * F.col("y") * F.col("y") * (F.col("iyy") - F.col("share") * F.col("y") * F.col("y"))
    seen = lambda v: _sums(v, any_hot).groupBy("who").agg(F.sum(agree).alias("sy"), F.sum(over).alias("o"))
    start = materialize(seen(votes.withColumn("y", F.lit(1.0))).where("o > 0"))  # with y = 1, o is D
    total = start.agg(F.sum("o")).first()[0] or 0.0
    if not total:
        x = guess.select("who", F.lit(UNKNOWN).alias("x"))
    else:
        root = F.sqrt("d")
        state = start.select("who", F.col("o").alias("d"), (F.sqrt("o") / math.sqrt(total)).alias("u"))
        shift, size, value, fit = 0.0, 1.0, 0.0, 0.0
        for step in range(1, STEPS + 1):
            y = state.select("who", (F.col("u") / root).alias("y"))
            got = seen(votes.join(y, "who")).withColumnRenamed("who", "v")
            watch = Observation()
            new = state.join(got, F.col("who") == F.col("v")).select("who", "d", "u", (F.col("sy") / root).alias("mu"), "o")
            new = materialize(new.observe(watch, F.sum(F.col("u") * F.col("mu")).alias("value"), F.sum(F.col("mu") * F.col("mu")).alias("size"), F.sum("o").alias("fit")))
            value, size, fit = (watch.get[k] or 0.0 for k in ("value", "size", "fit"))
            if size - value * value <= (TOLERANCE * value) ** 2 + 1e-18:
                break
            if step == SHIFT_FROM:
                shift = math.sqrt(size)
            norm = math.sqrt(size + 2 * shift * value + shift * shift)
            state = new.select("who", "d", ((F.col("mu") + shift * F.col("u")) / norm).alias("u"))
        else:
            raise RuntimeError(f"the agreement matrix has no leading eigenvector after {STEPS} steps: residual {math.sqrt(size - value * value)}, eigenvalue {value}")
        scale = math.sqrt(max(0.0, value) / fit) if fit else 0.0
        x = state.select("who", (scale * F.col("u") / root).alias("x"))
        x = guess.select("who").join(x, "who", "left").select("who", F.coalesce("x", F.lit(UNKNOWN)).alias("x"))
    accuracy = F.greatest(F.least(F.col("x") * (1 - F.col("guess")) + F.col("guess"), F.lit(MOST_ACCURACY)), F.lit(LEAST_ACCURACY))
    people = materialize(guess.join(x, "who").select("who", accuracy.alias("accuracy"), F.col("x").alias("reliability"), "votes"))
    weighted.sparkSession.sql(f"drop table {name}")  # the scratch folder goes with the process
    return people


def scores(votes: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scored, annotators): scored (g, s, r, label, score, n) has for each claim the sum of log odds of those who
    stated it, with UNNAMED for each unnamed supporter, and the number of named votes."""
    weighted = materialize(weigh(votes))
    people = reliability(weighted)
    odds = F.log(F.col("accuracy") * (F.col("labels") - 1) / (1 - F.col("accuracy")))
    scored = weighted.where("labels > 1").join(people.select("who", "accuracy"), "who").groupBy("g", "s", "r", "label").agg(F.sum(odds * F.col("share")).alias("score"), F.sum("share").alias("n"))
    c = claims.join(
        scored.select(*[F.col(x).alias(f"v_{x}") for x in ("g", "s", "r", "label", "score", "n")]),
        F.col("g").eqNullSafe(F.col("v_g")) & F.col("s").eqNullSafe(F.col("v_s")) & F.col("r").eqNullSafe(F.col("v_r")) & (F.col("label") == F.col("v_label")),
        "left",
    ).select("g", "s", "r", "label", (F.coalesce("v_score", F.lit(0.0)) + UNNAMED * F.col("unnamed")).alias("score"), F.coalesce("v_n", F.lit(0.0)).alias("n"))
    return c, people


def consensus(votes: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels, annotators).

    labels (g, s, r, label, agreement, values, top): the label with the highest score; agreement is the share of named
    votes for it, top its score. A tie goes to more votes, then to the alphabetically first label. An item that nobody
    named stated is decided by the number of unnamed supporters in the same way. Empty input gives no rows.
    """
    c, people = scores(votes, claims)
    return _best(c), people


def _best(c: DataFrame) -> DataFrame:
    # the alphabetically first of equals: compare on the score, then the votes, then the label the other way round
    first = c.groupBy("g", "s", "r", "score", "n").agg(F.min("label").alias("label"), F.count("*").alias("k"))
    best = F.max_by(F.struct("label", "score", "n"), F.struct("score", "n")).alias("b")
    done = first.groupBy("g", "s", "r").agg(best, F.sum(F.col("n") * F.col("k")).alias("all_n"), F.sum("k").alias("values"))
    return done.select("g", "s", "r", F.col("b.label").alias("label"), F.try_divide(F.col("b.n"), F.col("all_n")).alias("agreement"), "values", F.col("b.score").alias("top"))


def confidences(votes: DataFrame, claims: DataFrame) -> DataFrame:
    """The labels of consensus() with confidence, the label's posterior share among the item's values."""
    c = materialize(scores(votes, claims)[0])
    labels = materialize(_best(c))
    t = labels.select(F.col("g").alias("tg"), F.col("s").alias("ts"), F.col("r").alias("tr"), F.col("top").alias("t"))
    same = F.col("g").eqNullSafe(F.col("tg")) & F.col("s").eqNullSafe(F.col("ts")) & F.col("r").eqNullSafe(F.col("tr"))
    mass = c.join(t, same).groupBy("tg", "ts", "tr").agg(F.sum(F.exp(F.col("score") - F.col("t"))).alias("mass"))
    return labels.join(mass, same).select("g", "s", "r", "label", "agreement", "values", (1 / F.col("mass")).alias("confidence"))
