"""Attribute frames: slots of concepts with a confirmed and a potential tier, their similarity, bridges and prototypes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Slots by relation, and the weights of values shared in both tiers, in the potential one, across tiers.
SLOT_OF = {
    "color": "color",
    "is_color": "color",
    "size": "size",
    "lives_in": "habitat",
    "is_in": "habitat",
    "found_in": "habitat",
    "live_in": "habitat",
    "habitat_type": "habitat",
    "eats": "diet",
    "diet": "diet",
    "hunts": "diet",
    "can": "abilities",
    "has": "body_parts",
    "has_property": "traits",
    "needs": "needs",
    "makes": "produces",
    "communicates_via": "behaviors",
    "pollinates": "behaviors",
    "orbits": "behaviors",
}
#: Share of a similarity that is the categories' own, where both concepts have any; similarity that is written back.
CATEGORY_SHARE, WRITTEN_FROM = 0.3, 0.7
CONFIRMED, POTENTIAL, CROSS = 1.0, 0.5, 0.3
REVERSE = ["belongs_to", "has_instance", "is_color_of", "provided_by", "orbited_by", "damaged_by", "pollinated_by", "helped_by", "eaten_by"]
CATEGORY = ["is", "is_a", "type_of", "kind_of"]


def slots(facts: DataFrame) -> DataFrame:
    """(concept, attribute, value, confirmed) from facts (s, r, o, confidence); a confirmed value absorbs a potential one.

    "can be X" makes X a possible trait, low confidence a potential value. Relations without a slot of their own make
    one of their name if it has more than two letters and no "_" among the first three.
    """
    r, o = F.col("r"), F.col("o")
    maybe = (r == "can") & F.rlike(o, F.lit("^be[ _]."))
    known = F.coalesce(*[F.when(r == k, F.lit(v)) for k, v in SLOT_OF.items()])
    own = F.when((F.length(r) > 2) & ~F.contains(F.substring(r, 1, 3), F.lit("_")), r)
    rows = facts.where(~r.isin(REVERSE) & ~r.isin(CATEGORY) & (o != "") & (F.col("s") != ""))
    rows = rows.select(
        F.col("s").alias("concept"), F.when(maybe, "traits").otherwise(F.coalesce(known, own)).alias("attribute"),
        F.when(maybe, F.regexp_replace(o, "^be[ _]+", "")).otherwise(o).alias("value"), (~maybe & (F.coalesce("confidence", F.lit("medium")) != "low")).alias("sure"),
    )
    return rows.where("attribute is not null").groupBy("concept", "attribute", "value").agg(F.bool_or("sure").alias("confirmed"))


def _pairs(frames: DataFrame) -> DataFrame:
    """One row for each value that two concepts a < b share in an attribute."""
    x = frames.select(F.col("concept").alias("a"), "attribute", "value", F.col("confirmed").alias("ca"))
    y = frames.select(F.col("concept").alias("b"), "attribute", "value", F.col("confirmed").alias("cb"))
    return x.join(y, ["attribute", "value"]).where("a < b")


def tier_weight(ca: Column, cb: Column) -> Column:
    return F.when(ca & cb, CONFIRMED).when(~ca & ~cb, POTENTIAL).otherwise(CROSS)


def similarity(frames: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """(a, b, similarity): weighted shared values over the union of values in the attributes that both concepts have.

    Only pairs that share a value get a row, so everything else is 0. With categories (category, member) the similarity
    of the category sets counts for CATEGORY_SHARE where both concepts have categories.
    """
    sizes = frames.groupBy("concept", "attribute").agg(F.count("*").alias("n"))
    shared = _pairs(frames).groupBy("a", "b", "attribute").agg(F.sum(tier_weight(F.col("ca"), F.col("cb"))).alias("w"), F.count("*").alias("k"))
    pairs = shared.select("a", "b").distinct()
    na = sizes.select(F.col("concept").alias("a"), "attribute", F.col("n").alias("na"))
    nb = sizes.select(F.col("concept").alias("b"), "attribute", F.col("n").alias("nb"))
    both = pairs.join(na, "a").join(nb, ["b", "attribute"]).join(shared, ["a", "b", "attribute"], "left")
    total = both.groupBy("a", "b").agg(F.sum(F.coalesce("w", F.lit(0.0))).alias("w"), F.sum(F.col("na") + F.col("nb") - F.coalesce("k", F.lit(0))).alias("u"))
    own = total.select("a", "b", (F.col("w") / F.col("u")).alias("x"))
    if categories is None:
        return own.select("a", "b", F.round("x", 6).alias("similarity"))
    c = categories.select("member", "category").distinct()
    n = c.groupBy("member").agg(F.count("*").alias("n"))
    side = lambda k: n.select(F.col("member").alias(k), F.col("n").alias(f"c{k}"))
    both = own.select("a", "b").join(c.select(F.col("member").alias("a"), "category"), "a").join(c.select(F.col("member").alias("b"), "category"), ["b", "category"]).groupBy("a", "b").agg(F.count("*").alias("both"))
    joined = own.join(side("a"), "a", "left").join(side("b"), "b", "left").join(both, ["a", "b"], "left")
    k = F.coalesce("both", F.lit(0))
    blended = (1 - CATEGORY_SHARE) * F.col("x") + CATEGORY_SHARE * k / (F.col("ca") + F.col("cb") - k)
    return joined.select("a", "b", F.round(F.coalesce(blended, "x"), 6).alias("similarity"))


def written_back(similar: DataFrame, facts: DataFrame) -> DataFrame:
    """(s, r, o, confidence): similar_to facts, both ways, of pairs from WRITTEN_FROM on of which neither way is stated."""
    stated = facts.where("r = 'similar_to'").select(F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b")).distinct()
    new = similar.where(F.col("similarity") >= WRITTEN_FROM).join(stated, ["a", "b"], "left_anti")
    ways = F.array(F.struct(F.col("a").alias("s"), F.col("b").alias("o")), F.struct(F.col("b").alias("s"), F.col("a").alias("o")))
    return new.select(F.explode(ways).alias("w")).select("w.s", F.lit("similar_to").alias("r"), "w.o", F.lit("medium").alias("confidence"))


def described(frames: DataFrame) -> DataFrame:
    """(concept, text): a frame as text: its attributes in order with their values, confirmed ones first, "?" behind potential ones."""
    value = F.struct((~F.col("confirmed")).alias("k"), F.concat("value", F.when(F.col("confirmed"), "").otherwise("?")).alias("v"))
    slots_ = frames.groupBy("concept", "attribute").agg(F.array_join(F.transform(F.array_sort(F.collect_list(value)), lambda x: x["v"]), ", ").alias("vs"))
    return slots_.groupBy("concept").agg(F.array_join(F.array_sort(F.collect_list(F.concat("attribute", F.lit(": "), "vs"))), "; ").alias("text"))


def save(frames: DataFrame, path: str) -> None:
    """A snapshot: one JSON row for each concept and attribute with its confirmed and potential values; empty slots are left out."""
    tier = lambda sure: F.array_sort(F.collect_set(F.when(F.col("confirmed") == F.lit(sure), F.col("value"))))
    frames.groupBy("concept", "attribute").agg(tier(True).alias("confirmed"), tier(False).alias("potential")).write.mode("overwrite").json(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The frames of a snapshot; the older form, in which a slot is one list of values, holds confirmed ones."""
    rows = spark.read.schema("concept string, attribute string, confirmed array<string>, potential array<string>, values array<string>").json(path)
    sure = F.transform(F.concat(F.coalesce("confirmed", F.array()), F.coalesce("values", F.array())), lambda v: F.struct(v.alias("value"), F.lit(True).alias("confirmed")))
    maybe = F.transform(F.coalesce("potential", F.array()), lambda v: F.struct(v.alias("value"), F.lit(False).alias("confirmed")))
    return rows.select("concept", "attribute", F.explode(F.concat(sure, maybe)).alias("v")).select("concept", "attribute", "v.value", "v.confirmed")


def bridges(frames: DataFrame) -> DataFrame:
    """(a, b, attribute, confirmed, potential, cross_tier, strength): what two concepts share in one attribute."""
    ca, cb = F.col("ca"), F.col("cb")
    return _pairs(frames).groupBy("a", "b", "attribute").agg(
        F.count_if(ca & cb).alias("confirmed"), F.count_if(~ca & ~cb).alias("potential"), F.count_if(ca != cb).alias("cross_tier"), F.round(F.sum(tier_weight(ca, cb)), 6).alias("strength")
    )


def clusters(members: DataFrame, least: int = 2) -> DataFrame:
    """(category, members, confidence) of (category, member): categories of at least `least` members."""
    n = members.distinct().groupBy("category").agg(F.count("*").alias("members")).where(F.col("members") >= least)
    return n.withColumn("confidence", F.round(F.least(F.lit(1.0), 0.2 * F.col("members")), 6))


def prototypes(members: DataFrame, frames: DataFrame, share: float = 0.5) -> DataFrame:
    """(category, attribute, value, holders): values that at least a share of a category's members confirm."""
    sizes = members.distinct().groupBy("category").agg(F.count("*").alias("n"))
    held = members.distinct().join(frames.where("confirmed"), F.col("member") == F.col("concept")).groupBy("category", "attribute", "value").agg(F.count("*").alias("holders"))
    return held.join(sizes, "category").where(F.col("holders") >= share * F.col("n")).select("category", "attribute", "value", "holders")


def propagation(similar: DataFrame, categories: DataFrame, least: float = 0.4) -> DataFrame:
    """(concept, category, similarity): categories offered to concepts that are similar to a member and lack them."""
    both = similar.select(F.col("a").alias("x"), F.col("b").alias("y"), "similarity").unionByName(similar.select(F.col("b").alias("x"), F.col("a").alias("y"), "similarity"))
    offers = both.where(F.col("similarity") >= least).join(categories.select(F.col("member").alias("y"), "category"), "y")
    best = offers.groupBy(F.col("x").alias("concept"), "category").agg(F.max("similarity").alias("similarity"))
    return best.join(categories.select(F.col("member").alias("concept"), "category"), ["concept", "category"], "left_anti")


def cycle(facts: DataFrame, categories: DataFrame) -> dict[str, DataFrame]:
    """Everything that is recomputed from facts (s, r, o, confidence) and categories (category, member): the slots without
    empty values, bridges, clusters with prototypes, similarities, what is written back, and categories offered."""
    own = slots(facts)
    similar = similarity(own, categories)
    return {
        "slots": own, "bridges": bridges(own), "clusters": clusters(categories), "prototypes": prototypes(categories, own),
        "similarity": similar, "written": written_back(similar, facts), "offered": propagation(similar, categories),
    }
