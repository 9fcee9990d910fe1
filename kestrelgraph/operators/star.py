"""The star schema's tables as facts (g, s, r, o, confidence), for reasoning over relations with a fixed meaning.

places and abilities are the instance "supply", parts the instance "catalog".
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelgraph.runtime import table
from kestrelgraph.sources import packs

SIZES = ["small", "large"]
COLORS = ["red", "blue", "green"]


def key(prefix: str, column: str):
    return F.concat(F.lit(prefix + "_"), F.col(column))


def low(column: str):
    return F.replace(F.lower(F.trim(F.col(column))), F.lit(" "), F.lit("_"))


def places(spark: SparkSession, d: str) -> DataFrame:
    """Who and what is where: nation and region, customer and supplier by nation, order by customer."""
    nation, region, customer, supplier, orders = (table(spark, d, t) for t in ("nation", "region", "customer", "supplier", "orders"))
    high = F.lit("high").alias("confidence")
    n = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    home = nation.select(F.col("n_nationkey").alias("nk"), low("n_name").alias("place"))
    c = customer.join(home, F.col("c_nationkey") == F.col("nk"))
    s = supplier.join(home, F.col("s_nationkey") == F.col("nk"))
    fact = lambda rows, subject, r, obj, conf=high: rows.select(F.lit("supply").alias("g"), subject.alias("s"), F.lit(r).alias("r"), obj.alias("o"), conf)
    status = F.when(F.col("o_orderstatus") == "F", "high").when(F.col("o_orderstatus") == "O", "medium").otherwise("low").alias("confidence")
    return (
        fact(n, low("n_name"), "part_of", low("r_name"))
        .unionByName(fact(n, low("n_name"), "is", F.lit("nation")))
        .unionByName(fact(c, key("customer", "c_custkey"), "part_of", F.col("place"), F.when(F.col("c_acctbal") < 0, "medium").otherwise("high").alias("confidence")))
        .unionByName(fact(c, key("customer", "c_custkey"), "has", low("c_mktsegment")))
        .unionByName(fact(s, key("supplier", "s_suppkey"), "located_in", F.col("place")))
        .unionByName(fact(orders, key("order", "o_orderkey"), "part_of", key("customer", "o_custkey"), status))
    )


def parts(spark: SparkSession, d: str) -> DataFrame:
    """What parts are: their type, brand, and the two words of their name."""
    p = table(spark, d, "part")
    words = F.split(F.lower(F.trim("p_name")), r"\s+")
    slot = F.when(words[0].isin(SIZES), "size").when(words[0].isin(COLORS), "color").otherwise("has_property")
    facts = F.array(
        F.struct(F.lit("is").alias("r"), low("p_type").alias("o")), F.struct(F.lit("has").alias("r"), low("p_brand").alias("o")),
        F.struct(F.lit("is").alias("r"), words[1].alias("o")), F.struct(slot.alias("r"), words[0].alias("o")),
    )
    return p.select(key("part", "p_partkey").alias("s"), F.explode(facts).alias("f")).select(F.lit("catalog").alias("g"), "s", "f.r", "f.o", F.lit("high").alias("confidence")).distinct()


def deliveries(spark: SparkSession, d: str) -> DataFrame:
    """(g, s, r, o, temporal) of each line item: that its supplier can, cannot or did deliver the part, by its return flag,
    and whether the line is closed (past) or open (currently)."""
    flag = F.when(F.col("l_returnflag") == "N", "can").when(F.col("l_returnflag") == "R", "cannot").otherwise("has")
    when = F.when(F.col("l_linestatus") == "F", "past").otherwise("currently")
    rows = table(spark, d, "lineitem").where("l_returnflag is not null")
    return rows.select(F.lit("supply").alias("g"), key("supplier", "l_suppkey").alias("s"), flag.alias("r"), key("part", "l_partkey").alias("o"), when.alias("temporal"))


def abilities(spark: SparkSession, d: str) -> DataFrame:
    """(g, s, r, o, temporal): what suppliers can, cannot and did deliver."""
    return deliveries(spark, d).distinct()


PLACES_SQL = """places as (
  select 'supply' as g, lower(replace(n_name, ' ', '_')) as s, 'part_of' as r, lower(replace(r_name, ' ', '_')) as o, 'high' as confidence from nation join region on n_regionkey = r_regionkey
  union all select 'supply', lower(replace(n_name, ' ', '_')), 'is', 'nation', 'high' from nation join region on n_regionkey = r_regionkey
  union all select 'supply', 'customer_' || c_custkey, 'part_of', lower(replace(n_name, ' ', '_')), case when c_acctbal < 0 then 'medium' else 'high' end from customer join nation on c_nationkey = n_nationkey
  union all select 'supply', 'customer_' || c_custkey, 'has', lower(replace(c_mktsegment, ' ', '_')), 'high' from customer join nation on c_nationkey = n_nationkey
  union all select 'supply', 'supplier_' || s_suppkey, 'located_in', lower(replace(n_name, ' ', '_')), 'high' from supplier join nation on s_nationkey = n_nationkey
  union all select 'supply', 'order_' || o_orderkey, 'part_of', 'customer_' || o_custkey, case o_orderstatus when 'F' then 'high' when 'O' then 'medium' else 'low' end from orders)"""
PARTS_SQL = """parts as (
  select distinct 'catalog' as g, s, r, o, 'high' as confidence from (
    select 'part_' || p_partkey as s, 'is' as r, lower(replace(p_type, ' ', '_')) as o from part
    union all select 'part_' || p_partkey, 'has', lower(replace(p_brand, ' ', '_')) from part
    union all select 'part_' || p_partkey, 'is', split_part(lower(p_name), ' ', 2) from part
    union all select 'part_' || p_partkey, case when split_part(lower(p_name), ' ', 1) in ('small', 'large') then 'size' when split_part(lower(p_name), ' ', 1) in ('red', 'blue', 'green') then 'color' else 'has_property' end, split_part(lower(p_name), ' ', 1) from part))"""
ABILITIES_SQL = """abilities as (select distinct 'supply' as g, 'supplier_' || l_suppkey as s, case l_returnflag when 'N' then 'can' when 'R' then 'cannot' else 'has' end as r, 'part_' || l_partkey as o,
  case when l_linestatus = 'F' then 'past' else 'currently' end as temporal from lineitem where l_returnflag is not null)"""


#: The built-in packs with names in one spelling, as the instance "packs".
PACKED = sorted({("packs", *[x.lower().replace(" ", "_") for x in t[1:]], "high") for t in packs.triples()})


def world(spark: SparkSession, d: str) -> DataFrame:
    """(g, s, r, o, confidence): places, parts, abilities and the built-in packs."""
    own = abilities(spark, d).select("g", "s", "r", "o", F.lit("high").alias("confidence")).distinct()
    built_in = spark.createDataFrame(PACKED, "g string, s string, r string, o string, confidence string")
    return places(spark, d).unionByName(parts(spark, d)).unionByName(own).unionByName(built_in)


WORLD_SQL = f"""{PLACES_SQL}, {PARTS_SQL}, {ABILITIES_SQL}, packed(g, s, r, o, confidence) as (values {", ".join(map(str, PACKED))}),
world as (select g, s, r, o, confidence from places union select g, s, r, o, confidence from parts union select g, s, r, o, 'high' from abilities union select * from packed)"""
