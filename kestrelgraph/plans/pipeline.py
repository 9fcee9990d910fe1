"""Queries of the general data-pipeline problems: repeated deliveries, hierarchies, trailing periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelgraph.operators import delivery, hierarchy, rolling
from kestrelgraph.runtime import materialize, scratch_path, table

MEASURES = {"in": "input_tokens", "out": "output_tokens"}


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.repeats(table(spark, sf_dir, "turns"), "message_id", "id", ["id"])


def p2_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.once(table(spark, sf_dir, "turns"), "message_id", "id")


def _forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "facts").where("relation = 'part_of'")
    return hierarchy.forest(hierarchy.links(rows, F.col("instance"), F.col("subject"), F.col("object")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forest(spark, sf_dir).select(F.col("g").alias("instance"), "node", "root", "depth", "path")


def p3_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.descendants(_forest(spark, sf_dir)).withColumnRenamed("g", "instance")


def _state(spark: SparkSession, sf_dir: str) -> rolling.State:
    """The rolling state of every working directory, a version for each month in which its files were delivered.

    A file's delivery date is in its path; rows of earlier days come late and correct what has been computed.
    """
    kept = delivery.once(table(spark, sf_dir, "turns"), "message_id", "id", ["timestamp", "cwd", "batch_path", *MEASURES.values()])
    month = F.coalesce(F.nullif(F.regexp_extract("batch_path", r"/(\d{4}-\d{2})-\d{2}/", 1), F.lit("")), F.date_format("timestamp", "yyyy-MM"))
    arrivals = materialize(rolling.daily(kept.withColumn("period", month), "cwd", "timestamp", MEASURES, "period"))
    return rolling.replay(arrivals, "period", scratch_path(spark), list(MEASURES))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(spark, sf_dir).totals().select(F.col("entity").alias("cwd"), F.date_format("day", "yyyy-MM-dd").alias("activity_date"), "in_7", "in_30", "out_7", "out_30")


def p5_recomputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dates that each version recomputed: new days, and those that late rows reach."""
    text = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return _state(spark, sf_dir).recomputed().select("version", F.col("entity").alias("cwd"), text("from_day"), text("to_day"))


def p5_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = rolling.averages(_state(spark, sf_dir).totals(), list(MEASURES))
    return means.select(
        F.col("entity").alias("cwd"), F.date_format("day", "yyyy-MM-dd").alias("activity_date"), *[F.round(f"avg_{m}_{s}", 6).alias(f"avg_{m}_{s}") for m in MEASURES for s in rolling.SPANS]
    )


QUERIES = {"p2_found": p2_found, "p2_once": p2_once, "p3_found": p3_found, "p3_descendants": p3_descendants, "p5_found": p5_found, "p5_averages": p5_averages, "p5_recomputed": p5_recomputed}

_KEPT = """
kept as (
  select * from (
    select *, row_number() over (partition by case when message_id is null or message_id = '' then 'row ' || id else 'message ' || message_id end order by id) as copy
    from turns)
  where copy = 1)"""
_DAYS = f"""{_KEPT},
days as (
  select cwd, cast("timestamp" as date) as d, coalesce(sum(input_tokens), 0) as i, coalesce(sum(output_tokens), 0) as o
  from kept where "timestamp" is not null and cwd is not null group by 1, 2),
grid as (select cwd, cast(unnest(generate_series(min(d), max(d), interval 1 day)) as date) as d from days group by cwd),
filled as (select g.cwd, g.d, coalesce(days.i, 0) as i, coalesce(days.o, 0) as o from grid g left join days using (cwd, d)),
totals as (
  select cwd, strftime(d, '%Y-%m-%d') as activity_date,
    cast(sum(i) over week as bigint) as in_7, cast(sum(i) over month as bigint) as in_30,
    cast(sum(o) over week as bigint) as out_7, cast(sum(o) over month as bigint) as out_30
  from filled
  window week as (partition by cwd order by d rows between 6 preceding and current row),
    month as (partition by cwd order by d rows between 29 preceding and current row))"""
_TREES = """
names as (
  select instance, lower(replace(trim(subject), ' ', '_')) as node, lower(replace(trim(object), ' ', '_')) as parent
  from facts where relation = 'part_of'),
up as (select instance, node, min(parent) as parent from names group by 1, 2),
nodes as (select instance, node from up union select instance, parent from up),
walk as (
  select n.instance, n.node, n.node as top, [n.node] as trail, false as turned from nodes n
  union all
  select w.instance, w.node, u.parent, list_prepend(u.parent, w.trail), list_contains(w.trail, u.parent)
  from walk w join up u on u.instance = w.instance and u.node = w.top where not w.turned),
trees as (
  select w.instance, w.node, w.top as root, len(w.trail) - 1 as depth, w.trail
  from walk w left join up u on u.instance = w.instance and u.node = w.top where u.node is null),
turns_back as (
  select instance, node, top, list_slice(trail, 1, list_position(list_slice(trail, 2, len(trail)), top)) as ring
  from walk where turned),
rings as (
  select instance, node, list_min(ring) as root, case when list_contains(ring, node) then -1 else -2 end as depth from turns_back)"""
SQL = {
    "p2_found": f"with {_KEPT} select id from turns where id not in (select id from kept)",
    "p2_once": f"with {_KEPT} select * exclude (copy) from kept",
    "p3_found": f"""with recursive {_TREES}
select instance, node, root, cast(depth as bigint) as depth, array_to_string(trail, '/') as path from trees
union all select instance, node, root, cast(depth as bigint), '' from rings""",
    "p3_descendants": f"""with recursive {_TREES},
pairs as (select instance, node as descendant, depth, unnest(trail) as node, unnest(range(len(trail))) as pos from trees)
select instance, node, descendant, cast(depth - pos as bigint) as distance from pairs where pos < depth""",
    "p5_found": f"with {_DAYS} select * from totals",
    "p5_recomputed": f"""with {_KEPT},
days as (
  select cwd, cast("timestamp" as date) as d, coalesce(nullif(regexp_extract(batch_path, '/([0-9]{{4}}-[0-9]{{2}})-[0-9]{{2}}/', 1), ''), strftime("timestamp", '%Y-%m')) as period
  from kept where "timestamp" is not null and cwd is not null),
bounds as (select cwd, period, min(d) as low, max(d) as high from days group by 1, 2),
old as (
  select *, min(low) over w as old_first, max(high) over w as old_last from bounds
  window w as (partition by cwd order by period rows between unbounded preceding and 1 preceding))
select (select count(distinct period) from bounds b where b.period <= old.period)::int as version, cwd, strftime(case when old_last < low then old_last + 1 else low end, '%Y-%m-%d') as from_day,
  strftime(least(greatest(high, coalesce(old_last, high)), greatest(high + 29, coalesce(old_first, high))), '%Y-%m-%d') as to_day from old""",
    "p5_averages": f"""with {_DAYS}
select cwd, activity_date, round(in_7 / 7.0, 6) as avg_in_7, round(in_30 / 30.0, 6) as avg_in_30, round(out_7 / 7.0, 6) as avg_out_7, round(out_30 / 30.0, 6) as avg_out_30 from totals""",
}
