"""Time-driven state in closed form: decay, access, staleness, priming, edge weights and question priority.

The current time is always an argument, so a result can be repeated.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrelgraph.runtime import ship

# Activation decay a tick, and the level below which it ends; edge weights and what moves them.
DECAY, GONE = 0.88, 0.01
WEIGHT, LEAST_WEIGHT, MOST_WEIGHT, WEAKEN = 1.0, 0.1, 5.0, 0.05
RECENT, THRESHOLD_SHARE, STRENGTHEN = 20, 0.8, 0.2
CORE_FROM, STALE_HOURS, SPARED_FROM = 20, 24, 10
# Question weights by type.
TYPE_WEIGHT = {"open": 10, "contradiction": 6, "chain_gap": 5, "origin": 4, "inference": 3, "low_confidence": 3, "missing_property": 2, "causal_effect": 2, "rule": 1}


def decayed(level: Column, ticks: Column) -> Column:
    """A level after some ticks; null once it has faded."""
    now = level * F.pow(F.lit(DECAY), ticks)
    return F.when(now >= GONE, now)


def weakened(weight: Column, ticks: Column) -> Column:
    return F.greatest(weight - WEAKEN * ticks, F.lit(LEAST_WEIGHT))


def access(events: DataFrame, entity: str) -> DataFrame:
    """(entity, accesses, reinforcements, core): every fifth access strengthens an entity, twenty make it core."""
    n = events.groupBy(F.col(entity).alias("entity")).agg(F.count("*").alias("accesses"))
    return n.select("entity", "accesses", F.floor(F.col("accesses") / 5).alias("reinforcements"), (F.col("accesses") >= CORE_FROM).alias("core"))


def staleness(last: DataFrame, now: Column) -> DataFrame:
    """(entity, idle_hours, level, demoted) from (entity, at, accesses, level): one level down after a day without use.

    Entities with ten accesses or more are spared.
    """
    idle = (F.unix_micros(now) - F.unix_micros("at")) / 3.6e9
    stale = (idle >= STALE_HOURS) & (F.col("accesses") < SPARED_FROM)
    lower = F.when(F.col("level") == "high", "medium").otherwise("low")
    return last.select("entity", F.floor(idle).alias("idle_hours"), F.when(stale, lower).otherwise(F.col("level")).alias("level"), (stale & (F.col("level") != "low")).alias("demoted"))


def bursts(events: DataFrame, entity: str, at: str, gap_seconds: int) -> DataFrame:
    """(entity, first, last, events): runs of events no further apart than the gap."""
    w = Window.partitionBy("entity").orderBy("t")
    rows = events.select(F.col(entity).alias("entity"), F.col(at).alias("t")).where("entity is not null and t is not null")
    new = F.when((F.unix_micros("t") - F.unix_micros(F.lag("t").over(w))) <= gap_seconds * 1_000_000, 0).otherwise(1)
    runs = rows.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    return runs.groupBy("entity", "run").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("events")).drop("run")


def edge_weights(events: DataFrame, group: str, edge: str, order: str) -> DataFrame:
    """(group, edge, weight, uses): edge weights after all uses in order, by a sliding threshold.

    A use adds half the usual amount to an edge above 0.8 of the mean weight of the most recently used edges, and one
    and a half times it to any other. The threshold depends on every earlier use, so each group is one ordered fold:
    it streams through its rows in order and keeps a group's edges only.
    """
    ship(events.sparkSession)
    kind = events.schema[group].dataType.simpleString()
    rows = events.select(F.col(group).alias("group"), F.col(edge).cast("string").alias("edge"), F.col(order).alias("at")).where("edge is not null")
    placed = rows.repartition("group").sortWithinPartitions("group", "at", "edge").select("group", "edge")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, weights, uses = None, {}, {}

        def done() -> pd.DataFrame:
            return pd.DataFrame({"group": [current] * len(weights), "edge": list(weights), "weight": [round(x, 6) for x in weights.values()], "uses": list(uses.values())})

        for pdf in batches:
            for g, e in zip(pdf["group"], pdf["edge"]):
                if g != current:
                    if weights:
                        yield done()
                    current, weights, uses = g, {}, {}
                recent = list(islice(reversed(weights.values()), RECENT))
                bar = THRESHOLD_SHARE * (sum(recent) / len(recent) if recent else WEIGHT)
                w = weights.pop(e, WEIGHT)
                weights[e] = min(MOST_WEIGHT, w + STRENGTHEN * (0.5 if w > bar else 1.5))
                uses[e] = uses.pop(e, 0) + 1
        if weights:
            yield done()

    return placed.mapInPandas(fold, f"group {kind}, edge string, weight double, uses bigint")


def priority(kind: Column, relations: Column, idle_seconds: Column) -> Column:
    """A question's priority: its type, the topic's relations (at most 2), and how long it has been left alone."""
    base = F.coalesce(*[F.when(kind == k, F.lit(float(v))) for k, v in TYPE_WEIGHT.items()], F.lit(1.0))
    idle = F.when(idle_seconds > 3600, 2.0).when(idle_seconds > 600, 1.0).otherwise(0.0)
    return base + F.least(F.lit(2.0), 0.1 * relations) + idle
