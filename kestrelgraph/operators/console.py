"""The console: slash commands as named views of one instance's facts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelgraph.operators import context, frames, insight, mining, reading, reasoning, store


def _edges(facts: DataFrame) -> DataFrame:
    return store.edges(facts).select(F.col("instance").alias("g"), F.col("subject").alias("s"), F.col("relation").alias("r"), F.col("object").alias("o"))


def _levels(facts: DataFrame) -> DataFrame:
    c = store.confidences(facts)
    return c.select(F.col("instance").alias("g"), F.col("subject").alias("s"), F.col("relation").alias("r"), F.col("object").alias("o"), "confidence")


def _members(e: DataFrame) -> DataFrame:
    return e.where("r = 'is'").select(F.col("o").alias("category"), F.col("s").alias("member")).distinct()


def _frames(facts: DataFrame) -> DataFrame:
    return frames.slots(_levels(facts).select("s", "r", "o", "confidence"))


def _about(rows: DataFrame, column: str, name: str) -> DataFrame:
    key = name.strip().lower().replace(" ", "_")
    return rows.where(F.col(column) == key) if key else rows


VIEWS: dict[str, Callable[[DataFrame, str], DataFrame]] = {
    "stats": lambda f, a: store.stats(f),
    "show": lambda f, a: _about(context.node_view(_edges(f)), "s", a),
    "compact": lambda f, a: _about(store.adjacency(f), "subject", a),
    "neuron": lambda f, a: _about(store.degrees(store.edges(f)), "node", a),
    "entities": lambda f, a: store.degrees(store.edges(f)).select("node").distinct(),
    "weights": lambda f, a: store.confidences(f),
    "frame": lambda f, a: _about(frames.described(_frames(f)), "concept", a),
    "bridges": lambda f, a: frames.bridges(_frames(f)),
    "clusters": lambda f, a: frames.clusters(_members(_edges(f))),
    "analogies": lambda f, a: insight.analogy_facts(_edges(f).select("g", F.col("s").alias("holder"), F.concat_ws("|", "r", "o").alias("value")).distinct()),
    "inferences": lambda f, a: reasoning.inferred(_levels(f).where(F.col("r").isin(reasoning.TRANSITIVE) & (F.col("s") != F.col("o")))),
    "conflicts": lambda f, a: reasoning.contradictions(_edges(f)),
    "chain": lambda f, a: _about(reasoning.chains(_levels(f).where("s <> o")), "s", a.split(" ")[0]),
    "context": lambda f, a: mining.value_classes(_edges(f)),
    "forget": lambda f, a: store.forget(f, entity=a.strip().lower().replace(" ", "_")),
    "forget-all": lambda f, a: store.forget(f),
}


def run(facts: DataFrame, text: str) -> DataFrame:
    """The view that a slash command asks for over facts; help lists the commands. Another text raises a ValueError."""
    spark = facts.sparkSession
    parsed = spark.createDataFrame([(text,)], "text string").select(reading.command(F.col("text")).alias("c")).first().c
    if parsed is None:
        raise ValueError(f"no command: {text}")
    if parsed.name in VIEWS:
        return VIEWS[parsed.name](facts, parsed.argument)
    return spark.createDataFrame([(name, name in VIEWS) for name in reading.COMMANDS], "command string, view boolean")
