"""Confidence levels: weights, labels and consolidation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The weight of each level, and the cut-offs of the labels of a product of weights.
WEIGHTS = {"high": 1.0, "medium": 0.7, "low": 0.4}
HIGH_FROM, MEDIUM_FROM, KEPT_FROM = 0.9, 0.5, 0.3
SLACK = 1e-9


def weight(level: Column) -> Column:
    """A missing level counts as medium."""
    return F.when(level == "high", 1.0).when(level == "low", 0.4).otherwise(0.7)


def label(product: Column) -> Column:
    return F.when(product >= HIGH_FROM - SLACK, "high").when(product >= MEDIUM_FROM - SLACK, "medium").otherwise("low")


def rank(level: Column) -> Column:
    return F.when(level == "high", 3).when(level == "medium", 2).when(level == "low", 1).otherwise(2)


def level(rank_: Column) -> Column:
    return F.when(rank_ >= 3, "high").when(rank_ == 2, "medium").otherwise("low")


def repeated(best: Column, times: Column) -> Column:
    """The level after a statement was repeated: each repeat lifts the best level so far by one."""
    return level(F.least(rank(best) + times - 1, F.lit(3)))


def visible(temporal: Column, query: str) -> Column:
    """Whether a fact of this temporal kind answers a query about another: always does, and currently also sometimes."""
    ok = (temporal == "always") | (temporal == query)
    return ok | (temporal == "currently") if query == "sometimes" else ok


def heard(score: Column) -> Column:
    """The level of a transcribed segment by the recogniser's own score."""
    return F.when(score >= 0.9, "high").when(score >= 0.7, "medium").otherwise("low")


def assigned(given: Column, source: Column, hedged: Column) -> Column:
    """The level of a new fact: as given, low if hedged, else by where it came from (high without a source)."""
    by_source = F.when(source.isNull() | source.isin("user", "clarification"), "high").when(source.isin("inference", "inheritance"), "medium").otherwise("low")
    return F.coalesce(given, F.when(hedged, "low"), by_source)


def provenance(source: str, premises: Column | None = None, speaker: Column | None = None) -> Column:
    """struct(source_type, confidence, premises, speaker_id) of a fact from a kind of source: what users say is sure, what
    is inferred is likely, anything else is a guess."""
    level_ = {"user": "high", "clarification": "high", "inference": "medium", "inheritance": "medium"}.get(source, "low")
    none = F.array().cast("array<struct<subject:string,relation:string,object:string>>")
    return F.struct(F.lit(source).alias("source_type"), F.lit(level_).alias("confidence"), (none if premises is None else premises).alias("premises"), (F.lit(None).cast("string") if speaker is None else speaker).alias("speaker_id"))
