"""Usage analytics over turns, sessions and processed files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelgraph.functions.text import project_name

TOKENS = {"input_tokens": "input", "output_tokens": "output", "cache_read_tokens": "cache_read", "cache_creation_tokens": "cache_creation"}


def _sums() -> list:
    return [F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in TOKENS.items()]


def by_session(turns: DataFrame) -> DataFrame:
    """One row for each session: token sums, turns, first and last time, last model and first project in order of id."""
    return turns.groupBy("session_id").agg(
        *_sums(), F.count("*").alias("turns"), F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp"),
        F.max_by("model", F.when(F.col("model").isNotNull(), F.col("id"))).alias("model"), F.min_by(project_name(F.col("cwd")), F.when(F.col("cwd").isNotNull(), F.col("id"))).alias("project"),
    )


def by_model(turns: DataFrame) -> DataFrame:
    return turns.groupBy(F.coalesce("model", F.lit("unknown")).alias("model")).agg(*_sums(), F.count("*").alias("turns"), F.count_distinct("session_id").alias("sessions"))


def by_day(turns: DataFrame) -> DataFrame:
    rows = turns.where("timestamp is not null")
    return rows.groupBy(F.to_date("timestamp").alias("day"), F.coalesce("model", F.lit("unknown")).alias("model")).agg(*_sums(), F.count("*").alias("turns"))


def day_average(turns: DataFrame) -> DataFrame:
    """The mean over days of each day's sums: an aggregate of an aggregate."""
    days = turns.where("timestamp is not null").groupBy(F.to_date("timestamp").alias("day")).agg(*_sums(), F.count("*").alias("turns"))
    return days.agg(F.count("*").alias("days"), *[F.round(F.avg(n), 6).alias(f"avg_{n}") for n in (*TOKENS.values(), "turns")])


def by_project(turns: DataFrame, sessions: DataFrame, top: int | None = None) -> DataFrame:
    """Turn totals by the session's project; turns of unknown sessions count as "unknown"."""
    rows = turns.join(sessions.select("session_id", "project_name"), "session_id", "left")
    out = rows.groupBy(F.coalesce("project_name", F.lit("unknown")).alias("project")).agg(*_sums(), F.count("*").alias("turns"), F.count_distinct("session_id").alias("sessions"))
    return out if top is None else out.orderBy(F.desc(F.col("input") + F.col("output")), "project").limit(top)


def recomputed(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """Each session with its stored totals and those of its turns, 0 without any, and whether they differ."""
    t = turns.groupBy("session_id").agg(*_sums(), F.count("*").alias("turns"))
    s = sessions.select("session_id", F.col("total_input_tokens").alias("stored_input"), F.col("total_output_tokens").alias("stored_output"), F.col("turn_count").alias("stored_turns"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = s.join(t, "session_id", "left").select("session_id", "stored_input", "stored_output", "stored_turns", zero("input"), zero("output"), zero("turns"))
    return out.withColumn("differs", ~(F.col("stored_input").eqNullSafe(F.col("input")) & F.col("stored_output").eqNullSafe(F.col("output")) & F.col("stored_turns").eqNullSafe(F.col("turns"))))


def durations(sessions: DataFrame) -> DataFrame:
    """Minutes from the first to the last time of a session, to one decimal; 0 if either is missing."""
    minutes = (F.unix_micros(F.col("last_timestamp").cast("timestamp")) - F.unix_micros(F.col("first_timestamp").cast("timestamp"))) / 6e7
    return sessions.select("session_id", F.coalesce(F.round(minutes, 1), F.lit(0.0)).alias("minutes"))


def calendar(turns: DataFrame) -> DataFrame:
    """Turns and tokens by day, by model and in total at once."""
    rows = turns.where("timestamp is not null").select(F.to_date("timestamp").alias("day"), F.coalesce("model", F.lit("unknown")).alias("model"), *TOKENS)
    return rows.cube("day", "model").agg(F.grouping_id().cast("int").alias("level"), *_sums(), F.count("*").alias("turns"))


def pending_files(listed: DataFrame, processed: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(path, skip_lines) of the listed files (path, mtime) that are new or changed; known lines are skipped."""
    known = processed.select("path", F.col("mtime").alias("known_mtime"), F.col("lines").alias("skip_lines"))
    changed = F.col("known_mtime").isNull() | (F.abs(F.col("mtime") - F.col("known_mtime")) >= tolerance)
    return listed.join(known, "path", "left").where(changed).select("path", F.coalesce("skip_lines", F.lit(0)).alias("skip_lines"))
