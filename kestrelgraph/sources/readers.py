"""Readers and writers: triples as JSON or delimited text, usage transcripts, CSV and JSON exports, versioned tables."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kestrelgraph.functions import confidence as C
from kestrelgraph.operators import statements
from kestrelgraph.sources import packs

TRIPLE = "subject string, relation string, object string, s string, r string, o string"
TRANSCRIPT = (
    "type string, sessionId string, timestamp string, cwd string, gitBranch string, "
    "message struct<id: string, model: string, usage: struct<input_tokens: bigint, output_tokens: bigint, cache_read_input_tokens: bigint, cache_creation_input_tokens: bigint>, "
    "content: array<struct<type: string, name: string>>>"
)


def _named(rows: DataFrame) -> DataFrame:
    part = lambda a, b: F.nullif(F.trim(F.coalesce(a, b)), F.lit("")).alias(a)
    return rows.select(part("subject", "s"), part("relation", "r"), part("object", "o"), F.col("_metadata.file_path").alias("path"))


def json_triples(spark: SparkSession, *paths: str) -> DataFrame:
    """(subject, relation, object, path) of files that hold JSON arrays of objects with full or one-letter keys.

    Objects with a missing or empty part are left out; see load_report() for how many there were.
    """
    return _named(spark.read.schema(TRIPLE).option("multiLine", True).json(list(paths))).where("subject is not null and relation is not null and object is not null")


def load_report(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, rows, loaded, failed): what became of each JSON file's objects."""
    rows = _named(spark.read.schema(TRIPLE).option("multiLine", True).json(list(paths)))
    ok = F.col("subject").isNotNull() & F.col("relation").isNotNull() & F.col("object").isNotNull()
    return rows.groupBy("path").agg(F.count("*").alias("rows"), F.count_if(ok).alias("loaded"), F.count_if(~ok).alias("failed"))


def text_triples(spark: SparkSession, *paths: str) -> DataFrame:
    """(subject, relation, object, path) of lines "subject | relation | object" or with commas; # starts a comment."""
    lines = spark.read.text(list(paths)).select(F.trim("value").alias("line"), F.col("_metadata.file_path").alias("path")).where("line <> '' and not startswith(line, '#')")
    parts = F.transform(F.split("line", F.when(F.contains("line", F.lit("|")), F.lit(r"\|")).otherwise(F.lit(","))), lambda x: F.trim(x))
    out = lines.select(parts.alias("p"), "path").where("size(p) >= 3")
    return out.select(F.get("p", 0).alias("subject"), F.get("p", 1).alias("relation"), F.get("p", 2).alias("object"), "path").where("subject <> '' and relation <> '' and object <> ''")


def pasted_triples(messages: DataFrame, text: str) -> DataFrame:
    """Triples of messages that are JSON arrays of objects; other messages give none."""
    rows = messages.select(F.explode(F.from_json(F.col(text), f"array<struct<{', '.join(x.replace(' ', ': ', 1) for x in TRIPLE.split(', '))}>>")).alias("x"))
    full = rows.select(F.coalesce("x.subject", "x.s").alias("subject"), F.coalesce("x.relation", "x.r").alias("relation"), F.coalesce("x.object", "x.o").alias("object"))
    return full.where("subject <> '' and relation <> '' and object <> ''")


def _turns(rows: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(F.col(f"message.usage.{c}"), F.lit(0))
    tool = F.get(F.filter("message.content", lambda c: c["type"] == "tool_use"), 0)["name"]
    return rows.where("type in ('assistant', 'user') and sessionId <> ''").select(
        F.col("sessionId").alias("session_id"), F.to_timestamp("timestamp").alias("timestamp"), F.col("message.model").alias("model"),
        zero("input_tokens").alias("input_tokens"), zero("output_tokens").alias("output_tokens"),
        zero("cache_read_input_tokens").alias("cache_read_tokens"), zero("cache_creation_input_tokens").alias("cache_creation_tokens"),
        tool.alias("tool_name"), "cwd", F.col("message.id").alias("message_id"), F.col("gitBranch").alias("git_branch"), F.col("_metadata.file_path").alias("batch_path"),
    )


def transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """Usage turns of all JSON-lines files below a folder; lines that are no such record are skipped."""
    return _turns(spark.read.schema(TRANSCRIPT).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").json(folder))


def transcript_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same as a stream: Spark's checkpoint remembers which files were read."""
    return _turns(spark.readStream.schema(TRANSCRIPT).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").json(folder))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; fields with commas, quotes or line ends are quoted, quotes doubled."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_facts(facts: DataFrame, path: str) -> None:
    """The fact table by instance, so that a tenant's scan reads its own files only."""
    facts.write.mode("overwrite").partitionBy("instance").parquet(path)


def read_facts(spark: SparkSession, path: str, instance: str | None = None) -> DataFrame:
    facts = spark.read.parquet(path)
    return facts if instance is None else facts.where(F.col("instance") == instance)


def load(spark: SparkSession, source: str | Sequence) -> DataFrame:
    """(subject, relation, object) of whatever source is: the name of a pack, a file, a folder, or a list of triples, of
    objects with full or one-letter keys, or of sentences, told by the first of the list."""
    triple = ["subject", "relation", "object"]
    if isinstance(source, str):
        if source in packs.PACKS:
            return packs.pack(spark, source).select(*triple)
        if source.endswith(".json"):
            return json_triples(spark, source).select(*triple)
        if source.endswith((".txt", ".csv")):
            return text_triples(spark, source).select(*triple)
        return folder_triples(spark, source)
    shape = "subject string, relation string, object string"
    if not source:
        return spark.createDataFrame([], shape)
    if isinstance(source[0], dict):
        rows = [tuple((x.get(k) or x.get(k[0]) or "").strip() for k in triple) for x in source]
    elif isinstance(source[0], str):
        said = spark.createDataFrame([(0, x) for x in source], "id int, text string")
        return statements.read(said, "id", "text").select(*triple)
    else:
        rows = [tuple(x) for x in source]
    return spark.createDataFrame([r for r in rows if all(r)], shape)


def folder_triples(spark: SparkSession, folder: str) -> DataFrame:
    """The triples of all *.json and *.txt files of a folder."""
    read = lambda reader, ending: reader(spark, f"{folder}/*.{ending}").select("subject", "relation", "object")
    return read(json_triples, "json").unionByName(read(text_triples, "txt"))


def folder_report(spark: SparkSession, folder: str) -> DataFrame:
    """(path, loaded): how many triples each file of a folder gave, JSON files first."""
    read = lambda reader, ending, k: reader(spark, f"{folder}/*.{ending}").groupBy("path").agg(F.count("*").alias("loaded")).withColumn("k", F.lit(k))
    return read(json_triples, "json", 0).unionByName(read(text_triples, "txt", 1)).orderBy("k", "path").drop("k")


def location(name: str, default: str) -> str:
    """Where the store is, from the environment; quotes around the value are taken off."""
    return os.environ.get(name, "").strip().strip("\"'") or default


def write_document(facts: DataFrame, path: str) -> None:
    """The store as JSON rows, rewritten as a whole."""
    facts.write.mode("overwrite").json(path)


def read_document(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A store of JSON rows."""
    return spark.read.schema(schema).json(path)


def read_legacy(spark: SparkSession, path: str) -> DataFrame:
    """(subject, relation, object) of the older single document {"knowledge": {subject: {relation: [objects]}}}."""
    rows = spark.read.schema("knowledge map<string, map<string, array<string>>>").option("multiLine", True).json(path)
    by_subject = rows.select(F.explode("knowledge").alias("subject", "relations"))
    return by_subject.select("subject", F.explode("relations").alias("relation", "objects")).select("subject", "relation", F.explode("objects").alias("object"))


def write_indexed(facts: DataFrame, path: str) -> None:
    """Two copies of the facts by instance, one sorted by subject and one by object: a lookup by either reads few row groups."""
    for name, first, second in (("by_subject", "subject", "relation"), ("by_object", "object", "relation")):
        placed = facts.repartitionByRange("instance", first).sortWithinPartitions("instance", first, second)
        placed.write.mode("overwrite").partitionBy("instance").parquet(f"{path}/{name}")


def evolved(rows: DataFrame, schema: StructType) -> DataFrame:
    """rows in a newer schema: missing columns are null, columns that it does not name are kept behind."""
    have = {c.lower() for c in rows.columns}
    own = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name.lower() in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    rest = [c for c in rows.columns if c.lower() not in {f.name.lower() for f in schema}]
    return rows.select(*own, *rest)


def spoken_facts(segments: DataFrame) -> DataFrame:
    """(transcript_id, at, subject, relation, object, speaker_id, confidence) of transcript segments (transcript_id, idx,
    text, confidence, speaker_id); a segment's confidence gives its facts' level."""
    keyed = segments.withColumn("id", F.struct("transcript_id", "idx", "speaker_id", "confidence"))
    facts = statements.read(keyed, "id", "text")
    return facts.select("id.transcript_id", F.col("id.idx").alias("at"), "subject", "relation", "object", "id.speaker_id", C.heard(F.col("id.confidence")).alias("confidence"))
