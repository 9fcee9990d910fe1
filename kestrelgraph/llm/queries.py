"""Queries of the training-data operators, with SQL where it can state the same result."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelgraph.llm import bpe, canonical, consensus, leakage, quality
from kestrelgraph.runtime import table

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
SPELLINGS = ["base_verb", "past", "present_s", "present_p"]


def _votes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return consensus.review_votes(table(spark, sf_dir, "facts"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = consensus.consensus(*_votes(spark, sf_dir))[0]
    return labels.where("values > 1").selectExpr("g as instance", "s as subject", "r as relation", "label as object")


def p1_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = consensus.confidences(*_votes(spark, sf_dir))
    return labels.selectExpr("g as instance", "s as subject", "r as relation", "label as object", "round(agreement, 6) as agreement", "round(confidence, 6) as confidence")


def p1_annotators(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = consensus.consensus(*_votes(spark, sf_dir))[1]
    return people.selectExpr("who as speaker", "round(accuracy, 6) as accuracy", "round(reliability, 6) as reliability", "votes")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, defs = table(spark, sf_dir, "facts").select("fact_id", "relation"), table(spark, sf_dir, "relation_defs")
    stray = canonical.strays(facts, "relation", defs, "relation")
    return canonical.map_values(stray, "relation", defs, "relation", SPELLINGS).selectExpr("fact_id", "canonical_relation as relation")


def p4_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, defs = table(spark, sf_dir, "facts").select("fact_id", "relation"), table(spark, sf_dir, "relation_defs")
    stray = canonical.strays(facts, "relation", defs, "relation")
    found = canonical.map_values(stray, "relation", defs, "relation", SPELLINGS).where(f"canonical_relation = '{canonical.UNMATCHED}'")
    return found.groupBy("relation").agg({"*": "count"}).withColumnRenamed("count(1)", "facts")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def p6_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts decoded from their ids: the inverse of p6_ids over the whole corpus."""
    path = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    return p6_ids(spark, sf_dir).select("doc_id", bpe.Encoder(spark, path).text(F.col("ids")).alias("text"))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).where("part = 'passage'").select("doc_id", "item_id")


def p7_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).selectExpr("doc_id", "item_id", "part", "round(score, 6) as score", "round(coverage, 6) as coverage")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.not_prose(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.outlierness(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {"p1_found": p1_found, "p1_agreement": p1_agreement, "p1_annotators": p1_annotators, "p4_found": p4_found, "p4_unmatched": p4_unmatched, "p6_ids": p6_ids, "p6_texts": p6_texts, "p7_found": p7_found, "p7_scores": p7_scores, "p8_found": p8_found, "p8_statistics": p8_statistics}
SQL = {"p6_texts": "select doc_id, coalesce(text, '') as text from documents"}
