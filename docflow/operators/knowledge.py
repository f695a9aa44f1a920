"""Entities, citations, and knowledge that merges: sums, unions of sets, latest of the most confident."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import entity_key

# Capitalised words that are no names.
COMMON = ("the", "this", "that", "with", "from", "have")
ACRONYM, NAME = r"[A-Z][A-Za-z]*", r"^[A-Z][a-z]+$"


def entities(docs: DataFrame, session: str = "source") -> DataFrame:
    """Rows (session, entity, type, occurrences, first_page): acronyms and capitalised words of ASCII letters.

    Words are counted per document before they meet, so a common name makes one
    row per document.
    """
    words = docs.select(F.col(session).alias("session"), F.col("doc_id").alias("page"), F.explode(F.split("text", "[^A-Za-z]+")).alias("word"))
    kind = F.when(F.col("word").rlike("^[A-Z]{2,8}$"), "abbreviation").when(F.col("word").rlike("^[A-Z][a-z]{2,}$") & ~F.lower("word").isin(*COMMON), "concept")
    found = words.withColumn("type", kind).where("type is not null")
    return found.groupBy("session", entity_key(F.col("word")).alias("entity"), "type").agg(F.count("*").alias("occurrences"), F.min("page").alias("first_page"))


def merge_entities(analyses: DataFrame) -> DataFrame:
    """Rows (entity, occurrences, first_page, sessions): many analyses as one; associative and commutative."""
    return analyses.groupBy("entity").agg(F.sum("occurrences").cast("bigint").alias("occurrences"), F.min("first_page").alias("first_page"), F.array_join(F.array_sort(F.collect_set("session")), ",").alias("sessions"))


def merge_glossary(entries: DataFrame) -> DataFrame:
    """Rows (source, target, confidence, uses): the target of most confidence, the latest of equals, by (confidence, seq)."""
    return entries.groupBy("source").agg(F.max_by("target", F.struct("confidence", "seq")).alias("target"), F.max("confidence").alias("confidence"), F.count("*").alias("uses"))


def citations(docs: DataFrame, pattern: str) -> DataFrame:
    """Rows (citation, n, docs): bracketed citations over all documents."""
    each = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("citation"))
    return each.groupBy("citation", "doc_id").agg(F.count("*").alias("n")).groupBy("citation").agg(F.sum("n").cast("bigint").alias("n"), F.count("*").alias("docs"))


def abbreviations(docs: DataFrame) -> DataFrame:
    """Distinct (abbreviation, long_form) from "Long Form (LF)"."""
    pattern = r"([A-Z][A-Za-z ]{2,40}) \(([A-Z]{2,8})\)"
    each = docs.select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("raw"))
    return each.select(F.regexp_extract("raw", pattern, 2).alias("abbreviation"), F.trim(F.regexp_extract("raw", pattern, 1)).alias("long_form")).distinct()


def stats(merged: DataFrame) -> DataFrame:
    """One row (entities, occurrences)."""
    return merged.agg(F.count("*").alias("entities"), F.coalesce(F.sum("occurrences"), F.lit(0)).cast("bigint").alias("occurrences"))


def upsert(current: DataFrame, changes: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """``current`` with the values of ``changes`` where they have any, and its new keys."""
    c, n = current.alias("c"), changes.alias("n")
    joined = c.join(n, key, "full_outer")
    return joined.select(*key, *(F.coalesce(F.col(f"n.{v}"), F.col(f"c.{v}")).alias(v) for v in values))
