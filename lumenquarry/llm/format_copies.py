"""Duplicates hidden by formatting differences (problem 5).

Byte-identical rows are collapsed first, only the distinct survivors are canonicalised, and
these are grouped again on their full canonical text with the counts summed. Membership is
found by 128-bit digests, so texts travel twice and never for the join back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bare, cut, digest

PAYLOAD = "question string, answer string"


def qa_records(samples: DataFrame, raw: DataFrame) -> DataFrame:
    """sample_id, question, answer of loaded and not yet loaded records.

    A payload is a flat JSON object in any field order and escaping; one that is null or
    no object is left out, as are rows without sample_id.
    """
    parsed = raw.filter(F.col("payload").isNotNull()).select(
        "sample_id", F.from_json("payload", PAYLOAD).alias("p")
    )
    return (
        samples.select("sample_id", "question", "answer")
        .unionByName(parsed.select("sample_id", "p.question", "p.answer"))
        .filter(F.col("sample_id").isNotNull())
    )


def survivors(records: DataFrame) -> DataFrame:
    """Byte-identical texts once: raw (their digest), bq and ba (bare question and answer, none
    of them empty), canon (the digest of these), first_id, last_id, n_rows. Written and read
    back, as both the sets and their members come from it."""
    once = (
        records.filter(F.col("question").isNotNull() & F.col("answer").isNotNull())
        .groupBy("question", "answer")
        .agg(F.min("sample_id").alias("first_id"), F.max("sample_id").alias("last_id"), F.count("*").alias("n_rows"))
        .select(digest(F.col("question"), F.col("answer")).alias("raw"), bare(F.col("question")).alias("bq"), bare(F.col("answer")).alias("ba"), "first_id", "last_id", "n_rows")
        .filter((F.col("bq") != "") & (F.col("ba") != ""))
    )
    return cut(once.withColumn("canon", digest(F.col("bq"), F.col("ba"))))


def canonical_sets(forms: DataFrame) -> DataFrame:
    """Sets of the survivors of equal bare question and equal bare answer: canon, kept_id (smallest
    sample_id), last_id, n_forms (byte-distinct forms), n_rows (rows, with those delivered
    again). One row per set."""
    return (
        forms.groupBy("bq", "ba")
        .agg(
            F.first("canon").alias("canon"),
            F.min("first_id").alias("kept_id"),
            F.max("last_id").alias("last_id"),
            F.count("*").alias("n_forms"),
            F.sum("n_rows").alias("n_rows"),
        )
        .drop("bq", "ba")
    )


def _members(records: DataFrame, forms: DataFrame, sets: DataFrame) -> DataFrame:
    """kept_id, copy_id of every member of a set but its smallest sample_id."""
    more = sets.filter("kept_id <> last_id").select("canon", "kept_id")
    of_form = forms.select("raw", "canon").join(more, "canon").select("raw", "kept_id")
    rows = records.filter(F.col("question").isNotNull() & F.col("answer").isNotNull()).select(
        digest(F.col("question"), F.col("answer")).alias("raw"), F.col("sample_id").alias("copy_id")
    )
    return rows.join(of_form, "raw").filter("copy_id <> kept_id").select("kept_id", "copy_id").distinct()


def copies(records: DataFrame) -> DataFrame:
    """kept_id, copy_id: one row for each member of a set but its smallest sample_id."""
    forms = survivors(records)
    return _members(records, forms, canonical_sets(forms))


def collapsed(records: DataFrame) -> DataFrame:
    """kept_id and the number of records (distinct sample_ids) of its set, singletons included."""
    forms = survivors(records)
    sets = cut(canonical_sets(forms))
    more = _members(records, forms, sets).groupBy("kept_id").agg(F.count("*").alias("n_more"))
    return sets.join(more, "kept_id", "left").select("kept_id", (F.coalesce("n_more", F.lit(0)) + 1).alias("n_copies"), "n_forms")
