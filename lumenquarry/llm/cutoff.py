"""Score cutoff per group that keeps a target share (problem 4).

Equal scores are summed up first, so that a tie shared by a third of all rows is one row.
The distinct scores are then range-sorted by group and falling score over all partitions,
counted per partition and group, and a prefix sum over these few counts names the one
partition that holds each group's cutoff; only there are rows numbered to read the exact
row. No group is ever sorted or held in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut


def scored_results(results: DataFrame) -> DataFrame:
    """One row per result_id with its group and whether it counts.

    The group is the source in sample_id (all before ``_{split}_{index}``) and the lower-case
    answer_type, null or blank as open. A result counts with a confidence in 0..1 and a
    non-null ``correct``. Of a result delivered twice the earliest counts.
    """
    row = F.struct("ingested_at", "sample_id", "answer_type", "confidence", "correct")
    one = results.groupBy("result_id").agg(F.min(row).alias("r")).select("result_id", "r.*")
    kind = F.lower(F.trim(F.coalesce("answer_type", F.lit(""))))
    return one.select(
        "result_id",
        F.regexp_extract("sample_id", r"^(.*)_[^_]+_[^_]+$", 1).alias("source"),
        F.when(kind == "", "open").otherwise(kind).alias("answer_type"),
        (F.col("confidence") + F.lit(0.0)).alias("score"),
        "correct",
    ).filter((F.col("score") >= 0) & (F.col("score") <= 1) & F.col("correct").isNotNull() & F.col("source").isNotNull())


def group_targets(targets: DataFrame) -> DataFrame:
    """Targets by normalised group; of contradicting rows the larger share holds, null ones are left out."""
    kind = F.lower(F.trim(F.coalesce("answer_type", F.lit(""))))
    return (
        targets.select("source", F.when(kind == "", "open").otherwise(kind).alias("answer_type"), "target_pct")
        .filter(F.col("target_pct").isNotNull() & F.col("source").isNotNull())
        .groupBy("source", "answer_type")
        .agg(F.max("target_pct").alias("target_pct"))
    )


def cutoffs(scored: DataFrame, targets: DataFrame) -> DataFrame:
    """source, answer_type, target_pct, n_results, cutoff, n_kept, n_kept_correct.

    The cutoff is the highest score at which the rows at or above it make up at least
    target_pct percent of the group. Groups without a target or without rows are left out;
    a target of 0 or less keeps the rows at the top score, one above 100 has no cutoff.
    """
    key = ["source", "answer_type"]
    ties = scored.groupBy(*key, "score").agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("long")).alias("ok"))
    ranged = cut(
        ties.repartitionByRange(*key, F.col("score").desc()).withColumn("part", F.spark_partition_id())
    )
    before = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*key)
    parts = (
        ranged.groupBy(*key, "part")
        .agg(F.sum("n").alias("n_part"), F.sum("ok").alias("ok_part"))
        .withColumn("n_before", F.coalesce(F.sum("n_part").over(before), F.lit(0)))
        .withColumn("ok_before", F.coalesce(F.sum("ok_part").over(before), F.lit(0)))
        .withColumn("n_results", F.sum("n_part").over(whole))
        .join(group_targets(targets), key)
        .filter(
            (F.col("n_before") * 100 < F.greatest(F.col("target_pct") * F.col("n_results"), F.lit(1)))
            & ((F.col("n_before") + F.col("n_part")) * 100 >= F.col("target_pct") * F.col("n_results"))
        )
    )
    running = Window.partitionBy(*key, "part").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    first = Window.partitionBy(*key).orderBy(F.col("score").desc())
    return (
        ranged.join(parts, [*key, "part"])
        .withColumn("n_kept", F.col("n_before") + F.sum("n").over(running))
        .withColumn("n_kept_correct", F.col("ok_before") + F.sum("ok").over(running))
        .filter(F.col("n_kept") * 100 >= F.col("target_pct") * F.col("n_results"))
        .withColumn("rn", F.row_number().over(first))
        .filter("rn = 1")
        .select(*key, "target_pct", "n_results", F.col("score").alias("cutoff"), "n_kept", "n_kept_correct")
    )


def kept_results(scored: DataFrame, targets: DataFrame) -> DataFrame:
    """result_id of all rows at or above their group's cutoff."""
    limits = cutoffs(scored, targets).select("source", "answer_type", "cutoff")
    return scored.join(limits, ["source", "answer_type"]).filter(F.col("score") >= F.col("cutoff")).select("result_id")
