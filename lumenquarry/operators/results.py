"""The per-sample fact table: one row per result, and paired runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def one_delivery(results: DataFrame) -> DataFrame:
    """The earliest delivery of each result (then by creation, sample and prediction); confidence NaN becomes null, the answer type lower
    case with open for null and blank, texts never null."""
    first = Window.partitionBy("result_id").orderBy("ingested_at", "created_at", "sample_id", "prediction")
    kind = F.lower(F.trim(T.text_or_empty(F.col("answer_type"))))
    return (
        results.withColumn("_rn", F.row_number().over(first))
        .filter("_rn = 1")
        .drop("_rn")
        .withColumn("answer_type", F.when(kind == "", "open").otherwise(kind))
        .withColumn("confidence", F.nanvl("confidence", F.lit(None).cast("double")))
        .withColumn("prediction", T.text_or_empty(F.col("prediction")))
        .withColumn("ground_truth", T.text_or_empty(F.col("ground_truth")))
        .withColumn("decision", T.text_or_empty(F.col("decision")))
    )


def last_per_sample(results: DataFrame) -> DataFrame:
    """One row per run and sample: the last result, as a dictionary fill would keep it."""
    last = Window.partitionBy("run_id", "sample_id").orderBy(F.col("result_id").desc())
    return results.withColumn("_rn", F.row_number().over(last)).filter("_rn = 1").drop("_rn")


def is_match() -> Column:
    return T.normalize_eval(F.col("prediction")) == T.normalize_eval(F.col("ground_truth"))


def matched(results: DataFrame) -> DataFrame:
    """``results`` with ``hit``: whether prediction and truth have the same evaluation form."""
    return results.withColumn("hit", is_match())


def paired(agent: DataFrame, baseline: DataFrame) -> DataFrame:
    """Inner join of an agent's run with the baseline on sample_id; columns of the latter begin
    with ``b_``. Samples in one run only are left out."""
    other = baseline.select("sample_id", *[F.col(c).alias(f"b_{c}") for c in ("prediction", "ground_truth", "decision", "confidence", "hit")])
    return agent.join(other, "sample_id")


def with_baseline(agent: DataFrame, baseline: DataFrame) -> DataFrame:
    """Left join in which a sample the baseline lacks stands in for itself."""
    b = baseline.select("sample_id", F.col("hit").alias("_b"))
    return agent.join(b, "sample_id", "left").withColumn("baseline_hit", F.coalesce("_b", "hit")).drop("_b")


def remaining(samples: DataFrame, done: DataFrame) -> DataFrame:
    """Samples that no finished result has: what a resumed run still owes."""
    return samples.join(done.select("sample_id").distinct(), "sample_id", "left_anti")


def demo_entries(wanted: DataFrame, results: DataFrame, fallback: DataFrame) -> DataFrame:
    """One row for each wanted sample_id: its last result of any run, else the fallback's, else nulls;
    ``found`` tells where it comes from."""
    cols = ["prediction", "ground_truth", "confidence", "decision"]
    last = lambda df: df.groupBy("sample_id").agg(F.max_by(F.struct(*cols), F.struct("result_id", "run_id")).alias("_r")).select("sample_id", "_r.*")
    side = lambda df, p: last(df).select("sample_id", *[F.col(c).alias(f"{p}{c}") for c in cols], F.lit(True).alias(f"{p}has"))
    joined = wanted.select("sample_id").distinct().join(side(results, "r_"), "sample_id", "left").join(side(fallback, "f_"), "sample_id", "left")
    found = F.when(F.col("r_has"), "result").when(F.col("f_has"), "fallback").otherwise("none")
    return joined.select("sample_id", *[F.when(F.col("r_has"), F.col(f"r_{c}")).otherwise(F.col(f"f_{c}")).alias(c) for c in cols], found.alias("found"))


def index_range(samples: DataFrame, first: int, last: int) -> DataFrame:
    """Samples whose index lies within first..last; bounds beyond the collection are no error."""
    index = F.regexp_extract("sample_id", r"_(\d+)$", 1).try_cast("long")
    return samples.filter(index.between(first, last))
