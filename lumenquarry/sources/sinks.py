"""Sinks: indexes, results, checkpoints of runs, reports, calibrators, thresholds."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval


# Bounds (high, low) of a kind for which none was found.
THRESHOLDS = {"closed": (0.65, 0.20), "open": (0.85, 0.55)}


def save_index(documents: DataFrame, folder: str, model: str, dimension: int, version: str = "1.0.0") -> None:
    """Documents as Parquet, partitioned by source, and one row of meta."""
    documents.write.mode("overwrite").partitionBy("source").parquet(f"{folder}/documents")
    documents.agg(
        F.count("*").alias("doc_count"),
        F.lit(model).alias("model"),
        F.lit(dimension).alias("dimension"),
        F.current_timestamp().alias("built_at"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.lit(version).alias("version"),
    ).coalesce(1).write.mode("overwrite").json(f"{folder}/meta")


def save_postings(documents: DataFrame, folder: str) -> int:
    """Postings by term, the documents' tokens and the term weights; the size of the vocabulary."""
    retrieval.postings(documents).write.mode("overwrite").parquet(f"{folder}/postings")
    index = retrieval.bm25_index(documents)
    index.tokens.write.mode("overwrite").parquet(f"{folder}/tokens")
    index.weights.write.mode("overwrite").parquet(f"{folder}/terms")
    return documents.sparkSession.read.parquet(f"{folder}/terms").count()


def save_results(results: DataFrame, folder: str) -> None:
    """Results as JSON lines, a folder for each run."""
    results.write.mode("overwrite").partitionBy("run_id").json(folder)


def append_checkpoint(results: DataFrame, folder: str) -> None:
    """Finished rows of a run; a resumed run leaves out their sample_ids."""
    results.write.mode("append").parquet(folder)


def save_table(table: DataFrame, folder: str) -> None:
    table.coalesce(1).write.mode("overwrite").json(folder)


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A small text of the driver, through the cluster's file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def get_text(spark: SparkSession, path: str) -> str:
    rows = spark.read.text(path, wholetext=True).collect()
    return rows[0][0] if rows else ""


def save_calibrator(spark: SparkSession, path: str, method: str, parameters: dict) -> None:
    _put(spark, path, json.dumps({"method": method, **parameters}, indent=1))


def load_calibrator(spark: SparkSession, path: str | None) -> dict | None:
    """None for a missing, unreadable or unknown one: confidences then stay as they are."""
    try:
        found = json.loads(get_text(spark, path)) if path else None
    except Exception:
        return None
    return found if found and found.get("method") in ("platt", "isotonic") else None


def save_thresholds(spark: SparkSession, path: str, best: dict[str, tuple[float, float]], method: str) -> None:
    """YAML of the best (high, low) pair of closed and open; a kind that is missing takes the combined
    pair, else the default. Other kinds are written too."""
    lines = [f"calibration_method: {method}"]
    kinds = {k: best.get(k) or best.get("combined") or v for k, v in THRESHOLDS.items()} | best
    for kind, (high, low) in sorted(kinds.items()):
        lines += [f"supervisor_{kind}_high_confidence: {high:.2f}", f"supervisor_{kind}_low_confidence: {low:.2f}"]
    _put(spark, path, "\n".join(lines) + "\n")


def save_report(spark: SparkSession, folder: str, markdown: str, numbers: dict) -> None:
    _put(spark, f"{folder}/report.md", markdown)
    _put(spark, f"{folder}/report.json", json.dumps(numbers, default=str, indent=1))
