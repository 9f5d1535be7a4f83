"""Calibration analytics: bins, ECE, discrimination, thresholds, sweeps, fitted scalers.

Confidences are first summed up by value. Range joins and cumulative windows then work on the
distinct values (as many as the score has digits), not on the results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .metrics import ratio

#: Default thresholds and the grid of the sweep.
THRESHOLDS = (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)
HIGH_GRID = (0.40, 0.50, 0.60, 0.65, 0.70, 0.75, 0.80)
LOW_GRID = (0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50)


def by_confidence(results: DataFrame, *keys: str) -> DataFrame:
    """n and k (correct ones) of every distinct confidence; rows without one don't count."""
    return (
        results.filter("confidence IS NOT NULL")
        .groupBy(*keys, (F.col("confidence") + F.lit(0.0)).alias("confidence"))
        .agg(F.count("*").alias("n"), F.count_if("hit").alias("k"))
    )


def _edges(spark: SparkSession, n_bins: int) -> DataFrame:
    rows = [(i, i / n_bins, (i + 1) / n_bins) for i in range(n_bins)]
    return spark.createDataFrame(rows, "bin int, lo double, hi double")


def bins(results: DataFrame, *keys: str, n_bins: int = 10) -> DataFrame:
    """Every bin with count, accuracy and mean confidence, empty ones as zeros; the last bin is
    closed on the right. Values outside 0..1 fall in none."""
    edges = _edges(results.sparkSession, n_bins)  # n_bins rows
    by = by_confidence(results, *keys)
    inside = (F.col("confidence") >= F.col("lo")) & ((F.col("confidence") < F.col("hi")) | ((F.col("bin") == n_bins - 1) & (F.col("confidence") <= F.col("hi"))))
    filled = (
        by.join(F.broadcast(edges), inside)
        .groupBy(*keys, "bin")
        .agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(F.col("n") * F.col("confidence")).alias("s"))
    )
    frame = by.select(*keys).distinct().crossJoin(F.broadcast(edges)) if keys else edges
    return frame.join(filled, [*keys, "bin"], "left").select(
        *keys,
        "bin",
        "lo",
        "hi",
        F.coalesce("n", F.lit(0)).alias("n"),
        F.round(ratio(F.col("k"), F.col("n")), 6).alias("accuracy"),
        F.round(ratio(F.col("s"), F.col("n")), 6).alias("mean_confidence"),
    )


def ece(results: DataFrame, *keys: str, n_bins: int = 10) -> DataFrame:
    """Expected calibration error; the weight of a bin is its share of all results with a
    confidence, those outside 0..1 included."""
    edges = _edges(results.sparkSession, n_bins)
    inside = (F.col("confidence") >= F.col("lo")) & ((F.col("confidence") < F.col("hi")) | ((F.col("bin") == n_bins - 1) & (F.col("confidence") <= F.col("hi"))))
    gap = F.abs(F.sum("k") - F.sum(F.col("n") * F.col("confidence")))
    return (
        by_confidence(results, *keys)
        .join(F.broadcast(edges), inside, "left")
        .groupBy(*keys, "bin")
        .agg(F.sum("n").alias("n"), gap.alias("gap"))
        .groupBy(*keys)
        .agg(F.sum("n").alias("n"), F.round(ratio(F.sum(F.when(F.col("bin").isNotNull(), F.col("gap")).otherwise(0.0)), F.sum("n")), 6).alias("ece"))
    )


#: Width of the blocks of confidences in which running sums are taken, as parts of 1.
BLOCKS = 4096


def below(by: DataFrame, *keys: str) -> DataFrame:
    """``by`` with the wrong results of all lower confidences. Sums run within narrow blocks of
    confidences; only the list of blocks is summed up in one task a key."""
    wrong = F.col("n") - F.col("k")
    blocked = by.withColumn("_b", F.floor(F.col("confidence") * BLOCKS))
    lower = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = blocked.groupBy(*keys, "_b").agg(F.sum(wrong).alias("_w")).withColumn("_w0", F.coalesce(F.sum("_w").over(lower), F.lit(0))).drop("_w")
    inside = Window.partitionBy(*keys, "_b").orderBy("confidence").rowsBetween(Window.unboundedPreceding, -1)
    return blocked.join(base, [*keys, "_b"]).withColumn("below", F.col("_w0") + F.coalesce(F.sum(wrong).over(inside), F.lit(0))).drop("_b", "_w0")


def discrimination(results: DataFrame, *keys: str) -> DataFrame:
    """Mean confidence of right and wrong results, their gap, and AUROC with ties counted
    half; 0.5 where one class is missing."""
    wrong = F.col("n") - F.col("k")
    area = F.sum(F.col("k") * (F.col("below") + 0.5 * wrong))
    k, w = F.sum("k"), F.sum(wrong)
    mean = lambda x, n: ratio(F.sum(x * F.col("confidence")), n)
    return (
        below(by_confidence(results, *keys), *keys)
        .groupBy(*keys)
        .agg(
            k.alias("n_correct"),
            w.alias("n_wrong"),
            F.round(mean(F.col("k"), k), 6).alias("mean_correct"),
            F.round(mean(wrong, w), 6).alias("mean_wrong"),
            F.round(mean(F.col("k"), k) - mean(wrong, w), 6).alias("gap"),
            F.round(F.coalesce(F.try_divide(area, (k * w).cast("double")), F.lit(0.5)), 6).alias("auroc"),
        )
    )


def thresholds(results: DataFrame, *keys: str, at: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Coverage and accuracy of the results at or above each threshold."""
    spark = results.sparkSession
    grid = spark.createDataFrame([(float(t),) for t in at], "threshold double")  # len(at) rows
    by = by_confidence(results, *keys)
    above = F.col("confidence") >= F.col("threshold")
    return (
        by.crossJoin(F.broadcast(grid))
        .groupBy(*keys, "threshold")
        .agg(
            F.sum(F.when(above, F.col("n")).otherwise(0)).alias("n_covered"),
            F.round(ratio(F.sum(F.when(above, F.col("n")).otherwise(0)), F.sum("n")), 6).alias("coverage"),
            F.round(ratio(F.sum(F.when(above, F.col("k")).otherwise(0)), F.sum(F.when(above, F.col("n")).otherwise(0))), 6).alias("accuracy"),
        )
    )


def recommendation(results: DataFrame, *keys: str, least_coverage: float = 0.5) -> DataFrame:
    """The threshold of the highest accuracy with enough coverage; the lowest one on a tie."""
    best = Window.partitionBy(*keys).orderBy(F.col("accuracy").desc(), F.col("threshold"))
    rows = thresholds(results, *keys).filter((F.col("coverage") >= least_coverage) & (F.col("n_covered") > 0))
    return rows.withColumn("_rn", F.row_number().over(best)).filter("_rn = 1").drop("_rn")


def sweep(results: DataFrame, *keys: str) -> DataFrame:
    """Rows (high_t, low_t) of the grid with low_t < high_t, for closed, open and combined:
    results below low_t abstain. high_t is recorded only, so rows of one low_t are equal."""
    spark = results.sparkSession
    pairs = [(h, w) for h in HIGH_GRID for w in LOW_GRID if w < h]
    lows = F.broadcast(spark.createDataFrame([(w,) for w in sorted({w for _, w in pairs})], "low_t double"))
    grid = F.broadcast(spark.createDataFrame(pairs, "high_t double, low_t double"))
    by = by_confidence(results, *keys, "answer_type")
    kind = F.when(F.grouping("answer_type") == 1, "combined").otherwise(F.col("answer_type")).alias("kind")
    over = F.col("confidence") >= F.col("low_t")
    sets = [[*map(F.col, keys), F.col("low_t")], [*map(F.col, keys), F.col("low_t"), F.col("answer_type")]]
    rows = by.crossJoin(lows).groupingSets(sets, *keys, "low_t", "answer_type").agg(
        kind,
        F.sum("n").alias("n_samples"),
        F.round(ratio(F.sum(F.when(over, 0).otherwise(F.col("n"))), F.sum("n")), 6).alias("abstain_rate"),
        F.round(ratio(F.sum(F.when(over, F.col("k")).otherwise(0)), F.sum(F.when(over, F.col("n")).otherwise(0))), 6).alias("accuracy_when_answered"),
        F.round(ratio(F.sum(F.when(over, F.col("k")).otherwise(0)), F.sum("n")), 6).alias("overall_accuracy"),
    )
    return rows.join(grid, "low_t").select(*keys, "kind", "high_t", "low_t", "n_samples", "abstain_rate", "accuracy_when_answered", "overall_accuracy")


def best_row(rows: DataFrame, *keys: str, least: float = 0.10, most: float = 0.25) -> DataFrame:
    """Of the rows whose abstention is in the window, else of all, the most accurate one; then
    the one that abstains least, then the lowest thresholds."""
    inside = F.col("abstain_rate").between(least, most)
    order = Window.partitionBy(*keys).orderBy(
        inside.desc(), F.col("accuracy_when_answered").desc(), F.col("abstain_rate"), F.col("high_t"), F.col("low_t")
    )
    return rows.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def fit_platt(results: DataFrame) -> tuple[float, float]:
    """(a, b) of the sigmoid with the least log loss, without regularisation, on the counted
    distinct confidences; (1, 0) for fewer than two values or one class."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    by = by_confidence(results)
    rows = by.select("confidence", F.lit(1.0).alias("label"), F.col("k").cast("double").alias("w")).unionByName(
        by.select("confidence", F.lit(0.0).alias("label"), (F.col("n") - F.col("k")).cast("double").alias("w"))
    )
    rows = rows.filter("w > 0").withColumn("features", array_to_vector(F.array("confidence")))
    if rows.agg(F.least(F.countDistinct("label"), F.countDistinct("confidence"))).first()[0] < 2:
        return 1.0, 0.0
    model = LogisticRegression(regParam=0.0, maxIter=200, tol=1e-10, weightCol="w", standardization=False).fit(rows)
    return float(model.coefficients[0]), float(model.intercept)


def fit_isotonic(results: DataFrame) -> tuple[list[float], list[float]]:
    """Knots of the non-decreasing fit; empty without results."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import IsotonicRegression

    by = by_confidence(results)
    rows = by.select(array_to_vector(F.array("confidence")).alias("features"), (F.col("k") / F.col("n")).alias("label"), F.col("n").cast("double").alias("w"))
    if rows.isEmpty():
        return [], []
    model = IsotonicRegression(weightCol="w").fit(rows)
    return [float(x) for x in model.boundaries], [float(y) for y in model.predictions]


def transfer(fitted: DataFrame, tested: DataFrame) -> DataFrame:
    """method, ece_raw, ece_calibrated, improvement on results that the scalers were not fitted on."""
    from ..functions.arrays import isotonic, platt

    c = F.col("confidence")
    by = tested.filter("confidence IS NOT NULL")
    scaled = {"platt": platt(c, *fit_platt(fitted)), "isotonic": isotonic(c, *fit_isotonic(fitted))}
    raw = float(ece(by).first().ece)
    rows = [(m, raw, e := float(ece(by.withColumn("confidence", x)).first().ece), round(raw - e, 6)) for m, x in scaled.items()]
    return fitted.sparkSession.createDataFrame(rows, "method string, ece_raw double, ece_calibrated double, improvement double")


def compare_scalers(results: DataFrame) -> DataFrame:
    """method, ece_before, ece_after, chosen: the scaler with the lower error, Platt on a tie."""
    from ..functions.arrays import isotonic, platt

    spark = results.sparkSession
    a, b = fit_platt(results)
    xs, ys = fit_isotonic(results)
    c = F.col("confidence")
    error = lambda df: float(ece(df).first().ece)
    before = error(results)
    after = {"platt": error(results.withColumn("confidence", platt(c, a, b))), "isotonic": error(results.withColumn("confidence", isotonic(c, xs, ys)))}
    chosen = "platt" if after["platt"] <= after["isotonic"] else "isotonic"
    return spark.createDataFrame([(m, before, e, m == chosen) for m, e in after.items()], "method string, ece_before double, ece_after double, chosen boolean")
