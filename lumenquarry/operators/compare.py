"""Paired comparison of runs: McNemar, metric deltas, error lists, ablation tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import calibration, metrics


def discordant(pairs: DataFrame, *keys: str) -> DataFrame:
    """b (only the agent is right), c (only the baseline), and the statistic with continuity
    correction, which is 0 below 25 discordant pairs."""
    b, c = F.count_if(F.col("hit") & ~F.col("b_hit")), F.count_if(~F.col("hit") & F.col("b_hit"))
    n = F.col("b") + F.col("c")
    stat = F.when(n >= 25, F.pow(F.abs(F.col("b") - F.col("c")) - 1, F.lit(2)) / n).otherwise(0.0)
    return pairs.groupBy(*keys).agg(b.alias("b"), c.alias("c")).withColumn("statistic", F.round(stat, 6))


def mcnemar_p(b: int, c: int) -> tuple[float, float]:
    """(statistic, p): 1 below five discordant pairs, the exact binomial below 25, else the
    chi-square tail with one degree of freedom."""
    n = b + c
    if n < 5:
        return 0.0, 1.0
    if n < 25:
        centre = math.comb(n, b)
        return 0.0, min(1.0, sum(math.comb(n, k) for k in range(n + 1) if math.comb(n, k) <= centre) / 2**n)
    stat = (abs(b - c) - 1) ** 2 / n
    return stat, math.erfc(math.sqrt(stat / 2))


def mcnemar(pairs: DataFrame, *keys: str) -> DataFrame:
    """b, c, statistic, p_value and significant (p below 0.05); one row a run reaches the driver."""
    rows = discordant(pairs, *keys).collect()
    out = [(*[r[k] for k in keys], r.b, r.c, *(sp := mcnemar_p(r.b, r.c)), sp[1] < 0.05) for r in rows]
    names = [f"{k} string" for k in keys] + ["b long", "c long", "statistic double", "p_value double", "significant boolean"]
    return pairs.sparkSession.createDataFrame(out, ", ".join(names))


def summary(results: DataFrame) -> DataFrame:
    """One row a run with its headline metrics: one pass over the results, and one that sums up the
    distinct confidences."""
    kind, p, g = F.col("answer_type"), T.normalize_eval(F.col("prediction")), T.normalize_eval(F.col("ground_truth"))
    answered = F.col("decision") != "abstain"
    share = lambda part, whole: F.round(metrics.ratio(part, whole), 6)
    of = lambda k: F.when(F.count_if(kind == k) > 0, share(F.count_if((kind == k) & F.col("hit")), F.count_if(kind == k)))
    count = lambda a, b: F.count_if((F.col("_p") == a) & (F.col("_g") == b))
    tp, fp, fn = count("yes", "yes"), count("yes", "no"), count("no", "yes")
    precision, recall = metrics.ratio(tp, tp + fp), metrics.ratio(tp, tp + fn)
    facts = (
        results.withColumns({"_p": p, "_g": g, "_f": metrics.token_f1(), "_u": metrics.bleu_1()})
        .groupBy("run_id")
        .agg(
            share(F.count_if("hit"), F.count("*")).alias("overall_accuracy"),
            of("closed").alias("closed_accuracy"),
            of("open").alias("open_accuracy"),
            share(F.count_if(F.col("decision") == "abstain"), F.count("*")).alias("abstention_rate"),
            share(F.count_if(answered & F.col("hit")), F.count_if(answered)).alias("accuracy_when_answered"),
            share(F.count_if(F.col("decision") == "re_query"), F.count("*")).alias("re_query_rate"),
            share(F.count_if(F.coalesce("retry_count", F.lit(0)) > 0), F.count("*")).alias("retried_rate"),
            share(2 * precision * recall, precision + recall).alias("closed_f1"),
            F.round(F.avg("_f"), 6).alias("token_f1"),
            F.round(F.avg("_u"), 6).alias("bleu_1"),
        )
    )
    return facts.join(calibration.ece(results, "run_id").select("run_id", "ece"), "run_id", "left").join(
        calibration.discrimination(results, "run_id").select("run_id", "auroc"), "run_id", "left"
    )


SUMMARY = ("overall_accuracy", "closed_accuracy", "open_accuracy", "accuracy_when_answered", "abstention_rate", "closed_f1", "token_f1", "bleu_1", "ece", "auroc")


def deltas(summaries: DataFrame, baseline: str) -> DataFrame:
    """run_id, metric, agent, baseline, delta (agent less baseline): one row a run and metric."""
    long = summaries.unpivot("run_id", list(SUMMARY), "metric", "value")
    b = long.filter(F.col("run_id") == baseline).select("metric", F.col("value").alias("baseline"))
    return (
        long.filter(F.col("run_id") != baseline)
        .join(b, "metric")
        .select("run_id", "metric", F.col("value").alias("agent"), "baseline", F.round(F.col("value") - F.col("baseline"), 6).alias("delta"))
    )


def errors(agent: DataFrame, kind: str, most: int) -> DataFrame:
    """The first ``most`` results, by result_id, that are wrong, over-abstained (the baseline was
    right) or improved. ``agent`` has ``baseline_hit``; a sample without baseline is its own."""
    rule = {
        "wrong": ~F.col("hit") & (F.col("decision") != "abstain"),
        "over_abstain": (F.col("decision") == "abstain") & F.col("baseline_hit"),
        "improved": F.col("hit") & ~F.col("baseline_hit"),
        "improved_answered": F.col("hit") & ~F.col("baseline_hit") & (F.col("decision") == "answer"),
    }[kind]
    return agent.filter(rule).orderBy("result_id").limit(most).select(F.lit(kind).alias("kind"), "result_id", "sample_id", "prediction", "ground_truth")


def ablation(summaries: DataFrame, configs: list[tuple[int, str]], model_only: tuple[str, ...] = ()) -> DataFrame:
    """One row a configuration (number, run_id), runs that are missing with nulls. Runs of the model
    alone (``model_only``) answer everything: their accuracy when answered is the overall one,
    and nothing is abstained."""
    frame = summaries.sparkSession.createDataFrame(configs, "num int, run_id string")
    alone = F.col("run_id").isin(*model_only) if model_only else F.lit(False)
    rows = summaries.select(
        "run_id",
        "overall_accuracy",
        F.when(alone, F.col("overall_accuracy")).otherwise(F.coalesce(F.nullif("accuracy_when_answered", F.lit(0.0)), "overall_accuracy")).alias("accuracy_when_answered"),
        F.when(alone, 0.0).otherwise(F.col("abstention_rate")).alias("abstention_rate"),
        "ece",
        "auroc",
    )
    return frame.join(rows, "run_id", "left")


def component_deltas(table: DataFrame, steps: list[tuple[str, int, int]]) -> DataFrame:
    """Change of each metric for steps (component, to, from) between configurations."""
    frame = table.sparkSession.createDataFrame(steps, "component string, to_num int, from_num int")
    cols = [c for c in table.columns if c not in ("num", "run_id")]
    side = lambda p: table.select(F.col("num").alias(f"{p}_num"), *[F.col(c).alias(f"{p}_{c}") for c in cols])
    return (
        frame.join(side("to"), "to_num", "left")
        .join(side("from"), "from_num", "left")
        .select("component", "to_num", "from_num", *[F.round(F.col(f"to_{c}") - F.col(f"from_{c}"), 6).alias(f"{c}_delta") for c in cols])
    )


def flags(summaries: DataFrame, relevance: DataFrame, baseline: str) -> DataFrame:
    """What a report would point out about each run."""
    base = summaries.filter(F.col("run_id") == baseline).select(F.col("overall_accuracy").alias("_b"))
    return (
        summaries.join(relevance.select("run_id", "citation_relevance"), "run_id", "left")
        .crossJoin(F.broadcast(base))  # one row
        .select(
            "run_id",
            (F.col("abstention_rate") > 0.25).alias("high_abstention"),
            (F.coalesce("citation_relevance", F.lit(0.0)) < 0.5).alias("low_citation_relevance"),
            (F.col("open_accuracy") < 0.30).alias("low_open_accuracy"),
            (F.col("ece") > 0.15).alias("high_ece"),
            (F.col("overall_accuracy") < F.col("_b")).alias("grounding_hurt"),
        )
    )


def progress(results: DataFrame, every: int = 25, batch: int = 1) -> DataFrame:
    """Running count, accuracy, abstentions, mean latency and minutes to go of each run by result_id, at
    every ``every``-th result and the last; with results that come in batches, at the first
    ``batch`` counts from there on. A run is summed up in blocks first, so that no task sees
    more than one block and the (small) list of blocks."""
    block = 100_000
    numbered = results.withColumn("_b", F.floor(F.col("result_id") / block))
    in_block = Window.partitionBy("run_id", "_b").orderBy("result_id").rowsBetween(Window.unboundedPreceding, 0)
    totals = numbered.groupBy("run_id", "_b").agg(
        F.count("*").alias("_n"), F.count_if("hit").alias("_h"), F.count_if(F.col("decision") == "abstain").alias("_a"),
        F.sum("latency_seconds").alias("_l"), F.count("latency_seconds").alias("_ln"),
    )
    before = Window.partitionBy("run_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("run_id")
    base = totals.select("run_id", "_b", F.sum("_n").over(whole).alias("_all"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("_n", "_h", "_a", "_l", "_ln")])
    run = lambda x, b: F.col(b) + F.sum(x).over(in_block)
    one = F.lit(1)
    lat, nlat = F.coalesce(F.sum("latency_seconds").over(in_block), F.lit(0.0)) + F.col("_l0"), F.count("latency_seconds").over(in_block) + F.col("_ln0")
    return (
        numbered.join(base, ["run_id", "_b"])
        .select(
            "run_id",
            "result_id",
            run(one, "_n0").alias("done"),
            run(F.col("hit").cast("int"), "_h0").alias("n_correct"),
            run((F.col("decision") == "abstain").cast("int"), "_a0").alias("n_abstained"),
            F.round(F.try_divide(lat, nlat), 4).alias("mean_latency"),
            F.round(F.try_divide(lat, nlat) * (F.col("_all") - run(one, "_n0")) / 60, 2).alias("minutes_to_go"),
            "_all",
        )
        .filter((F.col("done") % every < batch) | (F.col("done") == F.col("_all")))
        .withColumn("accuracy", F.round(F.col("n_correct") / F.col("done"), 6))
        .drop("_all")
    )


def type_table(results: DataFrame, configs: list[tuple[int, str]]) -> DataFrame:
    """Accuracies by question type, closed F1 and both counts of each configuration; abstentions
    count as results, runs that are missing have null measures."""
    kind = lambda k: F.col("answer_type") == k
    counts = results.groupBy("run_id").agg(
        F.round(metrics.ratio(F.count_if(kind("closed") & F.col("hit")), F.count_if(kind("closed"))), 6).alias("closed_accuracy"),
        F.round(metrics.ratio(F.count_if(kind("open") & F.col("hit")), F.count_if(kind("open"))), 6).alias("open_accuracy"),
        F.count_if(kind("closed")).alias("closed_count"),
        F.count_if(kind("open")).alias("open_count"),
    )
    f1 = metrics.precision_recall_f1(results, "run_id").select("run_id", F.col("f1").alias("closed_f1"))
    frame = results.sparkSession.createDataFrame(configs, "num int, run_id string")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return frame.join(counts.join(f1, "run_id"), "run_id", "left").select(
        "num", "run_id", "closed_accuracy", "open_accuracy", "closed_f1", zero("closed_count"), zero("open_count")
    )
