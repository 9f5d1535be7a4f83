"""Answer quality, abstention, grounding and citation metrics, each one pass over the results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where there is nothing."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def exact_match(results: DataFrame, *keys: str) -> DataFrame:
    """n, n_correct, accuracy by ``keys``; of the whole for none."""
    hit = F.count_if("hit")
    return results.groupBy(*keys).agg(F.count("*").alias("n"), hit.alias("n_correct"), F.round(ratio(hit, F.count("*")), 6).alias("accuracy"))


def by_type(results: DataFrame, *keys: str) -> DataFrame:
    """Accuracy of all, closed and open results in one pass (grouping sets)."""
    kinds = F.when(F.grouping("answer_type") == 1, "overall").otherwise(F.col("answer_type"))
    hit = F.count_if("hit")
    sets = [[F.col(k) for k in keys], [F.col(k) for k in (*keys, "answer_type")]]
    return (
        results.groupingSets(sets, *keys, "answer_type")
        .agg(kinds.alias("kind"), F.count("*").alias("n"), hit.alias("n_correct"), F.round(ratio(hit, F.count("*")), 6).alias("accuracy"))
        .select(*keys, "kind", "n", "n_correct", "accuracy")
    )


def type_counts(results: DataFrame, *keys: str) -> DataFrame:
    """total, closed, open, and unknown: what is neither."""
    kind = lambda k: F.count_if(F.col("answer_type") == k)
    return results.groupBy(*keys).agg(
        F.count("*").alias("total"), kind("closed").alias("closed"), kind("open").alias("open"), (F.count("*") - kind("closed") - kind("open")).alias("unknown")
    )


def confusion(results: DataFrame, *keys: str) -> DataFrame:
    """tp, tn, fp, fn with yes as positive; rows where either side is neither yes nor no are
    counted as excluded."""
    p, g = T.normalize_eval(F.col("prediction")), T.normalize_eval(F.col("ground_truth"))
    binary = p.isin("yes", "no") & g.isin("yes", "no")
    count = lambda a, b: F.count_if(F.col("_b") & (F.col("_p") == a) & (F.col("_g") == b))
    return (
        results.select(*keys, p.alias("_p"), g.alias("_g"), binary.alias("_b"))
        .groupBy(*keys)
        .agg(
            count("yes", "yes").alias("tp"),
            count("no", "no").alias("tn"),
            count("yes", "no").alias("fp"),
            count("no", "yes").alias("fn"),
            F.count_if(~F.col("_b")).alias("excluded"),
        )
    )


def precision_recall_f1(results: DataFrame, *keys: str) -> DataFrame:
    c = confusion(results, *keys)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f = ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r"))
    return (
        c.withColumn("p", p)
        .withColumn("r", r)
        .select(*keys, F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round(f, 6).alias("f1"), "excluded")
    )


def token_f1() -> Column:
    """F1 of the token sets; 0 where a side is empty."""
    p, g = F.array_distinct(T.eval_tokens(F.col("prediction"))), F.array_distinct(T.eval_tokens(F.col("ground_truth")))
    both = F.size(F.array_intersect(p, g))
    return F.when(both == 0, 0.0).otherwise(2.0 * both / (F.size(p) + F.size(g)))


def bleu_1() -> Column:
    """Unigram BLEU: clipped matches over the prediction's length, with the brevity penalty; 0
    where a side is empty or nothing matches."""
    p, g = T.eval_tokens(F.col("prediction")), T.eval_tokens(F.col("ground_truth"))
    count = lambda a, t: F.size(F.filter(a, lambda x: x == t))
    clipped = F.aggregate(F.array_distinct(p), F.lit(0), lambda s, t: s + F.least(count(p, t), count(g, t)))
    brevity = F.when(F.size(p) > F.size(g), 1.0).otherwise(F.exp(1.0 - F.size(g) / F.size(p)))
    return F.when((F.size(p) == 0) | (F.size(g) == 0) | (clipped == 0), 0.0).otherwise(brevity * clipped / F.size(p))


def text_scores(results: DataFrame, *keys: str) -> DataFrame:
    """Means of token F1 and BLEU-1; the model-based score is the sentinel -1 without a model."""
    return results.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.round(F.avg(token_f1()), 6).alias("token_f1"),
        F.round(F.avg(bleu_1()), 6).alias("bleu_1"),
        F.lit(-1.0).alias("bert_score_f1"),
    )


def abstention(results: DataFrame, *keys: str) -> DataFrame:
    """Abstention and re-query rates, accuracy of what was answered. Whatever isn't an
    abstention counts as answered, failed samples (blank decision) too."""
    answered = F.count_if(F.col("decision") != "abstain")
    return results.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.round(ratio(F.count_if(F.col("decision") == "abstain"), F.count("*")), 6).alias("abstention_rate"),
        F.round(ratio(F.count_if((F.col("decision") != "abstain") & F.col("hit")), answered), 6).alias("accuracy_when_answered"),
        F.round(ratio(F.count_if(F.col("decision") == "re_query"), F.count("*")), 6).alias("re_query_rate"),
        F.round(ratio(F.count_if(F.coalesce("retry_count", F.lit(0)) > 0), F.count("*")), 6).alias("retried_rate"),
    )


def correct_abstention(pairs: DataFrame, *keys: str) -> DataFrame:
    """Share of abstentions where the baseline was wrong."""
    out = F.count_if(F.col("decision") == "abstain")
    good = F.count_if((F.col("decision") == "abstain") & ~F.col("b_hit"))
    return pairs.groupBy(*keys).agg(out.alias("n_abstained"), good.alias("n_correct"), F.round(ratio(good, out), 6).alias("correct_abstention_rate"))


def grounding(pairs: DataFrame, *keys: str) -> DataFrame:
    """What grounding changed: abstentions, and of the answers those that got right, got wrong,
    stayed right, stayed wrong. The five counts sum to the total."""
    answered = F.col("decision") != "abstain"
    n = {
        "improved": answered & F.col("hit") & ~F.col("b_hit"),
        "degraded": answered & ~F.col("hit") & F.col("b_hit"),
        "both_correct": answered & F.col("hit") & F.col("b_hit"),
        "both_wrong": answered & ~F.col("hit") & ~F.col("b_hit"),
        "abstained_correct": ~answered & F.col("b_hit"),
        "abstained_wrong": ~answered & ~F.col("b_hit"),
        "abstained": ~answered,
    }
    counts = pairs.groupBy(*keys).agg(*[F.count_if(v).alias(k) for k, v in n.items()], F.count("*").alias("total"))
    return counts.withColumn("net_improvement", F.col("improved") - F.col("degraded"))


def citation_relevance(results: DataFrame, *keys: str, least: int = 1) -> DataFrame:
    """Share of results decided ``answer`` with a citation that has ``least`` tokens of the question."""
    q = T.citation_tokens(F.col("question"))
    hit = F.exists(F.coalesce("citations", F.array()), lambda c: F.size(F.array_intersect(q, T.citation_tokens(c["text"]))) >= least)
    return (
        results.filter("decision = 'answer'")
        .select(*keys, hit.alias("_h"))
        .groupBy(*keys)
        .agg(F.count("*").alias("n_answered"), F.count_if("_h").alias("n_relevant"), F.round(ratio(F.count_if("_h"), F.count("*")), 6).alias("citation_relevance"))
    )


def citation_hits(results: DataFrame, *keys: str) -> DataFrame:
    """The older measure: citations with a token of the ground truth (over two letters) in
    their text; rates over results that cite anything."""
    g = F.filter(T.eval_tokens(F.col("ground_truth")), lambda t: F.length(t) > 2)
    relevant = F.size(F.filter("citations", lambda c: F.exists(g, lambda t: F.contains(F.lower(T.text_or_empty(c["text"])), t))))
    cites = F.size(F.coalesce("citations", F.array())) > 0
    cited = F.count_if("_c")
    return (
        results.select(*keys, cites.alias("_c"), F.when(cites, relevant).otherwise(0).alias("_r"))
        .groupBy(*keys)
        .agg(
            F.round(ratio(F.count_if(F.col("_c") & (F.col("_r") > 0)), cited), 6).alias("citation_hit_rate"),
            F.round(ratio(F.sum("_r"), cited), 6).alias("mean_relevant_citations"),
            cited.alias("total_cited"),
            F.count_if(~F.col("_c")).alias("total_uncited"),
        )
    )


def benchmark(results: DataFrame, *keys: str) -> DataFrame:
    """Three accuracies and six counts under the benchmark's looser normal form."""
    hit = T.normalize_bench(F.col("prediction")) == T.normalize_bench(F.col("ground_truth"))
    kind = lambda k: F.lit(True) if k == "total" else F.col("answer_type") == k
    out = results.withColumn("_h", hit).groupBy(*keys).agg(
        *[F.count_if(kind(k)).alias(f"n_{k}") for k in ("total", "closed", "open")],
        *[F.count_if(kind(k) & F.col("_h")).alias(f"correct_{k}") for k in ("total", "closed", "open")],
    )
    for k in ("total", "closed", "open"):
        out = out.withColumn(f"accuracy_{k}", F.round(ratio(F.col(f"correct_{k}"), F.col(f"n_{k}")), 6))
    return out


def latencies(results: DataFrame, *keys: str) -> DataFrame:
    """Total, mean, the true median, and the upper one (the element at n div 2); throughput."""
    x = results.filter("latency_seconds IS NOT NULL AND NOT isnan(latency_seconds)")
    n, total = F.count("*"), F.sum("latency_seconds")
    out = x.groupBy(*keys).agg(
        n.alias("n"),
        total.alias("_t"),
        F.median("latency_seconds").alias("_m"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY latency_seconds)").alias("_low"),
    )
    # the upper median is the next value above the lower one if n is even
    upper = F.when(F.col("n") % 2 == 1, F.col("_m")).otherwise(2 * F.col("_m") - F.col("_low"))
    return out.select(
        *keys,
        "n",
        F.round("_t", 3).alias("total_seconds"),
        F.round(F.col("_t") / F.col("n"), 3).alias("mean_seconds"),
        F.round("_m", 4).alias("median_seconds"),
        F.round(upper, 3).alias("upper_median_seconds"),
        F.round(F.try_divide(F.col("n"), F.col("_t")), 2).alias("per_second"),
    )
