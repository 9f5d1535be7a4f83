"""Answer, re-query or abstain for all queries at once: the decision rules as expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

ABSTAIN = "ABSTAIN: Unable to provide a reliable answer for this case."


@dataclass(frozen=True)
class Policy:
    """Thresholds; one of 0 for a type falls back to the global one."""

    high: float = 0.50
    low: float = 0.15
    closed_high: float = 0.50
    closed_low: float = 0.15
    open_high: float = 0.50
    open_low: float = 0.25
    evidence: float = 0.4
    similarity: float = 0.87
    max_retries: int = 1


def validated(rows: DataFrame) -> DataFrame:
    """``validation_error`` for a missing image or question, the answer type from the question
    where none is given. The error stays with the row."""
    error = F.when(T.strip(F.col("img_name")) == "", "Invalid or missing image").when(T.strip(F.col("question")) == "", "Empty question").otherwise("")
    return rows.withColumn("validation_error", error).withColumn("question", T.strip(F.col("question"))).withColumn(
        "answer_type", T.type_from_question(F.col("question"), F.lower(F.trim("answer_type")))
    )


def keyword_support() -> Column:
    """Supporting share of the evidence: items of at least the policy's score that hold a keyword
    of the question (closed or yes/no answers) or of the answer."""
    yes_no = (F.col("answer_type") == "closed") | F.lower(F.trim("visual_answer")).isin("yes", "no")
    of_question, of_answer = T.keywords(F.col("question")), T.keywords(F.col("visual_answer"))
    return F.when(yes_no & (F.size(of_question) > 0), of_question).otherwise(of_answer)


def agreement(rows: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """``rows`` (with evidence as array of struct) and n_supporting, agreement by keywords."""
    item = lambda e: F.lower(F.concat_ws(" ", T.text_or_empty(e["text"]), T.text_or_empty(e["entity_name"])))
    fits = lambda e: (e["score"] >= policy.evidence) & F.exists(F.col("_k"), lambda k: T.keyword_in(k, item(e)))
    rows = rows.withColumn("evidence", F.coalesce("evidence", F.array())).withColumn("_k", keyword_support())
    n = F.size(F.filter("evidence", fits))
    return rows.withColumn("n_supporting", n).withColumn("agreement", F.coalesce(F.try_divide(n.cast("double"), F.size("evidence")), F.lit(0.0))).drop("_k")


def compared_text() -> Column:
    """What evidence is compared with: the question of closed or yes/no answers, else the answer."""
    yes_no = (F.col("answer_type") == "closed") | F.lower(F.trim("visual_answer")).isin("yes", "no")
    return F.trim(F.when(yes_no, F.col("question")).otherwise(F.col("visual_answer")))


def vector_agreement(rows: DataFrame, evidence: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """The same by similarity: ``evidence`` has query_id, score, similarity of each item; the
    share of the query's items that pass both gates."""
    ok = F.count_if((F.col("score") >= policy.evidence) & (F.col("similarity") >= policy.similarity))
    share = evidence.groupBy("query_id").agg(ok.alias("n_supporting"), (ok / F.count("*")).alias("agreement"))
    return rows.join(share, "query_id", "left").withColumns({"n_supporting": F.coalesce("n_supporting", F.lit(0)), "agreement": F.coalesce("agreement", F.lit(0.0))})


def decided(rows: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """``decision``, ``grounded_confidence`` and the retry count after it. Bounds are inclusive,
    and the high one holds first where it is below the low one; only an answer keeps its confidence."""
    pick = lambda own, rest: own if own > 0 else rest
    closed = F.col("answer_type") == "closed"
    high = F.when(closed, pick(policy.closed_high, policy.high)).otherwise(pick(policy.open_high, policy.high))
    low = F.when(closed, pick(policy.closed_low, policy.low)).otherwise(pick(policy.open_low, policy.low))
    c, a = F.coalesce("confidence", F.lit(0.0)), F.col("agreement")
    again = F.when(F.coalesce("retry_count", F.lit(0)) < policy.max_retries, "re_query").otherwise("abstain")
    decision = F.when(T.text_or_empty(F.col("visual_error")) != "", "abstain").when((c < low) & (c < high), "abstain").when(a > 0, "answer").otherwise(again)
    kept = F.when(c >= high, c * (0.5 + 0.5 * a)).otherwise(c * (0.3 + 0.7 * a))
    return (
        rows.withColumn("decision", decision)
        .withColumn("grounded_confidence", F.when(F.col("decision") == "answer", kept).otherwise(0.0))
        .withColumn("retry_count", F.coalesce("retry_count", F.lit(0)) + F.when(F.col("decision") == "re_query", 1).otherwise(0))
    )


def with_retries(rows: DataFrame, fetch, policy: Policy = Policy()) -> DataFrame:
    """The bounded loop unrolled: rows decided ``re_query`` get new evidence from
    ``fetch(rows)`` and are decided again, at most max_retries times."""
    done = decided(agreement(rows, policy), policy)
    for _ in range(policy.max_retries):
        open_ = done.filter("decision = 're_query'").drop("n_supporting", "agreement", "decision", "grounded_confidence")
        done = done.filter("decision <> 're_query'").unionByName(decided(agreement(fetch(open_), policy), policy))
    return done


def formatted(rows: DataFrame) -> DataFrame:
    """Final answer, confidence, at most three citations by falling score, and whether a person
    has to look. Whatever isn't an answer abstains."""
    ok = F.col("decision") == "answer"
    better = lambda x, y: F.when(x["score"] > y["score"], -1).when(x["score"] < y["score"], 1).when(x["rank_no"] < y["rank_no"], -1).when(x["rank_no"] > y["rank_no"], 1).otherwise(0)
    best = F.slice(F.array_sort("evidence", better), 1, 3)
    return (
        rows.withColumn("final_answer", F.when(ok, F.col("visual_answer")).otherwise(ABSTAIN))
        .withColumn("final_confidence", F.when(ok, F.col("grounded_confidence")).otherwise(0.0))
        .withColumn("citations", F.when(ok, best).otherwise(F.slice("evidence", 1, 0)))
        .withColumn("requires_human_review", ~ok)
    )
