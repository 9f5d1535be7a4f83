"""Report text from small summary tables; only these reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import calibration, compare, metrics, results

# What a report says of each flag: (flag, measure it quotes or None, text).
ADVICE = (
    ("high_abstention", "abstention_rate", "Many questions stay unanswered ({}); a lower confidence bound would answer more of them."),
    ("low_citation_relevance", None, "Fewer than half of the answers cite a text that shares a word with the question; the index lacks what is asked for."),
    ("low_open_accuracy", "open_accuracy", "Open questions are seldom right ({}); the model needs training on such questions."),
    ("high_ece", "ece", "Confidence and accuracy lie apart ({}); fit a scaler."),
    ("grounding_hurt", "overall_accuracy", "Retrieval lowers accuracy (now {}); ask more of the evidence, or better the index."),
)


def comparison_rows(summaries: DataFrame, baseline: str) -> DataFrame:
    """run_id, metric, agent, baseline, delta as they are printed."""
    d = compare.deltas(summaries, baseline)
    plain = F.col("metric").isin("token_f1", "bleu_1", "closed_f1", "ece", "auroc")
    show = lambda c: F.when(plain, T.score(F.col(c))).otherwise(T.percent(F.col(c)))
    # no answer is withheld in the baseline, and a score without change has no delta to show
    delta = (
        F.when(F.col("metric").isin("abstention_rate", "accuracy_when_answered"), "—")
        .when(F.col("metric").isin("ece", "auroc"), T.signed_score(F.col("delta"), False))
        .when(plain, T.signed_score(F.col("delta"), True))
        .otherwise(T.signed(F.col("delta")))
    )
    return d.select("run_id", "metric", show("agent").alias("agent"), show("baseline").alias("baseline"), delta.alias("delta"))


def markdown(summaries: DataFrame, flags: DataFrame, baseline: str) -> str:
    """Comparison table of each run and what to look at."""
    out = ["# Evaluation report", ""] + _table("run metric value baseline delta", comparison_rows(summaries, baseline).orderBy("run_id", "metric").collect())  # runs x metrics
    out += ["", "## Remarks", ""]
    for r in flags.orderBy("run_id").collect():  # one row a run
        told = [k.replace("_", " ") for k, v in r.asDict().items() if v is True]
        out.append(f"- {r.run_id}: {', '.join(told) or 'nothing stands out'}")
    return "\n".join(out) + "\n"


def _table(titles: str, rows) -> list[str]:
    names = titles.split()
    return ["| " + " | ".join(names) + " |", "|" + "---|" * len(names), *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)]


def _percent(x: float | None) -> str:
    return "N/A" if x is None or x < 0 else f"{100 * x:.1f}%"


def _score(x: float | None, digits: int = 3) -> str:
    return "N/A" if x is None or x < 0 else f"{x:.{digits}f}"


def _one(df: DataFrame, run: str) -> Row | None:
    return df.filter(F.col("run_id") == run).first()


def sections(rows: DataFrame, run: str, baseline: str, title: str) -> list[tuple[str, str]]:
    """(section, text) of the report on ``run``, in order: header, executive summary, baseline results,
    results comparison, closed and open questions, grounding, agent behaviour, calibration, errors,
    recommendations. ``rows`` are matched results of all runs; without rows of the baseline
    its sections say so."""
    summaries = compare.summary(rows)
    told = {r.run_id: r for r in summaries.filter(F.col("run_id").isin(run, baseline)).collect()}
    own, base = told.get(run), told.get(baseline)
    if own is None:
        raise ValueError(f"no results of run {run!r}")
    of_run = rows.filter(F.col("run_id") == run)
    n = {r.kind: r for r in metrics.by_type(of_run, "run_id").collect()}
    last = results.last_per_sample(rows)
    mine, other = last.filter(F.col("run_id") == run), last.filter(F.col("run_id") == baseline)
    test = compare.mcnemar(results.paired(mine, other), "run_id").first() if base else None
    ground = metrics.grounding(results.paired(mine, other), "run_id").first() if base else None
    out = [("header", f"# {title}\n\nRun {run}, {n['overall'].n} results")]

    if base:
        change = own.overall_accuracy - base.overall_accuracy
        sure = ", significant at 5 %" if test and test.significant else ""
        text = (
            f"{run} is right in {_percent(own.overall_accuracy)} of the cases, {baseline} in {_percent(base.overall_accuracy)}: {100 * change:+.1f} points{sure}. "
            f"Retrieval set {ground.net_improvement if ground else 0:+d} samples right on balance. {_percent(own.abstention_rate)} were not answered; of the answers {_percent(own.accuracy_when_answered)} are right."
        )
    else:
        text = f"{run} is right in {_percent(own.overall_accuracy)} of the cases (closed {_percent(own.closed_accuracy)}, open {_percent(own.open_accuracy)}); its calibration error is {_score(own.ece)}."
    out.append(("executive summary", text))
    accuracy = lambda r: (r.run_id, _percent(r.overall_accuracy), _percent(r.closed_accuracy), _percent(r.open_accuracy))
    out.append(("baseline results", "\n".join(_table("run overall closed open", [accuracy(r) for r in (base, own) if r]))))
    if base:
        compared = comparison_rows(summaries, baseline).filter(F.col("run_id") == run).drop("run_id").orderBy("metric").collect()
        line = f"McNemar: statistic {test.statistic:.3f}, p = {test.p_value:.4f}, {'significant' if test.significant else 'not significant'} at 5 %." if test else "McNemar: no common samples."
        out.append(("results comparison", "\n".join([*_table("metric value baseline delta", compared), "", line])))

    c, f = _one(metrics.confusion(of_run, "run_id"), run), _one(metrics.precision_recall_f1(of_run, "run_id"), run)
    closed, open_ = n.get("closed"), n.get("open")
    lines = [f"{closed.n if closed else 0} results, accuracy {_percent(closed.accuracy if closed else None)}, precision {_percent(f.precision)}, recall {_percent(f.recall)}, F1 {_percent(f.f1)}.", ""]
    out.append(("closed questions", "\n".join(lines + _table("truth yes no", [("yes", f"TP {c.tp}", f"FN {c.fn}"), ("no", f"FP {c.fp}", f"TN {c.tn}")]))))
    t = {r.answer_type: r for r in metrics.text_scores(of_run, "answer_type").collect()}.get("open")
    of_model = "not computed" if t is None or t.bert_score_f1 < 0 else _score(t.bert_score_f1)
    text = f"{open_.n if open_ else 0} results, accuracy {_percent(open_.accuracy if open_ else None)}, token F1 {_score(t.token_f1 if t else None)}, BLEU-1 {_score(t.bleu_1 if t else None)}, model-based score {of_model}."
    out.append(("open questions", text))
    if ground:
        kinds = [k for k in ground.asDict() if k not in ("run_id", "abstained", "total", "net_improvement")]
        shares = [(k.replace("_", " "), ground[k], _percent(ground[k] / ground.total if ground.total else 0.0)) for k in kinds]
        out.append(("grounding", "\n".join(_table("case count share", [*shares, ("net improvement", f"{ground.net_improvement:+d}", "—")]))))

    relevant, hits = _one(metrics.citation_relevance(of_run, "run_id"), run), _one(metrics.citation_hits(of_run, "run_id"), run)
    text = (
        f"Not answered {_percent(own.abstention_rate)}, right when answered {_percent(own.accuracy_when_answered)}, asked again {_percent(own.re_query_rate)}, "
        f"citations with a word of the question {_percent(relevant.citation_relevance if relevant else 0.0)}, with a word of the truth {_percent(hits.citation_hit_rate if hits else 0.0)}."
    )
    out.append(("agent behaviour", text))
    d = _one(calibration.discrimination(of_run, "run_id"), run)
    lines = [f"ECE {_score(own.ece, 4)}, AUROC {_score(own.auroc)}, mean confidence {_score(d.mean_correct if d else None)} when right and {_score(d.mean_wrong if d else None)} when wrong.", ""]
    bins = [r for r in calibration.bins(of_run, "run_id").orderBy("bin").collect() if r.n]
    lines += _table("bin count confidence accuracy gap", [(f"{r.lo:.1f}–{r.hi:.1f}", r.n, _score(r.mean_confidence), _score(r.accuracy), _score(abs(r.accuracy - r.mean_confidence))) for r in bins])
    at = calibration.thresholds(of_run, "run_id").orderBy("threshold").collect()
    lines += ["", *_table("threshold coverage accuracy count", [(f"{r.threshold:.2f}", _percent(r.coverage), _percent(r.accuracy), r.n_covered) for r in at])]
    best = _one(calibration.recommendation(of_run, "run_id"), run)
    lines += ["", f"Recommended threshold: {best.threshold:.2f} (coverage {_percent(best.coverage)}, accuracy {_percent(best.accuracy)})." if best else "No threshold covers half of the results."]
    out.append(("calibration", "\n".join(lines)))

    both = results.with_baseline(mine, other) if base else mine.withColumn("baseline_hit", F.col("hit"))
    lines = []
    for kind, most in (("wrong", 10), ("over_abstain", 5), ("improved_answered", 5)):
        found = compare.errors(both, kind, most).orderBy("result_id").collect()
        if found:
            lines += [f"### {kind.replace('_', ' ')}", "", *(f"{i}. `{r.sample_id}`: said {r.prediction!r}, truth {r.ground_truth!r}" for i, r in enumerate(found, 1)), ""]
    out.append(("errors", "\n".join(lines) or "None."))
    flagged = _one(compare.flags(summaries, metrics.citation_relevance(rows, "run_id"), baseline), run) if base else None
    said = [text.format(_percent(own[m]) if m and m != "ece" else _score(own.ece)) for k, m, text in ADVICE if flagged and flagged[k]]
    out.append(("recommendations", "\n".join(f"- {x}" for x in said or ["Nothing stands out; evaluate on more collections and vary the number of retrieved texts."])))
    return out


def full_markdown(found: list[tuple[str, str]]) -> str:
    return "\n\n".join(text if name == "header" else f"## {name.capitalize()}\n\n{text}" for name, text in found) + "\n"
