"""Order of loading, shares, retrieval in partitions, scans and the report, on small tables."""

import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lumenquarry.functions import arrays
from lumenquarry.operators import audit, compare, decide, results, retrieval
from lumenquarry.plans import report
from lumenquarry.sources import readers, sinks


def test_first_in_load_order(spark):
    """Number 2 comes before number 10, train before test, and one collection before the other."""
    rows = [("vqa_rad_train_10", "vqa_rad", "i"), ("vqa_rad_train_2", "vqa_rad", "i"), ("vqa_rad_test_1", "vqa_rad", "i"), ("slake_train_1", "slake", "i"), ("slake_train_x", "slake", "i")]
    df = spark.createDataFrame([(*r, "Is it?", "Yes ") for r in rows], "sample_id string, source string, img_name string, question string, answer string")
    assert {r.sample_id for r in audit.first_of_each(df).collect()} == {"vqa_rad_train_2", "slake_train_1"}
    assert [r.sample_id for r in audit.first_of_each(df, "img_name", "q", "a").collect()] == ["vqa_rad_train_2"]


@pytest.mark.parametrize("n", [0, 1, 9, 10, 57, 400])
def test_last_share(spark, monkeypatch, n):
    monkeypatch.setattr(audit, "LAST_PARTS", 7)
    rng = random.Random(n)
    rows = [(f"s{i}", rng.choice([i, i, 3])) for i in range(n)] + [("none", None)]
    got = sorted(r.sample_id for r in audit.last_share(spark.createDataFrame(rows, "sample_id string, i long"), "i", 0.1).collect())
    order = sorted(((i, s) for s, i in rows if i is not None), reverse=True)
    assert got == sorted(s for _, s in order[: max(1, int(n * 0.1))] if n)


def test_best_keeps_ties_in_order():
    rng = np.random.default_rng(4)
    for newest in (False, True):
        best, scores, docs = retrieval.Best(5, newest), rng.integers(0, 4, (3, 60)).astype(float), rng.permutation(60)
        for i in range(0, 60, 13):
            best.add(np.where(scores > 0, scores, -np.inf)[:, i : i + 13], docs[i : i + 13])
        q, s, d = best.rows
        for k in range(3):
            want = sorted((-x, -doc if newest else doc) for x, doc in zip(scores[k], docs) if x > 0)[:5]
            assert [(-x, -doc if newest else doc) for x, doc in zip(s[q == k], d[q == k])] == want


def test_bm25_blocks_nulls_and_repeats(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b b c"), (2, "a"), (3, None), (4, ""), (5, "b c d e")], "doc_id long, text string").withColumn("term", F.lit("clash"))
    queries = spark.createDataFrame([(1, "b b"), (2, "zz"), (3, None), (None, "b"), (4, "C d")], "query_id long, text string")
    whole = sorted(map(tuple, retrieval.bm25_topk(queries, docs).collect()))
    assert {(q, d) for q, d, _, _ in whole} == {(1, 1), (1, 5), (4, 1), (4, 5)}
    monkeypatch.setattr(retrieval, "BLOCK", 1)
    assert sorted(map(tuple, retrieval.bm25_topk(queries, docs).collect())) == whole
    assert retrieval.bm25_topk(queries, docs.limit(0)).count() == 0 and retrieval.bm25_topk(queries.limit(0), docs).count() == 0


def test_saved_postings(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b b c"), (2, "a x y"), (5, "b c d e")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "b a")], "query_id long, text string")
    assert sinks.save_postings(docs, str(tmp_path)) == 7
    assert retrieval.bm25_topk(queries, readers.postings(spark, str(tmp_path))).collect() == retrieval.bm25_topk(queries, docs).collect()


def test_filter_by_label_in_one_pass(spark):
    rng = np.random.default_rng(2)
    v = [(i, rng.normal(size=3).tolist(), None if i % 11 == 0 else i % 4) for i in range(60)]
    vectors = spark.createDataFrame([r[:2] for r in v], "doc_id long, embedding array<double>")
    labels = spark.createDataFrame([(i, k) for i, _, k in v], "doc_id long, label int")
    queries = spark.createDataFrame([(i, e, k) for i, e, k in v[:13]], "query_id long, embedding array<double>, label int")
    got = {}
    for r in retrieval.filtered_topk(queries, vectors, labels, 3, "pushdown").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    want = {i: [d for _, d in sorted((-round(float(np.dot(e, f)), 6), j) for j, f, m in v if m == k)[:3]] for i, e, k in v[:13] if k is not None}
    assert got == want


def test_verdict(spark):
    q = spark.createDataFrame([(i, "left lung nodule") for i in range(10)], "query_id long, text string")
    docs = spark.createDataFrame([(1, "a nodule", "s", "e", "a"), (2, "something else", "s", None, None)], "doc_id long, text string, source string, entity_name string, attribute string")
    for n, want in ((4, "PASS"), (3, "PARTIAL"), (2, "FAIL"), (0, "FAIL")):
        hits = spark.createDataFrame([(i, 1 if i < n else 2, 0.5, 1) for i in range(9)], "query_id long, doc_id long, score double, rank int")
        assert tuple(retrieval.verdict(hits, q, docs).first()) == (10, n, n / 10, want)
    assert retrieval.verdict(hits.limit(0), q.limit(0), docs).first().verdict == "FAIL"
    rows = retrieval.with_documents(hits.limit(0).union(spark.createDataFrame([(7, 2, 0.5, 2), (7, 1, 0.9, 1), (7, 99, 0.1, 3)])), docs).collect()
    assert [(e.rank_no, e.text, e.entity_name) for e in rows[0].evidence] == [(1, "a nodule", "e"), (2, "something else", None)]


def test_high_bound_below_the_low_one(spark):
    row = spark.createDataFrame([(0.4, 1.0, "open", "", 0)], "confidence double, agreement double, answer_type string, visual_error string, retry_count int")
    assert decide.decided(row, decide.Policy(open_high=0.3, open_low=0.6)).first().decision == "answer"
    assert decide.decided(row, decide.Policy(open_high=0.7, open_low=0.6)).first().decision == "abstain"


def test_triples_with_quotes_and_repeated_heading(spark, tmp_path):
    (tmp_path / "en_disease.csv").write_text('head#relation#tail\nflu#cause#"a # sign"\nhead#relation#tail\nflu#cause#\nx#y\n"two\nlines"#is#z\n', encoding="utf-8")
    got = sorted(map(tuple, readers.kg_triples(spark, str(tmp_path)).collect()))
    assert got == [("flu", "cause", "a # sign", "disease"), ("head", "relation", "tail", "disease"), ("two\nlines", "is", "z", "disease")]


def test_ontology_by_place(spark, tmp_path):
    cells = [f"c{i}" for i in range(47)]
    (tmp_path / "o.csv").write_text(",".join(f"h{i}" for i in range(47)) + "\n" + ",".join(cells) + "\n", encoding="utf-8")
    assert tuple(readers.ontology(spark, str(tmp_path / "o.csv")).first()) == ("c46", "c1", "c28", "c3", "c2", "c4")
    (tmp_path / "n.csv").write_text("label,rid,full_def,short_def,synonyms,obsolete\nl,r,f,s,y,1\n", encoding="utf-8")
    assert tuple(readers.ontology(spark, str(tmp_path / "n.csv")).first()) == ("r", "l", "f", "s", "y", "1")


RESULT = "result_id long, run_id string, sample_id string, question string, prediction string, ground_truth string, answer_type string, confidence double, decision string, retry_count int, latency_seconds double, citations array<struct<text:string>>, ingested_at long, created_at long"


def _results(spark, runs):
    rows, k = [], 0
    for run in runs:
        for i in range(40):
            k += 1
            truth = "yes" if i % 2 else "left lung"
            said = truth if (i + len(run)) % 3 else "no"
            rows.append((k, run, f"s{i}", "Is the lung clear?", said, truth, "closed" if i % 2 else "open", (i % 10) / 10, "abstain" if run == "agent" and i % 7 == 0 else "answer", 0, 1.0, [Row(text="a lung")], 1, 1))
    return results.matched(results.one_delivery(spark.createDataFrame(rows, RESULT)))


def test_report_sections(spark):
    found = report.sections(_results(spark, ("agent", "base")), "agent", "base", "Report")
    assert [name for name, _ in found] == [
        "header", "executive summary", "baseline results", "results comparison", "closed questions", "open questions",
        "grounding", "agent behaviour", "calibration", "errors", "recommendations",
    ]
    text = report.full_markdown(found)
    assert "McNemar" in text and "Recommended threshold" in text and "net improvement" in text and "| truth | yes | no |" in text
    alone = dict(report.sections(_results(spark, ("agent",)), "agent", "base", "Report"))
    assert "grounding" not in alone and "results comparison" not in alone and "open" in alone["executive summary"]
    with pytest.raises(ValueError):
        report.sections(_results(spark, ("agent",)), "none", "base", "Report")


def test_ablation_of_the_model_alone(spark):
    s = spark.createDataFrame([("base", 0.5, 0.9, 0.3, 0.1, 0.6), ("agent", 0.6, 0.0, 0.2, 0.1, 0.6)], "run_id string, overall_accuracy double, accuracy_when_answered double, abstention_rate double, ece double, auroc double")
    got = {r.run_id: (r.accuracy_when_answered, r.abstention_rate) for r in compare.ablation(s, [(1, "base"), (2, "agent"), (3, "gone")], ("base",)).collect()}
    assert got == {"base": (0.5, 0.0), "agent": (0.6, 0.2), "gone": (None, None)}


@pytest.mark.parametrize(("b", "c", "p"), [(2, 2, 1.0), (10, 2, 0.038574), (30, 10, 0.002663), (0, 0, 1.0)])
def test_mcnemar_values(b, c, p):
    assert round(compare.mcnemar_p(b, c)[1], 6) == p


def test_thresholds_fall_back(spark, tmp_path):
    sinks.save_thresholds(spark, f"{tmp_path}/t.yaml", {"open": (0.7, 0.3), "combined": (0.6, 0.2)}, "platt")
    text = (tmp_path / "t.yaml").read_text()
    assert "closed_high_confidence: 0.60" in text and "open_low_confidence: 0.30" in text
    sinks.save_thresholds(spark, f"{tmp_path}/u.yaml", {}, "none")
    assert "closed_high_confidence: 0.65" in (tmp_path / "u.yaml").read_text() and "open_low_confidence: 0.55" in (tmp_path / "u.yaml").read_text()


def test_sweep_files(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"combined": [{"high_t": 0.5}]}')
    assert readers.sweep_rows(spark, f"{tmp_path}/b.json").count() == 0
    (tmp_path / "c.json").write_text('{"other": 1}')
    with pytest.raises(ValueError):
        readers.sweep_rows(spark, f"{tmp_path}/c.json")


def test_token_probabilities(spark):
    row = spark.createDataFrame([([[1.0, 1.0], [0.0, 0.0, 0.0, 0.0]], [0, 3])], "x array<array<double>>, i array<int>")
    assert [round(p, 6) for p in row.select(arrays.token_probabilities(F.col("x"), F.col("i"))).first()[0]] == [0.5, 0.25]
