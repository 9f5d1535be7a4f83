import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from lumenquarry.operators import audit, calibration, compare, corpus, decide, metrics, results, retrieval
from lumenquarry.plans import report
from lumenquarry.sources import readers, sinks
from lumenquarry.streaming import ingest

T0 = dt.datetime(2025, 1, 1)


def frame(spark, rows):
    cols = "prediction string, ground_truth string, answer_type string, confidence double, decision string, run_id string, sample_id string, result_id long, question string, retry_count int, latency_seconds double"
    full = []
    for i, r in enumerate(rows):
        d = dict(prediction="yes", ground_truth="yes", answer_type="closed", confidence=0.5, decision="answer", run_id="a", sample_id=f"s_val_{i}", result_id=i, question="Is it?", retry_count=0, latency_seconds=1.0)
        full.append(tuple((d | r).values()))
    return results.matched(spark.createDataFrame(full, cols))


def test_token_f1_and_bleu(spark):
    df = frame(spark, [dict(prediction="left lung", ground_truth="left lower lung"), dict(prediction="", ground_truth="x"), dict(prediction="lung lung", ground_truth="lung")])
    got = [tuple(r) for r in df.select(metrics.token_f1(), metrics.bleu_1()).collect()]
    assert got[0] == pytest.approx((0.8, math.exp(-0.5)))
    assert got[1] == (0.0, 0.0)
    assert got[2] == pytest.approx((1.0, 0.5))


def test_yes_bias(spark):
    rows = [dict(prediction="yes", ground_truth="yes")] * 3 + [dict(prediction="yes", ground_truth="no")] * 2 + [dict(prediction="left", ground_truth="no")]
    r = metrics.precision_recall_f1(frame(spark, rows)).first()
    assert (r.precision, r.recall, r.f1, r.excluded) == (0.6, 1.0, 0.75, 1)


def test_empty_results(spark):
    none = frame(spark, []).limit(0)
    assert metrics.exact_match(none).first().accuracy == 0.0
    assert metrics.by_type(none, "run_id").count() == 0
    assert calibration.ece(none).first().ece == 0.0
    assert calibration.fit_platt(none) == (1.0, 0.0)
    assert calibration.fit_isotonic(none) == ([], [])


@pytest.mark.parametrize("confidences, hits, want", [([1.0, 1.0], [1, 1], 0.0), ([1.0, 1.0], [1, 0], 0.5), ([0.9] * 2, [1, 1], 0.1), ([0.1], [1], 0.9)])
def test_ece(spark, confidences, hits, want):
    rows = [dict(confidence=c, ground_truth="yes" if h else "no") for c, h in zip(confidences, hits)]
    assert calibration.ece(frame(spark, rows)).first().ece == pytest.approx(want)


def test_bins_edges(spark):
    rows = [dict(confidence=c) for c in (0.8999999999999999, 0.9, 1.0, 1.5, -0.2, 0.0)] + [dict(confidence=None)]
    n = [r.n for r in calibration.bins(frame(spark, rows)).orderBy("bin").collect()]
    assert n == [1, 0, 0, 0, 0, 0, 0, 0, 1, 2]
    assert calibration.ece(frame(spark, rows)).first().n == 6


def test_auroc_ties(spark):
    rows = [dict(confidence=0.5, ground_truth=g) for g in ("yes", "no")]
    assert calibration.discrimination(frame(spark, rows)).first().auroc == 0.5
    assert calibration.discrimination(frame(spark, rows[:1])).first().auroc == 0.5
    rows = [dict(confidence=0.9), dict(confidence=0.1, ground_truth="no")]
    assert calibration.discrimination(frame(spark, rows)).first().auroc == 1.0


def test_grid_has_low_below_high(spark):
    rows = calibration.sweep(frame(spark, [dict()])).filter("kind = 'combined'")
    assert rows.count() == 59
    assert rows.filter("low_t >= high_t").count() == 0


def test_isotonic_is_monotone(spark):
    df = frame(spark, [dict(confidence=c, ground_truth=g) for c, g in ((0.1, "no"), (0.2, "yes"), (0.3, "no"), (0.8, "yes"))])
    _, ys = calibration.fit_isotonic(df)
    assert ys == sorted(ys)
    a, _ = calibration.fit_platt(df)
    assert a > 0


@pytest.mark.parametrize("b, c, want", [(2, 2, 1.0), (5, 0, 0.0625), (10, 5, 0.3017578125), (30, 10, math.erfc(math.sqrt(19**2 / 40 / 2)))])
def test_mcnemar(b, c, want):
    assert compare.mcnemar_p(b, c)[1] == pytest.approx(want)


def test_grounding_counts_sum(spark):
    rows = [dict(decision=d, prediction=p) for d in ("answer", "abstain", "") for p in ("yes", "no")]
    agent = frame(spark, rows)
    base = frame(spark, [dict(r, prediction="no" if i % 3 else "yes", run_id="b") for i, r in enumerate(rows)])
    g = metrics.grounding(results.paired(agent, base)).first()
    assert g.improved + g.degraded + g.both_correct + g.both_wrong + g.abstained == g.total == 6


def test_missing_baseline_is_its_own(spark):
    a = frame(spark, [dict(), dict(prediction="no")])
    out = results.with_baseline(a, a.limit(0)).select("hit", "baseline_hit").collect()
    assert all(r.hit == r.baseline_hit for r in out)


def test_progress_and_resume(spark):
    df = frame(spark, [dict(result_id=i, latency_seconds=None if i == 0 else 2.0) for i in range(60)])
    assert [r.done for r in compare.progress(df, 25).orderBy("done").collect()] == [25, 50, 60]
    assert results.remaining(df, df.limit(0)).count() == 60


def test_latency_medians(spark):
    r = metrics.latencies(frame(spark, [dict(latency_seconds=x) for x in (1.0, 2.0, 3.0, 10.0, float("nan"))])).first()
    assert (r.median_seconds, r.upper_median_seconds, r.n) == (2.5, 3.0, 4)


def triples(spark, rows):
    return spark.createDataFrame([(i, *r, "f") for i, r in enumerate(rows)], "triple_id long, head string, relation string, tail string, category string, source_file string")


def test_kg_documents(spark):
    t = corpus.triples(triples(spark, [(" Asthma ", "symptom", "cough", "disease"), ("Asthma", "symptom", "wheeze", "disease"), ("Lung", "odd", "x", "organ"), ("Lung", "belong_to", "chest", "organ_rel"), ("Lung", "shape", " ", "organ"), ("Lung", "shape", None, "organ")]))
    got = {r.doc_key: r.text for r in corpus.kg_documents(t).collect()}
    assert got == {
        "kg_disease_asthma_symptom_0": "Asthma symptoms include: wheeze",
        "kg_disease_asthma_summary_0": "Asthma. Symptoms: wheeze.",
        "kg_organ_lung_odd_0": "Lung odd: x",
        "kg_organ_lung_summary_0": "Lung.",
        "kg_organ_rel_lung_belong_to_0": "Lung belongs to the chest.",
    }


def test_ontology_rows(spark):
    rows = [("R1", "Lung", "full", "short", "a|b", "0"), (None, "Bad é", None, "short", None, None), ("R3", "Old", "x", None, None, "1"), ("R4", " ", "x", None, None, None), ("R5", "None", "", " ", None, None)]
    df = spark.createDataFrame(rows, "rid string, label string, full_def string, short_def string, synonyms string, obsolete string")
    assert {r.doc_key: r.text for r in corpus.ontology_documents(df).collect()} == {"radlex_R1": "Lung: full Also known as: a, b", "radlex_bad": "Bad : short"}
    assert {r.reason: r.n for r in corpus.ontology_skips(df).collect()} == {"kept": 2, "obsolete": 1, "no_label": 1, "no_definition": 1}


def test_dense_and_fusion(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)] + [(9, None)], "doc_id long, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, embedding array<double>")
    top = retrieval.dense_topk(q, v, 2)
    assert [(r.doc_id, r["rank"]) for r in top.orderBy("rank").collect()] == [(5, 1), (4, 2)]
    assert retrieval.dense_topk(q, v.limit(0), 2).count() == 0
    assert retrieval.dense_topk(q.limit(0), v, 2).count() == 0
    bm = spark.createDataFrame([(1, 4, 9.0, 1), (1, 7, 8.0, 2)], "query_id long, doc_id long, score double, rank int")
    f = retrieval.fused(bm, top).orderBy("rank").collect()
    assert [r.doc_id for r in f] == [4, 5, 7] and f[0].score == 1.0
    assert retrieval.fused(bm, top, min_score=0.99).count() == 1


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "lung mass"), (2, "lung lung"), (3, "bone"), (4, None), (5, "")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "Lung lung"), (2, "absent"), (3, None)], "query_id long, text string")
    got = [r.doc_id for r in retrieval.bm25_topk(q, docs).orderBy("rank").collect()]
    assert got == [2, 1]


EV = "array<struct<text:string,score:double,source_type:string,entity_name:string,attribute:string,rank_no:int>>"


def queries(spark, rows):
    return spark.createDataFrame(rows, f"id int, question string, answer_type string, confidence double, evidence {EV}, visual_error string, visual_answer string, retry_count int")


def test_decisions(spark):
    good, bad = [("the lungs are clear", 0.9, "", "", "", 2), ("lung", 0.95, "", "", "", 1)], [("bone", 0.9, "", "", "", 1)]
    df = queries(
        spark,
        [
            (1, "Is the lung clear?", "closed", 0.9, good, "", "yes", 0),
            (2, "Is the lung clear?", "closed", 0.9, bad, "", "yes", 0),
            (3, "Is the lung clear?", "closed", 0.9, bad, "", "yes", 1),
            (4, "What?", "open", 0.3, good, "", "lung", 0),
            (5, "What?", "open", 0.1, good, "", "lung", 0),
            (6, "What?", "open", 0.9, good, "failed", "lung", 0),
            (7, "What?", "open", 0.25, None, "", "lung", 0),
            (8, "What?", "open", None, good, "", "lung", 0),
        ],
    )
    out = {r.id: (r.decision, round(r.grounded_confidence, 4), r.retry_count) for r in decide.decided(decide.agreement(df)).collect()}
    assert out == {1: ("answer", 0.9, 0), 2: ("re_query", 0.0, 1), 3: ("abstain", 0.0, 1), 4: ("answer", 0.3, 0), 5: ("abstain", 0.0, 0), 6: ("abstain", 0.0, 0), 7: ("re_query", 0.0, 1), 8: ("abstain", 0.0, 0)}
    final = decide.with_retries(df, lambda rows: rows)
    assert final.filter("decision = 're_query'").count() == 0
    done = {r.id: r for r in decide.formatted(final).collect()}
    assert [c.rank_no for c in done[1].citations] == [1, 2] and not done[1].requires_human_review
    assert done[2].final_answer == decide.ABSTAIN and done[2].citations == []


def test_vector_agreement(spark):
    rows = spark.createDataFrame([(1,), (2,)], "query_id long")
    ev = spark.createDataFrame([(1, 0.9, 0.9), (1, 0.3, 0.9), (1, 0.9, 0.5), (1, 0.4, 0.87)], "query_id long, score double, similarity double")
    got = {r.query_id: (r.n_supporting, r.agreement) for r in decide.vector_agreement(rows, ev).collect()}
    assert got == {1: (2, 0.5), 2: (0, 0.0)}


def test_audit(spark):
    s = spark.createDataFrame(
        [("a_train_0", "x", "Q ", "A", "i"), ("a_test_0", "x", "q", "a", "i"), ("a_test_1", "x", "q", "b", None), ("a_train_1", "x", "q", "b", None), ("a_val_2", "x", None, None, None)],
        "sample_id string, source string, question string, answer string, img_name string",
    )
    assert {r.kind: r.n for r in audit.overlap(s).collect()} == {"question": 1, "question_answer": 2, "question_answer_image": 2}
    assert {(r.q, r.a): r.same_image for r in audit.shared_pairs(s).collect()} == {("q", "a"): True, ("q", "b"): False}
    assert audit.duplicates(s, 1).first().n == 2
    assert audit.first_of_each(s).count() == 3
    assert audit.profile(s).first().n_empty_answer == 1
    assert audit.missing_references(s, s.limit(0), "img_name", "img_name").count() == 1


def test_sources_and_sinks(spark, tmp_path):
    kg = tmp_path / "KG"
    kg.mkdir()
    (kg / "en_disease.csv").write_text("subject#rel#object\nAsthma#symptom# cough \nx#y\n#a#b\n")
    (kg / "._en_disease.csv").write_text("bad")
    assert [tuple(r) for r in readers.kg_triples(spark, str(kg)).collect()] == [("Asthma", "symptom", "cough", "disease")]
    (tmp_path / "train.json").write_text(
        '[{"qid":1,"img_name":"a","question":"Q","answer":"yes","answer_type":"CLOSED","q_lang":"en","modality":"X-Ray","triple":["l","is","o"]},'
        '{"qid":2,"img_name":"a","question":"q ","answer":"Yes","answer_type":"CLOSED","q_lang":"en"},{"qid":3,"img_name":"b","question":"Q","answer":"是","q_lang":"zh"},'
        '{"qid":4,"img_name":"c","question":"Q","answer":" ","q_lang":"en"}]'
    )
    got = readers.slake(spark, str(tmp_path), "train").collect()
    assert [(r.sample_id, r.answer_type, r.modality, r.triple) for r in got] == [("slake_train_1", "closed", "xray", ["l", "is", "o"])]
    with pytest.raises(ValueError):
        readers.slake(spark, str(tmp_path), "nope")
    docs = spark.createDataFrame([(1, "a b", "kg"), (2, "b c", "qa")], "doc_id long, text string, source string")
    sinks.save_index(docs, f"{tmp_path}/index", "none", 0)
    back, meta = readers.index(spark, f"{tmp_path}/index")
    assert back.count() == 2 and meta.first().sources == ["kg", "qa"]
    assert sinks.save_postings(docs, f"{tmp_path}/bm25") == 3
    sinks.save_calibrator(spark, f"{tmp_path}/c.json", "platt", {"a": 1.0, "b": 0.0})
    assert sinks.load_calibrator(spark, f"{tmp_path}/c.json")["method"] == "platt"
    assert sinks.load_calibrator(spark, f"{tmp_path}/none.json") is None
    ok, errors = readers.best_effort(lambda: docs, lambda: spark.read.parquet(f"{tmp_path}/gone"))
    assert len(ok) == 1 and len(errors) == 1


def test_parquet_samples(spark, tmp_path):
    spark.createDataFrame([("q", "Yes"), ("r", "left")], "question string, answer string").coalesce(1).write.parquet(f"{tmp_path}/d")
    got = readers.parquet_samples(spark, f"{tmp_path}/d", "vqa_rad", "train").orderBy("sample_id").collect()
    assert [(r.sample_id, r.answer_type) for r in got] == [("vqa_rad_train_0", "closed"), ("vqa_rad_train_1", "open")]
    assert readers.parquet_samples(spark, f"{tmp_path}/d", "vqa_rad", "train", 1).count() == 1


def test_result_files_and_sweep_rows(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"run_name":"x","per_sample":[{"sample_id":"1","correct":true},{"sample_id":"2","correct":false}]}')
    assert readers.result_files(spark, f"{tmp_path}/r.json").count() == 2
    (tmp_path / "s.json").write_text('[{"confidence":0.5,"correct":true},{"confidence":0.1,"correct":false,"answer_type":"closed"}]')
    assert sorted(r.answer_type for r in readers.sweep_rows(spark, f"{tmp_path}/s.json").collect()) == ["closed", "open"]
    (tmp_path / "t.json").write_text('[{"correct":true}]')
    with pytest.raises(Exception, match="required"):
        readers.sweep_rows(spark, f"{tmp_path}/t.json").collect()


def test_stream_resumes_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, T0, True, "a"), (1, T0, True, "a"), (2, T0, False, "a")], "result_id long, created_at timestamp, correct boolean, run_id string")
    rows.write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        stream = ingest.result_stream(spark, f"{tmp_path}/in", rows.schema)
        ingest.resume_into(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_report(spark):
    from lumenquarry.plans.queries import BASELINE

    df = frame(spark, [dict(run_id=BASELINE), dict(run_id="a", decision="abstain", prediction="no")]).withColumn("citations", F.lit(None).cast(EV))
    s = compare.summary(df)
    text = report.markdown(s, compare.flags(s, metrics.citation_relevance(df, "run_id"), BASELINE), BASELINE)
    assert "| a | overall_accuracy |" in text and "high abstention" in text


def test_first_row_and_newest(spark, tmp_path):
    readers.check_first(spark.createDataFrame([("q",)], "question string"), "question")
    with pytest.raises(ValueError):
        readers.check_first(spark.createDataFrame([("",)], "question string"), "question")
    for n in ("a1.json", "a2.json"):
        (tmp_path / n).write_text("{}")
    assert readers.newest(spark, f"{tmp_path}/a*.json").endswith("a2.json")
    assert readers.newest(spark, f"{tmp_path}/b*.json") is None


def test_demo_entries(spark):
    r = frame(spark, [dict(sample_id="s_test_0"), dict(sample_id="s_test_0", prediction="no")])
    f = frame(spark, [dict(sample_id="s_test_1", prediction="left")])
    wanted = spark.createDataFrame([("s_test_0",), ("s_test_1",), ("s_test_2",)], "sample_id string")
    got = {x.sample_id: (x.prediction, x.found) for x in results.demo_entries(wanted, r, f).collect()}
    assert got == {"s_test_0": ("no", "result"), "s_test_1": ("left", "fallback"), "s_test_2": (None, "none")}
