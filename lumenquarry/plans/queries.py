"""Catalogue of the engine's own queries: (spark, folder of tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import folders
from ..functions import arrays as A
from ..functions import text as T
from ..operators import audit, calibration, compare, corpus, decide, metrics, results, retrieval
from ..sources import readers, sinks
from ..streaming import ingest
from . import report

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
BASELINE = "vlm_base"
#: Parameters of the fitted scalers that the apply queries use.
PLATT = (4.0, -2.0)
KNOTS = ([0.1, 0.35, 0.6, 0.9], [0.05, 0.3, 0.55, 0.95])


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def per_sample(spark: SparkSession, d: str) -> DataFrame:
    return results.matched(results.one_delivery(read(spark, d, "per_sample_results")))


def samples(spark: SparkSession, d: str) -> DataFrame:
    return corpus.one_sample(read(spark, d, "vqa_samples"))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = results.last_per_sample(per_sample(spark, d))
    return results.paired(rows.filter(F.col("run_id") != BASELINE), rows.filter(F.col("run_id") == BASELINE))


# text functions


@query
def normalize_variants(spark, d):
    return samples(spark, d).select(
        "sample_id",
        T.normalize_eval(F.col("answer")).alias("eval_form"),
        T.normalize_bench(F.col("answer")).alias("bench_form"),
        T.normalize_train(F.col("answer")).alias("train_form"),
        T.type_from_answer(F.col("answer")).alias("type_by_answer"),
        T.type_from_question(F.col("question")).alias("type_by_question"),
    )


@query
def document_slugs(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "entity_name", "attribute", "text")
    return docs.select(
        "doc_id", T.slug_keep(F.col("entity_name")).alias("slug_keep"), T.slug_ascii(F.col("entity_name")).alias("slug_ascii"), T.preview(F.col("text")).alias("preview")
    )


@query
def question_tokens(spark, d):
    return samples(spark, d).select(
        "sample_id",
        F.size(T.bm25_tokens(F.col("question"))).alias("n_tokens"),
        F.array_join(T.keywords(F.col("question")), " ").alias("keywords"),
        F.array_join(F.array_sort(T.citation_tokens(F.col("question"))), " ").alias("citation_tokens"),
    )


@query
def retrieval_queries(spark, d):
    r = per_sample(spark, d)
    q = T.retrieval_query(F.col("question"), F.col("visual_answer"), F.lit(""), F.coalesce("retry_count", F.lit(0)))
    return r.select("result_id", q.alias("query"))


@query
def training_conversations(spark, d):
    rows = corpus.training_records(samples(spark, d))
    return rows.select("sample_id", F.element_at("conversation", 1)["content"].alias("asked"), F.element_at("conversation", 2)["content"].alias("answered"))


@query
def windowed_pixels(spark, d):
    v = read(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.round(x.cast("double") * 1000)).alias("p"))
    out = A.window_pixels(F.col("p"), F.col("label") * 10.0, F.lit(200.0))
    return v.select("vec_id", F.aggregate(out, F.lit(0), lambda s, x: s + x).alias("pixel_sum"), F.array_max(out).alias("pixel_max"))


@query
def label_masks(spark, d):
    """Answer start and label mask of word ids: the marker is the document's third and fourth word."""
    docs = read(spark, d, "documents").select("doc_id", T.words(F.lower("text")).alias("w")).filter(F.size("w") >= 4)
    ids = F.transform("w", lambda x: F.length(x))
    start = A.answer_start(F.col("ids"), F.slice("ids", 3, 2))
    masked = F.filter(A.masked_labels(F.col("ids"), F.col("start"), 1), lambda x: x == -100)
    return docs.select("doc_id", ids.alias("ids")).withColumn("start", start).select("doc_id", "start", F.size(masked).alias("n_masked"))


@query
def fitted_sizes(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") / 10).cast("int").alias("w"), (F.col("o_custkey") * 3).cast("int").alias("h"))
    size = A.fitted_size(F.greatest("w", F.lit(1)), F.greatest("h", F.lit(1)))
    return o.select("o_orderkey", size["width"].alias("width"), size["height"].alias("height"))


@query
def public_tags(spark, d):
    c = read(spark, d, "customer")
    tags = F.create_map(F.lit("PatientName"), "c_name", F.lit("Modality"), F.col("c_mktsegment"), F.lit("PatientID"), F.col("c_custkey").cast("string"))
    return c.select("c_custkey", F.array_join(F.map_keys(A.without_private(tags)), ",").alias("kept"))


@query
def chunk_documents(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.posexplode(T.chunks(F.col("text"), 512, 50)).alias("chunk_index", "chunk"))
    return docs.select("doc_id", "chunk_index", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


# metrics


@query
def accuracy_by_type(spark, d):
    return metrics.by_type(per_sample(spark, d), "run_id")


@query
def closed_confusion(spark, d):
    return metrics.confusion(per_sample(spark, d), "run_id")


@query
def closed_prf(spark, d):
    return metrics.precision_recall_f1(per_sample(spark, d), "run_id")


@query
def text_scores(spark, d):
    return metrics.text_scores(per_sample(spark, d), "run_id", "answer_type")


@query
def abstention(spark, d):
    return metrics.abstention(per_sample(spark, d), "run_id")


@query
def correct_abstention(spark, d):
    return metrics.correct_abstention(pairs(spark, d), "run_id")


@query
def grounding_breakdown(spark, d):
    return metrics.grounding(pairs(spark, d), "run_id")


@query
def citation_relevance(spark, d):
    return metrics.citation_relevance(per_sample(spark, d), "run_id")


@query
def citation_hits(spark, d):
    return metrics.citation_hits(per_sample(spark, d), "run_id")


@query
def benchmark_metrics(spark, d):
    return metrics.benchmark(per_sample(spark, d), "run_id")


@query
def latency_medians(spark, d):
    return metrics.latencies(per_sample(spark, d), "run_id")


# calibration


@query
def calibration_bins(spark, d):
    return calibration.bins(per_sample(spark, d), "run_id")


@query
def ece(spark, d):
    return calibration.ece(per_sample(spark, d), "run_id")


@query
def ece_answered(spark, d):
    return calibration.ece(per_sample(spark, d).filter("decision <> 'abstain'"), "run_id")


@query
def discrimination(spark, d):
    return calibration.discrimination(per_sample(spark, d), "run_id")


@query
def threshold_analysis(spark, d):
    return calibration.thresholds(per_sample(spark, d), "run_id")


@query
def threshold_recommendation(spark, d):
    return calibration.recommendation(per_sample(spark, d), "run_id")


@query
def threshold_sweep(spark, d):
    return calibration.sweep(per_sample(spark, d), "run_id")


@query
def sweep_best_row(spark, d):
    return calibration.best_row(calibration.sweep(per_sample(spark, d), "run_id"), "run_id", "kind")


@query
def platt_apply(spark, d):
    r = per_sample(spark, d).filter("confidence IS NOT NULL")
    return r.select("result_id", F.round(A.platt(F.col("confidence"), *PLATT), 6).alias("calibrated"))


@query
def isotonic_apply(spark, d):
    r = per_sample(spark, d).filter("confidence IS NOT NULL")
    return r.select("result_id", F.round(A.isotonic(F.col("confidence"), *KNOTS), 6).alias("calibrated"))


@query
def scaler_comparison(spark, d):
    return calibration.compare_scalers(per_sample(spark, d).filter("confidence BETWEEN 0 AND 1"))


# comparison


@query
def mcnemar_counts(spark, d):
    return compare.discordant(pairs(spark, d), "run_id")


@query
def mcnemar_test(spark, d):
    rows = compare.mcnemar(pairs(spark, d), "run_id")
    return rows.withColumns({"statistic": F.round("statistic", 6), "p_value": F.round("p_value", 6)})


@query
def run_summary(spark, d):
    return compare.summary(per_sample(spark, d))


@query
def metric_deltas(spark, d):
    return compare.deltas(compare.summary(per_sample(spark, d)), BASELINE)


def _with_baseline(spark, d, run):
    rows = results.last_per_sample(per_sample(spark, d))
    return results.with_baseline(rows.filter(F.col("run_id") == run), rows.filter(F.col("run_id") == BASELINE))


@query
def error_lists(spark, d):
    rows = _with_baseline(spark, d, "agent_a")
    out = compare.errors(rows, "wrong", 10)
    for kind, most in (("over_abstain", 5), ("improved", 5), ("improved_answered", 5)):
        out = out.unionByName(compare.errors(rows, kind, most))
    return out


CONFIGS = [(1, "vlm_base"), (2, "agent_a"), (3, "agent_b"), (4, "not_run")]
STEPS = [("grounding", 2, 1), ("second agent", 3, 2), ("full system", 3, 1), ("missing", 4, 1)]


@query
def ablation_table(spark, d):
    return compare.ablation(compare.summary(per_sample(spark, d)), CONFIGS, (BASELINE,))


@query
def component_deltas(spark, d):
    return compare.component_deltas(compare.ablation(compare.summary(per_sample(spark, d)), CONFIGS, (BASELINE,)), STEPS)


@query
def question_type_table(spark, d):
    return compare.type_table(per_sample(spark, d), CONFIGS)


@query
def demo_entries(spark, d):
    r = per_sample(spark, d)
    wanted = samples(spark, d).filter("sample_id RLIKE '_test_'")
    return results.demo_entries(wanted, r.filter("run_id = 'agent_a'"), r.filter(F.col("run_id") == BASELINE)).select("sample_id", "prediction", "found")


@query
def index_range(spark, d):
    return results.index_range(samples(spark, d), 5, 40).select("sample_id")


@query
def report_flags(spark, d):
    r = per_sample(spark, d)
    return compare.flags(compare.summary(r), metrics.citation_relevance(r, "run_id"), BASELINE)


@query
def evaluation_report(spark, d):
    found = report.sections(per_sample(spark, d), "agent_a", BASELINE, "Evaluation report")
    return spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(found)], "place int, section string, text string")


@query
def running_progress(spark, d):
    return compare.progress(per_sample(spark, d), 25)


@query
def benchmark_progress(spark, d):
    return compare.progress(per_sample(spark, d), 50, 4)


@query
def type_counts(spark, d):
    return metrics.type_counts(per_sample(spark, d), "run_id")


@query
def transfer_ece(spark, d):
    r = per_sample(spark, d).filter("confidence BETWEEN 0 AND 1")
    return calibration.transfer(r.filter("run_id = 'agent_a'"), r.filter("run_id = 'agent_b'"))


@query
def resume_remaining(spark, d):
    done = per_sample(spark, d).filter("run_id = 'agent_a'")
    return results.remaining(samples(spark, d).filter("sample_id RLIKE '_(val|test)_'"), done).select("sample_id")


# corpus


def _triples(spark, d):
    return corpus.triples(read(spark, d, "kg_triples"))


@query
def kg_attribute_docs(spark, d):
    t = _triples(spark, d)
    return corpus.attribute_documents(t, "disease").unionByName(corpus.attribute_documents(t, "organ"))


@query
def kg_summary_docs(spark, d):
    t = _triples(spark, d)
    return corpus.summary_documents(t, "disease").unionByName(corpus.summary_documents(t, "organ"))


@query
def kg_relation_docs(spark, d):
    return corpus.relation_documents(_triples(spark, d))


@query
def kg_index_summary(spark, d):
    return audit.index_summary(corpus.kg_documents(_triples(spark, d)))


def _ontology(spark, d):
    """The triples' definitions as an ontology table."""
    t = _triples(spark, d)
    pick = lambda r: F.max(F.when(F.col("relation") == r, F.col("tail")))
    return t.groupBy(F.col("head").alias("label")).agg(
        pick("definition").alias("full_def"), pick("description").alias("short_def"), F.replace(pick("alias"), F.lit(", "), F.lit("|")).alias("synonyms"),
        F.lit(None).cast("string").alias("obsolete"), F.lit(None).cast("string").alias("rid"),
    )


@query
def ontology_docs(spark, d):
    return corpus.ontology_documents(_ontology(spark, d))


@query
def ontology_skips(spark, d):
    return corpus.ontology_skips(_ontology(spark, d))


@query
def qa_documents(spark, d):
    return corpus.qa_documents(samples(spark, d))


# audit


@query
def dataset_profile(spark, d):
    return audit.profile(samples(spark, d), "source")


@query
def answer_histogram(spark, d):
    return audit.histogram(samples(spark, d).withColumn("a", T.normalize_train(F.col("answer"))), "a", 5)


@query
def modality_histogram(spark, d):
    return audit.histogram(samples(spark, d), "modality")


@query
def duplicate_keys(spark, d):
    return audit.duplicates(samples(spark, d))


@query
def dedup_first_wins(spark, d):
    return audit.first_of_each(samples(spark, d)).select("sample_id")


@query
def dedup_by_image(spark, d):
    return audit.first_of_each(samples(spark, d), "img_name", "q", "a").select("sample_id")


@query
def split_overlap(spark, d):
    return audit.overlap(samples(spark, d))


@query
def shared_pairs(spark, d):
    return audit.shared_pairs(samples(spark, d))


@query
def missing_references(spark, d):
    docs = read(spark, d, "documents").withColumn("e", F.lower(F.trim("entity_name")))
    heads = read(spark, d, "kg_triples").withColumn("h", F.lower(F.trim("head")))
    return audit.missing_references(docs, heads, "e", "h")


@query
def document_index_summary(spark, d):
    return audit.index_summary(read(spark, d, "documents"))


@query
def mixed_calibration(spark, d):
    return audit.mixed_calibration(samples(spark, d)).select("sample_id")


# retrieval


def _vectors(spark, d):
    v = read(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return v.filter("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id"), v


def _questions(spark, d):
    return read(spark, d, "eval_items").filter("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.col("question").alias("text"))


def _texts(spark, d):
    return read(spark, d, "documents").select("doc_id", "text", "source")


@query
def dense_topk(spark, d):
    return retrieval.dense_topk(*_vectors(spark, d), k=5)


@query
def dense_topk_filtered(spark, d):
    q, v = _vectors(spark, d)
    return retrieval.filtered_topk(q, v, v.select("doc_id", "label"), 5)


@query
def dense_topk_pushdown(spark, d):
    q, v = _vectors(spark, d)
    return retrieval.filtered_topk(q, v, v.select("doc_id", "label"), 5, mode="pushdown")


@query
def bm25_topk(spark, d):
    return retrieval.bm25_topk(_questions(spark, d), _texts(spark, d))


def _dense_of_questions(spark, d):
    """Vectors are keyed by number alone: question n of the set has vector n, and vector n
    belongs to document 1000 + n."""
    q, v = _vectors(spark, d)
    q = q.filter("query_id < 400").withColumn("query_id", F.col("query_id") + 5000)
    return retrieval.dense_topk(q, v.withColumn("doc_id", F.col("doc_id") + 1000), 20)


@query
def hybrid_rrf_topk(spark, d):
    return retrieval.fused(retrieval.bm25_topk(_questions(spark, d), _texts(spark, d)), _dense_of_questions(spark, d))


@query
def retrieval_diagnostic(spark, d):
    hits = retrieval.bm25_topk(_questions(spark, d), _texts(spark, d), 5)
    return retrieval.diagnostic(hits, _questions(spark, d), _texts(spark, d))


@query
def retrieval_relevance(spark, d):
    q, docs = _questions(spark, d), _texts(spark, d)
    return retrieval.relevance(retrieval.bm25_topk(q, docs, 5), q, docs)


@query
def retrieval_verdict(spark, d):
    q, docs = _questions(spark, d), _texts(spark, d)
    return retrieval.verdict(retrieval.bm25_topk(q, docs, 5), q, docs)


@query
def index_comparison(spark, d):
    q, docs = _questions(spark, d), _texts(spark, d)
    small = docs.filter("source LIKE 'kg_%'")
    before = retrieval.diagnostic(retrieval.bm25_topk(q, small, 5), q, small)
    return retrieval.compared(before, retrieval.diagnostic(retrieval.bm25_topk(q, docs, 5), q, docs))


@query
def vocabulary_size(spark, d):
    return retrieval.term_weights(_texts(spark, d)).agg(F.count("*").alias("n_terms"), F.round(F.min("idf"), 6).alias("least_idf"))


# what is written and read again


@query
def postings_round_trip(spark, d):
    """BM25 over an index that was saved and read back."""
    folder = folders.fresh(spark, "postings")
    sinks.save_postings(_texts(spark, d), folder)
    return retrieval.bm25_topk(_questions(spark, d), readers.postings(spark, folder))


@query
def index_round_trip(spark, d):
    folder = folders.fresh(spark, "index")
    sinks.save_index(read(spark, d, "documents"), folder, "none", 0)
    docs, meta = readers.index(spark, folder)
    return audit.index_summary(docs).join(meta.select(F.col("doc_count").cast("long").alias("doc_count"), "version"), how="cross")  # one row of meta


@query
def results_round_trip(spark, d):
    folder = folders.fresh(spark, "results")
    sinks.save_results(per_sample(spark, d).select("result_id", "run_id", "sample_id", "prediction", "hit"), folder)
    back = spark.read.schema("result_id long, sample_id string, prediction string, hit boolean, run_id string").json(folder)
    return metrics.exact_match(back, "run_id")


@query
def resumed_stream(spark, d):
    """A run's results streamed into its checkpoint folder, twice: the second time nothing is new."""
    folder, mark, source = (folders.fresh(spark, n) for n in ("stream", "mark", "source"))
    read(spark, d, "per_sample_results").select("result_id", "run_id", "correct").write.parquet(source)
    for _ in range(2):
        ingest.resume_into(spark.readStream.schema("result_id long, run_id string, correct boolean").parquet(source), folder, mark).awaitTermination()
    return spark.read.parquet(folder).groupBy("run_id").agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct"))


@query
def scanned_types(spark, d):
    """Samples scanned from a Parquet dataset, by the type of their answer."""
    rows = readers.parquet_samples(spark, f"{d}/vqa_samples.parquet", "vqa_rad", "test")
    return rows.groupBy("answer_type").agg(F.count("*").alias("n"), F.countDistinct("sample_id").alias("n_ids"))


# decisions


def _queries(spark, d):
    r = per_sample(spark, d)
    return r.select(
        "result_id", "question", "answer_type", "confidence", F.col("citations").alias("evidence"), F.lit("").alias("visual_error"),
        F.when(T.text_or_empty(F.col("visual_answer")) == "", F.col("prediction")).otherwise(F.col("visual_answer")).alias("visual_answer"), F.lit(0).alias("retry_count"),
    )


@query
def validation(spark, d):
    rows = decide.validated(samples(spark, d).withColumn("answer_type", F.lit("")))
    return rows.select("sample_id", "validation_error", "answer_type")


@query
def keyword_agreement(spark, d):
    return decide.agreement(_queries(spark, d)).select("result_id", "n_supporting", F.round("agreement", 6).alias("agreement"))


@query
def agreement_texts(spark, d):
    return _queries(spark, d).select("result_id", decide.compared_text().alias("text"))


@query
def embedding_agreement(spark, d):
    """Support of each query vector among its five nearest, by inner product."""
    hits = retrieval.dense_topk(*_vectors(spark, d), k=5)
    q = _vectors(spark, d)[0].select("query_id")
    out = decide.vector_agreement(q, hits.withColumn("similarity", F.col("score")), decide.Policy(similarity=0.6))
    return out.select("query_id", "n_supporting", F.round("agreement", 6).alias("agreement"))


@query
def retrieved_decisions(spark, d):
    """Decisions on evidence that retrieval finds for question and answer, not on stored citations."""
    rows = _queries(spark, d).filter("result_id % 50 = 0").withColumn("query_id", F.col("result_id"))
    query = T.retrieval_query(F.col("question"), F.col("visual_answer"), F.col("visual_error"), F.col("retry_count"))
    docs = read(spark, d, "documents")
    bm25 = retrieval.bm25_topk(rows.select("query_id", query.alias("text")), docs.select("doc_id", "text"))
    found = retrieval.with_documents(retrieval.fused(bm25, bm25.limit(0)), docs)
    fed = rows.drop("evidence").join(found, "query_id", "left")
    return decide.decided(decide.agreement(fed)).select("result_id", F.size("evidence").alias("n_evidence"), "n_supporting", "decision", F.round("grounded_confidence", 6).alias("grounded_confidence"))


@query
def supervisor_decisions(spark, d):
    return decide.decided(decide.agreement(_queries(spark, d))).select("result_id", "decision", F.round("grounded_confidence", 6).alias("grounded_confidence"), "retry_count")


def _final(spark, d):
    """A second retrieval lowers every item's bar: its score is raised by a tenth."""
    again = lambda rows: rows.withColumn("evidence", F.transform("evidence", lambda e: e.withField("score", e["score"] + 0.1)))
    return decide.with_retries(_queries(spark, d), again)


@query
def requery_unrolled(spark, d):
    return _final(spark, d).select("result_id", "decision", "retry_count")


@query
def formatted_output(spark, d):
    out = decide.formatted(_final(spark, d))
    best = F.array_join(F.transform("citations", lambda c: c["rank_no"].cast("string")), ",")
    return out.select("result_id", "final_answer", F.round("final_confidence", 6).alias("final_confidence"), best.alias("citation_ranks"), "requires_human_review")


# events


@query
def event_windows(spark, d):
    return ingest.event_windows(read(spark, d, "events"))
