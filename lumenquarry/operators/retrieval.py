"""Exact dense search, BM25 and reciprocal-rank fusion for a set of queries at a time."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: BM25 with the usual constants; a term in over half of the documents gets EPSILON times the mean weight.
K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K, CANDIDATES, TOP_K = 60, 20, 5
#: Query vectors that a task holds at a time.
BLOCK = 4096


#: Documents that meet the queries of a block at a time.
CHUNK = 2048


class Best:
    """The k best documents of each query of a block, as rows of query number, score and document."""

    def __init__(self, k: int, newest: bool = False):
        self.k, self.sign = k, -1 if newest else 1
        self.rows = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        """``scores`` of queries x ``docs``; -inf is no hit. Ties with the k-th go on to the order by document."""
        if scores.shape[1] > self.k:
            at_least = np.partition(scores, -self.k, axis=1)[:, -self.k, None]
            q, d = np.nonzero((scores >= at_least) & (scores > -np.inf))
        else:
            q, d = np.nonzero(scores > -np.inf)
        q, s, d = (np.concatenate(x) for x in zip(self.rows, (q, scores[q, d], docs[d])))
        order = np.lexsort((self.sign * d, -s, q))
        q, s, d = q[order], s[order], d[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, "left")
        self.rows = tuple(x[place < self.k] for x in (q, s, d))


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int = TOP_K, min_score: float | None = None, same: str | None = None) -> DataFrame:
    """query_id, doc_id, score, rank: the k vectors of the highest inner product, by falling
    score and rising doc_id; scores below ``min_score`` are left out. ``queries`` has query_id
    and embedding, ``vectors`` doc_id and embedding; null embeddings match nothing. With ``same``, a
    column of both, a query meets only vectors of its own value, in the same pass. Queries are
    taken in blocks of BLOCK, and every block meets each partition once, where only its best k
    survive."""
    spark = vectors.sparkSession
    rows = queries.filter("embedding IS NOT NULL AND query_id IS NOT NULL").select("query_id", "embedding", *([same] if same else []))
    blocks = max(1, -(-rows.count() // BLOCK))
    found = None
    for b in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toPandas() if blocks > 1 else rows.toPandas()
        if not len(part):
            continue
        wanted = part[same].to_numpy() if same else None
        held = spark.sparkContext.broadcast((part.query_id.to_numpy(), np.stack(part.embedding).astype(np.float64), wanted))
        asked = vectors.filter("embedding IS NOT NULL").select("doc_id", "embedding", *([same] if same else []))
        best = asked.mapInPandas(_best(held, k, same), "query_id long, doc_id long, score double")
        found = best if found is None else found.unionByName(best)
    if found is None:
        return spark.createDataFrame([], "query_id long, doc_id long, score double, rank int")
    if min_score is not None:
        found = found.filter(F.col("score") >= min_score)
    return ranked(found, k)


def _best(held, k: int, same: str | None):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q, wanted = held.value
        best = Best(k)
        for pdf in batches:
            for i in range(0, len(pdf), CHUNK):
                part = pdf.iloc[i : i + CHUNK]
                s = np.round(q @ np.stack(part.embedding).astype(np.float64).T, 6)
                if same:
                    s[wanted[:, None] != part[same].to_numpy()] = -np.inf
                best.add(s, part.doc_id.to_numpy())
        at, score, doc = best.rows
        yield pd.DataFrame({"query_id": ids[at], "doc_id": doc, "score": score})

    return rows


def ranked(scored: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id"))
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def filtered_topk(queries: DataFrame, vectors: DataFrame, labels: DataFrame, k: int = TOP_K, mode: str = "overfetch") -> DataFrame:
    """Top k among the documents with the query's label; a null label has no equal. ``overfetch``
    fetches 3k and filters afterwards, so it may return fewer; ``pushdown`` carries the label along
    and filters before it ranks, in one pass whatever the number of labels."""
    if mode == "pushdown":
        known = queries.filter("label IS NOT NULL")
        return dense_topk(known, vectors.select("doc_id", "embedding").join(labels.filter("label IS NOT NULL"), "doc_id"), k, same="label")
    wanted = queries.select("query_id", F.col("label").alias("wanted"))
    over = dense_topk(queries, vectors, 3 * k).join(labels, "doc_id").join(wanted, "query_id").filter(F.col("label") == F.col("wanted"))
    again = Window.partitionBy("query_id").orderBy("rank")
    return over.withColumn("r", F.row_number().over(again)).filter(F.col("r") <= k).select("query_id", "doc_id", "score", F.col("r").alias("rank"))


def postings(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """term, doc_id, tf, dl: the index as a table, of the ``terms`` alone if they are given
    (other words are dropped before anything is shuffled by document). ``docs`` has doc_id and text."""
    tokens = docs.select("doc_id", T.bm25_tokens(F.col("text")).alias("w"))
    tokens = tokens.select("doc_id", F.size("w").alias("dl"), F.explode("w").alias("term"))
    if terms is not None:
        tokens = tokens.join(terms, "term", "left_semi")
    return tokens.groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf"))


def term_weights(docs: DataFrame) -> DataFrame:
    """term, idf: log odds of a document lacking the term; negative ones become EPSILON times
    the mean over all terms."""
    tokens = docs.select(F.explode(F.array_distinct(T.bm25_tokens(F.col("text")))).alias("term"))
    df = tokens.groupBy("term").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").cast("double").alias("n"))  # one row
    raw = df.crossJoin(F.broadcast(n)).select("term", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))  # one row
    return raw.crossJoin(F.broadcast(mean)).select("term", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


class Bm25Index(NamedTuple):
    """What BM25 reads: doc_id, w (tokens) of each document; term, idf; the mean number of tokens."""

    tokens: DataFrame
    weights: DataFrame
    mean_length: float


def bm25_index(docs: DataFrame) -> Bm25Index:
    """The index of ``docs`` (doc_id, text); ``sources.sinks.save_postings`` keeps one for later queries."""
    tokens = docs.select("doc_id", T.bm25_tokens(F.col("text")).alias("w"))
    return Bm25Index(tokens, term_weights(docs), tokens.agg(F.avg(F.size("w"))).first()[0] or 0.0)


def bm25_topk(queries: DataFrame, docs: DataFrame | Bm25Index, k: int = CANDIDATES) -> DataFrame:
    """query_id, doc_id, score, rank of the k best documents with a positive score, by falling
    score (6 digits) and falling doc_id. A query's repeated token counts each time. ``queries`` has
    query_id and text and is taken in blocks of BLOCK; ``docs`` are documents or a saved index.
    Each partition scores its documents and keeps the best k of a query, so no row for a query
    and a document is ever shuffled but these."""
    index = docs if isinstance(docs, Bm25Index) else bm25_index(docs)
    spark = queries.sparkSession
    asked = queries.filter("query_id IS NOT NULL").select("query_id", F.explode(T.bm25_tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    blocks = max(1, -(-queries.count() // BLOCK))
    found = spark.createDataFrame([], "query_id long, doc_id long, score double")
    for b in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else asked
        known = part.join(index.weights, "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight")).toPandas()  # the terms of BLOCK queries
        if len(known):
            held = spark.sparkContext.broadcast(_weights_by_term(known))
            found = found.unionByName(index.tokens.mapInPandas(_bm25(held, k, index.mean_length), found.schema))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id").desc())
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _weights_by_term(known: pd.DataFrame) -> tuple[np.ndarray, dict[str, tuple[np.ndarray, np.ndarray]]]:
    """The queries, and of each term the queries that have it with its weight in them."""
    ids, at = np.unique(known.query_id.to_numpy(), return_inverse=True)
    known = known.assign(at=at)
    return ids, {t: (g["at"].to_numpy(), g.weight.to_numpy()) for t, g in known.groupby("term")}


def _bm25(held, k: int, mean_length: float):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, terms = held.value
        best = Best(k, newest=True)
        for pdf in batches:
            for i in range(0, len(pdf), CHUNK // 2):
                part = pdf.iloc[i : i + CHUNK // 2]
                scores, hits = np.zeros((len(ids), len(part))), {}
                for row, w in enumerate(part.w):
                    for term, tf in Counter(w).items() if w is not None else ():
                        if term in terms:
                            at = hits.setdefault(term, ([], [], []))
                            for column, value in zip(at, (row, tf, len(w))):
                                column.append(value)
                for term, columns in hits.items():
                    row, tf, length = (np.array(c) for c in columns)
                    of, weight = terms[term]
                    gain = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))
                    scores[np.ix_(of, row)] += weight[:, None] * gain
                scores = np.round(scores, 6)
                best.add(np.where(scores > 0, scores, -np.inf), part.doc_id.to_numpy())
        at, score, doc = best.rows
        yield pd.DataFrame({"query_id": ids[at], "doc_id": doc, "score": score})

    return rows


def fused(bm25: DataFrame, dense: DataFrame, k: int = TOP_K, rrf_k: int = RRF_K, min_score: float = 0.0) -> DataFrame:
    """query_id, doc_id, score, rank: sums of 1 / (rrf_k + rank) over both lists, the best k,
    divided by the best one; ties go to the better BM25 rank, then the better dense one. Rows
    at or below ``min_score`` are left out and leave gaps in the ranks."""
    both = bm25.select("query_id", "doc_id", F.col("rank").alias("b"), F.lit(None).cast("int").alias("d")).unionByName(
        dense.select("query_id", "doc_id", F.lit(None).cast("int").alias("b"), F.col("rank").alias("d"))
    )
    one = lambda c: F.coalesce(1.0 / (F.col(c) + rrf_k), F.lit(0.0))
    scores = both.groupBy("query_id", "doc_id").agg(F.round(F.sum(one("b") + one("d")), 9).alias("raw"), F.min("b").alias("b"), F.min("d").alias("d"))
    order = Window.partitionBy("query_id").orderBy(F.col("raw").desc(), F.col("b").asc_nulls_last(), F.col("d").asc_nulls_last(), "doc_id")
    top = scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    most = Window.partitionBy("query_id")
    return (
        top.withColumn("score", F.round(F.col("raw") / F.max("raw").over(most), 6))
        .filter(F.col("score") > min_score)
        .select("query_id", "doc_id", "score", "rank")
    )


def with_documents(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id and evidence: the hits with their documents' text, source, entity and attribute, as an
    array by rank. Hits whose document is gone are left out."""
    item = F.struct(
        F.col("rank").alias("rank_no"), "text", "score", F.col("source").alias("source_type"), "entity_name", "attribute",
    )
    rows = hits.join(docs.select("doc_id", "text", "source", "entity_name", "attribute"), "doc_id")
    return rows.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("evidence"))  # at most k items a query


def relevance(hits: DataFrame, queries: DataFrame, docs: DataFrame, least: int = 1) -> DataFrame:
    """query_id, rank, doc_id, score, source, preview, token_overlap, relevant: every hit with the tokens it
    shares with its question."""
    q = queries.select("query_id", T.citation_tokens(F.col("text")).alias("q"))
    d = docs.select("doc_id", "source", "text")
    shared = F.size(F.array_intersect("q", T.citation_tokens(F.col("text"))))
    return hits.join(q, "query_id").join(d, "doc_id").select(
        "query_id", "rank", "doc_id", "score", "source", F.left("text", F.lit(100)).alias("preview"), shared.alias("token_overlap"), (shared >= least).alias("relevant")
    )


def verdict(hits: DataFrame, queries: DataFrame, docs: DataFrame, good: float = 0.40, fair: float = 0.25) -> DataFrame:
    """One row: n_questions, n_hits (questions with a relevant hit), hit_rate and verdict (PASS from
    ``good``, PARTIAL from ``fair``, else FAIL). Questions without any hit count too."""
    hit = relevance(hits, queries, docs).groupBy("query_id").agg(F.max("relevant").alias("hit"))
    rows = queries.select("query_id").distinct().join(hit, "query_id", "left")
    rate = F.coalesce(F.try_divide(F.col("n_hits").cast("double"), F.col("n_questions")), F.lit(0.0))
    return rows.agg(F.count("*").alias("n_questions"), F.count_if("hit").alias("n_hits")).select(
        "n_questions", "n_hits", F.round(rate, 6).alias("hit_rate"), F.when(rate >= good, "PASS").when(rate >= fair, "PARTIAL").otherwise("FAIL").alias("verdict")
    )


def diagnostic(hits: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """source, n_hits: questions for which a retrieved document of that source shares a token
    with the question, each once; the row without a source counts the questions with any."""
    relevant = relevance(hits, queries, docs).filter("relevant")
    return relevant.groupingSets([[F.col("source")], []], "source").agg(F.countDistinct("query_id").alias("n_hits")).select("source", "n_hits")


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two diagnostics side by side with their difference."""
    a, b = before.withColumnRenamed("n_hits", "n_before"), after.withColumnRenamed("n_hits", "n_after")
    joined = a.join(b, a.source.eqNullSafe(b.source), "full").select(
        F.coalesce(a.source, b.source).alias("source"), F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after")
    )
    return joined.withColumn("delta", F.col("n_after") - F.col("n_before"))
