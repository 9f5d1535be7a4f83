"""The pN_ queries and, where SQL can say the same on whole tables, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cutoff, eval_leaks, format_copies, near_groups, packing, reply_defects, split_overlap, splitting, subjects
from .shared import table

Query = Callable[[SparkSession, str], DataFrame]


def _split_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_overlap.split_records(table(spark, sf_dir, "vqa_samples"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = split_overlap.pairs(_split_records(spark, sf_dir))
    return found.select(
        F.least("train_id", "eval_id").alias("sample_id_lo"), F.greatest("train_id", "eval_id").alias("sample_id_hi")
    )


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_overlap.report(_split_records(spark, sf_dir)).drop("longest_run")  # it hangs on the order of the words


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return splitting.pieces(docs).filter(F.size("pieces") > 1).select("doc_id")


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.exploded(table(spark, sf_dir, "documents"))


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_defects.replies(table(spark, sf_dir, "vqa_samples"), table(spark, sf_dir, "per_sample_results"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_defects.defects(_replies(spark, sf_dir))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_defects.report(_replies(spark, sf_dir))


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return cutoff.scored_results(table(spark, sf_dir, "per_sample_results")), table(spark, sf_dir, "keep_targets")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutoff.kept_results(*_scored(spark, sf_dir))


def p4_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutoff.cutoffs(*_scored(spark, sf_dir))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_copies.qa_records(table(spark, sf_dir, "vqa_samples"), table(spark, sf_dir, "raw_qa"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_copies.copies(_records(spark, sf_dir))


def p5_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_copies.collapsed(_records(spark, sf_dir)).select("kept_id", "n_copies")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups.document_pairs(table(spark, sf_dir, "documents"))


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups.document_groups(table(spark, sf_dir, "documents"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def p7_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.usage(table(spark, sf_dir, "documents"))


def _leak_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eval_leaks.leaks(*_leak_tables(spark, sf_dir))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eval_leaks.leak_report(*_leak_tables(spark, sf_dir))


def p8_paraphrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eval_leaks.paraphrases(*_leak_tables(spark, sf_dir))


def _subject_tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [table(spark, sf_dir, t) for t in ("documents", "subject_labels", "subject_areas", "eval_items")]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.document_subjects(*_subject_tables(spark, sf_dir)).select("doc_id", "subject").distinct()


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.composition(*_subject_tables(spark, sf_dir))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (p1_found, p1_report, p2_found, p2_pieces, p3_found, p3_report, p4_found, p4_cutoffs, p5_found, p5_collapsed, p6_found, p6_groups, p7_containers, p7_usage, p8_found, p8_report, p8_paraphrases, p9_found, p9_composition)
}

_RECORDS = r"""
records AS (
  SELECT DISTINCT sample_id, question, answer FROM (
    SELECT sample_id, question, answer FROM vqa_samples
    UNION ALL
    SELECT sample_id, json_extract_string(payload, '$.question'), json_extract_string(payload, '$.answer')
    FROM raw_qa WHERE payload IS NOT NULL)
  WHERE sample_id IS NOT NULL AND question IS NOT NULL AND answer IS NOT NULL),
bare AS (
  SELECT sample_id, regexp_replace(lower(question), '[^\p{L}\p{N}]', '', 'g') AS bq,
         regexp_replace(lower(answer), '[^\p{L}\p{N}]', '', 'g') AS ba FROM records),
kept AS (
  SELECT bq, ba, min(sample_id) AS kept_id, count(DISTINCT sample_id) AS n_copies
  FROM bare WHERE bq <> '' AND ba <> '' GROUP BY bq, ba)
"""

_CUT = r"""
one AS (
  SELECT result_id, min(struct_pack(i := ingested_at, s := sample_id, t := answer_type, c := confidence, k := correct)) AS r
  FROM per_sample_results GROUP BY result_id),
scored AS (
  SELECT result_id, regexp_extract(r.s, '^(.*)_[^_]+_[^_]+$', 1) AS source,
         CASE WHEN trim(coalesce(r.t, '')) = '' THEN 'open' ELSE lower(trim(r.t)) END AS answer_type,
         r.c + 0.0 AS score, r.k AS correct
  FROM one WHERE r.c >= 0 AND r.c <= 1 AND r.k IS NOT NULL AND r.s IS NOT NULL),
targets AS (
  SELECT source, CASE WHEN trim(coalesce(answer_type, '')) = '' THEN 'open' ELSE lower(trim(answer_type)) END AS answer_type,
         max(target_pct) AS target_pct
  FROM keep_targets WHERE target_pct IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2),
ranked AS (
  SELECT *, count(*) OVER (PARTITION BY source, answer_type ORDER BY score DESC RANGE UNBOUNDED PRECEDING) AS n_kept,
         sum(CAST(correct AS BIGINT)) OVER (PARTITION BY source, answer_type ORDER BY score DESC RANGE UNBOUNDED PRECEDING) AS ok,
         count(*) OVER (PARTITION BY source, answer_type) AS n_results
  FROM scored JOIN targets USING (source, answer_type)),
limits AS (
  SELECT source, answer_type, max(score) AS cutoff FROM ranked
  WHERE n_kept * 100 >= target_pct * n_results GROUP BY source, answer_type)
"""

_WORDS = r"list_filter(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


def _runs(n: int) -> str:
    """All sequences of n words of the list w, as texts."""
    return f"list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))"


_LEAKS = f"""
        WITH i AS (SELECT item_id, {_WORDS.format('passage')} AS w FROM eval_items UNION ALL SELECT item_id, {_WORDS.format('question')} FROM eval_items),
        g AS (SELECT DISTINCT item_id, unnest({_runs(12)}) AS x FROM i WHERE len(w) >= 12),
        v AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
        d AS (SELECT doc_id, unnest({_runs(12)}) AS x FROM v WHERE len(w) >= 12)"""

_OVERLAP = rf"""
        r AS (
          SELECT DISTINCT sample_id, regexp_extract(sample_id, '_(train|val|test)_[^_]+$', 1) AS split,
                 regexp_replace(lower(answer), '[^\p{{L}}\p{{N}}]', '', 'g') AS ba, list_distinct({_WORDS.format('question')}) AS w
          FROM vqa_samples WHERE sample_id IS NOT NULL AND question IS NOT NULL AND answer IS NOT NULL),
        e AS (SELECT sample_id, split = 'train' AS tr, ba, len(w) AS n, unnest(w) AS word FROM r WHERE ba <> '' AND split <> ''),
        c AS (
          SELECT t.sample_id AS a, h.sample_id AS b, t.n AS n, h.n AS m, count(*) AS k
          FROM e t JOIN e h ON t.ba = h.ba AND t.word = h.word WHERE t.tr AND NOT h.tr GROUP BY ALL),
        p AS (SELECT * FROM c WHERE k * 10 >= 7 * (n + m - k))"""

SQL: dict[str, str] = {
    "p1_found": f"WITH {_OVERLAP} SELECT least(a, b) AS sample_id_lo, greatest(a, b) AS sample_id_hi FROM p",
    "p1_report": rf"""WITH {_OVERLAP},
        g AS (SELECT regexp_extract(sample_id, '_(train|val|test)_[^_]+$', 1) AS split, regexp_extract(sample_id, '^(.*)_(train|val|test)_[^_]+$', 1) AS source, sample_id
              FROM vqa_samples WHERE question IS NOT NULL AND answer IS NOT NULL AND regexp_matches(sample_id, '_(val|test)_[^_]+$')),
        o AS (SELECT b AS sample_id, count(*) AS n, bool_or(n = m AND k = n) AS same FROM p GROUP BY b),
        e1 AS (SELECT split, source, count(DISTINCT sample_id) AS n_records FROM g GROUP BY ALL),
        e2 AS (SELECT split, source, count(*) AS n_overlapping, CAST(sum(CAST(same AS INT)) AS BIGINT) AS n_same, CAST(sum(n) AS BIGINT) AS n_pairs FROM (SELECT DISTINCT * FROM g) JOIN o USING (sample_id) GROUP BY ALL)
        SELECT split, source, n_records, coalesce(n_overlapping, 0) AS n_overlapping, coalesce(n_same, 0) AS n_same, coalesce(n_pairs, 0) AS n_pairs FROM e1 LEFT JOIN e2 USING (split, source)""",
    "p6_groups": f"""
        WITH RECURSIVE v AS (SELECT doc_id, lower(trim(attribute)) AS attribute, {_WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL),
        d AS (SELECT doc_id, attribute, list_distinct({_runs(3)}) AS s FROM v WHERE len(w) >= 3),
        h AS (SELECT doc_id, attribute, min(doc_id) OVER (PARTITION BY list_sort(s)) AS rep, s FROM d),
        e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM h WHERE doc_id = rep),
        c AS (SELECT a.doc_id AS lo, b.doc_id AS hi, a.n AS n, b.n AS m, count(*) AS k FROM e a JOIN e b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
        f AS (SELECT lo, hi FROM c WHERE k * 10 >= 6 * (n + m - k)),
        t AS (SELECT DISTINCT rep AS a, rep AS b FROM h UNION SELECT t.a, f.hi FROM t JOIN f ON t.b = f.lo),
        l AS (SELECT b AS rep, min(a) AS group_id FROM t GROUP BY b),
        q AS (SELECT lo AS rep, count(*) AS n_links FROM f GROUP BY lo)
        SELECT doc_id, group_id, coalesce(n_links, 0) AS n_links, attribute FROM h JOIN l USING (rep) LEFT JOIN q USING (rep)""",
    "p6_found": f"""
        WITH v AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL),
        d AS (SELECT doc_id, list_distinct({_runs(3)}) AS s FROM v WHERE len(w) >= 3),
        e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM d),
        c AS (SELECT a.doc_id AS lo, b.doc_id AS hi, a.n AS n, b.n AS m, count(*) AS k FROM e a JOIN e b USING (x) WHERE a.doc_id < b.doc_id GROUP BY ALL)
        SELECT lo AS doc_id_lo, hi AS doc_id_hi FROM c WHERE k * 10 >= 6 * (n + m - k)""",
    "p8_found": f"{_LEAKS} SELECT DISTINCT doc_id, item_id FROM d JOIN g USING (x)",
    "p8_report": f"""{_LEAKS}, n AS (SELECT item_id, count(DISTINCT doc_id) AS n FROM d JOIN g USING (x) GROUP BY item_id)
        SELECT item_id, dataset, coalesce(n, 0) AS n_documents FROM eval_items LEFT JOIN n USING (item_id)""",
    "p2_found": r"""
        SELECT doc_id FROM documents
        WHERE len(regexp_extract_all(text, '[^\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+')) > 300""",
    "p4_found": f"WITH {_CUT} SELECT result_id FROM scored JOIN limits USING (source, answer_type) WHERE score >= cutoff",
    "p4_cutoffs": f"""WITH {_CUT}
        SELECT DISTINCT source, answer_type, target_pct, n_results, cutoff, n_kept, CAST(ok AS BIGINT) AS n_kept_correct
        FROM ranked JOIN limits USING (source, answer_type) WHERE score = cutoff""",
    "p5_found": f"""WITH {_RECORDS}
        SELECT DISTINCT kept_id, sample_id AS copy_id FROM bare JOIN kept USING (bq, ba) WHERE sample_id <> kept_id""",
    "p5_collapsed": f"WITH {_RECORDS} SELECT kept_id, n_copies FROM kept",
}
