"""Explicit schemas of the records that the readers produce; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)


def _s(**fields) -> StructType:
    return StructType([StructField(k, v, True) for k, v in fields.items()])


STR, INT, LONG, DBL, BOOL = StringType(), IntegerType(), LongType(), DoubleType(), BooleanType()

SAMPLE = _s(sample_id=STR, question=STR, answer=STR, answer_type=STR, modality=STR, source=STR)
SLAKE_RAW = _s(
    qid=LONG, img_name=STR, question=STR, answer=STR, answer_type=STR, q_lang=STR, modality=STR, location=STR,
    content_type=STR, triple=ArrayType(STR),
)
TRIPLE = _s(head=STR, relation=STR, tail=STR, category=STR)
META = _s(source_type=STR, entity_name=STR, attribute=STR, source_file=STR, chunk_index=INT)
DOCUMENT = _s(text=STR, doc_id=STR, meta=META)
EVIDENCE = _s(text=STR, score=DBL, source_type=STR, entity_name=STR, attribute=STR, rank_no=INT)
PER_SAMPLE = _s(
    sample_id=STR, question=STR, ground_truth=STR, prediction=STR, correct=BOOL, answer_type=STR, confidence=DBL,
    latency_seconds=DBL, decision=STR, citations=ArrayType(EVIDENCE), reasoning=STR, retrieval_query=STR, visual_answer=STR,
    retry_count=INT,
)
RESULT_FILE = StructType([StructField("run_name", STR), StructField("per_sample", ArrayType(PER_SAMPLE))])
SWEEP_ROW = _s(confidence=DBL, correct=BOOL, answer_type=STR)
