"""Documents from knowledge-graph triples, ontology rows and question-answer pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# How a triple reads as a sentence, by category and relation: text before the
# entity, between entity and value. Other relations read "{entity} {relation}: {value}".
TEMPLATES = {
    "disease": {
        "symptom": ("", " symptoms include: "),
        "cause": ("", " is caused by: "),
        "treatment": ("Treatment for ", ": "),
        "location": ("", " is located in the "),
        "description": ("", ": "),
        "prevention": ("Prevention of ", ": "),
        "infectivity": ("", " infectivity: "),
        "susceptible_population": ("", " commonly affects: "),
        "alias": ("", " is also known as: "),
    },
    "organ": {
        "function": ("The function of ", ": "),
        "position": ("", " is located at: "),
        "definition": ("", ": "),
        "component": ("", " consists of: "),
        "effect": ("The effect of ", ": "),
        "shape": ("The shape of ", ": "),
        "nature": ("", " nature: "),
        "characteristic": ("", " characteristic: "),
        "length": ("The length of ", ": "),
        "classification": ("", " classification: "),
        "weight": ("The weight of ", ": "),
        "diameter": ("The diameter of ", ": "),
        "alias": ("", " is also known as: "),
    },
}
# Attributes of a summary, in order, with what stands before them.
SUMMARY = {
    "disease": {
        "description": "",
        "location": "Location: ",
        "symptom": "Symptoms: ",
        "cause": "Causes: ",
        "treatment": "Treatment: ",
        "prevention": "Prevention: ",
        "infectivity": "Infectivity: ",
        "susceptible_population": "Commonly affects: ",
    },
    "organ": {"definition": "", "function": "Function: ", "position": "Position: ", "component": "Components: ", "effect": "Effect: "},
}


def triples(rows: DataFrame) -> DataFrame:
    """Trimmed triples without blank head, relation, tail or category, in the order of ``pos``."""
    out = rows.select(F.col("triple_id").alias("pos"), *[F.trim(c).alias(c) for c in ("head", "relation", "tail", "category")], "source_file")
    return out.filter(" AND ".join(f"{c} <> ''" for c in ("head", "relation", "tail", "category")))


def attributes(rows: DataFrame, category: str) -> DataFrame:
    """head, relation, value: of a repeated (head, relation) the last one holds."""
    return rows.filter(F.col("category") == category).groupBy("head", "relation").agg(F.max_by("tail", "pos").alias("value"), F.min("pos").alias("first_pos"))


def _document(source: str, attribute: Column, text: Column, doc_id: Column | None = None) -> list[Column]:
    made = F.concat_ws("_", F.lit(source), T.slug_keep(F.col("head")), T.slug_keep(attribute), F.lit("0"))
    return [
        (made if doc_id is None else doc_id).alias("doc_key"),
        text.alias("text"),
        F.lit(source).alias("source"),
        F.col("head").alias("entity_name"),
        attribute.alias("attribute"),
    ]


def attribute_documents(rows: DataFrame, category: str) -> DataFrame:
    """One document for each entity and relation."""
    before, between = F.lit(None).cast("string"), F.lit(None).cast("string")
    for relation, (a, b) in TEMPLATES[category].items():
        hit = F.col("relation") == relation
        before, between = F.when(hit, a).otherwise(before), F.when(hit, b).otherwise(between)
    text = F.concat(F.coalesce(before, F.lit("")), "head", F.coalesce(between, F.concat(F.lit(" "), "relation", F.lit(": "))), "value")
    return attributes(rows, category).select(*_document(f"kg_{category}", F.col("relation"), text))


def summary_documents(rows: DataFrame, category: str) -> DataFrame:
    """One document for each entity: its attributes in a fixed order."""
    parts = [F.max(F.when(F.col("relation") == r, F.concat(F.lit(p), F.col("value")))).alias(r) for r, p in SUMMARY[category].items()]
    wide = attributes(rows, category).groupBy("head").agg(*parts)
    text = F.concat(F.concat_ws(". ", "head", *SUMMARY[category]), F.lit("."))
    return wide.select(*_document(f"kg_{category}", F.lit("summary"), text))


def relation_documents(rows: DataFrame) -> DataFrame:
    """One document for each organ relation; ids repeat where an organ has several."""
    text = F.concat("head", F.lit(" belongs to the "), "tail", F.lit("."))
    return rows.filter("category = 'organ_rel'").select(*_document("kg_organ_rel", F.lit("belong_to"), text))


def kg_documents(rows: DataFrame) -> DataFrame:
    parts = [f(rows, c) for c in ("disease", "organ") for f in (attribute_documents, summary_documents)]
    out = parts[0]
    for p in [*parts[1:], relation_documents(rows)]:
        out = out.unionByName(p)
    return out


def ontology_documents(rows: DataFrame) -> DataFrame:
    """``{label}: {definition}``, the full definition before the short one, with synonyms; only
    labelled, current rows with a definition. Signs beyond ASCII are dropped. ``rows`` has
    rid, label, full_def, short_def, synonyms, obsolete."""
    c = {k: F.nullif(T.strip(F.col(k)), F.lit("")) for k in ("rid", "label", "full_def", "short_def", "synonyms", "obsolete")}
    definition = F.coalesce(c["full_def"], c["short_def"])
    known = F.coalesce(F.concat(F.lit(" Also known as: "), F.replace(c["synonyms"], F.lit("|"), F.lit(", "))), F.lit(""))
    text = F.trim(F.regexp_replace(F.concat(c["label"], F.lit(": "), definition, known), r"[^\x00-\x7F]", ""))
    return (
        rows.filter(c["label"].isNotNull() & (F.coalesce(c["obsolete"], F.lit("")) != "1") & definition.isNotNull())
        .select(
            F.concat(F.lit("radlex_"), F.coalesce(c["rid"], T.slug_ascii(F.col("label")))).alias("doc_key"),
            text.alias("text"),
            F.lit("radlex").alias("source"),
            c["label"].alias("entity_name"),
            F.lit("definition").alias("attribute"),
        )
        .filter("text <> ''")
    )


def ontology_skips(rows: DataFrame) -> DataFrame:
    """Why rows were skipped, each counted under the first reason that fits."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    reason = (
        F.when(blank("label"), "no_label")
        .when(F.coalesce(F.trim("obsolete"), F.lit("")) == "1", "obsolete")
        .when(blank("full_def") & blank("short_def"), "no_definition")
        .otherwise("kept")
    )
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def qa_documents(samples: DataFrame) -> DataFrame:
    """Question and answer as one text; with body region, modality and category where given
    and only in English for the source that has them."""
    q, a = T.strip(F.col("question")), T.strip(F.col("answer"))
    extra = lambda label, c: F.when(T.strip(F.col(c)) != "", F.concat(F.lit(f" {label}: "), T.strip(F.col(c)))).otherwise("")
    slake = F.col("source") == "slake"
    more = F.when(slake, F.concat(extra("Body region", "body_location"), extra("Modality", "modality"), extra("Category", "content_type"))).otherwise("")
    return (
        samples.filter((q != "") & (a != "") & F.col("source").isin("slake", "vqa_rad"))
        .filter(~slake | (F.lower("q_lang") == "en"))
        .select(
            F.concat(F.lit("qa_"), "sample_id").alias("doc_key"),
            F.concat(F.lit("Question: "), q, F.lit(" Answer: "), a, more).alias("text"),
            F.when(slake, "qa_slake").otherwise("qa_vqarad").alias("source"),
            F.col("sample_id").alias("entity_name"),
            F.lit("qa_pair").alias("attribute"),
        )
    )


def one_sample(samples: DataFrame) -> DataFrame:
    """The earliest delivery of each sample_id; then by creation, question and answer."""
    first = Window.partitionBy("sample_id").orderBy("ingested_at", "created_at", "question", "answer")
    return samples.filter("sample_id IS NOT NULL").withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")


def training_records(samples: DataFrame) -> DataFrame:
    """sample_id, conversation: the train split with its answers in training form, cut to fifty
    words; blank answers are left out."""
    answer = T.first_words(T.normalize_train(F.col("answer")))
    rows = samples.filter(F.col("sample_id").contains("_train_")).select("sample_id", "question", answer.alias("answer")).filter("answer <> '' AND question IS NOT NULL")
    return rows.select("sample_id", T.conversation(F.col("question"), F.col("answer")).alias("conversation"))
