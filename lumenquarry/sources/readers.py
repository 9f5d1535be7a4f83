"""Scans: sample collections, triples, ontologies, indexes, result files, images' metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as T
from ..operators import retrieval

SLAKE_FILES = {"train": "train.json", "val": "validate.json", "validation": "validate.json", "test": "test.json"}
KG_FILES = {"en_disease.csv": "disease", "en_organ.csv": "organ", "en_organ_rel.csv": "organ_rel"}
#: What the columns of a triple file may be called.
KG_NAMES = {"head": ("head", "subject", "entity1", "h"), "relation": ("relation", "rel", "predicate", "r"), "tail": ("tail", "object", "entity2", "t")}
#: Places of the ontology's columns.
ONTOLOGY = {"rid": 46, "label": 1, "full_def": 28, "short_def": 3, "synonyms": 2, "obsolete": 4}
#: Spellings of modalities.
MODALITIES = {"X-Ray": "xray", "CT": "ct", "MRI": "mri"}


def parquet_samples(spark: SparkSession, path: str, source: str, split: str, max_samples: int | None = None) -> DataFrame:
    """Question-answer rows of a Parquet dataset as samples. The index is the row's place in
    the files (file, then row), so a limit takes the first rows of the scan."""
    rows = spark.read.parquet(path).select("question", "answer", "_metadata.file_path", "_metadata.row_index")
    order = ["file_path", "row_index"]
    if max_samples is not None:
        rows = rows.orderBy(*order).limit(max_samples)
    counted = rows.groupBy("file_path").agg((F.max("row_index") + 1).alias("n"))  # one row a file
    before = counted.select("file_path", F.coalesce(F.sum("n").over(Window.orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("n0"))
    index = (F.col("n0") + F.col("row_index")).cast("string")
    return rows.join(before, "file_path").select(
        F.concat(F.lit(f"{source}_{split}_"), index).alias("sample_id"),
        "question",
        "answer",
        T.type_from_answer(F.col("answer")).alias("answer_type"),
        F.lit("unknown").alias("modality"),
        F.lit(source).alias("source"),
    )


def slake(spark: SparkSession, folder: str, split: str, images: DataFrame | None = None) -> DataFrame:
    """One split of the JSON collection: English rows with an answer, and with an existing image
    if ``images`` (column img_name) is given; the first of equal (image, question, answer)."""
    if split not in SLAKE_FILES:
        raise ValueError(f"unknown split {split!r}")
    rows = spark.read.schema(schemas.SLAKE_RAW).json(f"{folder}/{SLAKE_FILES[split]}", multiLine=True)
    rows = rows.withColumn("_pos", F.monotonically_increasing_id()).filter((F.col("q_lang") == "en") & (T.strip(F.col("answer")) != ""))
    if images is not None:
        rows = rows.join(images.select("img_name").distinct(), "img_name", "left_semi")
    kept = rows.groupBy("img_name", F.lower(T.strip(F.col("question"))).alias("_q"), F.lower(T.strip(F.col("answer"))).alias("_a")).agg(F.min_by(F.struct("*"), "_pos").alias("r"))
    r = lambda c: F.col(f"r.{c}")
    return kept.select(
        F.concat(F.lit(f"slake_{split}_"), r("qid").cast("string")).alias("sample_id"),
        r("question").alias("question"),
        r("answer").alias("answer"),
        F.when(F.upper(r("answer_type")) == "CLOSED", "closed").otherwise("open").alias("answer_type"),
        _modality(r("modality")).alias("modality"),
        F.lit("slake").alias("source"),
        "img_name",
        r("location").alias("body_location"),
        r("content_type").alias("content_type"),
        F.coalesce(r("triple"), F.array().cast("array<string>")).alias("triple"),
    )


def _modality(col):
    out = F.lit("unknown")
    for spelled, name in MODALITIES.items():
        out = F.when(col == spelled, name).otherwise(out)
    return out


def kg_triples(spark: SparkSession, folder: str) -> DataFrame:
    """Triples of the three files with ``#`` between fields, which may be quoted; columns by their heading,
    else by position; incomplete rows, missing files and resource forks (``._*``) are left out."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    out = spark.createDataFrame([], schemas.TRIPLE)
    for name, category in KG_FILES.items():
        path = hadoop(f"{folder}/{name}")
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            continue
        rows = spark.read.csv(f"{folder}/{name}", sep="#", header=True, quote='"', escape='"', multiLine=True)
        titles = [t.strip().lower() for t in rows.columns]
        if len(titles) < 3:
            continue
        at = {k: next((titles.index(n) for n in names if n in titles), i) for i, (k, names) in enumerate(KG_NAMES.items())}
        cells = rows.toDF(*[f"c{i}" for i in range(len(titles))])
        part = cells.select(*[F.trim(f"c{i}").alias(k) for k, i in at.items()], F.lit(category).alias("category"))
        out = out.unionByName(part.filter("head <> '' AND relation <> '' AND tail <> ''"))
    return out


def ontology(spark: SparkSession, path: str) -> DataFrame:
    """rid, label, full_def, short_def, synonyms, obsolete of an ontology table exported as CSV
    (cells may hold line breaks): by heading where these are the headings, else by position."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if set(ONTOLOGY) <= set(rows.columns):
        return rows.select(*ONTOLOGY)
    cells = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])
    return cells.select(*[(F.col(f"c{i}") if i < len(rows.columns) else F.lit(None).cast("string")).alias(k) for k, i in ONTOLOGY.items()])


def index(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Documents and meta of a saved index; a missing version reads unknown."""
    meta = spark.read.json(f"{folder}/meta")
    version = F.coalesce("version", F.lit("unknown")) if "version" in meta.columns else F.lit("unknown")
    return spark.read.parquet(f"{folder}/documents"), meta.withColumn("version", version)


def postings(spark: SparkSession, folder: str) -> retrieval.Bm25Index:
    """The saved index of documents' tokens, for any number of queries."""
    tokens = spark.read.parquet(f"{folder}/tokens")
    return retrieval.Bm25Index(tokens, spark.read.parquet(f"{folder}/terms"), tokens.agg(F.avg(F.size("w"))).first()[0] or 0.0)


def result_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Per-sample rows of all result files of a folder, with their file."""
    rows = spark.read.schema(schemas.RESULT_FILE).json(pattern, multiLine=True).select(F.input_file_name().alias("file"), "run_name", F.explode("per_sample").alias("r"))
    return rows.select("file", "run_name", "r.*")


def sweep_rows(spark: SparkSession, path: str) -> DataFrame:
    """confidence, correct, answer_type of a list of rows; a null type reads open, a row without
    confidence or correct fails the scan. A file of sweeps (an object with ``combined``) has no
    rows; another object is an error."""
    first = spark.read.text(path).filter("trim(value) <> ''").first()
    if first and first[0].lstrip().startswith("{"):
        if "combined" not in spark.read.json(path, multiLine=True).columns:
            raise ValueError("expected a list of rows or an object with 'combined'")
        return spark.createDataFrame([], schemas.SWEEP_ROW)
    rows = spark.read.schema(schemas.SWEEP_ROW).json(path, multiLine=True)
    ok = F.assert_true(F.col("confidence").isNotNull() & F.col("correct").isNotNull(), F.lit("confidence and correct are required"))
    return rows.withColumn("_ok", ok).filter("_ok IS NULL").drop("_ok").withColumn("answer_type", F.coalesce("answer_type", F.lit("open")))


def union_samples(*parts: DataFrame) -> DataFrame:
    """All samples; columns that one collection lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def best_effort(*loaders) -> tuple[list[DataFrame], list[str]]:
    """What could be loaded, and why the rest could not."""
    out, errors = [], []
    for load in loaders:
        try:
            df = load()
            df.schema  # noqa: B018  analysed here, so that a missing path shows now
            out.append(df)
        except Exception as e:
            errors.append(f"{type(e).__name__}: {str(e).splitlines()[0]}")
    return out, errors


def training_samples(samples: DataFrame) -> DataFrame:
    """The training split alone; test and validation rows never pass."""
    return samples.filter(F.col("sample_id").rlike(r"_train_[^_]+$"))


def dicom(spark: SparkSession, pattern: str) -> DataFrame:
    """path, pixels, tags of single-frame images. Needs the optional package pydicom."""
    try:
        import pydicom  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading DICOM files needs pydicom") from e

    def rows(batches):
        import io

        import pandas as pd
        import pydicom

        for pdf in batches:
            out = []
            for path, content in zip(pdf.path, pdf.content):
                ds = pydicom.dcmread(io.BytesIO(content))
                if int(getattr(ds, "NumberOfFrames", 1)) > 1:
                    raise ValueError(f"multi-frame image: {path}")
                tags = {e.keyword: str(e.value) for e in ds if e.keyword and not e.keyword.startswith("Pixel")}
                out.append((path, ds.pixel_array.astype(float).tolist(), tags))
            yield pd.DataFrame(out, columns=["path", "pixels", "tags"])

    files = spark.read.format("binaryFile").load(pattern).select("path", "content")
    return files.mapInPandas(rows, "path string, pixels array<array<double>>, tags map<string,string>")


def check_first(rows: DataFrame, *columns: str) -> None:
    """Fails unless there is a row and its ``columns`` are filled."""
    first = rows.select(*columns).limit(1).collect()
    if not first or any(first[0][c] in (None, "") for c in columns):
        raise ValueError(f"the first row lacks one of {', '.join(columns)}")


def newest(spark: SparkSession, pattern: str) -> str | None:
    """The last file by name that fits the pattern."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return max((f.getPath().toString() for f in found), default=None) if found else None
