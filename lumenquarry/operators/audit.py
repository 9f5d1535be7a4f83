"""Profiles, duplicates, leakage and missing references of a sample collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .metrics import ratio

QA = ("question", "answer")


def keyed(samples: DataFrame) -> DataFrame:
    """``samples`` with q and a in training form and the split of the id."""
    return samples.withColumns(
        {"q": T.normalize_train(F.col("question")), "a": T.normalize_train(F.col("answer")), "split": F.regexp_extract("sample_id", r"_(train|val|test)_[^_]+$", 1)}
    )


def profile(samples: DataFrame, *keys: str) -> DataFrame:
    """Counts, blanks, answer lengths (mean, the element at n div 2, largest, share over ten
    words), long and tagged answers, distinct answers, repeated question-answer pairs."""
    n_words = F.size(T.words(F.col("answer")))
    rows = keyed(samples).withColumn("w", n_words)
    n = F.count("*")
    upper = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY w)")
    out = rows.groupBy(*keys).agg(
        n.alias("n"),
        F.count_if(F.col("q") == "").alias("n_empty_question"),
        F.count_if(F.col("a") == "").alias("n_empty_answer"),
        F.round(F.avg("w"), 6).alias("mean_words"),
        F.median("w").alias("_m"),
        upper.alias("_low"),
        F.max("w").alias("max_words"),
        F.round(ratio(F.count_if(F.col("w") > 10), n), 6).alias("share_over_10"),
        F.count_if(F.col("w") > 50).alias("n_over_50"),
        F.count_if(F.contains(T.text_or_empty(F.col("answer")), F.lit("<")) & F.contains(T.text_or_empty(F.col("answer")), F.lit(">"))).alias("n_tagged"),
        F.countDistinct("a").alias("n_answers"),
        (n - F.countDistinct("q", "a")).alias("n_repeated_pairs"),
    )
    middle = F.when(F.col("n") % 2 == 1, F.col("_m")).otherwise(2 * F.col("_m") - F.col("_low"))
    return out.withColumn("median_words", middle.cast("int")).drop("_m", "_low")


def histogram(rows: DataFrame, column: str, most: int | None = None) -> DataFrame:
    """value, n by falling count; the ``most`` commonest ones."""
    out = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return out if most is None else out.orderBy(F.col("n").desc(), F.col("value").asc_nulls_last()).limit(most)


def duplicates(samples: DataFrame, most: int | None = None) -> DataFrame:
    """q, a, n of question-answer pairs that stand more than once."""
    out = keyed(samples).groupBy("q", "a").agg(F.count("*").alias("n")).filter("n > 1")
    return out if most is None else out.orderBy(F.col("n").desc(), "q", "a").limit(most)


#: The order in which collections and splits are loaded.
SOURCES, SPLITS = ("vqa_rad", "slake", "pathvqa"), ("train", "val", "test")


def load_order() -> list[Column]:
    """Samples in the order they are loaded in: by collection, split and number; ids that end in no
    number follow, in string order."""
    place = lambda names, c: F.nullif(F.array_position(F.array(*map(F.lit, names)), c), F.lit(0)).asc_nulls_last()
    number = F.regexp_extract("sample_id", r"_(\d+)$", 1).try_cast("long")
    return [place(SOURCES, F.col("source")), place(SPLITS, F.regexp_extract("sample_id", r"_(train|val|test)_[^_]+$", 1)), number.asc_nulls_last(), F.col("sample_id")]


def first_of_each(samples: DataFrame, *keys: str) -> DataFrame:
    """The first row, in load order, of each source, question and answer in training form."""
    rows = keyed(samples)
    first = Window.partitionBy(*(keys or ("source", "q", "a"))).orderBy(*load_order())
    return rows.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn", "q", "a", "split")


def overlap(samples: DataFrame) -> DataFrame:
    """kind, n: distinct questions, question-answer pairs and pairs with image that train and
    the held-out splits share."""
    rows = keyed(samples)
    train, held = rows.filter("split = 'train'"), rows.filter("split IN ('val', 'test')")
    kinds = {"question": ["q"], "question_answer": ["q", "a"], "question_answer_image": ["q", "a", "img_name"]}
    out = None
    for name, cols in kinds.items():
        both = train.select(cols).intersect(held.select(cols)).agg(F.lit(name).alias("kind"), F.count("*").alias("n"))
        out = both if out is None else out.unionByName(both)
    return out


def shared_pairs(samples: DataFrame) -> DataFrame:
    """q, a, same_image of pairs in train and held-out splits: whether any image is the same.
    Each side is reduced to its distinct (q, a, image) first."""
    rows = keyed(samples).select("split", "q", "a", "img_name")
    side = lambda held: rows.filter(F.col("split").isin("val", "test") if held else F.col("split") == "train").select("q", "a", "img_name").distinct()
    pairs = lambda df: df.select("q", "a").distinct()
    both = pairs(side(False)).join(pairs(side(True)), ["q", "a"])
    image = side(False).join(side(True), ["q", "a", "img_name"]).select("q", "a").distinct().withColumn("hit", F.lit(True))
    return both.join(image, ["q", "a"], "left").select("q", "a", F.coalesce("hit", F.lit(False)).alias("same_image"))


def missing_references(rows: DataFrame, known: DataFrame, column: str, key: str) -> DataFrame:
    """value, n of ``column`` that ``known`` has no ``key`` for; nulls don't refer to anything."""
    used = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return used.join(known.select(F.col(key).alias("value")).distinct(), "value", "left_anti")


def index_summary(documents: DataFrame) -> DataFrame:
    """source, n_documents, and the total in the row without a source."""
    return documents.rollup("source").agg(F.count("*").alias("n_documents"))


#: Ranges in which the rows are counted.
LAST_PARTS = 4096


def last_share(rows: DataFrame, order: str, share: float) -> DataFrame:
    """The last ``max(1, int(n * share))`` rows by the whole number ``order``, then by sample_id; of rows
    without a number none. The numbers are counted in LAST_PARTS ranges of equal width; all rows
    of the upper ones are in, and only those of the range with the bound are ranked."""
    n, low, high = rows.filter(F.col(order).isNotNull()).agg(F.count("*"), F.min(order), F.max(order)).first()
    if not n:
        return rows.filter(F.col(order).isNotNull())
    width = (high - low) // LAST_PARTS + 1
    part = F.floor((F.col(order) - low) / width).cast("long")
    open_ = max(1, int(n * share))
    for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).filter("part IS NOT NULL").orderBy(F.col("part").desc()).collect():  # at most LAST_PARTS rows
        if r.n >= open_:
            break
        open_ -= r.n
    last = Window.partitionBy("_part").orderBy(F.col(order).desc(), F.col("sample_id").desc())
    bound = rows.withColumn("_part", part).filter(F.col("_part") == r.part).withColumn("_rn", F.row_number().over(last)).filter(F.col("_rn") <= open_)
    return rows.filter(part > r.part).unionByName(bound.drop("_part", "_rn"))


def mixed_calibration(samples: DataFrame, share: float = 0.1) -> DataFrame:
    """The validation split of one source and the last share of the training split of another."""
    index = F.regexp_extract("sample_id", r"_(\d+)$", 1).cast("long")
    train = samples.filter(F.col("sample_id").rlike(r"^vqa_rad_train_\d+$")).withColumn("_i", index)
    val = samples.filter(F.col("sample_id").rlike(r"^slake_val_\d+$"))
    return val.unionByName(last_share(train, "_i", share).drop("_i"))
