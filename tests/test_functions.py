import pytest
from pyspark.sql import functions as F

from lumenquarry.functions import arrays as A
from lumenquarry.functions import text as T


def one(spark, expr, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)))
    return df.select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    "given, want",
    [("The  Left-sided Lung.", "left-sided lung"), ("-yes-", "yes"), (None, ""), ("a an the", ""), ("É x_y", "é x_y"), ("   ", "")],
)
def test_eval_form(spark, given, want):
    assert one(spark, T.normalize_eval(F.lit(given).cast("string"))) == want


def test_three_forms_differ(spark):
    c = F.lit(" The Lung?! ")
    assert one(spark, T.normalize_eval(c)) == "lung"
    assert one(spark, T.normalize_bench(c)) == "the lung"
    assert one(spark, T.normalize_train(c)) == "the lung?!"


def test_types(spark):
    assert one(spark, T.type_from_answer(F.lit(" Yes "))) == "closed"
    assert one(spark, T.type_from_question(F.lit("Is' it?"))) == "closed"
    assert one(spark, T.type_from_question(F.lit("What is it?"))) == "open"
    assert one(spark, T.type_from_question(F.lit("What?"), F.lit("closed"))) == "closed"
    assert one(spark, T.type_from_question(F.lit(None).cast("string"))) == "open"


def test_chunks(spark):
    words = " ".join(map(str, range(10)))
    assert one(spark, T.chunks(F.lit(words), 4, 1)) == ["0 1 2 3", "3 4 5 6", "6 7 8 9"]
    assert one(spark, T.chunks(F.lit(" 1  2 "), 4, 1)) == [" 1  2 "]
    assert one(spark, T.chunks(F.lit("  "), 4, 1)) == []
    assert one(spark, T.chunks(F.lit(None).cast("string"), 4, 1)) == []
    with pytest.raises(ValueError):
        T.chunks(F.lit("x"), 4, 4)


def test_keywords(spark):
    assert one(spark, T.keywords(F.lit("Are the lungs, Lungs? of it"))) == ["lungs", "lungs"]
    assert one(spark, T.keyword_in(F.lit("lungs"), F.lit("left lung")))
    assert not one(spark, T.keyword_in(F.lit("mass"), F.lit("left ma")))


def test_retrieval_query(spark):
    q = lambda a, e, r: one(spark, T.retrieval_query(F.lit("q"), F.lit(a), F.lit(e), F.lit(r)))
    assert (q("a", "", 0), q("a", "", 1), q("a", "bad", 0), q("", "", 0)) == ("q a", "q", "q", "q")


def test_conversation(spark):
    turns = T.conversation(F.lit("Q?"), F.lit("yes"))
    got = one(spark, T.typed_blocks(turns))
    assert [b.type for b in got[0].content] == ["image", "text"]
    assert got[0].content[1].text.startswith("Q?\n")
    assert got[1].content[0].text == "yes"


def test_answer_start_and_mask(spark):
    ids, marker = [1, 7, 8, 2, 7, 8, 5, 0], [7, 8]
    assert one(spark, A.answer_start(F.col("i"), F.col("m")), i=ids, m=marker) == 6
    assert one(spark, A.answer_start(F.col("i"), F.col("m")), i=ids, m=[9]) == 0
    assert one(spark, A.masked_labels(F.col("i"), F.lit(6), 0), i=ids) == [-100] * 6 + [5, -100]


def test_windowing(spark):
    px = [0.0, 64.0, 128.0, 300.0]
    assert one(spark, A.window_pixels(F.col("p"), F.lit(128.0), F.lit(256.0)), p=px) == [0, 63, 127, 255]
    none = F.lit(None).cast("double")
    assert one(spark, A.window_pixels(F.col("p"), none, none), p=px) == [0, 54, 108, 255]
    assert one(spark, A.window_pixels(F.col("p"), F.lit(1.0), F.lit(0.0)), p=px) == [0, 0, 0, 0]


def test_scalers(spark):
    assert one(spark, A.platt(F.lit(0.5), 100.0, 0.0)) == 0.99
    assert one(spark, A.isotonic(F.lit(0.5), [0.0, 1.0], [0.2, 0.4])) == pytest.approx(0.3)
    assert one(spark, A.isotonic(F.lit(0.5), [], [])) == 0.5


def test_tags_and_sizes(spark):
    tags = F.create_map(F.lit("PatientID"), F.lit("7"), F.lit("Rows"), F.lit("9"))
    assert one(spark, A.without_private(tags)) == {"Rows": "9"}
    assert one(spark, A.fitted_size(F.lit(8192), F.lit(100))).asDict() == {"width": 4096, "height": 50}
    assert one(spark, A.mean_probability(F.col("p")), p=[0.5, 1.0]) == 0.75
    assert one(spark, A.mean_probability(F.array().cast("array<double>"))) == 0.5
    assert one(spark, A.inner_product(F.col("a"), F.col("b")), a=[1.0, 2.0], b=[3.0, 4.0]) == 11.0


def test_print_forms(spark):
    assert one(spark, T.percent(F.lit(0.415))) == "41.5%"
    assert one(spark, T.percent(F.lit(-1.0))) == "N/A"
    assert one(spark, T.signed(F.lit(0.02))) == "+2.0%"


def test_training_numbers_and_names(spark):
    null = F.lit(None).cast("double")
    got = one(spark, A.training_numbers(F.lit(10), F.lit(4), F.lit(1.0), F.lit(2.0)))
    assert (got.steps, got.overfit) == (3, True)
    assert one(spark, A.training_numbers(F.lit(10), F.lit(4), F.lit(1.0), null)).asDict() == {"steps": 3, "perplexity": None, "overfit": False}
    assert one(spark, A.renamed_key(F.lit("model.layers.3.w"))) == "model.language_model.layers.3.w"
    assert one(spark, A.renamed_key(F.lit("lm_head.w"))) == "lm_head.w"
