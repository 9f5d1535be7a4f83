"""Splitting oversized texts at natural boundaries (problem 2).

One regular expression walks each text. Its alternatives are ordered by boundary strength
(end of text, paragraph, line, sentence, clause, word, and single characters where a "word"
never ends); each is a bounded quantifier that consumes as many words as still fit. The
overlap is read backwards from the text before a piece. All of it is SQL array functions;
nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, SPACES

MAX_WORDS, OVERLAP = 300, 40
#: A run without any space beyond this length is cut by characters.
MAX_RUN = 4000


#: The same for texts of ASCII alone, for which Java has a fast path.
ASCII_SPACE = r"\t\n\x0b\f\r\x1c-\x1f "


def _by_charset(text: Column, make) -> Column:
    """``make(space)`` with the space class that the text needs."""
    return F.when(F.length(text) == F.octet_length(text), make(ASCII_SPACE)).otherwise(make(SPACE))


def n_words(text: Column) -> Column:
    """Number of maximal runs of non-whitespace; 0 for null."""
    text = F.ltrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return _by_charset(text, lambda space: F.length(F.regexp_replace(text, rf"[^{space}]++[{space}]*+", "\u0001")))


def longer_than(text: Column, words: int) -> Column:
    """Whether a text has more words; reads no further than it must."""
    rule = lambda space: text.rlike(rf"\A[{space}]*+(?:[^{space}]++[{space}]++){{{words}}}[^{space}]")
    return (F.length(text) > 2 * words) & _by_charset(text, rule)


def piece_pattern(new_words: int, space: str = SPACE, max_run: int = MAX_RUN) -> str:
    unit = rf"(?:[^{space}]{{1,{max_run}}}+[{space}]*+)"
    least = max(1, new_words // 2)
    ends = [
        r"(?<=\n[ \t\r]{0,4}\n[ \t\r\n]{0,4})",  # paragraph
        r"(?<=\n[ \t\r]{0,8})",  # line
        r"""(?<=[.!?…。！？]["')\]”’]{0,2}[ \t]{1,4})""",  # sentence
        r"(?<=[;:,|，；] {1,4})",  # clause
    ]
    return "|".join(
        [rf"{unit}{{1,{new_words}}}\z", *[rf"{unit}{{{least},{new_words}}}{end}" for end in ends], rf"{unit}{{1,{new_words}}}", rf"(?s:.{{1,{max_run}}})"]
    )


def pieces(docs: DataFrame, max_words: int = MAX_WORDS, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` with the array ``pieces`` of struct(overlap_text, new_text).

    A text of at most max_words is one piece, unchanged; null or blank texts have no piece.
    A longer one is cut into pieces of at most max_words words, of which every piece but the
    first repeats the last ``overlap`` words before it. The new_texts of a document put
    together are its text without leading whitespace. Columns of the input with other names
    stay; one named pieces is replaced.
    """
    if not 0 <= overlap < max_words:
        raise ValueError("overlap must be at least 0 and below max_words")
    text = F.regexp_replace(F.coalesce("text", F.lit("")), rf"^[{SPACE}]+", "")
    cores = _by_charset(
        text, lambda space: F.regexp_extract_all(text, F.lit(piece_pattern(max_words - overlap, space)), F.lit(0))
    )
    unit = rf"^[{SPACE}]*+(?:[^{SPACE}]{{1,{MAX_RUN}}}+[{SPACE}]*+){{0,{overlap}}}"
    tail = lambda before: F.reverse(F.regexp_extract(F.reverse(before), unit, 0))
    whole = F.array(F.struct(F.lit("").alias("overlap_text"), text.alias("new_text")))
    # The array is bound to a lambda variable, else every element would walk the text again.
    parts = F.element_at(
        F.transform(
            F.array(cores),
            lambda c: F.transform(
                c,
                lambda new, i: F.struct(
                    F.when(i == 0, "")
                    .otherwise(tail(F.concat(F.coalesce(F.get(c, i - 2), F.lit("")), F.coalesce(F.get(c, i - 1), F.lit("")))))
                    .alias("overlap_text"),
                    new.alias("new_text"),
                ),
            ),
        ),
        1,
    )
    none = F.array().cast("array<struct<overlap_text:string,new_text:string>>")
    return docs.withColumn(
        "pieces", F.when(longer_than(F.col("text"), max_words), parts).when(text != "", whole).otherwise(none)
    )


def exploded(docs: DataFrame) -> DataFrame:
    """One row per piece: doc_id, chunk_index from 0, entity_name (trimmed), text, n_words, n_overlap_words."""
    # The outer form, as from the plain one Catalyst infers a filter that walks every text once more.
    rows = pieces(docs.select("doc_id", "text", "entity_name")).select("doc_id", "entity_name", F.posexplode_outer("pieces").alias("chunk_index", "p")).filter("p IS NOT NULL")
    before, new = F.col("p.overlap_text"), F.col("p.new_text")
    counted = rows.select("doc_id", "chunk_index", "entity_name", before.alias("before"), new.alias("new"), F.when(before == "", 0).otherwise(n_words(before)).alias("n_before"))
    # a word that no space ends goes on in the new text
    torn = (F.col("before") != "") & (F.length("before") == F.length(F.rtrim("before", F.lit(SPACES))))
    return counted.select(
        "doc_id",
        "chunk_index",
        F.trim("entity_name").alias("entity_name"),
        F.rtrim(F.concat("before", "new"), F.lit(SPACES)).alias("text"),
        (F.col("n_before") + n_words(F.col("new")) - torn.cast("int")).alias("n_words"),
        F.col("n_before").alias("n_overlap_words"),
    )
