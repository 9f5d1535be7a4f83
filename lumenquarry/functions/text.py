"""Text functions, column to column, all of them built-ins of the JVM.

Three normalisers exist side by side because three parts of the evaluation compare answers
differently; they are not interchangeable.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that the operators leave out or look for.
ARTICLES = ("a", "an", "the")
KEYWORD_STOP = (
    "is are was were does do did has have had a an the in on at of to for with this that what which where how why when who there "
    "any show can be it from"
).split()
CITATION_STOP = (
    "a an the is are was were be been do does did have has had will would can could should may might this that there in on at of to "
    "for and or not what which where how any with"
).split()
CLOSED_PREFIXES = "is are does do was were has have can will should".split()


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def words(col: Column) -> Column:
    """Words between white space of any kind, empty ones left out."""
    return F.filter(F.split(F.regexp_replace(text_or_empty(col), r"(?U)\s+", " "), " "), lambda w: w != "")


def strip(col: Column) -> Column:
    return F.regexp_replace(text_or_empty(col), r"(?U)^\s+|\s+$", "")


def eval_tokens(col: Column) -> Column:
    """Tokens of the evaluation's normal form: punctuation but hyphens and underscores out,
    hyphens off the ends, articles out."""
    cleaned = F.regexp_replace(F.lower(text_or_empty(col)), r"[^\p{L}\p{N}_-]", " ")
    tokens = F.transform(F.split(cleaned, " "), lambda t: F.regexp_replace(t, "^-+|-+$", ""))
    return F.filter(tokens, lambda t: (t != "") & ~t.isin(*ARTICLES))


def normalize_eval(col: Column) -> Column:
    return F.array_join(eval_tokens(col), " ")


def normalize_bench(col: Column) -> Column:
    """The benchmark's normal form: lower case without trailing punctuation and space."""
    return F.regexp_replace(F.lower(strip(col)), r"[\p{Punct}\s]+$", "")


def normalize_train(col: Column) -> Column:
    return F.lower(strip(col))


def type_from_answer(answer: Column) -> Column:
    return F.when(F.lower(strip(answer)).isin("yes", "no"), "closed").otherwise("open")


def type_from_question(question: Column, given: Column | None = None) -> Column:
    """closed if the first word asks for yes or no; only where no type is given."""
    first = F.regexp_replace(F.lower(F.coalesce(F.get(words(question), F.lit(0)), F.lit(""))), r"['?]+$", "")
    guess = F.when(first.isin(*CLOSED_PREFIXES), "closed").otherwise("open")
    return guess if given is None else F.coalesce(F.nullif(given, F.lit("")), guess)


def slug_keep(col: Column) -> Column:
    """Lower case with space, slash and hash as underscores."""
    return F.translate(F.lower(text_or_empty(col)), " /#", "___")


def slug_ascii(col: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text_or_empty(col)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def bm25_tokens(col: Column) -> Column:
    """Lower-case words with their punctuation, for corpus and query alike."""
    return words(F.lower(text_or_empty(col)))


def keywords(col: Column) -> Column:
    """Content words of at least three letters, in order, repeats kept."""
    tokens = F.transform(words(F.lower(text_or_empty(col))), lambda w: F.regexp_replace(w, "^[?.!,;:]+|[?.!,;:]+$", ""))
    return F.filter(tokens, lambda t: (F.length(t) >= 3) & ~t.isin(*KEYWORD_STOP))


def keyword_in(keyword: Column, text: Column) -> Column:
    """The keyword, or its singular stem, is part of the lower-case text."""
    stem = keyword.endswith("s") & (F.length(keyword) >= 5) & F.contains(text, F.left(keyword, F.length(keyword) - 1))
    return F.contains(text, keyword) | stem


def citation_tokens(col: Column) -> Column:
    cleaned = F.regexp_replace(F.lower(text_or_empty(col)), r"[^a-z0-9\s]", " ")
    return F.array_distinct(F.filter(words(cleaned), lambda t: (F.length(t) > 1) & ~t.isin(*CITATION_STOP)))


def retrieval_query(question: Column, answer: Column, error: Column, retry: Column) -> Column:
    plain = (retry > 0) | (text_or_empty(answer) == "") | (text_or_empty(error) != "")
    return F.when(plain, question).otherwise(F.concat_ws(" ", question, answer))


def chunks(col: Column, size: int = 512, overlap: int = 50) -> Column:
    """Overlapping word windows; a text of at most ``size`` words is returned as it is, a blank
    one gives no chunk, and no chunk consists of overlap alone."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    w, step = words(col), size - overlap
    n = F.size(w)
    starts = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(step))
    many = F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, size), " "))
    return F.when(n == 0, F.array().cast("array<string>")).when(n <= size, F.array(col)).otherwise(many)


def first_words(col: Column, n: int = 50) -> Column:
    return F.array_join(F.slice(words(col), 1, n), " ")


def preview(col: Column, n: int = 120) -> Column:
    return F.when(F.length(col) > n, F.concat(F.left(col, F.lit(n)), F.lit("..."))).otherwise(col)


def safe_name(col: Column) -> Column:
    """A text as part of a file name."""
    return F.regexp_replace(F.regexp_replace(col, r"[/\\: ]", "_"), r"[^A-Za-z0-9._-]", "")


#: Fixed value: what a question is followed by, so that training and inference agree.
CONCISE = "Provide only the direct answer in 1-5 words. Do not explain."


def conversation(question: Column, answer: Column) -> Column:
    """Chat turns of one training record."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(turn("user", F.concat(F.lit("<image>\n"), question, F.lit("\n" + CONCISE))), turn("assistant", answer))


def typed_blocks(turns: Column) -> Column:
    """Plain turns as typed content blocks; a user's turn gets an image block and loses its image mark."""

    def blocks(turn: Column) -> Column:
        block = lambda kind, body: F.struct(F.lit(kind).alias("type"), body.alias("text"))
        text = F.regexp_replace(turn["content"], r"^<image>\n?", "")
        asked = F.array(block("image", F.lit(None).cast("string")), block("text", text))
        content = F.when(turn["role"] == "user", asked).otherwise(F.array(block("text", turn["content"])))
        return F.struct(turn["role"].alias("role"), content.alias("content"))

    return F.transform(turns, blocks)


def percent(col: Column, digits: int = 1) -> Column:
    """A share as percent, N/A for the negative sentinel."""
    return F.when(col < 0, "N/A").otherwise(F.concat(F.format_number(col * 100, digits), F.lit("%")))


def score(col: Column, digits: int = 3) -> Column:
    """A score as it is, N/A for the negative sentinel."""
    return F.when(col < 0, "N/A").otherwise(F.format_number(col, digits))


def signed_score(col: Column, blank_zero: bool, digits: int = 3) -> Column:
    """A difference of scores; with ``blank_zero`` N/A where there is none."""
    none = col.isNull() | (F.lit(blank_zero) & (col == 0))
    return F.when(none, "N/A").otherwise(F.concat(F.when(col >= 0, "+").otherwise(""), F.format_number(col, digits)))


def signed(col: Column, digits: int = 1) -> Column:
    return F.when(col.isNull(), "N/A").otherwise(F.concat(F.when(col >= 0, "+").otherwise(""), F.format_number(col * 100, digits), F.lit("%")))
