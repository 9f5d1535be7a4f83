"""Functions over arrays and maps: vectors, token ids, pixels, metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metadata keys that tell who a patient is.
PRIVATE_TAGS = (
    "PatientName PatientID PatientBirthDate PatientSex PatientAge InstitutionName ReferringPhysicianName StudyDate AccessionNumber"
).split()


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def token_probabilities(logits: Column, ids: Column) -> Column:
    """The softmax probability of each chosen token: ``logits`` has an array over the vocabulary for each."""

    def chosen(row: Column, i: Column) -> Column:
        top = F.array_max(row)
        return F.exp(F.get(row, i) - top) / F.aggregate(row, F.lit(0.0), lambda s, x: s + F.exp(x - top))

    return F.zip_with(logits, ids, chosen)


def mean_probability(probabilities: Column, fallback: float = 0.5) -> Column:
    """Mean token probability, ``fallback`` where there is none."""
    total = F.aggregate(probabilities, F.lit(0.0), lambda s, x: s + F.coalesce(x.cast("double"), F.lit(0.0)))
    return F.coalesce(F.try_divide(total, F.size(probabilities)), F.lit(fallback))


def answer_start(ids: Column, marker: Column) -> Column:
    """Position behind the last occurrence of ``marker``; 0 if it doesn't occur."""
    n, m = F.size(ids), F.size(marker)
    at = F.filter(F.sequence(F.lit(0), F.greatest(n - m, F.lit(0))), lambda i: F.slice(ids, i + 1, m) == marker)
    return F.when((m > 0) & (F.size(at) > 0), F.array_max(at) + m).otherwise(0)


def masked_labels(ids: Column, start: Column, pad: int, ignore: int = -100) -> Column:
    """Token ids as labels; prompt and padding are ignored."""
    return F.transform(ids, lambda x, i: F.when((i < start) | (x == pad), F.lit(ignore)).otherwise(x))


def window_pixels(pixels: Column, center: Column, width: Column) -> Column:
    """Pixels clipped to a window and scaled to 0..255, cut to whole numbers. Without a window
    the extremes of the array stand in; a window of no width gives zeros."""
    low = F.coalesce(center - width / 2, F.array_min(pixels))
    high = F.coalesce(center + width / 2, F.array_max(pixels))
    span = high - low

    def scale(x: Column) -> Column:
        return F.floor((F.least(F.greatest(x, low), high) - low) / span * 255).cast("int")

    return F.transform(pixels, lambda x: F.when(span > 0, scale(x)).otherwise(0))


def without_private(tags: Column) -> Column:
    return F.map_filter(tags, lambda k, v: ~k.isin(*PRIVATE_TAGS))


def fitted_size(width: Column, height: Column, most: int = 4096) -> Column:
    """Image size after shrinking the longer side to at most ``most``."""
    scale = F.lit(float(most)) / F.greatest(width, height)
    fits = F.greatest(width, height) <= most
    size = lambda x: F.when(fits, x).otherwise(F.floor(x * scale)).cast("int")
    return F.struct(size(width).alias("width"), size(height).alias("height"))


def platt(confidence: Column, a: float, b: float) -> Column:
    """Sigmoid of a * confidence + b, kept within 0.01..0.99."""
    p = 1.0 / (1.0 + F.exp(-(F.lit(float(a)) * confidence + F.lit(float(b)))))
    return F.greatest(F.lit(0.01), F.least(F.lit(0.99), p))


def isotonic(confidence: Column, xs: list[float], ys: list[float]) -> Column:
    """Linear interpolation between knots, flat outside, kept within 0.01..0.99; the plain
    confidence where nothing was fitted."""
    if not xs:
        return confidence
    out = F.when(confidence <= xs[0], F.lit(float(ys[0])))
    for x0, x1, y0, y1 in zip(xs, xs[1:], ys, ys[1:]):
        out = out.when(confidence <= x1, F.lit(float(y0)) + (confidence - x0) * F.lit((y1 - y0) / (x1 - x0) if x1 > x0 else 0.0))
    out = out.when(confidence.isNotNull(), F.lit(float(ys[-1])))
    return F.greatest(F.lit(0.01), F.least(F.lit(0.99), out))


def training_numbers(n: Column, batch: Column, train_loss: Column, eval_loss: Column) -> Column:
    """Steps of an epoch, perplexity (null without a loss), and whether the evaluation loss is
    over one and a half times the training loss."""
    return F.struct(
        F.ceil(n / batch).alias("steps"), F.exp(eval_loss).alias("perplexity"), F.coalesce(eval_loss > 1.5 * train_loss, F.lit(False)).alias("overfit")
    )


# Prefixes of parameter names and what stands for them today; the first that fits counts.
RENAMED = (
    ("model.vision_tower.vision_tower.", "model.vision_tower."),
    ("model.mm_projector.0.", "model.multi_modal_projector.linear_1."),
    ("model.mm_projector.2.", "model.multi_modal_projector.linear_2."),
    ("model.layers.", "model.language_model.layers."),
    ("model.embed_tokens.", "model.language_model.embed_tokens."),
    ("model.norm.", "model.language_model.norm."),
)


def renamed_key(key: Column) -> Column:
    out = key
    for old, new in reversed(RENAMED):
        out = F.when(key.startswith(old), F.concat(F.lit(new), F.substr(key, F.lit(len(old) + 1)))).otherwise(out)
    return out
