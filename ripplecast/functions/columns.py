"""Column expressions shared by the operators; all of them stay inside codegen or built-in functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DELETED = "[deleted]"


def norm_id(c: Column) -> Column:
    """Bare id: no ``comment_`` marker, no leading ``t1_`` / ``t3_``."""
    return F.regexp_replace(F.replace(c, F.lit("comment_"), F.lit("")), "^(t1_|t3_)", "")


def comment_key(c: Column) -> Column:
    return F.concat(F.lit("comment_"), norm_id(c))


def parent_comment(parent: Column, link: Column) -> Column:
    """Bare id of the parent comment, null when the parent is the submission."""
    # the common marked forms need no regular expression: joins copy this into scan filters
    bare = norm_id(parent)
    return F.when(parent.startswith("t1_"), F.substr(parent, F.lit(4))).when(
        ~parent.startswith("t3_") & (bare != norm_id(link)), bare)


def epoch_to_ts(c: Column) -> Column:
    """Epoch seconds (any type) to a UTC timestamp; null when it is no number or out of range."""
    whole = c.cast("string").try_cast("double").try_cast("bigint")
    return F.when(whole.between(-62135596800, 253402300799), F.timestamp_seconds(whole))


def safe_float(c: Column) -> Column:
    text = c.cast("string")
    first_number = F.nullif(F.regexp_extract(text, r"-?\d+\.?\d*", 0), F.lit(""))
    return F.coalesce(text.try_cast("double"), first_number.try_cast("double"), F.lit(0.0))


def safe_time_diff(later: Column, earlier: Column) -> Column:
    number = lambda c: c.cast("string").try_cast("double")
    return F.coalesce(number(later) - number(earlier), F.lit(0.0))


def text_length(c: Column) -> Column:
    return F.coalesce(F.length(c), F.lit(0)).cast("bigint")


def token_count(c: Column) -> Column:
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    return F.when(c.isNull(), 0).otherwise(F.size(words)).cast("bigint")


def preview(c: Column, length: int = 100) -> Column:
    return F.when(F.length(c) > length, F.concat(F.substring(c, 1, length), F.lit("..."))).otherwise(c)


def hash_bucket(c: Column, buckets: int | Column = 1000) -> Column:
    """The same number in every process: first 32 bits of md5."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("bigint") % buckets


def user_label(name: Column, posts: Column, ratio: Column) -> Column:
    return F.format_string("User %s (posts: %.0f, hate ratio: %.2f)", name, posts.cast("double"), ratio)


# Class names that count as harmless.
HARMLESS_CLASSES = ["normal", "neutral", "non-toxic", "non_hate", "clean"]


def toxicity(labels: Column) -> Column:
    """Share of harmful classes in ``array<struct<label,score>>``, clamped to [0, 1].

    A class whose name contains a harmless word is harmless; a class without a name is harmful.
    """
    def harmless(name: Column) -> Column:
        return F.coalesce(any_of([F.contains(F.lower(name), F.lit(h)) for h in HARMLESS_CLASSES]), F.lit(False))

    harmful = F.filter(labels, lambda l: ~harmless(l["label"]))
    total = F.aggregate(harmful, F.lit(0.0), lambda acc, l: acc + l["score"])
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))


def threshold_class(p: Column, tau: float = 0.5) -> Column:
    return F.when(p >= tau, "toxic").otherwise("non_toxic")


def ratio(num: Column, den: Column) -> Column:
    """num / den, 0 when den is 0 or null."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def sigmoid(c: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-c))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + eps)


def cosine_or_zero(a: Column, b: Column) -> Column:
    """Plain cosine; 0 when a side is missing or a zero vector."""
    length = norm(a) * norm(b)
    return F.coalesce(F.when(length > 0, dot(a, b) / length), F.lit(0.0))


def euclid_similarity(a: Column, b: Column) -> Column:
    gap = F.aggregate(
        F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2.0)),
        F.lit(0.0),
        lambda s, v: s + v,
    )
    return 1.0 / (1.0 + F.sqrt(gap))


def fit_width(v: Column, dim: int) -> Column:
    """Pad with zeros or cut to ``dim`` numbers; null becomes zeros."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return F.when(v.isNull(), zeros).otherwise(F.slice(F.concat(v.cast("array<float>"), zeros), 1, dim))


def mean_of(v: Column) -> Column:
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return F.when(F.size(v) > 0, total / F.size(v))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
