"""Vector and score columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
NORM_TOLERANCE = 0.01
LANES = 8


def _numbers(text: Column) -> Column:
    """Blank-separated numbers; null when one of them is not a number."""
    words = F.filter(F.split(text, " "), lambda word: word != "")
    values = F.transform(words, lambda word: word.try_cast("double"))
    return F.when(~F.exists(values, lambda v: v.isNull()), values)


def vector_parse(text: Column) -> Column:
    """``"[0.1 0.2 ...]"``, possibly over several lines, as ``array<double>``."""
    return _numbers(F.regexp_replace(text, r"[\[\]\r\n]", " "))


def score_shape_ok(text: Column) -> Column:
    """A score line is there and has exactly two blank-separated parts."""
    parts = F.filter(F.split(text, " "), lambda part: part != "")
    return F.coalesce(F.size(parts) == 2, F.lit(False))


def score_parse(text: Column) -> Column:
    """``"[contra entail]"`` as ``struct<contra,entail>``; null for a bad line."""
    parts = F.filter(F.split(text, " "), lambda part: part != "")
    contra = F.ltrim(F.get(parts, F.lit(0)), F.lit("[")).try_cast("double")
    entail = F.rtrim(F.get(parts, F.lit(1)), F.lit("]")).try_cast("double")
    ok = score_shape_ok(text) & contra.isNotNull() & entail.isNotNull()
    return F.when(ok, F.struct(contra.alias("contra"), entail.alias("entail")))


def vector_to_float(vector: Column) -> Column:
    return vector.cast("array<float>")


def l2_norm(vector: Column) -> Column:
    return F.sqrt(
        F.aggregate(vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    )


def dot_product(left: Column, right: Column) -> Column:
    """Cosine similarity of two unit vectors, summed in double precision.

    For single pairs; ``operators.similarity`` serves claims against all topics.
    """
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def has_unit_norm(vector: Column) -> Column:
    return F.abs(l2_norm(vector) - 1.0) <= NORM_TOLERANCE


def has_valid_size(vector: Column) -> Column:
    return (F.size(vector) > 0) & (F.size(vector) % LANES == 0)


def softmax2(contra_logit: Column, entail_logit: Column) -> Column:
    """Softmax of two logits as ``struct<contra,entail>``."""
    top = F.greatest(contra_logit, entail_logit)
    c, e = F.exp(contra_logit - top), F.exp(entail_logit - top)
    return F.struct((c / (c + e)).alias("contra"), (e / (c + e)).alias("entail"))
