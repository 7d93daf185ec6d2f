"""Scalar expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def m_value(beta: Column) -> Column:
    """log2(beta / (1 - beta)); null outside the open interval from 0 to 1."""
    return F.when((beta > 0) & (beta < 1), F.log2(beta / (1 - beta)))


def sample_label(path: Column) -> Column:
    """File stem without its channel marks."""
    stem = F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)
    return F.regexp_replace(stem, "_(Grn|Red|grn|red)", "")


def body_mass_index(weight: Column, height: Column) -> Column:
    """weight / height^2; infinite for a height of zero, NaN if the weight is zero as well."""
    square = height.cast("double") * height
    zero = F.when(weight > 0, F.lit(float("inf"))).when(weight < 0, F.lit(float("-inf"))).when(weight == 0, F.lit(float("nan")))
    return F.when(square == 0, zero).otherwise(F.try_divide(weight.cast("double"), square))
