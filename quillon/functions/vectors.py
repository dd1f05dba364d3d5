"""Vector columns: distances, literals, validation, casts.

A vector is ``array<float>`` (``array<double>`` works too). Distances are computed in double from built-in higher-order functions,
so they stay in the JVM and below any filter. A null argument gives null; unequal dimensions raise.
"""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DIMENSIONS = 16_000


class Metric(Enum):
    """Smaller is nearer for each. Codes as stored in index manifests."""

    L2 = 0
    COSINE = 1
    INNER_PRODUCT = 2


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def vector_literal(values) -> Column:
    """A constant vector of doubles, so the plan needs no join."""
    return F.array(*[F.lit(float(v)) for v in values])


def _guarded(a: Column, b: Column, value: Column) -> Column:
    message = F.concat(F.lit("vector dimension mismatch: "), F.size(a).cast("string"), F.lit(" != "), F.size(b).cast("string"))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(F.size(a) != F.size(b), F.raise_error(message).cast("double")).otherwise(value)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_squared_distance(a, b) -> Column:
    a, b = _col(a), _col(b)
    return _guarded(a, b, _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def l2_distance(a, b) -> Column:
    return F.sqrt(l2_squared_distance(a, b))


def inner_product(a, b) -> Column:
    a, b = _col(a), _col(b)
    return _guarded(a, b, _dot(a, b))


def negative_inner_product(a, b) -> Column:
    return -inner_product(a, b)


def cosine_distance(a, b) -> Column:
    """1 - cosine; NaN where a vector has no length, which sorts last."""
    a, b = _col(a), _col(b)
    norms = F.sqrt(_dot(a, a) * _dot(b, b))
    value = F.when(norms == 0, F.lit(float("nan"))).otherwise(F.lit(1.0) - _dot(a, b) / F.when(norms == 0, F.lit(1.0)).otherwise(norms))
    return _guarded(a, b, value)


#: What orders the rows: the L2 metric ranks by the square, and shows the root after the limit only.
RANKING = {Metric.L2: l2_squared_distance, Metric.COSINE: cosine_distance, Metric.INNER_PRODUCT: negative_inner_product}
#: What is shown.
DISTANCE = {Metric.L2: l2_distance, Metric.COSINE: cosine_distance, Metric.INNER_PRODUCT: negative_inner_product}


@dataclass(frozen=True)
class OwnMetric:
    """A distance of one's own, for the exact searches that are expressions (one query, per group)."""

    name: str


def register_metric(name: str, distance) -> OwnMetric:
    """Make a function of two vector columns a metric; smaller is nearer. The guards for nulls and dimensions are added."""
    metric = OwnMetric(name)

    def guarded(a, b):
        return _guarded(_col(a), _col(b), distance(_col(a), _col(b)))

    RANKING[metric] = DISTANCE[metric] = guarded
    return metric


def shown(metric: Metric, ranked: Column) -> Column:
    """The distance from what ranks it."""
    return F.sqrt(ranked) if metric is Metric.L2 else ranked


class VectorError(ValueError):
    """A vector or its literal is refused."""


def _finite(x: Column) -> Column:
    return ~(F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))


def vector_problem(vector) -> Column:
    """Null for a valid vector, else the error's text. Null vectors have no problem."""
    v = _col(vector)
    positions = F.filter(F.transform(v, lambda x, i: F.when(x.isNull() | ~_finite(x), i)), lambda i: i.isNotNull())
    return (
        F.when(v.isNull(), F.lit(None).cast("string"))
        .when(F.size(v) == 0, F.lit("vector must have at least one dimension"))
        .when(F.size(v) > MAX_DIMENSIONS, F.concat(F.lit("vector has "), F.size(v).cast("string"), F.lit(f" dimensions, the maximum is {MAX_DIMENSIONS}")))
        .when(F.size(positions) > 0, F.concat(F.lit("vector element "), F.get(positions, F.lit(0)).cast("string"), F.lit(" must be a finite number")))
    )


def validated(vector) -> Column:
    """The vector as ``array<float>``; raises where it is not valid. This is the cast from an array."""
    v = _col(vector).cast("array<float>")
    problem = vector_problem(v)
    return F.when(problem.isNotNull(), F.raise_error(problem).cast("array<float>")).otherwise(v)


def to_array(vector) -> Column:
    """The explicit cast back: the same values."""
    return _col(vector).cast("array<float>")


def literal_problem(text) -> Column:
    """Null for a good literal such as ``[1, 2.5]``, else the error's text, tests in a fixed order."""
    t = F.trim(F.regexp_replace(_col(text), r"^\s+|\s+$", ""))
    body = F.regexp_replace(F.substring(t, F.lit(2), F.greatest(F.length(t) - 2, F.lit(0))), r"^\s+|\s+$", "")
    fields = F.transform(F.split(body, ",", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    bad = F.filter(F.transform(fields, lambda x, i: F.when(_number(x).isNull(), i)), lambda i: i.isNotNull())
    return (
        F.when(t.isNull(), F.lit(None).cast("string"))
        .when(~t.startswith("["), F.lit("malformed vector literal: expected '[' at the start"))
        .when(~t.endswith("]") | (F.length(t) < 2), F.lit("malformed vector literal: expected ']' at the end"))
        .when(body == "", F.lit("vector must have at least one dimension"))
        .when(F.size(fields) > MAX_DIMENSIONS, F.concat(F.lit("vector has "), F.size(fields).cast("string"), F.lit(f" dimensions, the maximum is {MAX_DIMENSIONS}")))
        .when(F.size(bad) > 0, F.concat(F.lit("vector element "), F.get(bad, F.lit(0)).cast("string"), F.lit(" is not a number")))
        .otherwise(vector_problem(F.transform(fields, _number)))
    )


def _number(x: Column) -> Column:
    """A field's value, null where it is no number. Signs, exponents, inf and nan count as numbers."""
    plain = x.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    word = F.lower(F.regexp_replace(x, r"^[+-]", ""))
    return (
        F.when(plain, x.try_cast("float"))
        .when(word.isin("inf", "infinity"), F.when(x.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))).cast("float"))
        .when(word == "nan", F.lit(float("nan")).cast("float"))
    )


def parse_vector(text, strict: bool = True) -> Column:
    """A literal as ``array<float>``. Strict: raises on a bad literal; else null."""
    problem = literal_problem(text)
    t = F.regexp_replace(_col(text), r"^\s*\[|\]\s*$", "")
    value = F.transform(F.split(t, ",", -1), lambda x: _number(F.regexp_replace(x, r"^\s+|\s+$", "")))
    refused = F.raise_error(problem).cast("array<float>") if strict else F.lit(None).cast("array<float>")
    return F.when(_col(text).isNull(), F.lit(None).cast("array<float>")).when(problem.isNotNull(), refused).otherwise(value)


def shortest_float(x: float) -> str:
    """The shortest decimal that reads back as the same single-precision number, without exponent."""
    x = np.float32(x)
    if np.isnan(x):
        return "NaN"
    if np.isinf(x):
        return "inf" if x > 0 else "-inf"
    return np.format_float_positional(x, unique=True, trim="-")


def format_vector(vector) -> Column:
    """``[1,2.5]``: no spaces, shortest numbers. Java writes single-precision numbers otherwise, so this is a pandas UDF."""

    import pandas as pd

    def run(s):
        return s.map(lambda v: None if v is None else "[" + ",".join(shortest_float(float(x)) for x in v) + "]")

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}  # real types: this module postpones annotations
    return F.pandas_udf(run, "string")(_col(vector).cast("array<float>"))
