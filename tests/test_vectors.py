import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import vectors as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_distances(spark):
    a, b = V.vector_literal([1, 2, 3]), V.vector_literal([4, 6, 3])
    assert one(spark, V.l2_squared_distance(a, b)) == 25
    assert one(spark, V.l2_distance(a, b)) == 5
    assert one(spark, V.inner_product(a, b)) == 25
    assert one(spark, V.negative_inner_product(a, b)) == -25
    assert one(spark, V.cosine_distance(a, a)) == pytest.approx(0, abs=1e-12)
    assert math.isnan(one(spark, V.cosine_distance(a, V.vector_literal([0, 0, 0]))))


def test_null_and_mismatch(spark):
    a, none = V.vector_literal([1, 2]), F.lit(None).cast("array<double>")
    assert one(spark, V.l2_distance(a, none)) is None
    with pytest.raises(Exception, match="vector dimension mismatch: 2 != 3"):
        one(spark, V.cosine_distance(a, V.vector_literal([1, 2, 3])))


@pytest.mark.parametrize(
    ("text", "problem"),
    [
        ("[1,2,3]", None), (" [ 1 , -2.5 ] ", None), ("[1e3]", None), ("[]", "vector must have at least one dimension"), ("[1,x]", "vector element 1 is not a number"), ("[1,NaN]", "vector element 1 must be a finite number"),
        ("[inf]", "vector element 0 must be a finite number"), ("1,2,3", "malformed vector literal: expected '[' at the start"), ("[1,2", "malformed vector literal: expected ']' at the end"), ("[1,,2]", "vector element 1 is not a number"), ("[1e39]", "vector element 0 must be a finite number"),
    ],
)
def test_literals(spark, text, problem):
    assert one(spark, V.literal_problem(F.lit(text))) == problem
    if problem is None:
        assert one(spark, V.parse_vector(F.lit(text)))
    else:
        assert one(spark, V.parse_vector(F.lit(text), strict=False)) is None
        with pytest.raises(Exception, match=problem.replace("[", r"\[").replace("]", r"\]")):
            one(spark, V.parse_vector(F.lit(text)))


def test_validated(spark):
    assert one(spark, V.validated(F.array(F.lit(1.5), F.lit(2)))) == [1.5, 2.0]
    with pytest.raises(Exception, match="vector has 16001 dimensions, the maximum is 16000"):
        one(spark, V.validated(F.array_repeat(F.lit(1.0), 16001)))
    with pytest.raises(Exception, match="must be a finite number"):
        one(spark, V.validated(F.array(F.lit(None).cast("float"))))


def test_format(spark):
    assert one(spark, V.format_vector(V.vector_literal([1, 0.1, -2.5, 1e10, 1e-7]))) == "[1,0.1,-2.5,10000000000,0.0000001]"


@settings(max_examples=200, deadline=None)
@given(st.floats(width=32, allow_nan=False, allow_infinity=False))
def test_shortest_float_reads_back(x):
    import struct

    text = V.shortest_float(x)
    assert "e" not in text
    assert struct.pack("<f", float(text)) == struct.pack("<f", x) or x == 0
