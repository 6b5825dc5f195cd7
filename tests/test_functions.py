"""Fixed values of vector functions."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from nearfield.functions import naming
from nearfield.functions import vectors as V

ARRAYS = "a array<double>, b array<double>"


def one(spark, column, row=((0.0,), (0.0,)), kind=ARRAYS):
    return spark.createDataFrame([row], kind).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("a", "b", "want"), [([1.0, 2.0, 3.0, 4.0], [1.0] * 4, math.sqrt(14)), ([-1.0, -2.0, -3.0], [1.0, 2.0, 3.0], math.sqrt(56)), ([0.0], [3.0], 3.0), ([1.0], [1.0, 2.0], None)])
@pytest.mark.parametrize("unrolled", [True, False])
def test_l2(spark, a, b, want, unrolled):
    got = one(spark, V.l2(F.col("a"), F.col("b"), len(a) if unrolled else None), (a, b))
    assert got is None if want is None else abs(got - want) < 1e-12


def test_bounds(spark):
    def of(*vectors):
        return tuple(V.bounds(spark.createDataFrame([(list(v),) for v in vectors], "embedding array<double>")).first())

    assert [round(x, 6) for x in of([0.0, 1.0, 2.0], [-1.0, 3.0])] == [-1.004, 3.004]
    assert [round(x, 6) for x in of([1.0, float("nan")])] == [0.999, 1.001]
    assert of([float("inf")]) == of([float("nan")]) == of([]) == (None, None)


@pytest.mark.parametrize(
    ("lo", "hi", "values", "want"),
    [
        (0.0, 10.0, [0.0, 5.0, 10.0, 20.0, 2.5], [0, 127, 255, 255, 63]),
        (-10.0, 10.0, [-10.0, 0.0, 10.0, float("nan")], [0, 127, 255, 0]),
        (1.0, 1.0, [0.0, 9.0], [0, 0]),
        (0.0, 1e-9, [1.0], [0]),
        (0.0, float("inf"), [1.0], [0]),
    ],
)
def test_quantise(spark, lo, hi, values, want):
    assert one(spark, V.quantise(F.col("a"), F.lit(lo), F.lit(hi)), (values, [])) == want


def test_centre_and_padding(spark):
    assert one(spark, V.centre(F.array(F.lit(0), F.lit(128), F.lit(255)))) == [-128, 0, 127]
    assert V.padding(1) == 31 * 16384 and V.padding(33) == 31 * 16384 and V.padding(64) == 0
    assert one(spark, V.routing_distance(F.lit(5), F.lit(0), F.lit(9))) == 1.0


def test_probes(spark):
    assert [V.default_probes(k) for k in (1, 3, 10, 25, 100)] == [50, 60, 200, 500, 500]


def test_names():
    assert naming.namespace("a b/c.d-e_f") == "a_b_c.d-e_f" and naming.namespace("//").startswith("ns_")
    assert naming.fnv1a(b"") == 0xCBF29CE484222325 and naming.fnv1a(b"a") == 0xAF63DC4C8601EC8C
