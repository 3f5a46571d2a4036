"""Exact sums against fractions: on plain limbs, in windows, blocks and in state."""

import math
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import day
from tidemark.operators.exact_sums import USUAL, ExactSum, Grid, grid_of, grids, limb_names, rounded, with_limbs, with_totals
from tidemark.operators.running import entity_features

ORDINARY = [k / n for n in (3, 7, 49, 137) for k in (1, 2, 5)]
MIXED = [*ORDINARY, 1e-19, 1e25, -1e25, 5e-324, 2.0**-40, -0.0, 123456.789, -1 / 3]
HUGE = [1.7e308, -1.7e308, 1e-300, 5e-324, 1.0]


def nearest(values):
    """The double nearest to the sum."""
    total = sum(map(Fraction, values), Fraction(0))
    return total.numerator / total.denominator


@settings(max_examples=300, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=64, max_value=1e300, min_value=-1e300), max_size=12), st.integers(0, 11))
def test_state_sums(values, cut):
    one = ExactSum()
    for x in values[:cut]:
        one.add(x)
    one = ExactSum.of_text(one.text())
    for x in values[cut:]:
        one.add(x)
    assert one.value() == nearest(values)


def test_infinite_values_in_state():
    total = ExactSum()
    total.add(math.inf)
    assert total.value() == math.inf
    total.add(-math.inf)
    assert math.isnan(ExactSum.of_text(total.text()).value())


def test_grids_cover_every_bit():
    for values in (ORDINARY, MIXED, HUGE, [5e-324], [1.7e308], [0.5], [3.0, 4.0]):
        sizes = [abs(v) for v in values if v]
        grid = grid_of(max(sizes), min(sizes))
        assert all(Fraction(v) % Fraction(2) ** grid.low == 0 for v in values)
        assert max(map(Fraction, sizes)) < Fraction(2) ** (grid.low + 26 * grid.limbs)
    assert grid_of(None, None) == grid_of(0.0, None) == grid_of(1.0, 1 / 137) == USUAL


@pytest.mark.parametrize("values", [ORDINARY * 40, MIXED * 10, HUGE, [0.1] * 1000, [5e-324, 5e-324], [1e25, 1.0, -1e25], [2.0**60, 1.0, 2.0**-16]])
def test_limbs_add_up_and_round_once(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(3)
    grid = grids(df, ["x"])["x"]
    parts = with_limbs(df, {"s": ("x", grid)}).select(*limb_names("s", grid))
    summed = parts.agg(*[F.sum(c).alias(c) for c in parts.columns])
    assert with_totals(summed, {"out": ("s", grid)}).first().out == nearest(values)
    row = summed.first()
    assert rounded(row, grid.low) == nearest(values)


def test_rounding_of_three_limbs(spark):
    """Ties, values next to ties, both signs, all sizes of the upper limb."""
    rows = []
    for h in (0, 1, 2, 3, 511, 2046, 2047, 2048, 4095, 2**20 + 1, 2**25, 2**33 + 7, 2**35):
        for tail in (0, 1, 2**7, 2**8, 2**9, 2**10, 2**26, 2**51, 2**52 - 1):
            for near in (-1, 0, 1):
                for sign in (1, -1):
                    whole = sign * (h * 2**52 + tail + near)
                    rows.append((whole & (2**26 - 1), (whole >> 26) & (2**26 - 1), whole >> 52))
    df = spark.createDataFrame(rows, "s_0 long, s_1 long, s_2 long")
    made = with_totals(df.withColumn("kept", F.array("s_0", "s_1", "s_2")), {"out": ("s", Grid(-30, 3))})
    for r in made.collect():
        assert r.out == rounded(r.kept, -30)
    # Limbs as sums leave them: large and of mixed signs.
    loose = [((-1) ** i * (2**58 + i * 12345678901), (-1) ** (i // 2) * (2**57 - i * 987654321), i * 2**40 - 2**44) for i in range(200)]
    df = spark.createDataFrame(loose, "s_0 long, s_1 long, s_2 long")
    for r in with_totals(df.withColumn("kept", F.array("s_0", "s_1", "s_2")), {"out": ("s", Grid(-60, 3))}).collect():
        assert r.out == rounded(r.kept, -60)


def rows_of(spark, values):
    return spark.createDataFrame(
        [(i, 1, day("2020-01-01"), x, "nofake") for i, x in enumerate(values)],
        "review_id long, user_id long, ts timestamp_ntz, x double, label string",
    )


def plain(values):
    """Means and flags, row by row."""
    seen, made = [], []
    for n, x in enumerate(values, 1):
        if x is None or math.isnan(x):
            made.append((None, True))
            continue
        seen.append(x)
        if any(map(math.isinf, seen)):
            mean = sum(v for v in seen if math.isinf(v)) / n
        else:
            mean = nearest(seen) / n
        made.append((mean, not mean > x))
    return made


@pytest.mark.parametrize("hot_rows", [10**9, 5])
@pytest.mark.parametrize(
    "values",
    [
        [1 / 137, 1 / 137, 2 / 137, 1e-19, 0.1, 0.1, None, 0.1, float("nan"), 3.0],
        [1e25, 1e-19, 1 / 137, -1e25, 1.0, 1e25],
        [1.0, math.inf, 2.0, None, math.inf, -math.inf, 1.0, math.inf],
        [None, float("nan"), 0.0, -0.0, 5e-324, 1.7e308],
    ],
)
def test_means_and_flags(spark, values, hot_rows):
    made = entity_features(rows_of(spark, values), ["user_id"], "user", ["x"], hot_rows=hot_rows).orderBy("review_id").collect()
    got = [(r.x_avg_user, r.x_higher_user) for r in made]
    assert list(map(str, got)) == list(map(str, plain(values)))


def test_first_row_of_a_user_is_never_below_its_mean(spark):
    shares = [(i, i, day("2020-01-01"), k / n, "nofake") for i, (n, k) in enumerate((n, k) for n in range(1, 156) for k in range(1, n + 1, 3))]
    df = spark.createDataFrame(shares, "review_id long, user_id long, ts timestamp_ntz, x double, label string")
    made = entity_features(df, ["user_id"], "user", ["x"])
    assert made.where("x_avg_user != x or not x_higher_user").count() == 0
