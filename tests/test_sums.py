import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import sums as S


def wanted(values):
    known = [v for v in values if v is not None]
    if not known:
        return None
    try:
        return math.fsum(known)
    except OverflowError:
        return math.inf


def total_of(spark, values, parts=3):
    return S.totals(spark.createDataFrame([(v,) for v in values], "v double").repartition(parts), [], "v").first()[0]


def test_small_large_and_cancelling_values(spark):
    total = lambda *v: total_of(spark, v)
    assert total(*[4e-9] * 1000) == math.fsum([4e-9] * 1000) and total(*[0.1] * 10) == 1.0
    assert total(1e25, 1e21, -1e25) == 1e21 and total(1e300, 1.0, -1e300, 1e-300) == 1.0
    assert total(1e17, 0.25) == 1e17 and total(1e300) == 1e300 and total(None, 0.5) == 0.5 and total(None) is None and total() is None
    assert total(1.7e308, 1.7e308) == math.inf and total(float("inf"), 1.0) == math.inf and math.isnan(total(float("nan"), 1.0))


def test_groups_in_any_order(spark):
    """Values from 1e-300 to 1e300, sums that nearly cancel, halves of the last bit and neighbours of powers of two, shuffled twice."""
    rng = random.Random(1)
    groups = [[5e-324] * 3, [5e-324, -5e-324], [0.0], [2.0**53, 1.0], [2.0**53, 1.0, 2.0**-60], [2.0**53 + 2, 1.0], [-(2.0**53), -1.0, -(2.0**-1000)]]
    for _ in range(150):
        n = rng.randrange(1, 60)
        groups.append([rng.uniform(-1, 1) * 10.0 ** rng.randrange(-300, 300) for _ in range(n)])
        groups.append([round(rng.uniform(-1e5, 1e5), 2) for _ in range(n)])
        near = [math.ldexp(rng.uniform(-1, 1), rng.randrange(-20, 20)) for _ in range(n)]
        groups.append(near + [-x for x in near] + [math.ldexp(1, rng.randrange(-60, 60)), math.ldexp(1, -53)])
    for k in range(-1074, 1024, 13):
        x = math.ldexp(1.0, k)
        groups.append([x, math.nextafter(x, 0), math.nextafter(x, math.inf)])
    rows = [(k, x) for k, v in enumerate(groups) for x in v]
    for parts in (1, 4):
        rng.shuffle(rows)
        found = {r.k: r.total for r in S.totals(spark.createDataFrame(rows, "k int, v double").repartition(parts), ["k"], "v").collect()}
        assert [found[k] for k in range(len(groups))] == [wanted(v) for v in groups]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.floats(allow_nan=False, allow_infinity=False)), max_size=40))
def test_any_finite_doubles(spark, values):
    assert total_of(spark, values, 2) == wanted(values)


def test_decimals_and_counts(spark):
    rows = spark.createDataFrame([(1, "0.10"), (1, "0.20"), (2, None)], "k int, t string").withColumn("v", F.col("t").cast("decimal(18,2)"))
    found = {r.k: (r.total, r.n) for r in S.totals(rows, ["k"], "v", counts={"n": F.count(F.lit(1))}).collect()}
    assert found == {1: (0.3, 2), 2: (None, 1)}
    doubles = rows.withColumn("v", F.col("v").cast("double"))
    found = {r.k: (r.total, r.n) for r in S.totals(doubles, ["k"], "v", counts={"n": F.count(F.lit(1))}).collect()}
    assert found == {1: (0.1 + 0.2, 2), 2: (None, 1)}


def test_a_group_gathers_bins_not_rows(spark):
    parts = S.with_digits(spark.range(5000).select(F.lit(1).alias("k"), (F.col("id") * 1e-3).alias("v")), "v").groupBy("k", S.BIN).agg(*S.added_digits())
    assert parts.count() <= 3
    assert "Python" not in S.totals(spark.range(3).withColumn("v", F.rand()), [], "v")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("value", [1.0, -1.0, 0.1, 1e-310, 1.5e308])
def test_digits_make_up_the_value(spark, value):
    from fractions import Fraction

    r = S.with_digits(spark.createDataFrame([(value,)], "v double"), "v").first()
    assert sum(Fraction(r[d]) * Fraction(2) ** (S.WIDTH * (r[S.BIN] - i)) for i, d in enumerate(S.DIGITS)) == Fraction(value)
