"""Exactly rounded sums of doubles that don't depend on the order of rows or on partitions.

A double is cut into three signed digits of ``WIDTH`` bits by its exponent, without loss. Digits are added as 64-bit integers for each exponent bin, which combines on the map
side like any other sum; a group has few bins (82 at most, whatever its number of rows). Only when all rows are in, a group's bins are carried into one
number, which is rounded once, half to even. A sum beyond the largest double is infinite; a bin that gets more than about 10^11 rows fails loudly instead of overflowing.

Decimals are added as decimals. NaN and infinities add up as they do among doubles. A group without a value has a null sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 26
#: Columns of partial sums: the exponent bin, three digit sums from the highest down, and the sum of values that aren't finite.
BIN, DIGITS, ODD = "_bin", ("_s0", "_s1", "_s2"), "_odd"



def carried(a: str, b: str, c: str, d: str, below: list[str], zeros: str = "0", top: str = "t.place", rest: str = "t.rest") -> str:
    """The state after a digit: the four highest digits from the first that isn't 0 down, and whether anything that is ``below`` them isn't 0."""
    rest = " OR ".join([rest, *(f"t.{x} <> 0" for x in below)])
    return (
        f"named_struct('carry', shiftright(t.carry + v, {WIDTH}), 'a', {a}, 'b', {b}, 'c', {c}, 'd', {d}, 'rest', {rest}, "
        f"'zeros', {zeros}, 'top', {top}, 'place', t.place + 1)"
    )


#: Carries the signed digit sums ``_dense``, times ``_sign``, from the lowest bin up. Zeros wait, as a higher digit may follow.
NUMBER = f"""
aggregate(
  transform(_dense, v -> v * _sign),
  named_struct('carry', 0L, 'a', 0L, 'b', 0L, 'c', 0L, 'd', 0L, 'rest', false, 'zeros', 0, 'top', 0, 'place', 0),
  (t, v) -> aggregate(array((t.carry + v) & {(1 << WIDTH) - 1}), t, (same, x) -> CASE
    WHEN x = 0 THEN {carried('t.a', 't.b', 't.c', 't.d', [], zeros='t.zeros + 1', top='t.top')}
    WHEN t.zeros = 0 THEN {carried('x', 't.a', 't.b', 't.c', ['d'])}
    WHEN t.zeros = 1 THEN {carried('x', '0L', 't.a', 't.b', ['c', 'd'])}
    WHEN t.zeros = 2 THEN {carried('x', '0L', '0L', 't.a', ['b', 'c', 'd'])}
    ELSE {carried('x', '0L', '0L', '0L', ['a', 'b', 'c', 'd'])}
  END)
)"""
#: Four digits and a last bit for what lies below them: more than a double holds, so that the cast rounds right.
WHOLE = f"(((cast(_n.a as decimal(38,0)) * {1 << WIDTH} + _n.b) * {1 << WIDTH} + _n.c) * {1 << WIDTH} + _n.d) * 2 + if(_n.rest, 1, 0)"


def of_decimals(rows: DataFrame, value: str) -> bool:
    return dict(rows.dtypes)[value].startswith("decimal")


def with_digits(rows: DataFrame, value: str) -> DataFrame:
    """``rows`` with the digits of a column of numbers: value = (s0 + s1 / 2**26 + s2 / 2**52) * 2**(26 * bin)."""
    x, whole = F.col("_x"), float(1 << WIDTH)
    held = rows.withColumn("_x", F.col(value).cast("double"))
    finite = ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    held = held.withColumn(ODD, F.when(~finite, x)).withColumn("_x", F.when(finite, x))
    held = held.withColumn(BIN, F.coalesce(F.floor(F.log2(F.abs(x)) / WIDTH), F.lit(0)).cast("int"))  # a logarithm may be off beside a power of two
    held = held.withColumn("_p", F.pow(F.lit(2.0), F.col(BIN) * (-WIDTH // 2))).withColumn("_y", x * F.col("_p") * F.col("_p"))
    low = (F.abs("_y") < 1) & (F.col("_y") != 0)
    held = held.withColumn(BIN, F.col(BIN) - F.when(low, 1).otherwise(0)).withColumn("_y", F.when(low, F.col("_y") * whole).otherwise(F.col("_y")))
    held = held.withColumn("_s0", F.col("_y").cast("long")).withColumn("_y", (F.col("_y") - F.col("_s0")) * whole)
    held = held.withColumn("_s1", F.col("_y").cast("long")).withColumn("_s2", ((F.col("_y") - F.col("_s1")) * whole).cast("long"))
    return held.drop("_x", "_p", "_y")


def added_digits() -> list[Column]:
    return [F.sum(c).alias(c) for c in (*DIGITS, ODD)]


def totals(rows: DataFrame, keys: list[str], value: str, name: str = "total", counts: dict[str, Column] | None = None) -> DataFrame:
    """keys and the exactly rounded sum of ``value``; ``counts`` names further aggregates that may be added up over parts of a group."""
    counts = counts or {}
    if of_decimals(rows, value):
        return rows.groupBy(*keys).agg(F.sum(value).cast("double").alias(name), *(c.alias(n) for n, c in counts.items()))
    parts = with_digits(rows, value).groupBy(*keys, BIN).agg(*added_digits(), *(c.alias(n) for n, c in counts.items()))
    return from_bins(parts, keys, name, {n: F.sum(n) for n in counts})


def from_bins(parts: DataFrame, keys: list[str], name: str, others: dict[str, Column]) -> DataFrame:
    """keys, the rounded sum and ``others`` of partial sums with one row for each key and bin. The carrying is done once a group."""
    digit = lambda k, b: F.when(k == b[BIN], b[DIGITS[0]]).when(k == b[BIN] - 1, b[DIGITS[1]]).when(k == b[BIN] - 2, b[DIGITS[2]]).otherwise(F.lit(0).cast("long"))
    found = parts.groupBy(*keys).agg(F.collect_list(F.struct(BIN, *DIGITS)).alias("_bins"), F.sum(ODD).alias("_odds"), *(c.alias(n) for n, c in others.items()))
    found = found.withColumn("_known", F.filter("_bins", lambda b: b[DIGITS[0]].isNotNull()))
    found = found.withColumn("_lowest", F.array_min(F.transform("_known", lambda b: b[BIN])) - 2).withColumn("_highest", F.array_max(F.transform("_known", lambda b: b[BIN])) + 3)
    dense = F.transform(F.sequence("_lowest", "_highest"), lambda k: F.aggregate("_known", F.lit(0).cast("long"), lambda total, b: total + digit(k, b)))
    found = found.withColumn("_dense", dense).withColumn("_sign", F.expr(f"if(aggregate(_dense, 0L, (c, v) -> shiftright(c + v, {WIDTH})) < 0, -1L, 1L)"))
    found = found.withColumn("_n", F.expr(NUMBER)).withColumn("_power", F.expr(f"({WIDTH} * (_lowest + _n.top - 3) - 1) / 2D"))  # half of it twice, as a power may leave the range
    total = F.expr(f"_sign * cast({WHOLE} as double) * pow(2D, floor(_power)) * pow(2D, ceil(_power))")
    return found.select(*keys, F.when(F.col("_odds").isNotNull(), F.col("_odds")).when(F.size("_known") > 0, total).alias(name), *others)
