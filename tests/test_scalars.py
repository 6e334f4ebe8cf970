from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.functions import scalars as S


def apply(spark, texts, function):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(function(F.col("t"))).collect()]


@pytest.mark.parametrize(
    "text,number",
    [
        ("bad", None), ("", None), ("1,234.5", None), (" 1.5 ", 1.5), ("1e5", 1e5), ("1_000", None), ("1d", None), ("1.5f", None),
        ("nan", None), ("inf", None), ("1e999", None), (".5", 0.5), ("5.", 5.0), ("-2", -2.0), ("\u00a03\t", 3.0), (None, None), ("0", 0.0),
    ],
)
def test_strict_double(spark, text, number):
    assert apply(spark, [text], S.strict_double) == [number]


def test_strip_takes_all_unicode_space(spark):
    assert apply(spark, ["\t https://x \n", "\u00a0a b\u2003", "", None], S.strip) == ["https://x", "a b", "", None]


def test_access_key_is_first_44_digits(spark):
    texts = ["1" * 43, "2" * 44, "3" * 50, "x" + "4" * 44 + "|" + "5" * 44, "", None]
    assert apply(spark, texts, S.access_key) == [None, "2" * 44, "3" * 44, "4" * 44, None, None]


def test_emission(spark):
    texts = ["Emissão:\u00a001/02/2025 10:11:12 x", "Emissão: 31/02/2025 10:00:00", "Emissao: 01/02/2025 10:11:12", None]
    assert apply(spark, texts, S.emission_text) == ["01/02/2025 10:11:12", "31/02/2025 10:00:00", None, None]
    times = apply(spark, ["01/02/2025 10:11:12", "31/02/2025 10:00:00", "2025-01-01", None], S.day_first_timestamp)
    assert times == [datetime(2025, 2, 1, 10, 11, 12), None, None, None]


def test_comma_numbers(spark):
    assert apply(spark, ["12,50", "", None, "1.234,56", " 7 "], S.comma_double) == [12.5, None, None, None, 7.0]
    assert apply(spark, ["Qtde.:2"], lambda c: S.comma_double(c, S.QUANTITY_LABEL)) == [2.0]
    assert apply(spark, ["Vl. Unit.: 3,99"], lambda c: S.comma_double(c, S.UNIT_PRICE_LABEL)) == [3.99]
    assert apply(spark, ["1.234,56", "1.5"], lambda c: S.comma_double(c, thousands=True)) == [1234.56, 1.5]
    assert apply(spark, ["1.234,56", "", None, "2"], S.comma_failed) == [True, False, False, False]


def test_formats(spark):
    row = spark.range(1).select(S.euro_thousands(F.lit(1234567.891)), S.reais(F.lit(2.344)), S.timestamp_text(F.lit(datetime(2024, 1, 2, 3, 4, 5)))).first()
    assert list(row) == ["€1,234,567.89 mil euros", "R$ 2.34", "2024-01-02 03:04:05"]


def test_valid_utf8(spark):
    rows = spark.createDataFrame([(bytearray(b"ok"),), (bytearray(b"\xff"),), (None,)], "b binary")
    assert [r[0] for r in rows.select(S.valid_utf8(F.col("b"))).collect()] == ["ok", None, None]
