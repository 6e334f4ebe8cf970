from datetime import date, datetime

import pytest

from millrace.operators import sales as S

ROWS = [
    (datetime(2024, 3, 5, 0, 0), "Dinheiro", 10.0),
    (datetime(2024, 3, 5, 9, 0), "", 1.0),
    (datetime(2025, 3, 6), "Valor a Pagar", 2.0),
    (datetime(2024, 12, 30), "Valor a pagar R$:", 4.0),
    (datetime(2025, 1, 1), None, 8.0),
    (datetime(2025, 11, 21, 0, 0, 0), "Dinheiro", None),
    (datetime(2025, 11, 21, 0, 0, 1), "Dinheiro", 16.0),
    (None, "Dinheiro", 32.0),
]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(ROWS, "sold_at timestamp_ntz, payment string, total double")


def test_range_ends_at_midnight(rows):
    kept = S.filter_sales(rows, S.DEFAULT_START, S.DEFAULT_END)
    assert kept.count() == 6 and S.filter_sales(rows, S.DEFAULT_START, S.DEFAULT_END, inclusive_end_day=True).count() == 7
    assert S.filter_sales(rows, S.DEFAULT_START, S.DEFAULT_END, "Dinheiro").count() == 2


def test_range_reaches_the_scan(spark, rows, tmp_path):
    rows.write.parquet(str(tmp_path / "s"))
    plan = S.filter_sales(spark.read.parquet(str(tmp_path / "s")), date(2024, 1, 1), date(2024, 2, 1), "Dinheiro")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(sold_at" in plan


def test_clean(rows):
    payments = [r.payment for r in S.clean_sales(rows).collect()]
    assert sorted(map(str, payments)) == sorted(["Dinheiro", "Não Especificado", "None", "Dinheiro", "Dinheiro", "Dinheiro"])
    with pytest.raises(ValueError):
        S.clean_sales(rows.drop("payment"))


def test_sums(rows):
    clean = S.clean_sales(rows)
    by = lambda name, **o: {r[0]: r[1] for r in S.sales_by(clean, name, **o).collect()}
    assert by("month") == {None: 32.0, 1: 8.0, 3: 10.0, 11: 16.0, 12: 4.0}
    assert by("week")[1] == 12.0  # 2024-12-30 and 2025-01-01 are in week 1
    assert by("week", with_year=True)[202501] == 12.0 and by("month", with_year=True)[202403] == 10.0
    assert by("day")[date(2025, 11, 21)] == 16.0
    assert by("payment") == {"Dinheiro": 58.0, "Não Especificado": 4.0}
    with pytest.raises(ValueError):
        S.sales_by(clean, "year")


def test_metrics(spark, rows):
    assert tuple(S.sales_metrics(rows).first()) == (73.0, 8, 73.0 / 8)
    assert tuple(S.sales_metrics(rows.where("false")).first()) == (0.0, 0, 0.0)
    nulls = spark.createDataFrame([(datetime(2024, 1, 1), "x", None)], rows.schema)
    assert S.sales_by(nulls, "day").first().total == 0.0
    assert S.metric_tiles(S.sales_metrics(rows)).first().total == "R$ 73.00"


def test_report(rows):
    report = S.sales_report(rows)
    assert set(report) == {"metrics", *S.GRAINS} and report["metrics"].first().n == 6
