from datetime import date, datetime, timedelta

import duckdb
import pytest

from millrace.operators import distinct as D
from millrace.operators import imports as I
from millrace.operators import sales as S
from millrace.sources import stored_imports, stored_sales
from tests import plans

NAMED = "concat('commodity ', lpad(cast(id * 2 % 50000 as string), 6, '0'))"  # even numbers only


def many_imports(spark, rows=100_000):
    return spark.range(rows).selectExpr(f"concat('c', id % 7) AS country", f"{NAMED} AS commodity", "cast(id AS double) AS value", "id AS country_id")


@pytest.mark.parametrize("dictionary", [True, False])
def test_a_lookup_skips_row_groups(spark, tmp_path, dictionary):
    path, rows = str(tmp_path / "i"), many_imports(spark)
    stored_imports.store_by_commodity(rows, path, block_bytes=200_000, dictionary=dictionary, values_of_block=5_000)
    stored = stored_imports.stored_imports(spark, path)
    assert stored.count() == 100_000 and stored.columns == ["country", "commodity", "value"]
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, rows.select("country", "commodity", "value").collect()))
    there = stored.where("commodity = 'commodity 024680'").select("country")
    assert len(there.collect()) == 4
    assert 0 < plans.scans(there)[0]["numOutputRows"] < 50_000
    between = stored.where("commodity = 'commodity 024681'").select("country")  # between the smallest and the largest of a row group, in none
    assert between.collect() == [] and plans.scans(between)[0]["numOutputRows"] == 0
    found = lambda t: sorted(r.country for r in I.countries_by_commodity(t, "commodity 024680").collect())
    assert found(stored) == found(rows)


def test_blooms_are_in_the_files(spark, tmp_path):
    """Where they aren't used, the row group around a missing commodity is read."""
    path = str(tmp_path / "i")
    stored_imports.store_by_commodity(many_imports(spark), path, block_bytes=200_000, dictionary=False, values_of_block=5_000)
    held = duckdb.sql(f"SELECT count(*), count(bloom_filter_offset) FROM parquet_metadata('{path}/*.parquet') WHERE path_in_schema = 'commodity'").fetchall()[0]
    assert held[0] == held[1] > 1
    between = spark.read.option("parquet.filter.bloom.enabled", "false").parquet(path).where("commodity = 'commodity 024681'").select("country")
    assert between.collect() == [] and plans.scans(between)[0]["numOutputRows"] > 0


def test_odd_imports_are_stored(spark, tmp_path):
    odd = [("A", None, 1.0), (None, "x", None), ("A", "", 2.0), ("A", "x" * 100_000, 3.0), ("A", "x", 4.0), ("A", "x", 4.0)]
    rows = spark.createDataFrame(odd, "country string, commodity string, value double")
    stored_imports.store_by_commodity(rows, str(tmp_path / "i"))
    stored = stored_imports.stored_imports(spark, str(tmp_path / "i"))
    assert sorted(map(repr, stored.collect())) == sorted(map(repr, rows.collect()))
    assert {r.country for r in I.countries_by_commodity(stored, "x").collect()} == {None, "A"} and I.countries_by_commodity(stored, "").count() == 1
    stored_imports.store_by_commodity(rows.where("false"), str(tmp_path / "none"))
    assert stored_imports.stored_imports(spark, str(tmp_path / "none")).isEmpty()


SALES = "sold_at timestamp_ntz, payment string, total double"


@pytest.fixture
def stored(spark, tmp_path):
    rows = [(datetime(2024, 1, 1) + timedelta(hours=7 * k), "Dinheiro" if k % 3 else None, float(k)) for k in range(2_000)]
    rows += [(None, "Dinheiro", 1.0), (datetime(2024, 3, 31), "", 5.0), (datetime(2024, 3, 31, 0, 0, 1), "x", 6.0)]
    sales = spark.createDataFrame(rows, SALES)
    stored_sales.store_by_month(sales, str(tmp_path / "s"))
    stored_sales.store_calendar(sales, str(tmp_path / "c"))
    return sales, stored_sales.stored_sales(spark, str(tmp_path / "s"), SALES), stored_sales.stored_calendar(spark, str(tmp_path / "c"))


def rows_of(df):
    return sorted(map(repr, df.select("sold_at", "payment", "total").collect()))


def test_dates_choose_months(stored):
    sales, kept, _ = stored
    assert rows_of(kept) == rows_of(sales)
    for payment, inclusive in (("Todas", False), ("Dinheiro", False), ("Todas", True)):
        chosen = stored_sales.sales_between(kept, date(2024, 2, 15), date(2024, 3, 31), payment, inclusive).drop("month")
        assert rows_of(chosen) == rows_of(S.filter_sales(sales, date(2024, 2, 15), date(2024, 3, 31), payment, inclusive))
        chosen.collect()
        assert plans.scans(chosen)[0]["numPartitions"] == 2


def test_a_calendar_chooses_months(stored):
    sales, kept, calendar = stored
    days = calendar.where("quarter = 2 AND weekday >= 6")
    chosen = stored_sales.sales_on(kept, days)
    found = chosen.collect()
    assert sorted((r.sold_at, r.total) for r in found) == sorted((r.sold_at, r.total) for r in sales.collect() if r.sold_at and r.sold_at.month in (4, 5, 6) and r.sold_at.isoweekday() >= 6)
    assert "dynamicpruning" in plans.text(chosen)
    read = [m for m in plans.scans(chosen) if "numPartitions" in m]
    assert [m["numPartitions"] for m in read] == [len({(r.sold_at.year, r.sold_at.month) for r in found})]
    assert kept.select("month").distinct().count() > 12
    assert stored_sales.sales_on(kept, calendar.where("year = 1900")).isEmpty()


def test_calendar(spark, stored, tmp_path):
    sales, kept, calendar = stored
    told = {r.day: r for r in calendar.collect()}
    assert len(told) == calendar.count() and min(told) == date(2024, 1, 1)
    for day, r in told.items():
        assert (r.month, r.year, r.quarter) == (day.year * 100 + day.month, day.year, (day.month + 2) // 3) and (r.week_year, r.week, r.weekday) == tuple(day.isocalendar())
    assert rows_of(stored_sales.sales_on(kept, calendar)) == rows_of(sales.where("sold_at IS NOT NULL"))
    stored_sales.store_calendar(sales.where("sold_at IS NULL"), str(tmp_path / "none"))
    assert stored_sales.stored_calendar(spark, str(tmp_path / "none")).isEmpty()
    wide = spark.createDataFrame([(datetime(1, 1, 1), "", 0.0), (datetime(9999, 1, 1), "", 0.0)], SALES)
    with pytest.raises(Exception, match="too many days"):
        stored_sales.store_calendar(wide, str(tmp_path / "wide"))


def test_counts_by_bitmaps(spark):
    rows = many_imports(spark).unionByName(spark.createDataFrame([("c0", None, 1.0, 0), (None, "x", 1.0, 0), (None, "x", 1.0, 0)], "country string, commodity string, value double, country_id long"))
    numbers = D.commodity_numbers(rows)
    held = numbers.orderBy("number").collect()
    assert [r.commodity for r in held] == sorted({r.commodity for r in held}, key=lambda c: (c is not None, c)) and held[0].number == 1
    bitmaps = D.commodity_bitmaps(rows, numbers)
    exact = {}
    for r in rows.select("country", "commodity").distinct().collect():
        exact.setdefault(r.country, set()).add(r.commodity)
    counts = D.commodity_counts(bitmaps)
    assert {r.country: r.n_commodities for r in counts.collect()} == {c: len(x) for c, x in exact.items()}
    assert "collect_list" not in plans.text(counts)
    halves = D.merged_bitmaps(bitmaps.selectExpr("country IN ('c0', 'c1', 'c2') AS first", "block", "bits"), ["first"])
    merged = {r["first"]: r.n_commodities for r in D.commodity_counts(halves, ["first"]).collect()}
    assert merged[True] == len(exact["c0"] | exact["c1"] | exact["c2"]) and merged[None] == 1
    none = rows.where("false")
    assert D.commodity_counts(D.commodity_bitmaps(none, D.commodity_numbers(none))).isEmpty()
    with pytest.raises(Exception, match="without a number"):
        D.commodity_counts(D.commodity_bitmaps(rows, numbers.where("commodity != 'x'"))).collect()
