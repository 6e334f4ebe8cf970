"""The registered queries over the driver's tables.

A sale is an order, an item a line item, an import a line item with its customer's nation and its part's type, and a
message an event. What those tables lack (keys, day-first dates, bad numbers) is derived in the query.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.scalars import QUANTITY_LABEL, UNIT_PRICE_LABEL, comma_double, comma_failed, day_first_timestamp, emission_text
from millrace.operators import distinct, imports, profile, receipts, sales, sensors
from millrace.sources import stored_imports, stored_sales
from millrace.sources.folders import shared_folder
from millrace.sources.imports_csv import load_imports
from millrace.sources.packets import record_messages, recorded_messages
from millrace.streaming import stateful, stored_notes, telemetry

START, END = date(1996, 1, 1), date(1997, 12, 31)
URGENT = "1-URGENT"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def import_rows(spark: SparkSession, sf_dir: str, commodity: str = "p_type") -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    buyers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    parts = table(spark, sf_dir, "part").select("p_partkey", commodity)
    buyers = buyers.join(nations, buyers.c_nationkey == nations.n_nationkey).select("c_custkey", "n_name")
    origin = orders.join(buyers, orders.o_custkey == buyers.c_custkey).select("o_orderkey", "n_name")  # so that lines move once at most
    return (
        lines.join(parts, lines.l_partkey == parts.p_partkey)
        .join(origin, lines.l_orderkey == origin.o_orderkey)
        .select(F.col("n_name").alias("country"), F.col(commodity).alias("commodity"), F.col("l_extendedprice").cast("decimal(18,2)").alias("value"))
    )


def sale_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderkey").alias("sale"), F.col("o_orderdate").alias("sold_at"), F.col("o_orderpriority").alias("payment"), F.col("o_totalprice").alias("total")
    )


def odd_sale_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales with null, empty and special payment texts."""
    payment = (
        F.when(F.col("sale") % 11 == 0, F.lit(None).cast("string"))
        .when(F.col("sale") % 11 == 1, "")
        .when(F.col("sale") % 11 == 2, sales.AMOUNT_DUE)
        .when(F.col("sale") % 11 == 3, sales.AMOUNT_DUE_LABEL)
        .otherwise(F.col("payment"))
    )
    return sale_rows(spark, sf_dir).withColumn("payment", payment)


def in_cents(rows: DataFrame) -> DataFrame:
    """Sales with amounts of money as decimals."""
    return rows.withColumn("total", F.col("total").cast("decimal(18,2)"))


def key_of(number: str) -> Column:
    return F.lpad(F.col(number).cast("string"), 44, "0")


def registry_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    url = F.concat(F.lit("https://receipts.example/"), F.col("o_custkey").cast("string"))
    return orders.select(url.alias("url"), key_of("o_orderkey").alias("access_key"), F.col("o_orderdate").alias("read_at"))


def import_ranking_top10(spark, sf_dir):
    return imports.import_ranking(import_rows(spark, sf_dir))


def import_ranking_lines(spark, sf_dir):
    return imports.ranking_lines(imports.import_ranking(import_rows(spark, sf_dir), 5))


def country_rollup(spark, sf_dir):
    rolled = imports.country_rollup(import_rows(spark, sf_dir))
    return rolled.select("country", "total", "n_commodities", F.array_join("commodities", "|").alias("commodities"))


def first_commodities(spark, sf_dir):
    rows = import_rows(spark, sf_dir).withColumn("position", F.col("value"))
    return imports.first_seen_commodities(rows, "position").select("country", F.array_join("commodities", "|").alias("commodities"))


def country_lookup(spark, sf_dir):
    return imports.country_lookup(import_rows(spark, sf_dir), "NATION_7")


def country_lookup_missing(spark, sf_dir):
    return imports.country_lookup(import_rows(spark, sf_dir), "nation_7")


def country_commodities(spark, sf_dir):
    return imports.country_commodities(import_rows(spark, sf_dir, "p_brand"), "NATION_7")


def countries_by_commodity(spark, sf_dir):
    return imports.countries_by_commodity(import_rows(spark, sf_dir, "p_brand"), "Brand#12")


def stored_commodity_lookup(spark, sf_dir):
    """Who imports a commodity, asked of imports stored in the order of their commodities: one that is there, and one that would lie between two of them."""
    folder = shared_folder(spark, "imports")
    stored_imports.store_by_commodity(import_rows(spark, sf_dir, "p_brand"), folder)
    stored = stored_imports.stored_imports(spark, folder, "decimal(18,2)")
    told = [imports.countries_by_commodity(stored, c).select(F.lit(c).alias("asked"), "country") for c in ("Brand#12", "Brand#121")]
    return told[0].unionByName(told[1])


def country_commodity_bits(spark, sf_dir):
    rows = import_rows(spark, sf_dir)
    return distinct.commodity_bitmaps(rows, distinct.commodity_numbers(rows))


def country_commodity_counts(spark, sf_dir):
    return distinct.commodity_counts(country_commodity_bits(spark, sf_dir))


def region_commodity_counts(spark, sf_dir):
    """Distinct commodities of each region, from its countries' bitmaps."""
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    bits = country_commodity_bits(spark, sf_dir).join(places.select(F.col("n_name").alias("country"), F.col("r_name").alias("region")), "country")
    return distinct.commodity_counts(distinct.merged_bitmaps(bits, ["region"]), ["region"])


def import_value_guard(spark, sf_dir):
    text = (
        F.when(F.col("l_linenumber") == 1, "bad")
        .when(F.col("l_linenumber") == 2, "")
        .when(F.col("l_linenumber") == 3, F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("d")))
        .when(F.col("l_linenumber") == 4, F.concat(F.lit(" "), F.col("l_quantity").cast("int").cast("string"), F.lit(".5 ")))
        .when(F.col("l_linenumber") == 5, F.concat(F.lit("1,"), F.col("l_quantity").cast("int").cast("string")))
        .when(F.col("l_linenumber") == 6, "nan")
        .otherwise(F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("e1")))
    )
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("country"), F.col("l_linestatus").alias("commodity"), text.alias("value"))
    return imports.country_rollup(imports.valid_imports(rows)).select("country", "total", "n_commodities")


def import_fine_values(spark, sf_dir):
    """Values with four decimals, and some of a million billions."""
    text = F.when(F.col("l_linenumber") == 1, "1e17").otherwise(F.concat(F.lit("0.00"), F.lpad(F.col("l_quantity").cast("int").cast("string"), 2, "0")))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("country"), F.when(F.col("l_linenumber") == 1, "large").otherwise("fine").alias("commodity"), text.alias("value"))
    return imports.commodity_totals(imports.valid_imports(rows))


def import_lines_file(spark, sf_dir, odd_rows):
    """A folder of CSV files made from the line items: a quoted commodity, and odd rows. Each file has a header.

    A file holds the rows of a scan's part: its first row brings the header, so no rows are moved or sorted. One more file has the header alone.
    """
    plain = F.concat(F.lit("1,2,3,4,5,"), "l_returnflag", F.lit(',7,"'), "l_linestatus", F.lit(', ""q""",'), F.col("l_quantity").cast("int").cast("string"), F.lit(".5"))
    head = "a,b,c,d,e,country,f,commodity,amount"
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0  # in its partition
    lines = table(spark, sf_dir, "lineitem").select(odd_rows(plain).alias("value"), first.alias("first"))
    lines = lines.select(F.when(F.col("first"), F.concat(F.lit(head + "\n"), "value")).otherwise(F.col("value")).alias("value"))
    folder = shared_folder(spark, "csv")
    lines.unionByName(spark.range(1).select(F.lit(head).alias("value"))).write.text(folder)
    return folder


def import_csv_permissive(spark, sf_dir):
    """Totals of the rows of the header's length; short and over-long ones are counted as rejected."""
    odd = lambda plain: F.when(F.col("l_linenumber") == 1, F.concat(plain, F.lit(",9"))).when(F.col("l_linenumber") == 2, "1,2,3").otherwise(plain)
    rows, rejects = load_imports(spark, import_lines_file(spark, sf_dir, odd), multi_line=False)
    found = imports.country_rollup(imports.valid_imports(rows)).select("country", "total", "n_commodities")
    return found.unionByName(rejects.agg(F.lit("rejected").alias("country"), F.lit(None).cast("double").alias("total"), F.count("raw").alias("n_commodities")))


def import_csv_strict(spark, sf_dir):
    """Over-long rows are read by their own last field."""
    odd = lambda plain: F.when(F.col("l_linenumber") == 1, F.concat(plain, F.lit(",9"))).otherwise(plain)
    rows, _ = load_imports(spark, import_lines_file(spark, sf_dir, odd), mode="strict", multi_line=False)
    return imports.country_rollup(imports.valid_imports(rows)).select("country", "total", F.array_join("commodities", "|").alias("commodities"))


def import_csv_line_breaks(spark, sf_dir):
    """Commodities with a line break inside their quotes; the files are read whole."""
    broken = lambda plain: F.replace(plain, F.lit(', ""q""'), F.lit("\n\"\"q\"\""))
    rows, _ = load_imports(spark, import_lines_file(spark, sf_dir, broken))
    return imports.country_rollup(imports.valid_imports(rows)).select("country", "total", F.array_join("commodities", "|").alias("commodities"))


def country_lines(spark, sf_dir):
    return imports.country_lines(import_rows(spark, sf_dir), "NATION_7")


def country_lines_missing(spark, sf_dir):
    return imports.country_lines(import_rows(spark, sf_dir), "nation_7")


def commodity_lines(spark, sf_dir):
    rows = import_rows(spark, sf_dir, "p_brand")
    told = [imports.commodity_lines(rows, c).withColumn("asked", F.lit(c)) for c in ("Brand#12", "Brand")]
    return told[0].unionByName(told[1])


def customer_answers(spark, sf_dir):
    """Answers that customers would give, by balance and segment; one in nine gives none that counts."""
    yes = lambda c, no="n": F.when(c, "S").otherwise(no)
    buyers = table(spark, sf_dir, "customer")
    third = F.when(F.col("c_custkey") % 9 == 0, "maybe").otherwise(yes(F.col("c_mktsegment") > "FURN"))
    return buyers.select("c_custkey", yes(F.col("c_acctbal") > 5000).alias("r1"), yes(F.col("c_acctbal") < 0, "N").alias("r2"), third.alias("r3"))


def risk_profile_matrix(spark, sf_dir):
    answers = [F.col(c) for c in ("r1", "r2", "r3")]
    return customer_answers(spark, sf_dir).select("*", profile.risk_points(*answers).alias("points"), profile.risk_profile(*answers).alias("profile"))


def profile_lines(spark, sf_dir):
    return risk_profile_matrix(spark, sf_dir).select("c_custkey", profile.profile_line(F.col("profile")).alias("line"))


def profile_recommendations(spark, sf_dir):
    return profile.recommendations(spark, risk_profile_matrix(spark, sf_dir).select("c_custkey", "profile")).select("c_custkey", "profile", "place", "item")


def sales_filtered(spark, sf_dir):
    return sales.filter_sales(sale_rows(spark, sf_dir), START, END, URGENT)


def sales_filtered_all(spark, sf_dir):
    return sales.filter_sales(sale_rows(spark, sf_dir), START, END)


def sales_filtered_whole_last_day(spark, sf_dir):
    return sales.filter_sales(sale_rows(spark, sf_dir), START, END, inclusive_end_day=True)


def sales_stored_range(spark, sf_dir):
    """The sales of a range of dates, read from the months it touches."""
    rows, folder = sale_rows(spark, sf_dir), shared_folder(spark, "sales")
    stored_sales.store_by_month(rows, folder)
    return stored_sales.sales_between(stored_sales.stored_sales(spark, folder, rows.schema.toDDL()), START, END, URGENT).drop("month")


def sales_on_weekends(spark, sf_dir):
    """Sums of payments on the weekends of the last quarters, which a calendar made from the sales knows."""
    rows, folder = in_cents(sale_rows(spark, sf_dir)), shared_folder(spark, "sales")
    stored_sales.store_by_month(rows, f"{folder}/sales")
    stored_sales.store_calendar(rows, f"{folder}/calendar")
    stored, days = stored_sales.stored_sales(spark, f"{folder}/sales", rows.schema.toDDL()), stored_sales.stored_calendar(spark, f"{folder}/calendar")
    chosen = stored_sales.sales_on(stored, days.where("quarter = 4 AND weekday >= 6"))
    return sales.sales_by(chosen, "payment")


def sales_metrics(spark, sf_dir):
    return sales.sales_metrics(in_cents(sales.filter_sales(sale_rows(spark, sf_dir), START, END)))


def sales_metrics_empty(spark, sf_dir):
    return sales.sales_metrics(in_cents(sales.filter_sales(sale_rows(spark, sf_dir), START, END, "Dinheiro")))


def sales_metric_tiles(spark, sf_dir):
    return sales.metric_tiles(sales.sales_metrics(in_cents(sale_rows(spark, sf_dir))))


def sales_by_day(spark, sf_dir):
    return sales.sales_by(sales.clean_sales(in_cents(sale_rows(spark, sf_dir))), "day").withColumn("day", F.col("day").cast("string"))


def sales_by_day_of_text(spark, sf_dir):
    """The same sums where the time of sale comes as text."""
    rows = sale_rows(spark, sf_dir).withColumn("sold_at", F.date_format("sold_at", "yyyy-MM-dd HH:mm:ss"))
    return sales.sales_by(sales.clean_sales(in_cents(rows)), "day").withColumn("day", F.col("day").cast("string"))


def sales_status(spark, sf_dir):
    """A choice that holds sales and one that holds none."""
    chosen = [sales.filter_sales(sale_rows(spark, sf_dir), START, END, p) for p in (URGENT, "Dinheiro")]
    return sales.sales_status(chosen[0]).unionByName(sales.sales_status(chosen[1]))


def sales_by_week(spark, sf_dir):
    return sales.sales_by(sales.clean_sales(in_cents(sale_rows(spark, sf_dir))), "week")


def sales_by_month(spark, sf_dir):
    return sales.sales_by(sales.clean_sales(in_cents(odd_sale_rows(spark, sf_dir))), "month")


def sales_by_payment(spark, sf_dir):
    return sales.sales_by(sales.clean_sales(in_cents(odd_sale_rows(spark, sf_dir))), "payment")


def exact_country_totals(spark, sf_dir):
    """Products of doubles, summed as they are: each total is rounded once."""
    lines = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("L"), F.col("l_linenumber").cast("string")).alias("country"), F.col("l_returnflag").alias("commodity"), (F.col("l_extendedprice") * F.col("l_tax")).alias("value"))
    return imports.country_rollup(lines).select("country", "total", "n_commodities", F.array_join("commodities", "|").alias("commodities"))


def exact_commodity_totals(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("L"), F.col("l_linenumber").cast("string")).alias("country"), F.col("l_returnflag").alias("commodity"), (F.col("l_extendedprice") * F.col("l_tax")).alias("value"))
    return imports.commodity_totals(lines)


def exact_sales_by_day(spark, sf_dir):
    return sales.sales_by(sales.clean_sales(sale_rows(spark, sf_dir)), "day").withColumn("day", F.col("day").cast("string"))


def exact_sales_metrics(spark, sf_dir):
    return sales.sales_metrics(sale_rows(spark, sf_dir))


def payment_null_survives(spark, sf_dir):
    rows = odd_sale_rows(spark, sf_dir)
    count = lambda df, step: df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("payment").isNull()).alias("n_null")).select(F.lit(step).alias("step"), "n", "n_null")
    return count(rows, "before").unionByName(count(sales.clean_sales(rows), "after"))


def sales_report(spark, sf_dir):
    """The dashboard's report for its own dates and choice, over orders that are 29 years younger: a row for each number."""
    younger = in_cents(sale_rows(spark, sf_dir)).withColumn("sold_at", F.col("sold_at") + F.expr("interval 29 years"))
    report = sales.sales_report(younger)
    found = report["metrics"].select(F.lit("metrics").alias("part"), F.stack(F.lit(3), F.lit("total"), "total", F.lit("n"), F.col("n").cast("double"), F.lit("mean"), "mean").alias("key", "value"))
    for name in sales.GRAINS:
        found = found.unionByName(report[name].select(F.lit(name).alias("part"), F.col(name).cast("string").alias("key"), F.col("total").alias("value")))
    return found


def scan_rows(spark, sf_dir):
    digits = F.when(F.col("o_orderkey") % 4 == 0, F.lpad(F.col("o_orderkey").cast("string"), 43, "1")).otherwise(F.lpad(F.col("o_orderkey").cast("string"), 50, "7"))
    text = F.concat(F.lit(" \thttps://receipts.example/q?p="), digits, F.lit("|2|1 \n"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("qr_text"))


def access_key_extract(spark, sf_dir):
    return receipts.scanned(scan_rows(spark, sf_dir))


def key_scans(spark, sf_dir):
    text = F.concat(F.lit("https://receipts.example/"), F.col("o_custkey").cast("string"), F.lit("?k="), key_of("o_orderkey"))
    return receipts.scanned(table(spark, sf_dir, "orders").select(text.alias("qr_text")))


def registry_new_keys(spark, sf_dir):
    """All orders' codes are scanned; those read before 1998 are registered already."""
    return receipts.new_registrations(key_scans(spark, sf_dir), registry_rows(spark, sf_dir).where(F.col("read_at") < F.lit("1998-01-01").cast("timestamp_ntz")))


def registry_insert(spark, sf_dir):
    """What is appended to a registry that holds the keys read before 1998, with its stamp."""
    stored = registry_rows(spark, sf_dir).where(F.col("read_at") < F.lit("1998-01-01").cast("timestamp_ntz"))
    return receipts.register(key_scans(spark, sf_dir), stored, F.lit("2002-02-03 04:05:06").cast("timestamp_ntz"))


def registry_listing(spark, sf_dir):
    return receipts.registry_listing(registry_rows(spark, sf_dir))


def url_key_lookup(spark, sf_dir):
    notes = table(spark, sf_dir, "customer").select(F.concat(F.lit("https://receipts.example/"), F.col("c_custkey").cast("string")).alias("url"))
    return receipts.key_by_url(notes, registry_rows(spark, sf_dir))


def pending_notes(spark, sf_dir):
    stored = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(key_of("o_orderkey").alias("access_key"))
    return receipts.pending_notes(registry_rows(spark, sf_dir), stored)


def number_texts(spark, sf_dir):
    quantity = F.concat(F.lit(QUANTITY_LABEL), F.col("l_quantity").cast("int").cast("string"))
    price = F.concat(F.lit(UNIT_PRICE_LABEL + " "), F.replace(F.format_string("%.2f", "l_extendedprice"), F.lit("."), F.lit(",")))
    total = F.when(F.col("l_linenumber") == 1, "").when(F.col("l_linenumber") == 2, "1.234,56").otherwise(
        F.concat(F.lit(" "), F.replace(F.format_string("%.2f", "l_extendedprice"), F.lit("."), F.lit(",")), F.lit(" "))
    )
    lines = table(spark, sf_dir, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", quantity.alias("quantity"), price.alias("price"), total.alias("total"))


def locale_number_parse(spark, sf_dir):
    return number_texts(spark, sf_dir).select(
        "l_orderkey",
        "l_linenumber",
        comma_double(F.col("quantity"), QUANTITY_LABEL).alias("quantity"),
        comma_double(F.col("price"), UNIT_PRICE_LABEL).alias("price"),
        comma_double(F.col("total")).alias("total"),
        comma_failed(F.col("total")).alias("total_failed"),
        comma_double(F.col("total"), thousands=True).alias("total_grouped"),
    )


def emission_timestamp_parse(spark, sf_dir):
    day = F.when(F.col("o_orderkey") % 5 == 0, "31/02/2025 10:00:00").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy HH:mm:ss"))
    text = F.when(F.col("o_orderkey") % 7 == 0, "Série: 1").otherwise(F.concat(F.lit("Série: 1 Emissão: "), day, F.lit(" - Via")))
    found = emission_text(text)
    return table(spark, sf_dir, "orders").select("o_orderkey", found.alias("emission"), day_first_timestamp(found).alias("sold_at"))


def comma_money(amount: str) -> Column:
    """An amount with two decimals and a comma. Casts give the same digits as formats, faster; what a decimal can't hold is formatted."""
    plain = (F.col(amount) >= 0.01) & (F.col(amount) < 1e15)
    return F.replace(F.when(plain, F.col(amount).cast("decimal(18,2)").cast("string")).otherwise(F.format_string("%.2f", amount)), F.lit("."), F.lit(","))


def raw_notes(spark, sf_dir) -> DataFrame:
    """A note for each order: items of its lines in order of their fields."""
    lines = table(spark, sf_dir, "lineitem")
    item = F.struct(
        F.col("l_linenumber"),
        F.col("l_extendedprice"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("product"),
        F.concat(F.lit(QUANTITY_LABEL), F.col("l_quantity").cast("int").cast("string")).alias("quantity"),
        comma_money("l_extendedprice").alias("total"),
    )
    listed = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("items"))
    strip_order = F.transform("items", lambda i: F.struct(i.product.alias("product"), i.quantity.alias("quantity"), F.concat(F.lit(UNIT_PRICE_LABEL), i.total).alias("unit_price"), i.total.alias("total")))
    orders = table(spark, sf_dir, "orders")
    total = F.when(F.col("o_orderkey") % 5 == 0, "1.234,56").otherwise(comma_money("o_totalprice"))
    return orders.join(listed, orders.o_orderkey == listed.l_orderkey).select(
        key_of("o_orderkey").alias("access_key"),
        F.concat(F.lit("Emissão: "), F.date_format("o_orderdate", "dd/MM/yyyy HH:mm:ss")).alias("emission"),
        F.col("o_orderpriority").alias("payment"),
        total.alias("total"),
        strip_order.alias("items"),
    )


def note_status(spark, sf_dir):
    return receipts.parse_notes(raw_notes(spark, sf_dir)).select("access_key", "status", "reason")


def note_items_exploded(spark, sf_dir):
    return receipts.item_rows(receipts.parse_notes(raw_notes(spark, sf_dir)))


def note_header_upsert(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    existing = orders.select(key_of("o_orderkey").alias("access_key"), F.col("o_orderdate").alias("sold_at"), F.lit("old").alias("payment"), F.lit(1.0).alias("total"))
    return receipts.upsert_headers(existing, receipts.parse_notes(raw_notes(spark, sf_dir)))


def note_items_upsert(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    existing = orders.select(
        key_of("o_orderkey").alias("access_key"), F.lit(1).alias("line_no"), F.lit("old").alias("product"), F.lit(1.0).alias("quantity"), F.lit(1.0).alias("unit_price"), F.lit(1.0).alias("item_total")
    )
    return receipts.upsert_items(existing, receipts.parse_notes(raw_notes(spark, sf_dir)))


def note_header_items(spark, sf_dir):
    """Items beside the headers of their notes."""
    notes = receipts.parse_notes(raw_notes(spark, sf_dir))
    return receipts.notes_with_items(receipts.header_rows(notes), receipts.item_rows(notes))


def note_pages(spark, sf_dir, between=""):
    """Receipt pages made from the orders; ``between`` comes after each item."""
    notes = raw_notes(spark, sf_dir)
    row = lambda i: F.concat(
        F.lit("<tr><td><span>"), i.product, F.lit("</span><span>x</span><span>"), i.quantity, F.lit("</span><span>y</span><span>"), i.unit_price,
        F.lit("</span></td><td><span>"), i.total, F.lit("</span></td></tr>"),
    )
    page = F.concat(
        F.lit('<html><head><meta charset="utf-8"></head><body><div><div></div><div></div><div></div><div><div><div></div><div><div><table><tbody>'),
        F.array_join(F.transform("items", row), between),
        F.lit("</tbody></table><div></div><div></div><div><div></div><div><span>"), "total",
        F.lit("</span></div><div></div><div><label>"), "payment",
        F.lit("</label></div></div></div><div><div><div><ul><li>"), "emission",
        F.lit("</li></ul></div></div></div></div></div></div></div></body></html>"),
    )
    return notes.select(F.col("access_key").alias("url"), page.alias("html"))


def note_html_extract(spark, sf_dir):
    """Receipt pages read back to typed headers."""
    parsed = receipts.parse_notes(receipts.extract_notes(note_pages(spark, sf_dir)).withColumn("access_key", F.col("url")))
    return parsed.select("access_key", "sold_at", "payment", "total", "status", "reason", F.size("items").alias("n_items"))


def note_html_bodies(spark, sf_dir):
    """The items of pages whose table has a body for each of them."""
    pages = note_pages(spark, sf_dir, "</tbody><tbody>")
    return receipts.item_rows(receipts.parse_notes(receipts.extract_notes(pages).withColumn("access_key", F.col("url"))))


def message_rows(spark, sf_dir):
    payload = (
        F.when(F.col("event_id") % 10 == 0, "nope")
        .when(F.col("event_id") % 10 == 1, "")
        .when(F.col("event_id") % 10 == 2, "[1, 2]")
        .when(F.col("event_id") % 10 == 3, '{"k": 1, "received_at": "x"}')
        .otherwise(F.col("props"))
    )
    return table(spark, sf_dir, "events").select("event_id", payload.cast("binary").alias("payload"))


def telemetry_decode(spark, sf_dir):
    telemetry.allow_repeated_keys(spark)
    found = telemetry.good(telemetry.decode_telemetry(message_rows(spark, sf_dir)))
    return found.select("event_id", F.try_variant_get("doc", "$.k", "bigint").alias("k"))


def telemetry_dead_letter(spark, sf_dir):
    telemetry.allow_repeated_keys(spark)
    return telemetry.dead_letters(telemetry.decode_telemetry(message_rows(spark, sf_dir))).select("event_id", "error_kind")


def required_field_gate(spark, sf_dir):
    body = (
        F.when(F.col("event_id") % 5 == 0, '{"temperatura": 1, "umidade_ar": null, "umidade_solo": 3}')
        .when(F.col("event_id") % 5 == 1, '{"temperatura": 1}')
        .when(F.col("event_id") % 5 == 2, '{"umidade_solo": 1}')
        .when(F.col("event_id") % 5 == 3, "[]")
        .otherwise(F.col("props"))
    )
    posts = table(spark, sf_dir, "events").select("event_id", body.alias("body"))
    return telemetry.gate_required(posts).select("event_id", "status_code", "message")


def repeated_key_gate(spark, sf_dir):
    """Bodies with a repeated key are accepted, bodies with something behind the object or with bare keys aren't."""
    full = '"temperatura": 2, "umidade_ar": null, "umidade_solo": 3}'
    body = (
        F.when(F.col("event_id") % 4 == 0, '{"temperatura": 1, ' + full)
        .when(F.col("event_id") % 4 == 1, "{" + full + " x")
        .when(F.col("event_id") % 4 == 2, F.replace(F.lit("{" + full), F.lit('"'), F.lit("'")))
        .otherwise('{"umidade_ar": 1, "umidade_ar": 2, "temperatura": {"a": 1, "a": 2}}')
    )
    posts = table(spark, sf_dir, "events").select("event_id", body.alias("body"))
    return telemetry.gate_required(posts).select("event_id", "status_code", "message")


def answered_posts(spark, sf_dir):
    """What accepted posts are answered: an id made of their place, and their body with the stamp in place of the client's."""
    body = F.concat(F.lit('{"temperatura": '), F.col("event_id").cast("string"), F.lit(', "umidade_ar": null, "umidade_solo": 3, "dataRegistro": "x"}'))
    posts = table(spark, sf_dir, "events").select("event_id", body.alias("body"))
    gated = telemetry.gate_required(posts, registered_at=F.lit("2024-05-06 07:08:09").cast("timestamp"))
    return telemetry.stored_posts(gated, delivery=["event_id"]).select("event_id", "id", "dados")


def telemetry_stamp(spark, sf_dir):
    """The time of receipt beside messages that hold one of their own."""
    body = F.concat(F.lit('{"k": '), F.col("event_id").cast("string"), F.lit(', "received_at": "x"}'))
    messages = table(spark, sf_dir, "events").select("event_id", "ts", body.alias("payload"))
    found = telemetry.good(telemetry.decode_telemetry(messages, received_at=F.col("ts")))
    return found.select("event_id", telemetry.timestamp_text(F.col("received_at")).alias("received_at"), F.try_variant_get("doc", "$.received_at", "string").alias("sent"))


def packet_messages(spark, sf_dir):
    """Events recorded as publish packets of two topics; one topic read back as a batch."""
    folder = shared_folder(spark, "packets")
    topic = F.when(F.col("event_id") % 3 == 0, "sensores/agua").otherwise("sensores/ar")
    record_messages(message_rows(spark, sf_dir).withColumn("topic", topic), folder)
    telemetry.allow_repeated_keys(spark)
    found = telemetry.decode_telemetry(recorded_messages(spark, folder, "sensores/ar", streaming=False))
    return found.groupBy("topic", F.coalesce("error_kind", F.lit("good")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.try_variant_get("doc", "$.k", "bigint")).alias("k"))


def packet_stream(spark, sf_dir):
    """The same packets as a stream, whose good messages and dead letters are stored in one pass."""
    folder = shared_folder(spark, "packets")
    record_messages(message_rows(spark, sf_dir).withColumn("topic", F.lit("sensores/ar")), f"{folder}/in")
    decoded = telemetry.decode_telemetry(recorded_messages(spark, f"{folder}/in", "sensores/ar"))
    telemetry.store_stream(decoded, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    kinds = [telemetry.outcomes(spark, f"{folder}/out", o).select(F.lit(o).alias("outcome"), "error_kind") for o in ("good", "dead")]
    return kinds[0].unionByName(kinds[1]).groupBy("outcome", "error_kind").agg(F.count(F.lit(1)).alias("n"))


def stored_posts(spark, sf_dir):
    """Accepted posts as they are stored and answered, with an id that nobody else has."""
    body = F.when(F.col("event_id") % 5 == 1, '{"temperatura": 1}').otherwise('{"temperatura": 1, "umidade_ar": null, "umidade_solo": 3, "dataRegistro": "x"}')
    posts = table(spark, sf_dir, "events").select("event_id", body.alias("body"))
    stored = telemetry.stored_posts(telemetry.gate_required(posts, registered_at=F.lit("2024-05-06 07:08:09").cast("timestamp")))
    return stored.select("event_id", "message", "registered_at", (F.length("id") == 36).alias("has_id"))


def telemetry_stream_append(spark, sf_dir):
    """The events as a stream, appended until nothing is left, then read."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    decoded = telemetry.good(telemetry.decode_telemetry(stream.select("event_id", F.col("props").alias("payload"))))
    flat = decoded.select("event_id", F.try_variant_get("doc", "$.k", "bigint").alias("k"), "received_at")
    folder = shared_folder(spark, "telemetry")
    telemetry.append_stream(flat, f"{folder}/documents", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/documents").select("event_id", "k")


def frame_rows(spark, sf_dir):
    """Frames made from events: fields 1 to 14 are numbers of the event; every seventh checksum is wrong."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    words = [F.lit(sensors.PAYLOAD_BYTES)] + [((F.col("event_id") * (i + 1) + F.col("user_id")) % 65536).cast("int") for i in range(12)] + [F.lit(0)]
    head = "424D"
    body = F.concat(F.lit(head), *(F.lpad(F.hex(w), 4, "0") for w in words))
    total = F.lit(0x42 + 0x4D) + sum((F.shiftright(w, 8) + w.bitwiseAND(255) for w in words), F.lit(0))
    checksum = total + F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)
    return events.select("event_id", F.unhex(F.concat(body, F.lpad(F.hex(checksum), 4, "0"))).alias("frame"))


def pms_decode(spark, sf_dir):
    return sensors.decode_frames(frame_rows(spark, sf_dir), verify_header=True).select("event_id", *sensors.FRAME_FIELDS)


def pms_stream_frames(spark, sf_dir):
    """Frames found in raw bytes: stray bytes before each frame, the start of another one behind."""
    raw = F.concat(F.unhex(F.lit("00FF")), "frame", F.unhex(F.lit("424D001C")))
    captures = frame_rows(spark, sf_dir).select("event_id", raw.alias("data"))
    frames = captures.lateralJoin(sensors.SplitFrames(F.col("data").outer())).select("event_id", "place", "frame")
    return sensors.decode_frames(frames).select("event_id", "place", *sensors.FRAME_FIELDS)


def chunk_stream(spark, sf_dir):
    """Sensors' bytes in chunks of 20, out of order, as a stream."""
    data = F.concat(F.unhex(F.lit("00FF")), "frame")
    sensor = (F.col("event_id") % 16).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.lit(1)), lambda i: F.struct((F.col("event_id") * 2 + i).alias("at"), F.substring(data, F.when(i == 0, 1).otherwise(21), F.when(i == 0, 20).otherwise(14)).alias("data")))
    cut = frame_rows(spark, sf_dir).select(sensor.alias("sensor"), F.col("event_id").alias("event"), F.explode(pieces).alias("p")).select("sensor", (F.floor(F.col("event") / 16) * 2 + F.col("p.at") % 2).alias("seq"), "p.data")
    folder = shared_folder(spark, "chunks")
    cut.repartition(3, "seq").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(cut.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    return stream, folder


def pms_live_frames(spark, sf_dir):
    """Frames of the sensors' streams, whatever the cuts into chunks and triggers."""
    stream, folder = chunk_stream(spark, sf_dir)
    frames = stateful.frames_of_streams(stream)
    writer = frames.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    stateful.start(writer).awaitTermination()
    return sensors.decode_frames(spark.read.schema(frames.schema).parquet(f"{folder}/out")).select("sensor", *sensors.FRAME_FIELDS)


def registry_stream(spark, sf_dir):
    """Scans as a stream against the registry of before 1998: each new key is appended once."""
    registry = registry_rows(spark, sf_dir).where("read_at < timestamp_ntz'1998-01-01'")
    folder = shared_folder(spark, "registry")
    scans = key_scans(spark, sf_dir).select("url", "access_key")
    scans.unionByName(scans).repartition(2).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(scans.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    stateful.append_keys(stateful.new_keys(stream, registry), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("url", "access_key")


def note_store(spark, sf_dir):
    """Notes upserted into stored tables in two batches, the first of them twice: headers beside the number of their items."""
    notes = receipts.parse_notes(raw_notes(spark, sf_dir))
    old = notes.where(F.crc32(F.col("access_key").cast("binary")) % 2 == 0).withColumn("payment", F.lit("old"))
    folder = shared_folder(spark, "notes")
    for source, batch, rows in (("load", 0, old), ("load", 0, old), ("load", 1, notes)):
        stored_notes.upsert_notes(rows, folder, source, batch, buckets=8)
    items = stored_notes.stored(spark, folder, "items").groupBy("access_key").agg(F.count(F.lit(1)).alias("n_items"))
    return stored_notes.stored(spark, folder, "headers").join(items, "access_key")


def climate_lines(spark, sf_dir):
    """What the climate sensor shows of readings that haven't failed."""
    return sensors.reading_lines(failed_reading_guard(spark, sf_dir)).select("event_id", "line")


def sensor_lines(spark, sf_dir):
    """What the gas and the particulate sensor show."""
    events = table(spark, sf_dir, "events")
    gas = sensors.gas_lines(events.select("event_id", (F.col("event_id") % 1024).alias("raw_adc"), F.lit(76.5).alias("rzero"), F.lit(400).alias("ppm")))
    fine = sensors.particulate_lines(sensors.decode_frames(frame_rows(spark, sf_dir)))
    return gas.select("event_id", "line").unionByName(fine.select("event_id", "line"))


def failed_reading_guard(spark, sf_dir):
    nan = F.lit(float("nan"))
    readings = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_id") % 9 == 0, nan).otherwise(F.col("value")).alias("humidity"),
        F.when(F.col("event_id") % 9 == 4, nan).otherwise(F.col("value") + 1).alias("temperature"),
    )
    return sensors.drop_failed_readings(readings)


QUERIES = [
    import_ranking_top10, import_ranking_lines, country_rollup, country_lookup, country_lookup_missing, country_commodities, countries_by_commodity,
    import_value_guard, import_fine_values, import_csv_permissive, import_csv_strict, country_lines, country_lines_missing, commodity_lines,
    profile_lines, sales_by_day_of_text, sales_status, registry_insert, note_header_items, note_html_bodies, stored_posts, pms_stream_frames,
    sensor_lines, first_commodities, risk_profile_matrix, profile_recommendations, sales_filtered, sales_filtered_all,
    sales_filtered_whole_last_day, sales_metrics, sales_metrics_empty, sales_metric_tiles, sales_by_day, sales_by_week, sales_by_month,
    sales_by_payment, exact_country_totals, exact_commodity_totals, exact_sales_by_day, exact_sales_metrics, payment_null_survives, access_key_extract, registry_new_keys, registry_listing, url_key_lookup, pending_notes,
    locale_number_parse, emission_timestamp_parse, note_status, note_items_exploded, note_header_upsert, note_items_upsert, note_html_extract,
    import_csv_line_breaks, sales_report, repeated_key_gate, answered_posts, telemetry_stamp, packet_messages, packet_stream, pms_live_frames,
    stored_commodity_lookup, country_commodity_counts, region_commodity_counts, sales_stored_range, sales_on_weekends,
    registry_stream, note_store, climate_lines, telemetry_decode, telemetry_dead_letter, required_field_gate, telemetry_stream_append, pms_decode, failed_reading_guard,
]


def queries():
    return {q.__name__: q for q in QUERIES}
