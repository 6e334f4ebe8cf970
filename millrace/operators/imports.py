"""Import analytics: totals by country, distinct commodities, rankings and lookups in both directions.

Every operator starts from (country, commodity, value) rows and aggregates by (country, commodity) first: that
combines on the map side, and sums, distinct counts and lists all follow from the small result. Values are doubles, and a total is their exactly
rounded sum (``functions.sums``), or decimals, and a total is their sum as a double.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import sums
from millrace.functions.scalars import euro_thousands, strict_double


def valid_imports(rows: DataFrame) -> DataFrame:
    """country, commodity, value of the rows whose value is a number; others leave no trace of their country."""
    text = rows.select("country", "commodity", F.inline(F.array(F.struct(F.col("value").cast("string").alias("text")))))
    # A filter doesn't pass a generator, so each text is made once and read once.
    number = text.select("country", "commodity", F.inline(F.array(F.struct(strict_double(F.col("text")).alias("value")))))
    return number.where(F.col("value").isNotNull())


def commodity_totals(imports: DataFrame) -> DataFrame:
    """country, commodity, total: one row for each pair."""
    return sums.totals(imports, ["country", "commodity"], "value")


def country_sums(imports: DataFrame, listed: bool) -> DataFrame:
    """country, total, n_commodities and, if ``listed``, commodities (sorted). Totals are rounded once, not by commodity."""
    names = {"commodities": F.array_sort(F.collect_list("commodity"))} if listed else {}
    if sums.of_decimals(imports, "value"):
        pairs = imports.groupBy("country", "commodity").agg(F.sum("value").alias("value"))
        total = F.sum("value").cast("double").alias("total")
        return pairs.groupBy("country").agg(total, F.count(F.lit(1)).alias("n_commodities"), *(c.alias(n) for n, c in names.items()))
    # The bins of a pair are brought together, so that only its first one counts the commodity and names it.
    parts = sums.with_digits(imports, "value").groupBy("country", "commodity", sums.BIN).agg(*sums.added_digits())
    pairs = parts.groupBy("country", "commodity").agg(F.collect_list(F.struct(sums.BIN, *sums.DIGITS, sums.ODD)).alias("_bins"))
    cut = pairs.select("country", "commodity", F.posexplode("_bins").alias("_place", "_b")).select("country", "commodity", "_place", "_b.*")
    first = F.when(F.col("_place") == 0, F.col("commodity"))
    held = {"n_commodities": F.count_if(F.col("_place") == 0)} | ({"commodities": F.collect_list(first)} if listed else {})
    parts = cut.groupBy("country", sums.BIN).agg(*sums.added_digits(), *(c.alias(n) for n, c in held.items()))
    merged = {"n_commodities": F.sum("n_commodities")} | ({"commodities": F.array_sort(F.flatten(F.collect_list("commodities")))} if listed else {})
    return sums.from_bins(parts, ["country"], "total", merged)


def country_rollup(imports: DataFrame) -> DataFrame:
    """country, total, n_commodities, commodities (sorted)."""
    return country_sums(imports, listed=True)


def first_seen_commodities(imports: DataFrame, position: str) -> DataFrame:
    """country and its commodities in the order of their first ``position``."""
    first = imports.groupBy("country", "commodity").agg(F.min(position).alias("first"))
    listed = first.groupBy("country").agg(F.array_sort(F.collect_list(F.struct("first", "commodity"))).alias("pairs"))
    return listed.select("country", F.col("pairs.commodity").alias("commodities"))


def import_ranking(imports: DataFrame, top: int = 10) -> DataFrame:
    """rank, country, total, n_commodities of the ``top`` totals; ties by country. Fewer countries give fewer rows."""
    totals = country_sums(imports, listed=False)
    best = totals.orderBy(F.desc("total"), "country").limit(top)  # one bounded partition from here on
    order = Window.orderBy(F.desc("total"), "country")
    return best.select(F.row_number().over(order).cast("long").alias("rank"), "country", "total", "n_commodities")


# The texts of the lines below are those that users of such reports know.
def ranking_lines(ranking: DataFrame) -> DataFrame:
    text = F.concat(F.col("rank").cast("string"), F.lit("º - "), "country", F.lit(": "), euro_thousands(F.col("total")))
    return ranking.select("rank", F.concat(text, F.lit(" - "), F.col("n_commodities").cast("string"), F.lit(" commodities")).alias("line"))


def country_lines(imports: DataFrame, country: str) -> DataFrame:
    """place and line of what is told about a country: its total, its number of commodities and their sorted list."""
    found = country_lookup(imports, country)
    head = F.array(
        F.concat(F.lit("Dados do país: "), "country"),
        F.concat(F.lit("Valor total importado: "), euro_thousands(F.col("total"))),
        F.concat(F.lit("Tipos de commodities importadas: "), F.col("n_commodities").cast("string")),
        F.lit("Lista de commodities:"),
    )
    held = country_commodities(imports, country).groupBy("country").agg(F.array_sort(F.collect_list("commodity")).alias("held"))
    lines = F.when(F.col("found"), F.concat(head, F.transform("held", lambda c: F.concat(F.lit("- "), c)))).otherwise(F.array(F.lit("País não encontrado.")))
    return found.join(F.broadcast(held), "country", "left").select(F.posexplode(lines).alias("place", "line"))


def commodity_lines(imports: DataFrame, commodity: str) -> DataFrame:
    """place and line of what is told about a commodity: the countries that import it, sorted."""
    countries = countries_by_commodity(imports, commodity).agg(F.array_sort(F.collect_list("country")).alias("held"))
    named = F.transform("held", lambda c: F.concat(F.lit("- "), c))
    none = F.array(F.lit("Nenhum país encontrado com essa commodity."))
    lines = F.concat(F.array(F.lit(f"Países que importam a commodity '{commodity}':")), F.when(F.size("held") > 0, named).otherwise(none))
    return countries.select(F.posexplode(lines).alias("place", "line"))


def country_lookup(imports: DataFrame, country: str) -> DataFrame:
    """One row: country, found, total, n_commodities. Names are compared as they are."""
    asked = imports.sparkSession.createDataFrame([(country,)], "country string")
    found = country_sums(imports.where(F.col("country") == country), listed=False)
    return asked.join(F.broadcast(found), "country", "left").select("country", F.col("total").isNotNull().alias("found"), "total", "n_commodities")


def country_commodities(imports: DataFrame, country: str) -> DataFrame:
    return imports.where(F.col("country") == country).select("country", "commodity").distinct()


def countries_by_commodity(imports: DataFrame, commodity: str) -> DataFrame:
    """The countries that import exactly this commodity."""
    return imports.where(F.col("commodity") == commodity).select("country").distinct()
