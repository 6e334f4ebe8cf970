"""Sales reports: date and payment filters, metrics, and sums by day, ISO week, month and payment method."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import reais
from millrace.functions.sums import totals

# Payment methods as the receipts spell them.
ALL_PAYMENTS = "Todas"
PAYMENTS = ["Todas", "Cartão de Crédito", "Cartão de Débito", "Dinheiro", "Vale Alimentação"]
AMOUNT_DUE = "Valor a Pagar"
AMOUNT_DUE_LABEL = "Valor a pagar R$:"
NOT_SPECIFIED = "Não Especificado"
NOTHING_FOUND = "Nenhum dado encontrado para os filtros selecionados."
DEFAULT_START, DEFAULT_END = date(2024, 3, 1), date(2025, 11, 21)

GRAINS = ("day", "week", "month", "payment")


def filter_sales(sales: DataFrame, start: date, end: date, payment: str = ALL_PAYMENTS, inclusive_end_day: bool = False) -> DataFrame:
    """Sales (sold_at, payment, total) from ``start`` to ``end``.

    ``end`` means its midnight, so the rest of that day is out unless ``inclusive_end_day``. Both bounds are
    literals and reach the scan.
    """
    sold = F.col("sold_at")
    low, high = (F.lit(str(d)).cast("timestamp_ntz") for d in (start, end))
    until = sold < high + F.expr("interval 1 day") if inclusive_end_day else sold <= high
    kept = sales.where((sold >= low) & until)
    return kept if payment == ALL_PAYMENTS else kept.where(F.col("payment") == payment)


def clean_sales(sales: DataFrame) -> DataFrame:
    """Without rows of empty payment or a bare amount due; a null payment stays. The label of an amount due is renamed."""
    if "payment" not in sales.columns:
        raise ValueError("sales have no payment column")
    payment = F.col("payment")
    kept = sales.where(~payment.eqNullSafe(F.lit("")) & ~payment.eqNullSafe(F.lit(AMOUNT_DUE)))
    return kept.withColumn("payment", F.when(payment == AMOUNT_DUE_LABEL, NOT_SPECIFIED).otherwise(payment))


def timed(sales: DataFrame) -> DataFrame:
    """``sales`` with sold_at as a timestamp without zone, where it is text in ISO form. Other text fails, as it has no place in any group."""
    text = dict(sales.dtypes)["sold_at"] == "string"
    return sales.withColumn("sold_at", F.col("sold_at").cast("timestamp_ntz")) if text else sales


def grain(name: str, with_year: bool = False) -> Column:
    """A sale's key. Weeks (ISO) and months have no year by default: those of different years merge."""
    sold = F.col("sold_at")
    if name == "day":
        return F.to_date(sold)
    if name == "week":
        week = F.weekofyear(sold)
        return F.extract(F.lit("YEAROFWEEK"), sold) * 100 + week if with_year else week
    if name == "month":
        return F.year(sold) * 100 + F.month(sold) if with_year else F.month(sold)
    if name == "payment":
        return F.col("payment")
    raise ValueError(f"grain must be one of {GRAINS}")


def sales_by(sales: DataFrame, name: str, with_year: bool = False) -> DataFrame:
    """key and total of cleaned sales, keys ascending. Null amounts add nothing; a null payment has no group. A total is the exactly rounded sum."""
    keyed = timed(sales).select(grain(name, with_year).alias(name), "total")
    if name == "payment":
        keyed = keyed.where(F.col(name).isNotNull())
    return totals(keyed, [name], "total").withColumn("total", F.coalesce("total", F.lit(0.0))).orderBy(name)


def sales_metrics(sales: DataFrame) -> DataFrame:
    """One row: total, n, mean (over all rows; 0 without any). Computed before cleaning."""
    found = totals(sales, [], "total", counts={"n": F.count(F.lit(1))})
    found = found.select(F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    return found.select("total", "n", F.when(F.col("n") > 0, F.col("total") / F.col("n")).otherwise(0.0).alias("mean"))


def metric_tiles(metrics: DataFrame) -> DataFrame:
    return metrics.select(reais(F.col("total")).alias("total"), reais(F.col("mean")).alias("mean"))


def sales_status(chosen: DataFrame) -> DataFrame:
    """One row: n, status (ok or empty) and the warning of an empty choice."""
    counted = chosen.agg(F.count(F.lit(1)).alias("n"))
    empty = F.col("n") == 0
    return counted.select("n", F.when(empty, "empty").otherwise("ok").alias("status"), F.when(empty, NOTHING_FOUND).alias("warning"))


def sales_report(sales: DataFrame, start: date = DEFAULT_START, end: date = DEFAULT_END, payment: str = ALL_PAYMENTS) -> dict[str, DataFrame]:
    """Metrics of the filtered sales and, of the cleaned ones, the sums by each grain. ``sales_status`` tells of an empty choice."""
    chosen = filter_sales(sales, start, end, payment)
    cleaned = clean_sales(chosen)
    return {"metrics": sales_metrics(chosen)} | {name: sales_by(cleaned, name) for name in GRAINS}
