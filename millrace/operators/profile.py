"""Risk profile from three yes/no answers, and the fixed recommendations of each profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Profiles and what each is recommended.
CAUTIOUS, MODERATE, BOLD = "Conservador", "Moderado", "Ousado"
RECOMMENDED = {
    "Conservador": ["Ouro", "Alimentos básicos", "Energia (petróleo estável)"],
    "Moderado": ["Soja", "Minério de ferro", "Gás natural"],
    "Ousado": ["Petróleo", "Metais raros", "Commodities com variação cambial"],
}


def risk_points(prefers_safety: Column, accepts_swings: Column, prefers_spread: Column) -> Column:
    """One point each for a yes to the first and the third and a no to the second; null unless all are s or n."""
    answers = [F.lower(c) for c in (prefers_safety, accepts_swings, prefers_spread)]
    points = sum(((a == v).cast("int") for a, v in zip(answers, ("s", "n", "s"))), F.lit(0))
    valid = answers[0].isin("s", "n") & answers[1].isin("s", "n") & answers[2].isin("s", "n")
    return F.when(valid, points)


def risk_profile(*answers: Column) -> Column:
    points = risk_points(*answers)
    return F.when(points >= 2, CAUTIOUS).when(points == 1, MODERATE).when(points == 0, BOLD)


def profile_line(profile: Column) -> Column:
    return F.concat(F.lit("Seu perfil de investidor é: "), profile)


def recommendations(spark: SparkSession, profiles: DataFrame) -> DataFrame:
    """``profiles`` (column profile) with place and item; unknown profiles get none."""
    rows = [(p, i + 1, item) for p, items in RECOMMENDED.items() for i, item in enumerate(items)]
    return profiles.join(F.broadcast(spark.createDataFrame(rows, "profile string, place int, item string")), "profile")
