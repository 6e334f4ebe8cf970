import pytest
from pyspark.sql import functions as F

from millrace.operators import profile as P


@pytest.mark.parametrize(
    "answers,points,name",
    [
        ("sns", 3, "Conservador"), ("snn", 2, "Conservador"), ("sss", 2, "Conservador"), ("ssn", 1, "Moderado"),
        ("nns", 2, "Conservador"), ("nnn", 1, "Moderado"), ("nss", 1, "Moderado"), ("nsn", 0, "Ousado"), ("SnS", 3, "Conservador"), ("xns", None, None),
    ],
)
def test_profile(spark, answers, points, name):
    columns = [F.lit(a) for a in answers]
    assert tuple(spark.range(1).select(P.risk_points(*columns), P.risk_profile(*columns)).first()) == (points, name)


def test_recommendations(spark):
    asked = spark.createDataFrame([("Moderado",), ("Outro",), (None,)], "profile string")
    assert sorted((r.place, r.item) for r in P.recommendations(spark, asked).collect()) == [(1, "Soja"), (2, "Minério de ferro"), (3, "Gás natural")]
