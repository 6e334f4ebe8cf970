from pyspark.sql import functions as F

from millrace.sources.landing import message_lines, saved_pages, uploaded_images
from millrace.streaming import telemetry as T

MESSAGES = ['{"a": 1}', "nope", "", "[1, 2]", "5", '{"a": 1, "a": 2}', '{"received_at": "body", "a": 3}', '{"a": NaN}', None]


def decoded(spark):
    T.allow_repeated_keys(spark)
    rows = [(i, None if m is None else bytearray(m.encode())) for i, m in enumerate(MESSAGES)] + [(99, bytearray(b"\xff\xfe"))]
    return T.decode_telemetry(spark.createDataFrame(rows, "i int, payload binary"))


def test_good_and_dead(spark):
    rows = decoded(spark)
    kept = T.good(rows).select("i", F.try_variant_get("doc", "$.a", "int").alias("a"), "received_at").collect()
    assert {r.i: r.a for r in kept} == {0: 1, 5: 2, 6: 3} and all(r.received_at is not None for r in kept)
    kinds = {r.i: r.error_kind for r in T.dead_letters(rows).collect()}
    assert kinds == {1: "not JSON", 2: "not JSON", 3: "not an object", 4: "not an object", 7: "not JSON", 8: "not text", 99: "not text"}


def test_gate(spark):
    bodies = ['{"temperatura": null, "umidade_ar": 1, "umidade_solo": 2, "x": 3}', '{"umidade_ar": 1}', '{"temperatura": 1, "umidade_ar": 1}', "[]", "nope", None]
    rows = {r.i: r for r in T.gate_required(spark.createDataFrame(list(enumerate(bodies)), "i int, body string")).collect()}
    assert rows[0].status_code == 201 and rows[0].registered_at is not None
    assert rows[1].message == "Campo 'temperatura' ausente no JSON" and rows[2].message == "Campo 'umidade_solo' ausente no JSON"
    assert [rows[i].status_code for i in range(1, 6)] == [400] * 5 and rows[1].registered_at is None
    assert T.stored_posts(T.gate_required(spark.createDataFrame(list(enumerate(bodies)), "i int, body string"))).first().id


def test_stream_equals_batch_and_restarts(spark, tmp_path):
    T.allow_repeated_keys(spark)
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "a.txt").write_text("\n".join(['{"a": 1}', "bad", '{"a": 2}']))
    flat = lambda df: T.good(T.decode_telemetry(df)).select(F.try_variant_get("doc", "$.a", "int").alias("a"))
    for extra in ("", '{"a": 7}'):
        if extra:
            (landing / "b.txt").write_text(extra)
        T.append_stream(flat(message_lines(spark, str(landing))), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    batch = sorted(r.a for r in flat(message_lines(spark, str(landing), streaming=False)).collect())
    assert sorted(r.a for r in spark.read.parquet(str(tmp_path / "out")).collect()) == batch == [1, 2, 7]


def test_landed_files(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "x.html").write_text("<p>a\nb")
    (tmp_path / "p" / "y.PNG").write_bytes(b"1")
    (tmp_path / "p" / "z.png").write_bytes(b"2")
    assert [r.html for r in saved_pages(spark, str(tmp_path / "p" / "x.html")).collect()] == ["<p>a\nb"]
    assert [bytes(r.content) for r in uploaded_images(spark, str(tmp_path / "p")).collect()] == [b"2"]
