import struct

from pyspark.sql import functions as F

from millrace.operators import sensors as S
from millrace.streaming.stateful import frames_of_streams, start


def frame(values, second=0x4D, wrong=0):
    body = bytes([0x42, second]) + struct.pack(">14H", 28, *values, 0)
    return body + struct.pack(">H", sum(body) + wrong)


GOOD = frame(range(1, 13))


def decode(spark, frames, **options):
    rows = spark.createDataFrame([(i, None if f is None else bytearray(f)) for i, f in enumerate(frames)], "i int, frame binary")
    return S.decode_frames(rows, **options).collect()


def test_decode(spark):
    flipped = bytearray(GOOD)
    flipped[10] ^= 1
    found = decode(spark, [GOOD, flipped, frame([0x42] * 12), b"", None, GOOD[:31], b"\x41" + GOOD[1:], frame(range(12), wrong=1)])
    assert [r.i for r in found] == [0, 2]
    assert [found[0][n] for n in S.FRAME_FIELDS[:13]] == [28, *range(1, 13)] and found[0].checksum == sum(GOOD[:30])
    other = frame(range(12), second=0x4E)
    assert len(decode(spark, [other])) == 1 and decode(spark, [other], verify_header=True) == []


def test_take_frames():
    frames, tail = S.take_frames(b"\x00\x01" + GOOD + frame(range(12), wrong=1) + GOOD + GOOD[:7])
    assert frames == [GOOD, GOOD] and tail == GOOD[:7]
    assert S.take_frames(b"") == ([], b"") and S.take_frames(b"\x00\x00") == ([], b"")


def test_udtf(spark):
    spark.udtf.register("split_frames", S.SplitFrames)
    spark.createDataFrame([(1, bytearray(b"\x07" + GOOD + GOOD))], "sensor int, data binary").createOrReplaceTempView("captures")
    found = spark.sql("SELECT sensor, place, frame FROM captures, LATERAL split_frames(data)").collect()
    assert [(r.sensor, r.place, bytes(r.frame)) for r in found] == [(1, 0, GOOD), (1, 1, GOOD)]


def test_stream_keeps_the_tail(spark, tmp_path):
    stream = b"\x00" + GOOD + frame(range(2, 14)) + GOOD
    chunks = [stream[i : i + 20] for i in range(0, len(stream), 20)]
    chunks.insert(1, None)
    for i, chunk in enumerate(chunks):
        spark.createDataFrame([("s", i, None if chunk is None else bytearray(chunk))], "sensor string, seq int, data binary").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = spark.readStream.schema("sensor string, seq int, data binary").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    query = start(frames_of_streams(read).writeStream.format("memory").queryName("frames").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True))
    query.awaitTermination()
    assert [bytes(r.frame) for r in spark.sql("SELECT frame FROM frames").collect()] == [GOOD, frame(range(2, 14)), GOOD]


def test_failed_readings(spark):
    nan = float("nan")
    rows = spark.createDataFrame([(1.0, 2.0), (nan, 2.0), (1.0, nan), (nan, nan), (None, 1.0)], "humidity float, temperature float")
    kept = S.drop_failed_readings(rows)
    assert kept.count() == 2 and S.reading_lines(kept).where(F.col("humidity") == 1).first().line == "temperature: 2.00 humidity: 1.00"
