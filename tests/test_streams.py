import json
import struct
import uuid

import pytest
from pyspark.sql import functions as F

from millrace.operators.sensors import take_frames
from millrace.sources import packets as P
from millrace.streaming import stateful as S
from millrace.streaming import stored_notes as N
from millrace.streaming import telemetry as T


def frame(values):
    body = bytes([0x42, 0x4D]) + struct.pack(">14H", 28, *values, 0)
    return body + struct.pack(">H", sum(body))


def drain(df, name, tmp_path):
    S.start(df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True)).awaitTermination()


class Landing:
    """A folder that a stream reads file by file."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, folder, schema, 0
        folder.mkdir()

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(str(self.folder))

    def stream(self, files=1):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", files).parquet(str(self.folder))


@pytest.mark.parametrize("cut,order", [(7, "in order"), (33, "reversed"), (64, "mixed")])
def test_any_cut_gives_the_frames_of_the_whole(spark, tmp_path, cut, order):
    whole = {s: b"\x00\x42" + b"".join(frame(range(i, i + 12)) + b"\x07" * (i % 3) for i in range(s, s + 6)) + frame(range(12))[:9] for s in (1, 2)}
    chunks = [(s, i, bytearray(data[i * cut : (i + 1) * cut])) for s, data in whole.items() for i in range(-(-len(data) // cut))]
    chunks = chunks[::-1] if order == "reversed" else chunks[::2] + chunks[1::2] if order == "mixed" else chunks
    landing = Landing(spark, tmp_path / "in", "sensor int, seq long, data binary")
    for part in (chunks[: len(chunks) // 2], chunks[len(chunks) // 2 :] + chunks[:3]):  # some come twice
        landing.add(part)
    drain(S.frames_of_streams(landing.stream()), "out", tmp_path)
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    for s, data in whole.items():
        assert sorted(bytes(r.frame) for r in found if r.sensor == s) == sorted(take_frames(data)[0])


def test_tail_and_early_chunks_survive_a_restart(spark, tmp_path):
    data = frame(range(12)) + frame(range(1, 13)) + frame(range(2, 14))
    landing = Landing(spark, tmp_path / "in", "sensor string, seq int, data binary")
    rows = [("s", i, bytearray(data[i * 20 : i * 20 + 20])) for i in range(5)]
    landing.add([rows[0], rows[3], ("s", 1, None)])
    for more in ([("s", 2, bytearray(data[20:40])), ("t", 0, bytearray(frame(range(12))))], [("s", 4, bytearray(b"")), ("s", 5, bytearray(data[80:]))]):
        drain(S.frames_of_streams(landing.stream()), "out", tmp_path)
        landing.add(more)
    drain(S.frames_of_streams(landing.stream()), "out", tmp_path)
    found = [(r.sensor, bytes(r.frame)) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    # seq 3 came early and holds bytes 60 to 80, so the frame before it lacks bytes 40 to 60: lost, as its checksum is wrong.
    assert ("s", frame(range(12))) in found and ("t", frame(range(12))) in found
    assert sorted(found) == sorted([("s", f) for f in take_frames(data[:40] + data[60:80] + data[80:])[0]] + [("t", frame(range(12)))])


def test_a_gap_is_given_up_in_time(spark, tmp_path):
    landing = Landing(spark, tmp_path / "in", "sensor string, seq int, data binary")
    landing.add([("s", 0, bytearray(frame(range(12))[:10])), ("s", 2, bytearray(frame(range(1, 13))))])
    drain(S.frames_of_streams(landing.stream(), patience=1), "out", tmp_path)
    for i in (4, 5):  # batches in which the timer may ring
        landing.add([("other", i, bytearray(b""))])
        drain(S.frames_of_streams(landing.stream(), patience=1), "out", tmp_path)
    assert [bytes(r.frame) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [frame(range(1, 13))]


class Store:
    """A state handle that counts its calls."""

    def __init__(self):
        self.calls, self.data = 0, {}

    def getValueState(self, name, schema):
        return State(self, name)

    def getMapState(self, name, key, value):
        return State(self, name)

    def listTimers(self):
        return []

    def registerTimer(self, at):
        self.calls += 1


class State:
    def __init__(self, store, name):
        self.store, self.data = store, store.data.setdefault(name, {})

    def exists(self):
        self.store.calls += 1
        return bool(self.data)

    def get(self):
        return self.getValue(())

    def update(self, value):
        self.updateValue((), value)

    def getValue(self, key):
        self.store.calls += 1
        return self.data[key]

    def updateValue(self, key, value):
        self.store.calls += 1
        self.data[key] = value

    def removeKey(self, key):
        self.store.calls += 1
        del self.data[key]

    def keys(self):
        self.store.calls += 1
        return iter(list(self.data))


def test_the_store_is_asked_by_block(monkeypatch):
    """Chunks that come early cost some calls a block and batch, none a chunk; of equal seqs the one that was used first stays."""
    import pandas as pd

    clock = type("Clock", (), {"getCurrentProcessingTimeInMs": lambda self: 0})()
    data = b"".join(frame(range(i, i + 12)) for i in range(2000))
    chunks = [(i, data[i * 20 : i * 20 + 20]) for i in range(len(data) // 20)]
    store, found = Store(), []
    framing = S.Framing(0, 1)
    framing.init(store)
    for part in (chunks[1::3], chunks[2::3], chunks[0:1] + [(0, b"used")] + chunks[3::3]):
        batches = [pd.DataFrame(part[i : i + 400], columns=["seq", "data"]) for i in range(0, len(part), 400)]
        for rows in framing.handleInputRows(("s",), iter(batches), clock):
            found += list(rows["frame"])
    assert found == take_frames(data)[0] and len(found) == 2000
    assert not store.data["early"] and not store.data["blocks"] and store.calls < 200


def test_a_key_is_registered_once(spark, tmp_path):
    registry = spark.createDataFrame([("u0", "k0"), ("u0", None), ("u1", "k0")], "url string, access_key string")
    landing = Landing(spark, tmp_path / "in", "url string, access_key string")
    landing.add([("b", "k1"), ("a", "k1"), ("x", "k0"), ("y", None)])
    landing.add([("c", "k1"), ("d", "k2"), (None, "k3")])
    for _ in range(2):
        S.append_keys(S.new_keys(landing.stream(), registry), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
        landing.add([("e", "k2"), ("f", "k4")])
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    firsts = {r.access_key: r.url for r in rows}
    assert sorted(firsts) == ["k1", "k2", "k3", "k4"] and len(rows) == 4 and firsts["k1"] in ("a", "c") and all(r.read_at for r in rows)
    assert spark.conf.get(S.PROVIDER, "") != S.ROCKS_DB


def test_keys_are_registered_without_python_or_state(spark, tmp_path):
    """Batches are joined with the stored keys by Spark itself; a batch killed before its commit is written anew, and the registry is read with the first batch only."""
    registry = tmp_path / "registry"
    spark.createDataFrame([("k0",), (None,)], "access_key string").write.parquet(str(registry))
    landing = Landing(spark, tmp_path / "in", "url string, access_key string")
    landing.add([("b", "k1"), ("a", "k1"), ("x", "k0")])
    landing.add([(str(i), f"n{i}") for i in range(3000)] + [("c", "k1")])
    for again in range(2):
        S.append_keys(S.new_keys(landing.stream(), spark.read.parquet(str(registry))), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
        if not again:
            (tmp_path / "c" / "commits" / "1").unlink()
            (tmp_path / "c" / "commits" / ".1.crc").unlink(missing_ok=True)
            spark.createDataFrame([("n7",), ("late",)], "access_key string").write.mode("append").parquet(str(registry))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.access_key, r.url) for r in rows) == sorted([("k1", "a")] + [(f"n{i}", str(i)) for i in range(3000)])
    assert not (tmp_path / "c" / "state").exists()


def packets_of(messages):
    return b"".join(P.packet(t, p, q, n % 2 == 1, n + 1) for n, (t, p, q) in enumerate(messages))


def test_packets(spark, tmp_path):
    messages = [("air", b"{}", 0), ("é/ü", b"", 1), ("air", b"x" * 200, 2), ("air", b"y" * 20_000, 0), ("", b"\x00\xff", 0)]
    (tmp_path / "000.packets").write_bytes(packets_of(messages[:3]) + b"\xc0\x00" + packets_of(messages[3:]) + P.packet("air", b"cut")[:-1])
    (tmp_path / "001.packets").write_bytes(b"")
    (tmp_path / "002.part").write_bytes(packets_of(messages))
    rows = P.recorded_messages(spark, str(tmp_path), streaming=False).collect()
    assert [(r.topic, bytes(r.payload), r.quality) for r in rows] == messages and {r.file for r in rows} == {"000.packets"}
    assert [r.packet_number for r in rows] == [None, 2, 3, None, None] and [r.retained for r in rows] == [False, True, False, False, True]
    assert P.recorded_messages(spark, str(tmp_path), topic="é/ü", streaming=False).count() == 1
    (tmp_path / "none").mkdir()
    assert P.recorded_messages(spark, str(tmp_path / "none"), streaming=False).collect() == []
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "0.packets").write_bytes(b"\x30\xff\xff\xff\xff\x01")
    with pytest.raises(Exception, match="no packet at byte 0"):
        P.recorded_messages(spark, str(tmp_path / "bad"), streaming=False).collect()


@pytest.mark.parametrize("n", [0, 127, 128, 16_383, 16_384, 2_097_151, 2_097_152])
def test_sizes(n):
    import io

    data = bytes([0x30]) + P.size_bytes(n) + b"\x00" * n
    assert [(at, len(body)) for at, _, body in P.packets(io.BytesIO(data))] == [(0, n)]


def test_packet_stream_goes_on_behind_its_offset(spark, tmp_path):
    folder = tmp_path / "in"
    P.record_messages(spark.createDataFrame([("air", bytearray(b"%d" % i)) for i in range(6)], "topic string, payload binary").repartition(3), str(folder))
    for extra in (False, True):
        if extra:
            P.record_messages(spark.createDataFrame([("air", bytearray(b"%d" % i)) for i in (6, 7)], "topic string, payload binary").coalesce(1), str(folder))
        stream = P.recorded_messages(spark, str(folder))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    found = sorted(int(bytes(r.payload)) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    batch = sorted(int(bytes(r.payload)) for r in P.recorded_messages(spark, str(folder), streaming=False).collect())
    assert found == batch == list(range(8))


NOTE = "access_key string, sold_at timestamp_ntz, payment string, total double, items array<struct<product: string, quantity: double, unit_price: double, total: double>>, reason string"


def notes(spark, *rows):
    return spark.createDataFrame([(k, None, p, 1.0, [(f"{p}{i}", 1.0, 1.0, 1.0) for i in range(n)], None) for k, p, n in rows], NOTE)


def contents(spark, folder):
    headers = sorted((r.access_key, r.payment) for r in N.stored(spark, folder, "headers").collect())
    return headers, sorted((r.access_key, r.line_no, r["product"]) for r in N.stored(spark, folder, "items").collect())


def files_of(folder):
    return {p: p.stat().st_mtime_ns for p in folder.rglob("*.parquet") if "ledger" not in str(p)}


def test_upserts_touch_their_buckets_only(spark, tmp_path):
    folder = str(tmp_path / "store")
    assert contents(spark, folder) == ([], [])
    N.upsert_notes(notes(spark, *((f"k{i}", "a", 2) for i in range(40)), ("none", "a", 0)), folder, "s", 0, buckets=16)
    before = files_of(tmp_path / "store")
    N.upsert_notes(notes(spark, ("k3", "b", 1), ("new", "b", 1)), folder, "s", 1, buckets=16)
    headers, items = contents(spark, folder)
    assert headers == sorted([(f"k{i}", "b" if i == 3 else "a") for i in range(40)] + [("new", "b"), ("none", "a")])
    assert [x for x in items if x[0] == "k3"] == [("k3", 1, "b0"), ("k3", 2, "a1")] and len(items) == 81
    after = files_of(tmp_path / "store")
    assert all(after[p] == t for p, t in before.items())
    assert len({p.parent.name for p in set(after) - set(before)}) <= 2  # two keys
    entry = N.current(spark, folder)
    assert sum(f == "s-1" for f in entry.folders.values()) <= 4 and entry.batches == {"s": 1}


def test_a_killed_batch_can_be_repeated(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "store")
    N.upsert_notes(notes(spark, ("k1", "a", 1), ("k2", "a", 1)), folder, "s", 0)
    whole = contents(spark, folder)
    batch = notes(spark, ("k1", "b", 2), ("k9", "b", 1))
    with monkeypatch.context() as m:
        m.setattr(N, "write_entry", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            N.upsert_notes(batch, folder, "s", 1)
    assert contents(spark, folder) == whole  # both tables are as before
    N.upsert_notes(batch, folder, "s", 1)
    changed = contents(spark, folder)
    assert changed[0] == [("k1", "b"), ("k2", "a"), ("k9", "b")]
    N.upsert_notes(notes(spark, ("k1", "old", 1)), folder, "s", 1)  # is in the ledger already
    assert contents(spark, folder) == changed
    N.upsert_notes(notes(spark, ("k1", "c", 1)), folder, "other", 0)
    assert contents(spark, folder)[0][0] == ("k1", "c")


def test_upsert_stream(spark, tmp_path):
    landing = Landing(spark, tmp_path / "in", NOTE)
    for p in "ab":
        notes(spark, ("k1", p, 1), (f"only-{p}", p, 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        N.upsert_stream(landing.stream(), str(tmp_path / "store"), str(tmp_path / "c")).awaitTermination()
    assert contents(spark, str(tmp_path / "store"))[0] == [("k1", "b"), ("only-a", "a"), ("only-b", "b")]


def test_good_and_dead_add_up_after_a_restart(spark, tmp_path, monkeypatch):
    landing = Landing(spark, tmp_path / "in", "i int, payload string")
    for b in range(3):
        landing.add([(b * 4 + j, m) for j, m in enumerate(['{"a": 1, "a": 2}', "nope", "[1]", '{"b": null}'])])
    store, calls = T.store_outcomes, []

    def dies_once(rows, folder, batch):
        store(rows, folder, batch)
        calls.append(batch)
        if len(calls) == 2:
            raise RuntimeError("killed after the write, before the commit")

    monkeypatch.setattr(T, "store_outcomes", dies_once)
    query = T.store_stream(T.decode_telemetry(landing.stream()), str(tmp_path / "out"), str(tmp_path / "c"))
    with pytest.raises(Exception, match="killed"):
        query.awaitTermination()
    T.store_stream(T.decode_telemetry(landing.stream()), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    good, dead = (sorted(r.i for r in T.outcomes(spark, str(tmp_path / "out"), k).collect()) for k in ("good", "dead"))
    assert good == [0, 3, 4, 7, 8, 11] and sorted(good + dead) == list(range(12)) and calls == [0, 1, 1, 2]


BODIES = ['{"temperatura": 1, "temperatura": 2, "umidade_ar": 1, "umidade_solo": {"a": 1, "a": 2}}', '{"temperatura": 1, "umidade_ar": 1, "umidade_solo": 1} x', "{'temperatura': 1}", '{"temperatura": 1,}']


@pytest.mark.parametrize("setting", ["false", "true"])
def test_the_gate_reads_no_setting(spark, setting):
    key = "spark.sql.variant.allowDuplicateKeys"
    before = spark.conf.get(key)
    spark.conf.set(key, setting)
    try:
        rows = T.gate_required(spark.createDataFrame(list(enumerate(BODIES)), "i int, body string")).orderBy("i").collect()
        assert [r.status_code for r in rows] == [201, 400, 400, 400] and rows[1].message == "not a JSON object"
    finally:
        spark.conf.set(key, before)


def test_json_objects_are_told_as_the_standard_does(spark):
    texts = ['{"a":1}] x', '{"a":1},{"b":2}', '{"a":1},1]', '{"a":1}],[1', '{"a":01}', '{"a":"x\ty"}', "{a:1}", '{"a":1}//x', '{"a":1', '{"a":"\\x"}', "{}", '{"a":1e400}', ' {"a":[1,{"b":2}]}\n', '{"a":tru}', '"s"', "null", "5", "", None, '{"a":.5}']
    from millrace.functions.scalars import object_keys

    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(object_keys(F.col("t")).isNotNull()).collect()

    def is_object(t):
        try:
            return isinstance(json.loads(t), dict)
        except (ValueError, TypeError):
            return False

    assert [r[0] for r in rows] == [is_object(t) for t in texts]


def test_ids_are_named_and_bodies_stamped(spark):
    bodies = [BODIES[0], '{"temperatura": null, "umidade_ar": 1, "umidade_solo": "é", "dataRegistro": "client"}']
    gated = T.gate_required(spark.createDataFrame([(i, b) for i, b in enumerate(bodies * 2)], "place int, body string"), registered_at=F.lit("2024-05-06 07:08:09").cast("timestamp"))
    first, second = (sorted(T.stored_posts(gated.repartition(n), delivery=["place"]).collect()) for n in (1, 4))
    assert [r.id for r in first] == [r.id for r in second] and len({r.id for r in first}) == 4
    assert [r.id for r in first] == [str(uuid.uuid5(T.POSTS, json.dumps({"place": i}, separators=(",", ":")))) for i in range(4)]
    assert json.loads(first[0].dados) == {"temperatura": 2, "umidade_ar": 1, "umidade_solo": {"a": 2}, "dataRegistro": "2024-05-06 07:08:09"}
    assert json.loads(first[1].dados) == {"temperatura": None, "umidade_ar": 1, "umidade_solo": "é", "dataRegistro": "2024-05-06 07:08:09"}
