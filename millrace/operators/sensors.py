"""Sensor readings: binary frames of a particulate sensor, and guards on analog readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

# The frame's layout. Byte 0 is the start byte; big-endian words from byte 2.
FRAME_BYTES, START_BYTE, SECOND_BYTE, PAYLOAD_BYTES = 32, 0x42, 0x4D, 28
FRAME_FIELDS = [
    "framelen",
    "pm10_standard", "pm25_standard", "pm100_standard",
    "pm10_env", "pm25_env", "pm100_env",
    "particles_03um", "particles_05um", "particles_10um", "particles_25um", "particles_50um", "particles_100um",
    "unused",
    "checksum",
]


def decode_frames(frames: DataFrame, frame: str = "frame", verify_header: bool = False) -> DataFrame:
    """``frames`` with the fields of each valid frame; others are dropped.

    Valid: 32 bytes, the start byte, and a checksum equal to the sum of the bytes before it. ``verify_header`` also asks
    for the second start byte and the payload length.
    """
    start = f"{START_BYTE:02X}{SECOND_BYTE:02X}{PAYLOAD_BYTES:04X}" if verify_header else f"{START_BYTE:02X}"
    sound = (F.octet_length(frame) == FRAME_BYTES) & (F.expr(f"hex(substring({frame}, 1, {len(start) // 2}))") == start)
    held = "_w"
    while any(c.startswith(held) for c in frames.columns):
        held += "_"
    number = lambda at, n: f"cast(conv(hex(substring({frame}, {at}, {n})), 16, 10) as bigint)"
    # Three words are read at a time: six bytes are a number that fits. The sum is asked of what a generator gives, as filters don't pass it: else each frame would be read twice.
    parts = {f"{held}{i}": number(3 + 6 * i, 6) for i in range(len(FRAME_FIELDS) // 3)} | {f"{held}second": number(2, 1)}
    read = frames.where(sound).select(*frames.columns, F.expr(f"inline(array(named_struct({', '.join(f"'{n}', {v}" for n, v in parts.items())})))"))
    words = [F.shiftright(f"{held}{i}", 16 * (2 - k)).bitwiseAND(65535).cast("int") for i in range(len(FRAME_FIELDS) // 3) for k in range(3)]
    total = sum((F.shiftright(w, 8) + w.bitwiseAND(255) for w in words[:-1]), F.lit(START_BYTE) + F.col(f"{held}second"))
    return read.where(total == words[-1]).select(*frames.columns, *(w.alias(n) for w, n in zip(words, FRAME_FIELDS)))


def take_frames(buffer: bytes) -> tuple[list[bytes], bytes]:
    """Valid frames of a byte stream and the bytes that must wait for more.

    A byte that doesn't start a frame is skipped; a frame with a wrong checksum is lost whole.
    """
    frames, at = [], 0
    while at < len(buffer):
        if buffer[at] != START_BYTE:
            at = buffer.find(START_BYTE, at)
            if at < 0:
                at = len(buffer)
            continue
        if len(buffer) - at < FRAME_BYTES:
            break
        frame = buffer[at : at + FRAME_BYTES]
        if sum(frame[:-2]) == int.from_bytes(frame[-2:], "big"):
            frames.append(frame)
        at += FRAME_BYTES
    return frames, buffer[at:]


@udtf(returnType="place int, frame binary")
class SplitFrames:
    """Frames of one complete byte stream: ``SELECT * FROM captures, LATERAL split_frames(data)``."""

    def eval(self, data: bytes):
        for place, frame in enumerate(take_frames(bytes(data or b""))[0]):
            yield place, frame


def drop_failed_readings(readings: DataFrame, humidity: str = "humidity", temperature: str = "temperature") -> DataFrame:
    """Without readings where either value is NaN."""
    return readings.where(~(F.isnan(humidity) | F.isnan(temperature)))


def gas_lines(readings: DataFrame) -> DataFrame:
    """raw_adc, rzero and ppm as they are shown."""
    text = F.format_string("ADC bruto: %.2f RZero: %.2f PPM estimado: %.2f", *(F.col(c).cast("double") for c in ("raw_adc", "rzero", "ppm")))
    return readings.select("*", text.alias("line"))


def particulate_lines(frames: DataFrame) -> DataFrame:
    """The fine particles of decoded frames as they are shown."""
    return frames.select("*", F.format_string("Qualidade do Ar (PM 2.5): %d ug/m3", "pm25_standard").alias("line"))


def reading_lines(readings: DataFrame) -> DataFrame:
    return readings.select("*", F.format_string("temperature: %.2f humidity: %.2f", "temperature", "humidity").alias("line"))
