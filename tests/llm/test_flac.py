"""FLAC: exact round trips, streams built bit by bit by a plain writer, checksums, seeking, columns."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import flac


class Writer:
    """A plain bit-by-bit writer of FLAC streams, for what the encoder does not write."""

    def __init__(self):
        self.bits = ""

    def put(self, value, width):
        self.bits += format(value & (1 << width) - 1, f"0{width}b") if width else ""

    def rice(self, values, k):
        for v in values:
            u = 2 * v if v >= 0 else -2 * v - 1
            self.bits += "0" * (u >> k) + "1"
            self.put(u, k)

    def bytes(self):
        self.bits += "0" * (-len(self.bits) % 8)
        return bytes(int(self.bits[i : i + 8], 2) for i in range(0, len(self.bits), 8))


def plain_crc16(data):
    value = 0
    for byte in data:
        value ^= byte << 8
        for _ in range(8):
            value = (value << 1 ^ (0x8005 if value & 0x8000 else 0)) & 0xFFFF
    return value


def stream_of(frames, block, channel, bits, samples, rate=44100):
    channels = 2 if channel >= 8 else channel + 1
    packed = rate << 44 | (channels - 1) << 41 | (bits - 1) << 36 | len(samples)
    md5 = hashlib.md5(flac.pcm(np.array(samples), bits)).digest()
    info = block.to_bytes(2, "big") * 2 + bytes(6) + packed.to_bytes(8, "big") + md5
    out = b"fLaC\x80" + len(info).to_bytes(3, "big") + info
    for number, (size, body) in enumerate(frames):
        head = b"\xff\xf8\x70" + bytes([channel << 4 | {8: 1, 12: 2, 16: 4, 24: 6}[bits] << 1]) + flac._utf8(number) + (size - 1).to_bytes(2, "big")
        whole = head + bytes([flac._crc8(head)]) + body
        out += whole + plain_crc16(whole).to_bytes(2, "big")
    return out


def test_round_trips():
    rng = random.Random(3)
    texts = ["the cat and the dog. " * 90, "ö€😀" * 500, "a" * 5000, "".join(chr(rng.randrange(32, 127)) for _ in range(9000)), ""]
    payloads = [t.encode() for t in texts] + [bytes(rng.randrange(256) for _ in range(3000)), bytes(range(256)) * 9]
    payloads = [p + b"\xff" * (-len(p) % 576 or (0 if p else 576)) for p in payloads]
    streams = flac.encode(payloads)
    for payload, (info, x) in zip(payloads, flac.decode(streams)):
        assert (x[:, 0] + 128).astype(np.uint8).tobytes() == payload and info.bits == 8
    assert flac.encode(payloads[2:3])[0] == streams[2]
    assert len(streams[0]) < 0.95 * len(payloads[0])
    long = payloads[3]
    assert (flac.read_at(flac.encode([long * 4])[0], 20_000, 700)[:, 0] + 128).astype(np.uint8).tobytes() == (long * 4)[20_000:20_700]


def test_stereo_lpc_escape_wasted_and_short_last_block():
    rng = random.Random(4)
    left = [int(3000 * np.sin(i / 9)) + rng.randrange(-20, 20) for i in range(48)]
    right = [v - rng.randrange(-9, 9) for v in left]
    frames = []
    for at in (0, 32):
        l, r = left[at : at + 32], right[at : at + 32]
        w, n = Writer(), len(l)
        w.put(0b0_100001_0, 8)  # LPC of order 2
        for v in l[:2]:
            w.put(v, 16)
        w.put(11, 4), w.put(5, 5), w.put(62, 12), w.put(-31, 12)
        res = [l[i] - ((62 * l[i - 1] - 31 * l[i - 2]) >> 5) for i in range(2, n)]
        w.put(1, 2), w.put(1, 4)
        w.put(7, 5), w.rice(res[: n // 2 - 2], 7)
        w.put(31, 5), w.put(14, 5)
        for v in res[n // 2 - 2 :]:
            w.put(v, 14)
        side = [a - b for a, b in zip(l, r)]
        w.put(0b0_001000_0, 8), w.put(0, 2), w.put(0, 4), w.put(0, 4), w.rice(side, 0)
        frames.append((n, w.bytes()))
    want = list(zip(left, right))
    stream = stream_of(frames, 32, 8, 16, want)
    assert flac.decode([stream])[0][1].tolist() == [list(x) for x in want]
    w = Writer()
    w.put(0b0_000001_1, 8), w.put(0b01, 2)  # verbatim with two wasted bits
    mono = [rng.randrange(-500, 500) * 4 for _ in range(20)]
    for v in mono:
        w.put(v >> 2, 10)
    assert flac.decode([stream_of([(20, w.bytes())], 20, 0, 12, [[v] for v in mono])])[0][1][:, 0].tolist() == mono
    with pytest.raises(flac.FlacError):
        flac.decode([stream[:-9] + bytes([stream[-9] ^ 4]) + stream[-8:]])


def test_columns(spark):
    long = ("lorem ipsum " * 30_000).encode()
    rows = [(1, None, "x"), (2, b"", "x"), (3, b"abc", None), (3, b"abc", None), (None, long, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, payload binary, feature string").withColumn("pcm", F.lit(1))
    media = flac.encode_column(docs, "payload")
    assert media.columns == [*docs.columns, "media"]
    clash = flac.read_back(media.withColumn("Blocks", F.lit(2)).withColumn("bits", F.lit(3)))
    assert clash.columns == [*docs.columns, "Blocks", "bits", "channels", "bits_", "media_bytes", "media_sha256", "payload_", "feature_"]
    assert flac.read_back(media.select("doc_id", F.lit(None).cast("binary").alias("media"))).where("payload is null").count() == 5
    assert flac.encode_column(docs.withColumn("media", F.lit(1)), "payload").columns[-1] == "media_"
    back = flac.read_back(media.select("doc_id", "media")).collect()
    assert sorted((str(r.doc_id), len(r.payload)) for r in back) == [("1", 576), ("2", 576), ("3", 576), ("3", 576), ("None", 360_000)]
    assert len({(r.media_sha256, r.feature, bytes(r.payload)) for r in back if r.doc_id == 3}) == 1
    blocks = flac.pcm_blocks(media, "doc_id", samples=100_000).where("doc_id is null").sort("block").collect()
    assert [r.sample_offset for r in blocks] == [0, 100_000, 200_000, 300_000]
    joined = np.frombuffer(b"".join(bytes(r.pcm) for r in blocks), np.int8).astype(int) + 128
    assert joined.astype(np.uint8).tobytes()[: len(long)] == long
    assert flac.read_back(flac.encode_column(docs.limit(0), "payload").select("doc_id", "media")).count() == 0


def test_the_encoder_writes_linear_predictors():
    rng, x, wave = random.Random(8), [0.0, 0.0], bytearray()
    for _ in range(576 * 6):
        x.append(1.6 * x[-1] - 0.8 * x[-2] + rng.gauss(0, 6))
        wave.append(max(0, min(255, 128 + int(x[-1]))))
    stream = flac.encode([bytes(wave)])[0]
    frames = flac.frames_of(stream, flac.info_of(stream))
    assert [stream[f.body] >> 1 & 63 for f in frames].count(32 + flac.ORDER - 1) >= 4
    assert (flac.decode([stream])[0][1][:, 0] + 128).astype(np.uint8).tobytes() == bytes(wave) and len(stream) < 0.85 * len(wave)
