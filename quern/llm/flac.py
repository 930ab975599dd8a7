"""Media columns in FLAC: an encoder and a decoder that work on many frames at once, and PCM blocks with sample offsets.

Frames of a batch are decoded side by side.  Those with the same subframe layout advance together, sample by
sample: a 64-bit window at each frame's bit position gives the Rice quotient by its leading zeros and the remainder
by a shift, and linear predictors (fixed ones are a case of these) are run the same way.  Header CRC-8, frame CRC-16
and the MD5 of the samples are verified; a frame that fails raises.  Frame starts are found by the sync code, the
header's CRC-8 and the expected number, and confirmed by CRC-16.

The encoder writes mono 8-bit streams of 576-sample frames: constant, fixed predictors of order 0 to 2, or a linear
predictor of order 7 that is solved for the frame, with Rice partitions, or verbatim where that is smaller, a seek
table for streams of more than 16 frames, and the MD5.  The decoder takes mono and stereo streams of 4 to 24 bits with constant, verbatim, fixed and LPC
subframes, wasted bits and escaped partitions.

pcm_column() turns streams into PCM blocks with their sample offsets, from which payload_column() puts the payload
together again.  Samples are held in as many bytes as they have, so a very long stream takes a few times its size.

Defined cases of the column functions: a null payload counts as empty; a null stream gives no blocks, and no blocks a
null payload; repeated rows stay repeated; other columns stay as they are, and where one has a new column's name,
underscores are put behind the latter; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import fresh, slices

FRAME = 576
SEEK_FRAMES = 16
#: Frames that are worked on side by side.
SIDE = 8192
ENCODE_SIDE = 256
#: The encoder's linear predictors: order, bits of a coefficient, and their shift; what share of the residuals they must save.
ORDER, PRECISION, SHIFT, SAVED = 7, 4, 2, 0.05
#: Samples of a PCM block.
BLOCK = 65_536


class FlacError(ValueError):
    pass


def _crc_table(poly: int, width: int) -> np.ndarray:
    top, mask, found = 1 << (width - 1), (1 << width) - 1, []
    for byte in range(256):
        value = byte << (width - 8)
        for _ in range(8):
            value = ((value << 1) ^ poly if value & top else value << 1) & mask
        found.append(value)
    return np.array(found, np.uint16 if width == 16 else np.uint8)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_CRC8_LIST = _CRC8.tolist()


def _crc8(data: bytes) -> int:
    value = 0
    for byte in data:
        value = _CRC8_LIST[value ^ byte]
    return value


def _side_by_side(chunks: list[bytes], slack: int = 0) -> np.ndarray:
    """Byte strings as rows, zeros in front so that they end together; slack more zeros at the end."""
    sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
    wide = int(sizes.max())
    rows = np.zeros((len(chunks), wide + slack), np.uint8)
    flat = np.frombuffer(b"".join(chunks), np.uint8)
    ends = np.cumsum(sizes)
    rows[:, :wide][np.arange(wide) >= (wide - sizes)[:, None]] = flat
    assert len(flat) == ends[-1]
    return rows


def crc16(chunks: list[bytes]) -> np.ndarray:
    """CRC-16 of each; leading zeros leave it as it is, so all are run together."""
    value = np.zeros(len(chunks), np.uint16)
    for column in np.ascontiguousarray(_side_by_side(chunks).T):
        value = (value << np.uint16(8)) ^ _CRC16[(value >> np.uint16(8)) ^ column]
    return value


def _utf8(number: int) -> bytes:
    """The extended UTF-8 of frame numbers."""
    if number < 0x80:
        return bytes([number])
    size = 2
    while number >= 1 << (5 * size + 1):
        size += 1
    tail = [0x80 | (number >> (6 * i)) & 0x3F for i in range(size - 1)][::-1]
    return bytes([(0xFF00 >> size) & 0xFF | number >> (6 * (size - 1)), *tail])


_HEADERS: dict[int, bytes] = {}


def _header(number: int) -> bytes:
    found = _HEADERS.get(number)
    if found is None:
        head = bytes([0xFF, 0xF8, 0x20, 0x02]) + _utf8(number)
        found = head + bytes([_crc8(head)])
        if len(_HEADERS) < 100_000:
            _HEADERS[number] = found
    return found


# ---- encoding


def _subframes(samples: np.ndarray, parts: int = 8) -> list[bytes]:
    """Encoded subframes of rows of 8-bit samples, each a whole number of bytes."""
    count, length = samples.shape
    x = samples.astype(np.int32)
    residuals = [x, np.diff(x, axis=1, prepend=0), np.diff(x, n=2, axis=1, prepend=np.zeros((count, 2), np.int32))]
    sums = np.stack([np.abs(r[:, 2:]).sum(axis=1) for r in residuals])
    order = sums.argmin(axis=0)
    r = residuals[0]
    for o in (1, 2):
        r = np.where((order == o)[:, None], residuals[o], r)
    factors = _predictors(x)
    guess = sum(factors[:, j, None] * x[:, ORDER - 1 - j : length - 1 - j] for j in range(ORDER)) >> SHIFT
    solved = np.pad(x[:, ORDER:] - guess, ((0, 0), (ORDER, 0)))
    lpc = np.abs(solved).sum(axis=1) < (1 - SAVED) * sums.min(axis=0)
    r, order = np.where(lpc[:, None], solved, r), np.where(lpc, ORDER, order)
    u = (r << 1) ^ (r >> 31)
    place = np.arange(length)
    warm = place < order[:, None]
    u[warm] = 0
    whole = u.reshape(count, parts, -1)
    near = np.clip(np.floor(np.log2(np.maximum(whole.mean(axis=2) * 0.6931, 1))), 0, 8).astype(np.int32)
    tried = np.clip(near + np.arange(-1, 3, dtype=np.int32)[:, None, None], 0, 8)
    sizes = np.stack([(whole >> t[:, :, None]).sum(axis=2) for t in tried]) + (tried + 1) * whole.shape[2]
    k = np.take_along_axis(tried, sizes.argmin(axis=0)[None], axis=0)[0]
    k = np.repeat(k, length // parts, axis=1)
    q = u >> k
    size = np.where(warm, 8, q + 1 + k)
    before = np.where(place % (length // parts) == 0, 4, 0)[None, :].repeat(count, axis=0)
    before[:, 0] = 8
    extra = np.where(lpc, 9 + ORDER * PRECISION, 0)
    before[np.arange(count), order] += 10 + extra
    bits = (before + size).sum(axis=1)
    plain = bits >= 8 * length + 8
    flat = (x == x[:, :1]).all(axis=1)
    coded = np.flatnonzero(~plain & ~flat)
    out: list[bytes] = [b""] * count
    for i in np.flatnonzero(flat).tolist():
        out[i] = bytes([0, int(samples[i, 0]) & 0xFF])
    for i in np.flatnonzero(plain & ~flat).tolist():
        out[i] = b"\x02" + samples[i].tobytes()
    if len(coded):
        u, k, q, size, before, warm, order, x, lpc, factors = (a[coded] for a in (u, k, q, size, before, warm, order, x, lpc, factors))
        nbytes = (bits[coded] + 7) // 8
        base = np.r_[0, np.cumsum(nbytes)]
        start = np.cumsum(before + size, axis=1) - size + 8 * base[:-1, None]
        total = int(base[-1]) + 2

        def put(at: np.ndarray, value: np.ndarray, width: np.ndarray | int) -> np.ndarray:
            """Bytes with each value at its bit position; widths up to 9 reach into two bytes, and nothing overlaps."""
            word = (value << (16 - width - (at & 7))).ravel()
            byte = (at >> 3).ravel()
            return np.bincount(byte, word >> 8, total) + np.bincount(byte + 1, word & 255, total)

        rows = np.arange(len(coded))
        first = start[rows, order]
        edges = np.arange(length // parts, length, length // parts)
        stream = put(np.where(warm, start, start + q), np.where(warm, x & 0xFF, 1 << k | u & ((1 << k) - 1)), np.where(warm, 8, k + 1))
        kind = np.where(lpc, 0b01000000 | (order - 1) << 1, 0b00010000 | order << 1)
        at = (first - 10 - 9 - ORDER * PRECISION)[lpc]
        stream += put(at, np.full(len(at), (PRECISION - 1) << 5 | SHIFT), 9)
        for j in range(ORDER):
            stream += put(at + 9 + j * PRECISION, factors[lpc, j] & (1 << PRECISION) - 1, PRECISION)
        stream += put(8 * base[:-1], kind, 8) + put(first - 10, np.full(len(rows), 3), 6) + put(first - 4, k[:, 0], 4) + put(start[:, edges] - 4, k[:, edges], 4)
        packed = stream.astype(np.uint8).tobytes()
        for i, a, b in zip(coded.tolist(), base[:-1].tolist(), base[1:].tolist()):
            out[i] = packed[a:b]
    return out


def _predictors(x: np.ndarray) -> np.ndarray:
    """[row, coefficient] of each row's linear predictor: the normal equations of its autocorrelation, rounded."""
    v = x.astype(np.float64)
    lags = np.stack([(v[:, k:] * v[:, : v.shape[1] - k]).sum(axis=1) for k in range(ORDER + 1)], axis=1)
    place = np.abs(np.subtract.outer(np.arange(ORDER), np.arange(ORDER)))
    matrix = lags[:, place] + np.eye(ORDER) * (lags[:, :1, None] * 1e-6 + 1)
    found = np.linalg.solve(matrix, lags[:, 1:, None])[:, :, 0]
    most = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(found * (1 << SHIFT)), -most, most).astype(np.int32)


def encode(payloads: list[bytes], rate: int = 8000) -> list[bytes]:
    """FLAC streams of 8-bit mono samples (byte - 128); each payload is a positive multiple of 576 bytes."""
    if not payloads:
        return []
    counts = [len(p) // FRAME for p in payloads]
    if any(not p or len(p) % FRAME for p in payloads):
        raise FlacError("a payload is a positive multiple of 576 bytes")
    bodies: list[bytes] = []
    samples = (np.frombuffer(b"".join(payloads), np.uint8) ^ np.uint8(0x80)).view(np.int8)
    for at in range(0, len(samples), ENCODE_SIDE * FRAME):
        bodies += _subframes(samples[at : at + ENCODE_SIDE * FRAME].reshape(-1, FRAME))
    frames = [h + b for h, b in zip((_header(n) for c in counts for n in range(c)), bodies)]
    for at in range(0, len(frames), SIDE):
        part = frames[at : at + SIDE]
        frames[at : at + SIDE] = [f + int(c).to_bytes(2, "big") for f, c in zip(part, crc16(part).tolist())]
    out, at = [], 0
    for payload, count in zip(payloads, counts):
        own = frames[at : at + count]
        sizes = [len(f) for f in own]
        offset, points = 0, []
        for i, size in enumerate(sizes):
            if i % SEEK_FRAMES == 0:
                points.append((i * FRAME).to_bytes(8, "big") + offset.to_bytes(8, "big") + FRAME.to_bytes(2, "big"))
            offset += size
        md5 = hashlib.md5(samples[at * FRAME : at * FRAME + len(payload)].tobytes()).digest()
        packed = rate << 44 | 0 << 41 | 7 << 36 | len(payload)
        info = FRAME.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + packed.to_bytes(8, "big") + md5
        seek = b"".join(points)
        kept = [b"\x00" + len(info).to_bytes(3, "big") + info, b"\x83" + len(seek).to_bytes(3, "big") + seek] if len(points) > 1 else [b"\x80" + len(info).to_bytes(3, "big") + info]
        out.append(b"fLaC" + b"".join(kept) + b"".join(own))
        at += count
    return out


# ---- decoding


@dataclass
class Info:
    rate: int
    channels: int
    bits: int
    total: int
    md5: bytes
    block: int
    first: int
    seek: list[tuple[int, int, int]] = field(default_factory=list)


def info_of(stream: bytes) -> Info:
    """What the metadata blocks say."""
    if stream[:4] != b"fLaC":
        raise FlacError("not a FLAC stream")
    at, found, seek, last = 4, None, [], False
    while not last:
        head = stream[at : at + 4]
        if len(head) < 4:
            raise FlacError("the metadata are cut off")
        last, kind, size = head[0] >> 7, head[0] & 0x7F, int.from_bytes(head[1:], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            found = Info(packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, body[18:34], int.from_bytes(body[:2], "big"), 0)
        elif kind == 3:
            seek = [(int.from_bytes(body[i : i + 8], "big"), int.from_bytes(body[i + 8 : i + 16], "big"), int.from_bytes(body[i + 16 : i + 18], "big")) for i in range(0, size - 17, 18)]
        at += 4 + size
    if found is None:
        raise FlacError("no STREAMINFO")
    found.first, found.seek = at, [p for p in seek if p[0] != (1 << 64) - 1]
    return found


@dataclass
class Frame:
    start: int
    number: int
    block: int
    channels: int
    bits: int
    body: int
    end: int = 0


def _parse_header(stream: bytes, at: int, info: Info) -> Frame | None:
    """The frame header at a place, if there is a whole one with the right CRC-8."""
    head = stream[at : at + 16]
    if len(head) < 6 or head[0] != 0xFF or head[1] & 0xFE != 0xF8:
        return None
    size_code, rate_code, channel, bits_code = head[2] >> 4, head[2] & 15, head[3] >> 4, head[3] >> 1 & 7
    if not size_code or rate_code == 15 or channel > 10 or bits_code == 3 or head[3] & 1:
        return None
    lead, i = head[4], 5
    extra = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1
    if lead >= 0x80 and not 1 <= extra <= 6:
        return None
    number = lead if lead < 0x80 else lead & (0x3F >> extra)
    for byte in head[i : i + extra]:
        number = number << 6 | byte & 0x3F
    i += extra
    if size_code == 1:
        block = 192
    elif size_code <= 5:
        block = 576 << (size_code - 2)
    elif size_code >= 8:
        block = 256 << (size_code - 8)
    else:
        width = size_code - 5
        block = int.from_bytes(head[i : i + width], "big") + 1
        i += width
    i += {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
    if i >= len(head) or _crc8(head[:i]) != head[i]:
        return None
    bits = {0: info.bits, 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}[bits_code]
    return Frame(at, number, block, channel, bits, at + i + 1)


def frames_of(stream: bytes, info: Info, start: int | None = None) -> list[Frame]:
    """The frames from a place on, by sync code, header CRC-8 and running number."""
    at = info.first if start is None else start
    frame = _parse_header(stream, at, info)
    if frame is None:
        if at == len(stream) and not info.total:
            return []
        raise FlacError(f"no frame at byte {at}")
    found, variable, sync = [frame], stream[at + 1] & 1, stream[at : at + 2]
    while True:
        last, at = found[-1], found[-1].body + 3
        wanted = last.number + (last.block if variable else 1)
        while True:
            at = stream.find(sync, at)
            if at < 0:
                last.end = len(stream)
                return found
            frame = _parse_header(stream, at, info)
            if frame is not None and frame.number == wanted and frame.bits == last.bits:
                break
            at += 1
        last.end = frame.start
        found.append(frame)


class _Bits:
    """Rows of bytes with a bit position each; windows of 64 bits are prepared for every byte."""

    def __init__(self, chunks: list[bytes]):
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        data = np.frombuffer(b"".join(chunks) + bytes(16), np.uint8)
        self.windows = np.ndarray((len(data) - 8,), ">u8", data, strides=(1,)).astype(np.uint64)
        self.ends = 8 * np.cumsum(sizes)
        self.at = np.r_[0, self.ends[:-1]]

    def window(self, at: np.ndarray) -> np.ndarray:
        if at.size and int(at.max()) >> 3 >= len(self.windows):
            raise FlacError("a frame is cut off")
        return self.windows[at >> 3] << (at & 7).astype(np.uint64)

    def take(self, rows: np.ndarray, width: int | np.ndarray, signed: bool = False) -> np.ndarray:
        """Up to 32 bits from each of the rows."""
        at = self.at[rows]
        width = np.broadcast_to(np.asarray(width, np.int64), at.shape)
        value = self.window(at)
        value = np.where(width > 0, value >> (64 - np.maximum(width, 1)).astype(np.uint64), np.uint64(0)).astype(np.int64)
        if signed:
            value = np.where((width > 0) & (value >> np.maximum(width - 1, 0) & 1 > 0), value - (np.int64(1) << width), value)
        self.at[rows] = at + width
        return value

    def unary(self, rows: np.ndarray) -> np.ndarray:
        """Zeros before the next one, which is passed."""
        at = self.at[rows]
        zeros = np.zeros(len(at), np.int64)
        open_ = np.arange(len(at))
        while len(open_):
            top = (self.window(at[open_] + zeros[open_]) >> np.uint64(11)).astype(np.float64)
            here = np.where(top > 0, 52 - ((top.view(np.int64) >> 52) - 1023), 53)
            zeros[open_] += np.minimum(here, 53)
            open_ = open_[top == 0]
        self.at[rows] = at + zeros + 1
        return zeros


def _rice(bits: _Bits, rows: np.ndarray, out: np.ndarray, order: int, block: int, escape: int) -> None:
    """Residuals of rows with one layout, from sample `order` on, into out[sample, row]."""
    depth = bits.take(rows, 4)
    for d in np.unique(depth).tolist():
        own = np.flatnonzero(depth == d)
        sub, per = rows[own], block >> d
        if per << d != block or per < order:
            raise FlacError("partitions do not fit the block")
        for part in range(1 << d):
            param = bits.take(sub, escape)
            raw = param == (1 << escape) - 1
            if raw.any():
                width = np.zeros(len(sub), np.int64)
                width[raw] = bits.take(sub[raw], 5)
                for i in range(order if not part else part * per, (part + 1) * per):
                    out[i, own[raw]] = bits.take(sub[raw], width[raw], signed=True)
            coded = np.flatnonzero(~raw)
            if not len(coded):
                continue
            who, k, place = sub[coded], param[coded], own[coded]
            every = len(place) == out.shape[1]
            at, low = bits.at[who], (64 - k).astype(np.uint64)
            zero, longest = k == 0, int(k.max())
            for i in range(order if not part else part * per, (part + 1) * per):
                window = bits.windows[at >> 3] << (at & 7).astype(np.uint64)
                top = (window >> np.uint64(11)).astype(np.float64)
                q = 1075 - (top.view(np.int64) >> 52)
                if not top.all() or int(q.max()) + 1 + longest > 57:  # beyond the window
                    bits.at[who] = at
                    q = bits.unary(who)
                    value = q << k | bits.take(who, k)
                    at = bits.at[who]
                else:
                    rest = (window << (q + 1).astype(np.uint64)) >> np.minimum(low, np.uint64(63))
                    value = q << k | np.where(zero, 0, rest.astype(np.int64))
                    at = at + q + 1 + k
                value = (value >> 1) ^ -(value & 1)
                if every:
                    out[i] = value
                else:
                    out[i, place] = value
            bits.at[who] = at
    if (bits.at[rows] > bits.ends[rows]).any():
        raise FlacError("a frame is cut off")


def _fixed(order: int) -> list[int]:
    row = [1]
    for _ in range(order):
        row = [a - b for a, b in zip([*row, 0], [0, *row])]
    return [-c for c in row[1:]]


def _subframe(bits: _Bits, block: int, depth: np.ndarray) -> np.ndarray:
    """The next subframe of every row, as [sample, row]; depth is the bits of a sample of each row."""
    count = len(bits.at)
    every = np.arange(count)
    head = bits.take(every, 8)
    if (head >> 7).any():
        raise FlacError("a subframe starts with 1")
    kind, wasted = head >> 1 & 63, np.zeros(count, np.int64)
    if (more := np.flatnonzero(head & 1)).size:
        wasted[more] = bits.unary(more) + 1
    depth, result = depth - wasted, np.zeros((block, count), np.int64)
    for code in np.unique(kind).tolist():
        rows = np.flatnonzero(kind == code)
        own = np.zeros((block, len(rows)), np.int64)
        if code == 0:
            own[:] = bits.take(rows, depth[rows], signed=True)
        elif code == 1:
            width = depth[rows]
            at = bits.at[rows] + np.arange(block)[:, None] * width
            low = (64 - width).astype(np.uint64)
            own[:] = (bits.window(at) >> low).astype(np.int64)
            own -= (own >> (width - 1) & 1) << width
            bits.at[rows] += block * width
        elif 8 <= code <= 12 or code >= 32:
            order = code - 8 if code < 32 else code - 31
            if order > block:
                raise FlacError("a predictor is longer than its block")
            for i in range(order):
                own[i] = bits.take(rows, depth[rows], signed=True)
            if code >= 32:
                precision = bits.take(rows, 4) + 1
                shift = bits.take(rows, 5, signed=True)
                if (precision == 16).any() or (shift < 0).any():
                    raise FlacError("a predictor that is not allowed")
                factors = [bits.take(rows, precision, signed=True) for _ in range(order)]
            else:
                shift, factors = None, _fixed(order)
            method = bits.take(rows, 2)
            for m in np.unique(method).tolist():
                if m > 1:
                    raise FlacError("an unknown residual coding")
                sub = np.flatnonzero(method == m)
                if len(sub) == len(rows):
                    _rice(bits, rows, own, order, block, 4 + m)
                else:
                    part = np.zeros((block, len(sub)), np.int64)
                    _rice(bits, rows[sub], part, order, block, 4 + m)
                    own[order:, sub] = part[order:]
            if order:
                for i in range(order, block):
                    ahead = factors[0] * own[i - 1]
                    for j in range(1, order):
                        ahead = ahead + factors[j] * own[i - 1 - j]
                    own[i] += ahead if shift is None else ahead >> shift
        else:
            raise FlacError(f"an unknown subframe {code}")
        result[:, rows] = own
    return result << wasted


def _samples(chunks: list[bytes], block: int, channel: int, bits_: int) -> np.ndarray:
    """[frame, sample, channel] of frames of one shape, given without header and CRC-16."""
    bits, count = _Bits(chunks), len(chunks)
    channels = 2 if channel >= 8 else channel + 1
    found = []
    for c in range(channels):
        wider = {8: 1, 9: 0, 10: 1}.get(channel) == c
        found.append(_subframe(bits, block, np.full(count, bits_ + wider)).T)
    if (bits.ends - bits.at >= 8).any() or (bits.at > bits.ends).any():
        raise FlacError("a frame is longer or shorter than its samples")
    if channel == 8:
        found[1] = found[0] - found[1]
    elif channel == 9:
        found[0] = found[0] + found[1]
    elif channel == 10:
        side = found[1]
        middle = (found[0] << 1) | (side & 1)
        found = [(middle + side) >> 1, (middle - side) >> 1]
    return np.stack(found, axis=2)


def _decode_frames(streams: list[bytes], frames: list[tuple[int, Frame]]) -> list[np.ndarray]:
    """[sample, channel] of each (stream, frame), CRC-16 verified."""
    out: list = [None] * len(frames)
    groups: dict[tuple, list[int]] = {}
    for i, (_, f) in enumerate(frames):
        groups.setdefault((f.block, f.channels, f.bits), []).append(i)
    for (block, channel, bits), own in groups.items():
        side = max(1, SIDE * FRAME // block)
        for at in range(0, len(own), side):
            part = own[at : at + side]
            whole = [streams[frames[i][0]][frames[i][1].start : frames[i][1].end] for i in part]
            if crc16(whole).any():
                raise FlacError("a frame's CRC-16 is wrong")
            cut = [w[frames[i][1].body - frames[i][1].start : -2] for i, w in zip(part, whole)]
            for i, x in zip(part, _samples(cut, block, channel, bits).astype(np.int8 if bits <= 8 else np.int16 if bits <= 16 else np.int32)):
                out[i] = x
    return out


def _settle(stream: bytes, frames: list[Frame]) -> list[Frame]:
    """Frames whose CRC-16 fails take in the next one's bytes: its start was no frame's."""
    bad = np.flatnonzero(crc16([stream[f.start : f.end] for f in frames])).tolist() if frames else []
    drop = set()
    for i in bad:
        if i in drop:
            continue
        j = i
        while j + 1 < len(frames) and crc16([stream[frames[i].start : frames[i].end]])[0]:
            j += 1
            frames[i].end = frames[j].end
            drop.add(j)
    return [f for i, f in enumerate(frames) if i not in drop]


def decode(streams: list[bytes], verify: bool = True) -> list[tuple[Info, np.ndarray]]:
    """(info, [sample, channel]) of each stream, as 64-bit numbers; checksums, sizes and MD5 are verified."""
    return [(info, x.astype(np.int64)) for info, x in _decoded(streams, verify)]


def _decoded(streams: list[bytes], verify: bool = True) -> list[tuple[Info, np.ndarray]]:
    """As decode(), in numbers just wide enough."""
    infos, frames = [info_of(s) for s in streams], []
    for i, (stream, info) in enumerate(zip(streams, infos)):
        frames += [(i, f) for f in frames_of(stream, info)]
    try:
        parts = _decode_frames(streams, frames)
    except FlacError:
        frames = [(i, f) for i, s in enumerate(streams) for f in _settle(s, [g for j, g in frames if j == i])]
        parts = _decode_frames(streams, frames)
    per: list[list[np.ndarray]] = [[] for _ in streams]
    for (i, _), x in zip(frames, parts):
        per[i].append(x)
    out = []
    for info, own in zip(infos, per):
        samples = np.concatenate(own) if own else np.zeros((0, info.channels), np.int8)
        if info.total and len(samples) != info.total:
            raise FlacError(f"{len(samples)} samples instead of {info.total}")
        if verify and any(info.md5) and hashlib.md5(pcm(samples, info.bits)).digest() != info.md5:
            raise FlacError("the samples' MD5 is wrong")
        out.append((info, samples))
    return out


def pcm(samples: np.ndarray, bits: int) -> bytes:
    """Interleaved little-endian signed PCM in whole bytes."""
    if bits <= 8:
        return np.ascontiguousarray(samples, np.int8).tobytes()
    if bits <= 16:
        return np.ascontiguousarray(samples, "<i2").tobytes()
    wide = np.ascontiguousarray(samples, "<i4")
    return wide.tobytes() if bits > 24 else wide.reshape(-1, 1).view(np.uint8)[:, :3].tobytes()


def read_at(stream: bytes, sample: int, count: int) -> np.ndarray:
    """Samples [sample, sample + count) by the seek table: frames before the nearest point are not decoded."""
    info = info_of(stream)
    point = max((p for p in info.seek if p[0] <= sample), default=(0, 0, 0))
    frames, at, wanted = frames_of(stream, info, info.first + point[1]), point[0], []
    for f in frames:
        if at + f.block > sample and at < sample + count:
            wanted.append((at, f))
        at += f.block
    parts = _decode_frames([stream], [(0, f) for _, f in wanted])
    joined = np.concatenate(parts).astype(np.int64) if parts else np.zeros((0, info.channels), np.int64)
    begin = sample - wanted[0][0] if wanted else 0
    return joined[begin : begin + count]


# ---- columns

BLOCKS = "array<struct<sample_offset:bigint,n_samples:int,pcm:binary>>"
_BLOCKS = pa.list_(pa.struct([("sample_offset", pa.int64()), ("n_samples", pa.int32()), ("pcm", pa.binary())]))


def encode_column(docs: DataFrame, payload: str, media: str = "media") -> DataFrame:
    """docs with a FLAC stream of a binary column: bytes 255 fill it up to a positive multiple of 576."""
    media, body = fresh(docs, media, "body")
    schema = docs.withColumn(media, F.lit(None).cast("binary")).schema
    width = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, body, 6 << 20):
            padded = [b + b"\xff" * (-len(b) % FRAME or (0 if b else FRAME)) for b in (x or b"" for x in batch.column(body).to_pylist())]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(width)], pa.array(encode(padded), pa.binary())], names=schema.names)

    return docs.withColumn(body, F.col(payload)).mapInArrow(run, schema)


def pcm_column(media_rows: DataFrame, media: str = "media", samples: int = BLOCK) -> DataFrame:
    """media_rows, without the stream, with its blocks (sample_offset, n_samples, pcm), channels, bits, media_bytes and media_sha256."""
    kept = [c for c in media_rows.columns if c != media]
    kinds = {"blocks": F.lit(None).cast(BLOCKS), **{k: F.lit(None).cast(t) for k, t in (("channels", "int"), ("bits", "int"), ("media_bytes", "long"), ("media_sha256", "string"))}}
    schema = media_rows.select(*kept, *[v.alias(k) for k, v in zip(fresh(media_rows.select(*kept), *kinds), kinds.values())]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, media, 6 << 20):
            streams = batch.column(media).to_pylist()
            found = iter(_decoded([s for s in streams if s is not None]))
            rows: list[tuple] = []
            for s in streams:
                if s is None:
                    rows.append((None, None, None, None, None))
                    continue
                info, x = next(found)
                cut = [{"sample_offset": a, "n_samples": min(samples, len(x) - a), "pcm": pcm(x[a : a + samples], info.bits)} for a in range(0, len(x), samples)]
                rows.append((cut, info.channels, info.bits, len(s), hashlib.sha256(s).hexdigest()))
            added = [pa.array(values, kind) for values, kind in zip(zip(*rows), (_BLOCKS, pa.int32(), pa.int32(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *added], names=schema.names)

    return media_rows.mapInArrow(run, schema)


def pcm_blocks(media_rows: DataFrame, key: str, media: str = "media", samples: int = BLOCK) -> DataFrame:
    """(key, block, sample_offset, n_samples, channels, bits, pcm): a row for each PCM block of so many samples."""
    found = pcm_column(media_rows.select(F.col(key).alias("k"), F.col(media).alias("media")), "media", samples)
    each = found.select(F.col("k").alias(key), "channels", "bits", F.posexplode("blocks").alias("block", "b"))
    return each.select(key, "block", "b.sample_offset", "b.n_samples", "channels", "bits", "b.pcm")


def features(blocks: list[np.ndarray]) -> str:
    """Peak, energy and sign changes of samples, and the mean's numerator; whole numbers, so exact."""
    n = total = peak = energy = changes = 0
    last = None
    for block in blocks:
        flat = block.astype(np.int64).ravel()
        if not len(flat):
            continue
        sign = flat < 0
        changes += int((sign[1:] != sign[:-1]).sum()) + (last is not None and bool(sign[0]) != last)
        last = bool(sign[-1])
        n, total, peak, energy = n + len(flat), total + int(flat.sum()), max(peak, int(np.abs(flat).max())), energy + int((flat * flat).sum())
    return f"n={n};sum={total};peak={peak};energy={energy};changes={changes}"


def payload_column(rows: DataFrame, blocks: str = "blocks") -> DataFrame:
    """rows, without their blocks of 8-bit samples, with the payload (byte = sample + 128) and a feature of the samples.

    Blocks are put in the order of their offsets, which must leave no gap.
    """
    kept = [c for c in rows.columns if c != blocks]
    payload, feature = fresh(rows.select(*kept), "payload", "feature")
    schema = rows.select(*kept, F.lit(None).cast("binary").alias(payload), F.lit(None).cast("string").alias(feature)).schema

    def whole(found: list[dict] | None) -> tuple[bytes | None, str | None]:
        if found is None:
            return None, None
        found = sorted(found, key=lambda b: b["sample_offset"])
        at, parts = 0, []
        for b in found:
            if b["sample_offset"] != at or len(b["pcm"]) != b["n_samples"]:
                raise FlacError("the blocks of a stream leave a gap")
            at += b["n_samples"]
            parts.append(np.frombuffer(b["pcm"], np.int8))
        return b"".join((p.view(np.uint8) ^ np.uint8(0x80)).tobytes() for p in parts), features(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                made = [whole(x) for x in part.column(blocks).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array([p for p, _ in made], pa.binary()), pa.array([f for _, f in made], pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def read_back(media_rows: DataFrame, media: str = "media") -> DataFrame:
    """media_rows, without the stream, with what its PCM blocks give: channels, bits, media_bytes, media_sha256, payload, feature."""
    kept = [c for c in media_rows.columns if c != media]
    (blocks,) = fresh(media_rows.select(*kept), "blocks")
    return payload_column(pcm_column(media_rows, media), blocks)
