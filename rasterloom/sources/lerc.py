"""LERC2 blobs, by the published format: constant, one-sweep, bit-stuffed and Huffman-coded, with masks, depths and bands."""

from __future__ import annotations

import struct

import numpy as np

from rasterloom.sources import codecs
from rasterloom.sources.errors import DecodeFailed, UnsupportedCompression

# LERC's data types, in its order.
TYPES = ["i1", "u1", "i2", "u2", "i4", "u4", "f4", "f8"]
MAGIC = b"Lerc2 "


def fletcher32(data: bytes) -> int:
    """The checksum of 16-bit words, high byte first, from 0xffff."""
    words = np.frombuffer(data + b"\0" * (len(data) & 1), ">u2").astype(np.uint64)
    a = b = 0xFFFF
    for at in range(0, len(words), 359):
        part = words[at : at + 359]
        sums = np.cumsum(part) + np.uint64(a)
        a, b = int(sums[-1]), b + int(sums.sum())
        a, b = (a & 0xFFFF) + (a >> 16), (b & 0xFFFF) + (b >> 16)
        b = (b & 0xFFFF) + (b >> 16)
    return ((b & 0xFFFF) + (b >> 16)) << 16 | ((a & 0xFFFF) + (a >> 16))


def _mask(data: bytes, n: int) -> np.ndarray:
    out, at = bytearray(), 0
    while True:
        count = struct.unpack_from("<h", data, at)[0]
        at += 2
        if count == -32768:
            break
        if count > 0:
            out += data[at : at + count]
            at += count
        else:
            out += data[at : at + 1] * -count
            at += 1
    return np.unpackbits(np.frombuffer(bytes(out), np.uint8))[:n].astype(bool)


def _reduced_type(kind: int, code: int) -> int:
    """The smaller type that an offset is kept in."""
    if kind in (2, 4):
        return kind - code
    if kind in (3, 5):
        return kind - 2 * code
    if kind == 6:
        return (6, 2, 1)[code]
    if kind == 7:
        return 7 if code == 0 else 8 - 2 * code
    return kind


def _unstuff(data: bytes, at: int, version: int) -> tuple[np.ndarray, int]:
    """Numbers of a few bits each, and where they end."""
    head = data[at]
    at += 1
    wide, bits = head >> 6, head & 31
    n_bytes = 4 if wide == 0 else 3 - wide
    n = int.from_bytes(data[at : at + n_bytes], "little")
    at += n_bytes
    table = None

    def take(count: int, bits: int, at: int) -> tuple[np.ndarray, int]:
        size = (count * bits + 7) // 8
        raw = data[at : at + size]
        if version >= 3:
            flags = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[: count * bits].reshape(count, bits)
            return (flags.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(axis=1), at + size
        words = [int.from_bytes(raw[k : k + 4], "little") << 8 * (4 - len(raw[k : k + 4])) for k in range(0, size, 4)]
        flags = np.unpackbits(np.array(words, ">u4").view(np.uint8))[: count * bits].reshape(count, bits)
        return (flags.astype(np.uint64) << np.arange(bits - 1, -1, -1, dtype=np.uint64)).sum(axis=1), at + size

    if head & 32:
        entries = data[at] - 1
        at += 1
        table, at = take(entries, bits, at)
        index, at = take(n, max(1, entries.bit_length()), at)
        return np.concatenate([[0], table]).astype(np.uint64)[index.astype(np.int64)], at
    if not bits:
        return np.zeros(n, np.uint64), at
    return take(n, bits, at)


def _high_first(data: bytes, at: int) -> str:
    """The bits of little-endian 32-bit words, each word's high bits first."""
    words = np.frombuffer(data, "<u4", (len(data) - at) // 4, at).astype(">u4")
    return "".join(map(str, np.unpackbits(words.view(np.uint8)).tolist()))


def _huffman(data: bytes, at: int, version: int, valid: np.ndarray, depth: int, deltas: bool, offset: int) -> np.ndarray:
    """[rows * cols, depth] of 8-bit samples by a code table; deltas are to the sample left, else above, else before."""
    table_version, size, first, last = struct.unpack_from("<iiii", data, at)
    if table_version < 2 or not 0 < size <= 1 << 15 or not first < last <= first + size:
        raise DecodeFailed("a LERC2 code table that is none")
    lengths, at = _unstuff(data, at + 16, version)
    bits, here = _high_first(data, at), 0
    symbols = {}
    for k, n in enumerate(lengths.tolist()):
        if n:
            symbols[bits[here : here + n]] = (first + k) % size
            here += n
    at += 4 * -(-here // 32)
    bits, here = _high_first(data, at), 0
    widths = sorted({len(k) for k in symbols})

    def symbol() -> int:
        nonlocal here
        for n in widths:
            if (s := symbols.get(bits[here : here + n])) is not None and here + n <= len(bits):
                here += n
                return s
        raise DecodeFailed("LERC2 data that no code begins")

    rows, cols = valid.shape
    out = np.zeros((rows, cols, depth), np.int64)
    wrap = lambda v: (v + offset & 255) - offset
    if not deltas:
        for y, x in zip(*np.nonzero(valid), strict=True):
            for d in range(depth):
                out[y, x, d] = symbol() - offset
        return out.reshape(-1, depth)
    for d in range(depth):
        before = 0
        for y, x in zip(*np.nonzero(valid), strict=True):
            base = before if x and valid[y, x - 1] or not (y and valid[y - 1, x]) else int(out[y - 1, x, d])
            before = out[y, x, d] = wrap(symbol() - offset + base)
    return out.reshape(-1, depth)


def decode_blob(data: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """([rows, cols, depth], valid [rows, cols], bytes used) of one blob."""
    if data[:6] != MAGIC:
        raise DecodeFailed("no LERC2 blob")
    version = struct.unpack_from("<i", data, 6)[0]
    if not 1 <= version <= 5:
        raise UnsupportedCompression(f"LERC2 version {version}")
    at = 10
    checksum = None
    if version >= 3:
        checksum = struct.unpack_from("<I", data, at)[0]
        at += 4
    rows, cols = struct.unpack_from("<ii", data, at)
    at += 8
    depth = 1
    if version >= 4:
        depth = struct.unpack_from("<i", data, at)[0]
        at += 4
    n_valid, micro, size, kind = struct.unpack_from("<iiii", data, at)
    at += 16
    error, low, high = struct.unpack_from("<ddd", data, at)
    at += 24
    if size > len(data) or not 0 <= kind < 8 or rows < 1 or cols < 1 or depth < 1:
        raise DecodeFailed("a LERC2 header that does not fit its data")
    if checksum is not None and fletcher32(data[14:size]) != checksum:
        raise DecodeFailed("a LERC2 checksum does not match")
    dtype = np.dtype("<" + TYPES[kind])
    mask_bytes = struct.unpack_from("<i", data, at)[0]
    at += 4
    valid = np.full(rows * cols, n_valid > 0) if n_valid in (0, rows * cols) else _mask(data[at : at + mask_bytes], rows * cols)
    at += mask_bytes
    out = np.zeros((rows * cols, depth), dtype)
    valid = valid.reshape(rows, cols)
    done = lambda: (out.reshape(rows, cols, depth), valid, size)
    if not n_valid:
        return done()
    flat = valid.ravel()
    if low == high:
        out[flat] = np.array(low).astype(dtype)
        return done()
    highs = np.full(depth, high)
    if version >= 4:
        lows, highs = (np.frombuffer(data, dtype, depth, at + k * depth * dtype.itemsize) for k in (0, 1))
        at += 2 * depth * dtype.itemsize
        if (lows == highs).all():
            out[flat] = lows
            return done()
    sweep = data[at]
    at += 1
    if sweep:
        out[flat] = np.frombuffer(data, dtype, n_valid * depth, at).reshape(n_valid, depth)
        return done()
    if version >= 2 and kind in (0, 1) and error == 0.5:
        mode = data[at]
        at += 1
        if mode:
            out[:] = _huffman(data, at, version, valid, depth, mode == 1, 128 if kind == 0 else 0).astype(dtype)
            return done()
    cube = out.reshape(rows, cols, depth)
    for y in range(0, rows, micro):
        for x in range(0, cols, micro):
            here = valid[y : y + micro, x : x + micro]
            n = int(here.sum())
            for d in range(depth):
                tile = cube[y : y + micro, x : x + micro, d]
                flag = data[at]
                at += 1
                code, difference = flag & 3, version >= 5 and flag & 4
                if (flag >> 2 & (14 if version >= 5 else 15)) != (x >> 3 & (14 if version >= 5 else 15)):
                    raise DecodeFailed("a LERC2 tile out of place")
                before = cube[y : y + micro, x : x + micro, d - 1][here].astype(np.float64) if difference and d else 0.0
                if code == 2:
                    tile[here] = np.asarray(before + np.zeros(n)).astype(dtype)
                    continue
                if code == 0:
                    tile[here] = np.frombuffer(data, dtype, n, at)
                    at += n * dtype.itemsize
                    continue
                small = np.dtype("<" + TYPES[_reduced_type(4 if difference and kind < 6 else kind, flag >> 6)])
                offset = float(np.frombuffer(data, small, 1, at)[0])
                at += small.itemsize
                values = np.full(n, offset)
                if code == 1:
                    quants, at = _unstuff(data, at, version)
                    values = offset + quants[:n].astype(np.float64) * 2 * error
                tile[here] = np.minimum(before + values, highs[d]).astype(dtype)
    return done()


def decode(data: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    """All blobs, one after another: the bands of a set."""
    out, at = [], 0
    while data[at : at + 6] == MAGIC:
        values, valid, size = decode_blob(data[at:])
        out.append((values, valid))
        at += size
    if not out:
        raise DecodeFailed("no LERC2 blob")
    return out


def decode_block(data: bytes, additional: int, h: int, w: int, spp: int, dtype: np.dtype) -> np.ndarray:
    """[h, w, spp] of a TIFF block, whose blob may be deflated (1) or in zstd (2); what the mask hides is NaN or 0."""
    most = 4 * h * w * spp * 8 + 65536
    data = codecs.inflate(data, most) if additional == 1 else codecs.zstd_decode(data, most) if additional == 2 else data
    bands = decode(data)
    if len(bands) == 1 and bands[0][0].shape[2] == spp:
        values, valid = bands[0][0], np.broadcast_to(bands[0][1][:, :, None], bands[0][0].shape)
    elif len(bands) == spp and all(b.shape[2] == 1 for b, _ in bands):
        values, valid = np.concatenate([b for b, _ in bands], axis=2), np.stack([v for _, v in bands], axis=2)
    else:
        raise DecodeFailed(f"{len(bands)} LERC bands of depth {bands[0][0].shape[2]} for {spp} samples")
    if values.shape != (h, w, spp) or values.dtype != dtype.newbyteorder("<"):
        raise DecodeFailed(f"LERC samples {values.shape} {values.dtype} for a block of {(h, w, spp)} {dtype}")
    return np.where(valid, values, np.array(np.nan if dtype.kind == "f" else 0, dtype)).astype(dtype)


def encode(samples: np.ndarray, max_error: float = 0.0) -> bytes:
    """A blob of version 4 for [rows, cols, depth]: constant, quantised tiles where an error is allowed, else one sweep."""
    rows, cols, depth = samples.shape
    name = f"{samples.dtype.kind}{samples.dtype.itemsize}"
    if name not in TYPES:
        raise UnsupportedCompression(f"LERC holds no {samples.dtype}")
    kind = TYPES.index(name)
    data = samples.astype("<" + name)
    flat = data.reshape(-1, depth)
    if name[0] == "f" and not np.isfinite(flat).all():
        max_error = 0.0
    low, high = float(np.nanmin(flat.astype(np.float64))) if flat.size else 0.0, float(np.nanmax(flat.astype(np.float64))) if flat.size else 0.0
    error = max_error if name[0] == "f" else max(0.5, np.floor(max_error))
    micro, body = 8, b""
    constant = low == high and not (name[0] == "f" and np.isnan(flat).any())
    if not constant:
        body = flat.min(axis=0).tobytes() + flat.max(axis=0).tobytes()
        tiles = _tiles(data, kind, error, micro) if name[0] == "f" and max_error > 0 else None
        body += b"\0" + tiles if tiles is not None and len(tiles) < flat.nbytes else b"\1" + flat.tobytes()
    head = struct.pack("<iiiiiiiddd", rows, cols, depth, rows * cols, micro, 10 + 4 + 28 + 24 + 4 + len(body), kind, error, low, high) + struct.pack("<i", 0)
    tail = head + body
    return MAGIC + struct.pack("<iI", 4, fletcher32(tail)) + tail


def _tiles(data: np.ndarray, kind: int, error: float, micro: int) -> bytes | None:
    """Bit-stuffed tiles of quantised differences to each tile's least; None if a number takes over 30 bits."""
    rows, cols, depth = data.shape
    out = bytearray()
    size = data.dtype
    for y in range(0, rows, micro):
        for x in range(0, cols, micro):
            place = (x >> 3 & 15) << 2
            for d in range(depth):
                v = data[y : y + micro, x : x + micro, d].ravel().astype(np.float64)
                q = np.floor((v - v.min()) / (2 * error) + 0.5).astype(np.uint64)
                bits = int(q.max()).bit_length()
                if bits > 30:
                    return None
                if not bits:
                    out += bytes([place | 3]) + np.array([v.min()], size).tobytes()
                    continue
                flags = (q[:, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
                out += bytes([place | 1]) + np.array([v.min()], size).tobytes() + bytes([2 << 6 | bits, len(q)]) + np.packbits(flags.ravel(), bitorder="little").tobytes()
    return bytes(out)
