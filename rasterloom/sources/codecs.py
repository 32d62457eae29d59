"""Block codecs in numpy and the standard library: compressions, predictors, packed bits and subsampled chroma."""

from __future__ import annotations

import functools
import zlib

import numpy as np

from rasterloom.sources.errors import DecodeFailed, UnsupportedCompression

# Compression codes of the TIFF format.
NONE, LZW, OLD_JPEG, JPEG, DEFLATE, PACKBITS, OLD_DEFLATE, LERC, ZSTD = 1, 5, 6, 7, 8, 32773, 32946, 34887, 50000
NAMES = {NONE: "none", LZW: "lzw", OLD_JPEG: "old-jpeg", JPEG: "jpeg", DEFLATE: "deflate", PACKBITS: "packbits", OLD_DEFLATE: "old-deflate", LERC: "lerc", ZSTD: "zstd"}


def inflate(data: bytes, most: int) -> bytes:
    """What a zlib stream holds, up to what the block needs."""
    try:
        return zlib.decompressobj().decompress(data, most)
    except zlib.error as e:
        raise DecodeFailed(f"deflate: {e}") from e


def zstd_decode(data: bytes, most: int) -> bytes:
    import zstandard

    try:
        with zstandard.ZstdDecompressor().stream_reader(data) as r:
            return r.read(most)
    except zstandard.ZstdError as e:
        raise DecodeFailed(f"zstd: {e}") from e


def zstd_encode(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(data)


@functools.cache
def _lzw_schedule() -> tuple[np.ndarray, np.ndarray]:
    """Widths of the codes after a clear, and the bit at which each starts: they follow from a code's place alone."""
    size = 258 + np.maximum(0, np.arange(1 << 12) - 1)
    width = np.select([size < 511, size < 1023, size < 2047], [9, 10, 11], 12)
    return width, np.r_[0, np.cumsum(width)[:-1]]


def lzw_decode(data: bytes, most: int) -> bytes:
    """Codes of 9 to 12 bits, high bits first, that widen one code early; 256 clears, 257 ends.

    A table's entry is what its code gave and the byte after, so it is a piece of the output: codes are taken out of the
    bits many at a time, and words are copied from where they first came.
    """
    width, starts = _lzw_schedule()
    raw, bits = np.frombuffer(data + bytes(3), np.uint8).astype(np.uint32), 8 * len(data)
    out, at, ended = bytearray(), 0, False
    while not ended and len(out) < most:
        begins: list[int] = []  # of this table's words in the output
        cleared = False
        while not cleared and not ended:
            w, s = (width, at + starts) if not begins else (np.full(len(width), 12), at + 12 * np.arange(len(width)))
            there = int(np.searchsorted(s + w, bits, side="right"))
            w, s = w[:there], s[:there]
            k = s >> 3
            codes = ((raw[k] << 16 | raw[k + 1] << 8 | raw[k + 2]) >> (24 - (s & 7) - w).astype(np.uint32)) & ((1 << w) - 1).astype(np.uint32)
            marks = np.flatnonzero((codes == 256) | (codes == 257))
            n = int(marks[0]) if len(marks) else there
            for code in codes[:n].tolist():
                if len(out) >= most:
                    return bytes(out)
                here, entry = len(out), code - 258
                begins.append(here)
                if entry < 0:
                    out.append(code)
                elif entry < len(begins) - 1:
                    first = begins[entry]
                    out += out[first : begins[entry + 1] + 1]
                    if entry == len(begins) - 2:  # the entry that this very code completes
                        out.append(out[first])
                else:
                    raise DecodeFailed("lzw: the first code is no byte" if len(begins) == 1 else f"lzw: code {code} of {257 + len(begins)}")
            if len(marks):
                cleared, ended = codes[n] == 256, codes[n] == 257
                at = int(s[n] + w[n])
            else:
                at = int(s[-1] + w[-1]) if there else at
                ended = there < len(width)
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    out = bytearray()
    held = bits = 0
    width, table = 9, {bytes([i]): i for i in range(256)}

    def put(code: int) -> None:
        nonlocal held, bits
        held = held << width | code
        bits += width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    put(256)
    word, following = b"", 258
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = following
        following += 1
        if following == 4095:
            put(256)
            table = {bytes([k]): k for k in range(256)}
            width, following = 9, 258
        elif following + 1 > 1 << width:
            width += 1
        word = data[i : i + 1]
    if word:
        put(table[word])
        following += 1
        if following + 1 > 1 << width and width < 12:
            width += 1
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def packbits_decode(data: bytes, most: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < most:
        n = data[i]
        i += 1
        if n < 128:
            if i + n + 1 > len(data):
                raise DecodeFailed("packbits: literals are cut off")
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            if i >= len(data):
                raise DecodeFailed("packbits: a repeat is cut off")
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    """Runs of three bytes or more as repeats, all else as literals; for tests, as files are not written so."""
    out, i, literal = bytearray(), 0, 0

    def flush(end: int) -> None:
        for a in range(literal, end, 128):
            part = data[a : min(a + 128, end)]
            out.append(len(part) - 1)
            out.extend(part)

    while i < len(data):
        j = i
        while j < len(data) and data[j] == data[i] and j - i < 128:
            j += 1
        if j - i >= 3:
            flush(i)
            out.extend((257 - (j - i), data[i]))
            literal = j
        i = j
    flush(len(data))
    return bytes(out)


def decompress(code: int, data: bytes, most: int) -> bytes:
    """A block's bytes, `most` at most; LERC and JPEG blocks give samples and have functions of their own."""
    if code == NONE:
        return bytes(data[:most])
    if code in (DEFLATE, OLD_DEFLATE):
        return inflate(data, most)
    if code == LZW:
        return lzw_decode(data, most)[:most]
    if code == PACKBITS:
        return packbits_decode(data, most)[:most]
    if code == ZSTD:
        return zstd_decode(data, most)
    raise UnsupportedCompression(f"compression {code} ({NAMES.get(code, 'unknown')})")


def compress(code: int, data: bytes) -> bytes:
    if code == NONE:
        return data
    if code in (DEFLATE, OLD_DEFLATE):
        return zlib.compress(data, 6)
    if code == LZW:
        return lzw_encode(data)
    if code == ZSTD:
        return zstd_encode(data)
    raise UnsupportedCompression(f"compression {code} ({NAMES.get(code, 'unknown')}) is not written")


# Predictors, over [rows, cols, samples]


def forward_horizontal(samples: np.ndarray) -> np.ndarray:
    """Differences to the pixel before; floats are differenced as the whole numbers of their bits."""
    bits = samples.view(f"u{samples.itemsize}")
    out = bits.copy()
    out[:, 1:] -= bits[:, :-1]
    return out


def undo_horizontal(bits: np.ndarray) -> np.ndarray:
    return np.cumsum(bits, axis=1, dtype=bits.dtype)


def forward_float(samples: np.ndarray) -> bytes:
    """Each row's bytes by significance, highest first, then differences at the pixel's distance over the whole row."""
    rows, cols, spp = samples.shape
    planes = samples.astype(samples.dtype.newbyteorder(">")).view(np.uint8).reshape(rows, cols * spp, samples.itemsize).transpose(0, 2, 1).reshape(rows, -1)
    out = planes.copy()
    out[:, spp:] -= planes[:, :-spp]
    return out.tobytes()


def undo_float(data: bytes, rows: int, cols: int, spp: int, dtype: np.dtype) -> np.ndarray:
    size = dtype.itemsize
    delta = np.frombuffer(data, np.uint8).reshape(rows, cols * size, spp)
    planes = np.cumsum(delta, axis=1, dtype=np.uint8).reshape(rows, size, cols * spp)
    big = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(dtype.newbyteorder(">")).reshape(rows, cols, spp)
    return big.astype(dtype)


# Packed samples


def unpack_bits(data: bytes, rows: int, row_samples: int, bits: int) -> np.ndarray:
    """[rows, row_samples] of samples below eight bits, high bits first; each row starts at a byte."""
    width = (row_samples * bits + 7) // 8
    flags = np.unpackbits(np.frombuffer(data, np.uint8)[: rows * width].reshape(rows, width), axis=1)
    cut = flags[:, : row_samples * bits].reshape(rows, row_samples, bits)
    return (cut * (1 << np.arange(bits - 1, -1, -1, dtype=np.uint8))).sum(axis=2, dtype=np.uint8)


def upsample_chroma(data: bytes, rows: int, cols: int, h: int, v: int, dtype: np.dtype) -> np.ndarray:
    """[rows, cols, 3] of units that hold h x v lumas and one pair of chromas."""
    across, down = -(-cols // h), -(-rows // v)
    units = np.frombuffer(data, dtype)[: across * down * (h * v + 2)].reshape(down, across, h * v + 2)
    luma = units[:, :, : h * v].reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    chroma = [np.repeat(np.repeat(units[:, :, h * v + k], v, axis=0), h, axis=1) for k in (0, 1)]
    return np.stack([luma, *chroma], axis=2)[:rows, :cols]
