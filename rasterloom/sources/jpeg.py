"""Baseline JPEG in numpy: sequential Huffman-coded images of 8-bit samples, and gray images written.

Progressive, arithmetic and 12-bit images are refused. Tables may come from elsewhere, as TIFF keeps them.
"""

from __future__ import annotations

import numpy as np

from rasterloom.sources.errors import DecodeFailed, UnsupportedCompression


def _zigzag() -> np.ndarray:
    """Places of the 64 coefficients, along diagonals that turn."""
    return np.array([r * 8 + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))])


ZIGZAG = _zigzag()
K = np.arange(8)
#: The cosine transform: rows are frequencies.
DCT = np.where(K[:, None] == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * K[None, :] + 1) * K[:, None] * np.pi / 16)
# The luminance quantisation table and the lengths and symbols of the DC code in the JPEG standard, annex K.
QUANT = np.array(
    [16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
     18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99]
)
DC_LENGTHS, DC_SYMBOLS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], list(range(12))


def _ac_table() -> tuple[list[int], list[int]]:
    """Code lengths and symbols for run lengths and sizes: a prefix code of our own, which files carry with them; neither the standard's nor the shortest."""
    symbols = [0x00, *(0x00 | s for s in range(1, 6)), *(r << 4 | 1 for r in range(1, 8))]
    rest = [r << 4 | s for s in range(1, 11) for r in range(16)] + [0xF0]
    symbols += [s for s in rest if s not in symbols]
    lengths = [0] * 16
    # 13 common symbols of 5 bits, 30 of 7, and the rest of 10 bits, with room to spare.
    lengths[4], lengths[6] = 13, 30
    lengths[9] = len(symbols) - 43
    return lengths, symbols


def _codes(lengths: list[int], symbols: list[int]) -> dict[tuple[int, int], int]:
    """(length, code) to symbol."""
    out, code, at = {}, 0, 0
    for bits, n in enumerate(lengths, 1):
        for _ in range(n):
            out[bits, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _lookup(lengths: list[int], symbols: list[int]) -> list[tuple[int, int]]:
    """For each 16 bits that may follow: (bits of the code, symbol)."""
    table = [(0, 0)] * (1 << 16)
    for (bits, code), symbol in _codes(lengths, symbols).items():
        lo = code << (16 - bits)
        table[lo : lo + (1 << (16 - bits))] = [(bits, symbol)] * (1 << (16 - bits))
    return table


class _Bits:
    """Bits of an entropy-coded segment, a word at a time."""

    def __init__(self, data: bytes):
        self.data, self.at, self.value, self.left = data + b"\xff" * 8, 0, 0, 0

    def _need(self, n: int) -> None:
        while self.left < n:
            if self.at >= len(self.data):
                raise DecodeFailed("jpeg: the data end too early")
            self.value = (self.value & ((1 << self.left) - 1)) << 32 | int.from_bytes(self.data[self.at : self.at + 4].ljust(4, b"\xff"), "big")
            self.at += 4
            self.left += 32

    def peek16(self) -> int:
        self._need(16)
        return self.value >> (self.left - 16) & 0xFFFF

    def take(self, n: int) -> int:
        self._need(n)
        self.left -= n
        return self.value >> self.left & ((1 << n) - 1)


def _extend(v: int, bits: int) -> int:
    return v if not bits or v >> (bits - 1) else v - (1 << bits) + 1


def _segments(data: bytes):
    """(marker, body, where the next begins) until the scan's data."""
    at = 2
    if data[:2] != b"\xff\xd8":
        raise DecodeFailed("jpeg: no start of image")
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise DecodeFailed("jpeg: no marker where one is due")
        if data[at + 1] == 0xFF:
            at += 1
            continue
        marker = data[at + 1]
        if marker in (0xD9, 0x01) or 0xD0 <= marker <= 0xD7:
            at += 2
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        yield marker, data[at + 4 : at + 2 + size], at + 2 + size
        at += 2 + size


def decode(data: bytes, tables: bytes | None = None, to_rgb: bool = False) -> np.ndarray:
    """[rows, cols, components]; YCbCr of three components becomes RGB where asked, or where the file says so."""
    quant: dict[int, np.ndarray] = {}
    huff: dict[int, list[tuple[int, int]]] = {}
    frame = scan = None
    restart = 0
    adobe = None
    for source in filter(None, (tables, data)):
        for marker, body, after in _segments(source):
            if marker == 0xDB:
                at = 0
                while at < len(body):
                    wide = body[at] >> 4
                    quant[body[at] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, at + 1).astype(np.int64)
                    at += 1 + 64 * (1 + bool(wide))
            elif marker == 0xC4:
                at = 0
                while at < len(body):
                    lengths = list(body[at + 1 : at + 17])
                    n = sum(lengths)
                    huff[body[at]] = _lookup(lengths, list(body[at + 17 : at + 17 + n]))
                    at += 17 + n
            elif marker in (0xC0, 0xC1):
                frame = body
            elif 0xC2 <= marker <= 0xCF and marker != 0xC8:
                raise UnsupportedCompression(f"jpeg: marker {marker:#x} is not sequential baseline")
            elif marker == 0xDD:
                restart = int.from_bytes(body[:2], "big")
            elif marker == 0xEE and body[:5] == b"Adobe":
                adobe = body[11]
            elif marker == 0xDA:
                scan = (body, source[after:])
                break
    if frame is None or scan is None:
        raise DecodeFailed("jpeg: no frame or no scan")
    if frame[0] != 8:
        raise UnsupportedCompression(f"jpeg: {frame[0]} bits a sample")
    height, width, n = int.from_bytes(frame[1:3], "big"), int.from_bytes(frame[3:5], "big"), frame[5]
    parts = [(frame[6 + 3 * k], frame[7 + 3 * k] >> 4, frame[7 + 3 * k] & 15, frame[8 + 3 * k]) for k in range(n)]
    head, coded = scan
    if head[0] != n:
        raise UnsupportedCompression("jpeg: more than one scan")
    chosen = {head[1 + 2 * k]: (head[2 + 2 * k] >> 4, head[2 + 2 * k] & 15) for k in range(n)}
    hm, vm = max(p[1] for p in parts), max(p[2] for p in parts)
    if n == 1:
        parts, hm, vm = [(parts[0][0], 1, 1, parts[0][3])], 1, 1
    across, down = -(-width // (8 * hm)), -(-height // (8 * vm))
    blocks = [np.zeros((down * v, across * h, 64), np.int64) for _, h, v, _ in parts]
    segments, at = [], 0
    while True:  # restart markers part the data
        k = coded.find(b"\xff", at)
        while k >= 0 and k + 1 < len(coded) and coded[k + 1] == 0:
            k = coded.find(b"\xff", k + 2)
        end = len(coded) if k < 0 else k
        segments.append(coded[at:end].replace(b"\xff\x00", b"\xff"))
        if k < 0 or k + 1 >= len(coded) or not 0xD0 <= coded[k + 1] <= 0xD7:
            break
        at = k + 2
    try:
        units = iter(segments)
        bits, last = None, [0] * n
        for mcu in range(across * down):
            if bits is None or restart and mcu % restart == 0:
                bits, last = _Bits(next(units)), [0] * n
            my, mx = divmod(mcu, across)
            for k, (name, h, v, _) in enumerate(parts):
                dc, ac = huff[chosen[name][0]], huff[16 | chosen[name][1]]
                for sub in range(h * v):
                    out = blocks[k][my * v + sub // h, mx * h + sub % h]
                    size, s = dc[bits.peek16()]
                    if not size:
                        raise DecodeFailed("jpeg: no such code")
                    bits.take(size)
                    last[k] += _extend(bits.take(s), s)
                    out[0] = last[k]
                    i = 1
                    while i < 64:
                        size, rs = ac[bits.peek16()]
                        if not size:
                            raise DecodeFailed("jpeg: no such code")
                        bits.take(size)
                        s = rs & 15
                        if not s:
                            if rs != 0xF0:
                                break
                            i += 16
                            continue
                        i += rs >> 4
                        if i > 63:
                            raise DecodeFailed("jpeg: a run beyond its block")
                        out[i] = _extend(bits.take(s), s)
                        i += 1
    except (KeyError, StopIteration) as e:
        raise DecodeFailed("jpeg: a table or data are missing") from e
    planes = []
    for (_, h, v, q), b in zip(parts, blocks, strict=True):
        if q not in quant:
            raise DecodeFailed("jpeg: a quantisation table is missing")
        f = np.zeros(b.shape)
        f[:, :, ZIGZAG] = b * quant[q]
        f = f.reshape(*b.shape[:2], 8, 8)
        s = np.einsum("ki,yxkl,lj->yxij", DCT, f, DCT) + 128
        plane = s.transpose(0, 2, 1, 3).reshape(b.shape[0] * 8, b.shape[1] * 8)
        planes.append(np.repeat(np.repeat(plane, vm // v, axis=0), hm // h, axis=1)[:height, :width])
    image = np.stack(planes, axis=2)
    if n == 3 and adobe != 0 and (to_rgb or adobe == 1):
        y, cb, cr = image[:, :, 0], image[:, :, 1] - 128, image[:, :, 2] - 128
        image = np.stack([y + 1.402 * cr, y - 0.344136286 * cb - 0.714136286 * cr, y + 1.772 * cb], axis=2)
    return np.clip(np.floor(image + 0.5), 0, 255).astype(np.uint8)


def encode_gray(image: np.ndarray, quality: int = 75) -> bytes:
    """A baseline image of one component."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    table = np.clip((QUANT * scale + 50) // 100, 1, 255)
    h, w = image.shape
    full = np.pad(image, ((0, -h % 8), (0, -w % 8)), mode="edge").astype(float) - 128
    cells = full.reshape(full.shape[0] // 8, 8, full.shape[1] // 8, 8).transpose(0, 2, 1, 3)
    f = np.einsum("ki,yxij,lj->yxkl", DCT, cells, DCT).reshape(-1, 64)
    q = np.rint(f / table)[:, ZIGZAG].astype(int)
    ac_lengths, ac_symbols = _ac_table()
    dc = {s: k for k, s in _codes(DC_LENGTHS, DC_SYMBOLS).items()}
    ac = {s: k for k, s in _codes(ac_lengths, ac_symbols).items()}
    bits: list[str] = []

    def put(length: int, code: int) -> None:
        if length:
            bits.append(format(code, f"0{length}b"))

    def number(v: int) -> tuple[int, int]:
        n = abs(v).bit_length()
        return n, v if v > 0 else v + (1 << n) - 1

    last = 0
    for row in q.tolist():
        n, code = number(row[0] - last)
        last = row[0]
        put(*dc[n])
        put(n, code)
        run = 0
        for v in row[1:]:
            if not v:
                run += 1
                continue
            while run > 15:
                put(*ac[0xF0])
                run -= 16
            n, code = number(v)
            put(*ac[run << 4 | n])
            put(n, code)
            run = 0
        if run:
            put(*ac[0])
    text = "".join(bits)
    text += "1" * (-len(text) % 8)
    data = int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\x00") if text else b""

    def segment(marker: int, body: bytes) -> bytes:
        return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body

    return (
        b"\xff\xd8" + segment(0xDB, b"\0" + bytes(table[ZIGZAG].tolist())) + segment(0xC0, b"\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + b"\1\1\x11\0")
        + segment(0xC4, b"\0" + bytes(DC_LENGTHS) + bytes(DC_SYMBOLS)) + segment(0xC4, b"\x10" + bytes(ac_lengths) + bytes(ac_symbols)) + segment(0xDA, b"\1\1\0\0\x3f\0") + data + b"\xff\xd9"
    )
