"""The TIFF container: headers, directories, tags, layouts, colour models and blocks, read from any byte source."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

import numpy as np

from rasterloom.sources import codecs
from rasterloom.sources.bytesource import ByteSource
from rasterloom.sources.errors import (
    BandOutOfBounds, DecodeFailed, InvalidHeader, InvalidLayout, InvalidTag, SampleTypeMismatch, TiffError, Truncated, UnsupportedPlanar, UnsupportedPredictor, UnsupportedSampleFormat, WindowOutOfBounds,
)

# Tag ids of the TIFF, GeoTIFF and related formats.
NEW_SUBFILE_TYPE, SUBFILE_TYPE, IMAGE_WIDTH, IMAGE_LENGTH, BITS_PER_SAMPLE, COMPRESSION, PHOTOMETRIC = 254, 255, 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES_PER_PIXEL, ROWS_PER_STRIP, STRIP_BYTE_COUNTS, PLANAR_CONFIGURATION, PREDICTOR, COLOR_MAP = 273, 277, 278, 279, 284, 317, 320
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_BYTE_COUNTS, SUB_IFDS, INK_SET, EXTRA_SAMPLES, SAMPLE_FORMAT, JPEG_TABLES = 322, 323, 324, 325, 330, 332, 338, 339, 347
YCBCR_SUBSAMPLING, YCBCR_POSITIONING, REFERENCE_BLACK_WHITE, LERC_PARAMETERS = 530, 531, 532, 50674
PIXEL_SCALE, TIEPOINT, TRANSFORMATION, GEO_KEYS, GEO_DOUBLES, GEO_ASCII, NODATA = 33550, 33922, 34264, 34735, 34736, 34737, 42113
# Photometric interpretations.
WHITE_IS_ZERO, BLACK_IS_ZERO, RGB, PALETTE, MASK, SEPARATED, YCBCR, CIELAB = 0, 1, 2, 3, 4, 5, 6, 8
COLORS = {WHITE_IS_ZERO: 1, BLACK_IS_ZERO: 1, RGB: 3, PALETTE: 1, MASK: 1, SEPARATED: 4, YCBCR: 3, CIELAB: 3}
# Numpy kinds of the numeric tag types; 13 is a directory's offset.
TAG_KINDS = {1: "u1", 3: "u2", 4: "u4", 5: "u4", 6: "i1", 7: "u1", 8: "i2", 9: "i4", 10: "i4", 11: "f4", 12: "f8", 13: "u4", 16: "u8", 17: "i8", 18: "u8"}
MOST_IFDS = 10_000
GHOST = b"GDAL_STRUCTURAL_METADATA_SIZE="
KINDS = {1: "u", 2: "i", 3: "f"}


@dataclass(frozen=True)
class Tag:
    """values: text of an ASCII tag, bytes of an undefined one, pairs of a rational one, else numbers."""

    code: int
    type: int
    count: int
    values: Any

    def numbers(self) -> list:
        if isinstance(self.values, bytes):
            return list(self.values)
        if isinstance(self.values, str):
            raise InvalidTag(f"tag {self.code} is text")
        return [(n / d if d else float("inf") if n > 0 else float("-inf") if n < 0 else float("nan")) for n, d in self.values] if self.type in (5, 10) else list(self.values)


@dataclass(frozen=True)
class Layout:
    width: int
    height: int
    spp: int
    bits: int
    sample_format: int
    planar: int = 1
    predictor: int = 1

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(f"{KINDS[self.sample_format]}{max(1, self.bits // 8)}")

    @property
    def block_spp(self) -> int:
        return 1 if self.planar == 2 else self.spp


@dataclass(frozen=True)
class Block:
    index: int
    plane: int
    y: int
    x: int
    rows: int  # within the image
    cols: int
    offset: int
    byte_count: int
    block_h: int  # as stored
    block_w: int

    def overlaps(self, r0: int, c0: int, rows: int, cols: int) -> bool:
        return self.y < r0 + rows and r0 < self.y + self.rows and self.x < c0 + cols and c0 < self.x + self.cols


@dataclass
class ColorModel:
    kind: str
    colors: int
    extra: list[int]
    white_is_zero: bool = False
    color_map: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    ink_set: int | None = None
    subsampling: tuple[int, int] = (1, 1)
    positioning: int = 1


@dataclass
class Ifd:
    index: int
    offset: int
    tags: dict[int, Tag]
    next: int = 0
    top_level: bool = True
    _layout: Layout | None = field(default=None, repr=False, compare=False)

    def numbers(self, code: int, default: list | None = None) -> list:
        tag = self.tags.get(code)
        return (default if default is not None else []) if tag is None else tag.numbers()

    def number(self, code: int, default: int | None = None):
        return next(iter(self.numbers(code)), default)

    width = property(lambda self: self.number(IMAGE_WIDTH, 0))
    height = property(lambda self: self.number(IMAGE_LENGTH, 0))
    spp = property(lambda self: self.number(SAMPLES_PER_PIXEL, 1))
    bits = property(lambda self: self.numbers(BITS_PER_SAMPLE, [1]))
    sample_format = property(lambda self: self.numbers(SAMPLE_FORMAT, [1]))
    compression = property(lambda self: self.number(COMPRESSION, 1))
    photometric = property(lambda self: self.number(PHOTOMETRIC, BLACK_IS_ZERO))
    planar = property(lambda self: self.number(PLANAR_CONFIGURATION, 1))
    predictor = property(lambda self: self.number(PREDICTOR, 1))
    is_tiled = property(lambda self: TILE_WIDTH in self.tags and TILE_LENGTH in self.tags)

    def reduced(self) -> bool:
        if NEW_SUBFILE_TYPE in self.tags:
            return self.number(NEW_SUBFILE_TYPE) & 1 == 1
        return self.number(SUBFILE_TYPE) == 2

    def color_map(self):
        values = self.numbers(COLOR_MAP)
        if not values:
            return None
        if len(values) % 3:
            raise InvalidTag(f"a colour map of {len(values)} numbers")
        return tuple(np.array(values, np.uint16).reshape(3, -1))

    def _pair(self, code: int) -> tuple[int, int] | None:
        values = self.numbers(code)
        if values and len(values) != 2:
            raise InvalidTag(f"tag {code} has {len(values)} values, not 2")
        return tuple(values) if values else None

    def reference_black_white(self) -> list[float] | None:
        values = self.numbers(REFERENCE_BLACK_WHITE)
        if values and len(values) != 6:
            raise InvalidTag(f"tag {REFERENCE_BLACK_WHITE} has {len(values)} values, not 6")
        return values or None

    def lerc_parameters(self) -> tuple[int, int] | None:
        """(version, additional compression: 0 none, 1 deflate, 2 zstd)."""
        return self._pair(LERC_PARAMETERS)

    def color_model(self) -> ColorModel:
        p, extra = self.photometric, self.numbers(EXTRA_SAMPLES)
        if p not in COLORS:
            raise InvalidTag(f"photometric interpretation {p}")
        ink = self.number(INK_SET, 1) if p == SEPARATED else None
        colors = COLORS[p] if ink in (None, 1) else self.spp - len(extra)
        if p == MASK:
            return ColorModel("mask", 1, [])
        if len(extra) > self.spp - min(colors, self.spp) or colors > self.spp or colors < 1:
            raise InvalidLayout(f"{self.spp} samples a pixel do not hold {COLORS[p]} colours and {len(extra)} extra samples")
        extra = extra + [0] * (self.spp - colors - len(extra))
        if p in (WHITE_IS_ZERO, BLACK_IS_ZERO):
            return ColorModel("gray", 1, extra, white_is_zero=p == WHITE_IS_ZERO)
        if p == PALETTE:
            if (planes := self.color_map()) is None:
                raise InvalidLayout("a palette image without a colour map")
            return ColorModel("palette", 1, extra, color_map=planes)
        if p == SEPARATED:
            return ColorModel("cmyk" if ink == 1 else "separated", colors, extra, ink_set=ink)
        if p == YCBCR:
            return ColorModel("ycbcr", 3, extra, subsampling=self._pair(YCBCR_SUBSAMPLING) or (1, 1), positioning=self.number(YCBCR_POSITIONING, 1))
        return ColorModel({RGB: "rgb", CIELAB: "cielab"}[p], 3, extra)

    def layout(self) -> Layout:
        """The normal layout, or an error that says why there is none."""
        if self._layout is None:
            self._layout = self._checked_layout()
        return self._layout

    def _checked_layout(self) -> Layout:
        if not self.width or not self.height:
            raise InvalidLayout(f"an image of {self.width} x {self.height}")
        if not self.spp:
            raise InvalidLayout("no samples a pixel")
        for name, values in (("bits", self.bits), ("formats", self.sample_format)):
            if len(values) not in (1, self.spp):
                raise InvalidTag(f"{len(values)} sample {name} for {self.spp} samples")
            if len(set(values)) > 1:
                raise InvalidLayout(f"mixed sample {name}")
        bits, kind = self.bits[0], self.sample_format[0]
        if kind not in KINDS:
            raise UnsupportedSampleFormat(f"sample format {kind}")
        if bits not in {1: (1, 2, 4, 8, 16, 32, 64), 2: (8, 16, 32, 64), 3: (32, 64)}[kind]:
            raise UnsupportedSampleFormat(f"{bits} bits of sample format {kind}")
        if self.planar not in (1, 2):
            raise UnsupportedPlanar(f"planar configuration {self.planar}")
        if self.predictor not in (1, 2, 3):
            raise UnsupportedPredictor(f"predictor {self.predictor}")
        if bits < 8 and self.predictor != 1:
            raise InvalidLayout("a predictor over samples below a byte")
        model = self.color_model()
        if model.kind == "palette" and len(model.color_map[0]) != 1 << bits:
            raise InvalidLayout(f"a colour map of {len(model.color_map[0])} entries for {bits} bits")
        if model.kind == "ycbcr" and model.subsampling != (1, 1):
            if 0 in model.subsampling:
                raise InvalidLayout("chroma subsampling by nothing")
            if model.extra or self.predictor != 1:
                raise InvalidLayout("subsampled chroma with extra samples or a predictor")
        return Layout(self.width, self.height, self.spp, bits, kind, self.planar, self.predictor)

    def decoded_layout(self) -> Layout:
        stored, model = self.layout(), self.color_model()
        spp = {"palette": 3, "cmyk": 3, "ycbcr": 3}.get(model.kind, model.colors) + len(model.extra)
        bits, kind = max(8, stored.bits), stored.sample_format
        if model.kind == "palette":
            bits, kind = (8 if all((p % 257 == 0).all() for p in model.color_map) else 16), 1
        elif model.kind in ("cmyk", "ycbcr") and kind != 1:
            raise InvalidLayout(f"decoded {model.kind} needs unsigned samples")
        return Layout(stored.width, stored.height, spp, bits, kind)

    def blocks(self) -> list[Block]:
        """The strips or tiles, plane by plane and row by row."""
        lay = self.layout()
        planes = lay.spp if lay.planar == 2 else 1
        if self.is_tiled:
            h, w = self.number(TILE_LENGTH), self.number(TILE_WIDTH)
            offsets, counts = self.numbers(TILE_OFFSETS), self.numbers(TILE_BYTE_COUNTS)
            if not h or not w:
                raise InvalidLayout(f"tiles of {w} x {h}")
        else:
            rows = self.number(ROWS_PER_STRIP, lay.height)
            if not rows:
                raise InvalidLayout("RowsPerStrip is zero")
            h, w = min(rows, lay.height), lay.width
            offsets, counts = self.numbers(STRIP_OFFSETS), self.numbers(STRIP_BYTE_COUNTS)
        across, down = -(-lay.width // w), -(-lay.height // h)
        if len(offsets) != len(counts) or len(offsets) != planes * across * down:
            raise InvalidLayout(f"{len(offsets)} offsets and {len(counts)} byte counts for {planes * across * down} blocks")
        out = []
        for i, (offset, count) in enumerate(zip(offsets, counts, strict=True)):
            plane, at = divmod(i, across * down)
            y, x = at // across * h, at % across * w
            rows = min(h, lay.height - y)
            out.append(Block(i, plane, y, x, rows, min(w, lay.width - x), offset, count, h if self.is_tiled else rows, w))
        return out


@dataclass
class Ghost:
    """What a cloud-optimised file says of its blocks before its first directory."""

    text: str
    leader: bool = field(init=False)
    trailer: bool = field(init=False)

    def __post_init__(self) -> None:
        self.leader = "BLOCK_LEADER=SIZE_AS_UINT4" in self.text
        self.trailer = "BLOCK_TRAILER=LAST_4_BYTES_REPEATED" in self.text


class Tiff:
    """An open file. Nothing but directories is read before a block is asked for; `reads` counts the blocks."""

    def __init__(self, source: ByteSource):
        self.source, self.reads = source, 0
        head = source.read(0, min(16, source.size))
        self.order = {b"II": "<", b"MM": ">"}.get(head[:2])
        if self.order is None or len(head) < 8:
            raise InvalidHeader(f"starts with {head[:4]!r}")
        version = struct.unpack_from(f"{self.order}H", head, 2)[0]
        if version == 42:
            self.is_bigtiff, first = False, struct.unpack_from(f"{self.order}I", head, 4)[0]
        elif version == 43:
            if len(head) < 16 or struct.unpack_from(f"{self.order}H", head, 4)[0] != 8:
                raise InvalidHeader("BigTIFF offsets must have 8 bytes")
            self.is_bigtiff, first = True, struct.unpack_from(f"{self.order}Q", head, 8)[0]
        else:
            raise InvalidHeader(f"version {version}")
        self.ghost = self._ghost(16 if self.is_bigtiff else 8)
        self.ifds: list[Ifd] = []
        seen, at = set(), first
        while at:
            if at in seen:
                raise InvalidLayout(f"directories loop at {at}")
            if len(seen) >= MOST_IFDS:
                raise InvalidLayout(f"more than {MOST_IFDS} directories")
            seen.add(at)
            self.ifds.append(self.ifd_at(at, len(self.ifds)))
            at = self.ifds[-1].next

    def _ghost(self, at: int) -> Ghost | None:
        probe = self.source.read(at, min(64, max(0, self.source.size - at))) if self.source.size > at else b""
        digits = probe[len(GHOST) :].split(b" ")[0] if probe.startswith(GHOST) and b"\n" in probe else b""
        if not digits.isdigit():
            return None
        size = probe.index(b"\n") + 1 + int(digits)
        return Ghost(self.source.read(at, size).decode("utf-8", "replace")) if at + size <= self.source.size else None

    def ifd_at(self, offset: int, index: int | None = None) -> Ifd:
        """The directory at an offset; one outside the chain goes by its offset."""
        o, big = self.order, self.is_bigtiff
        head, entry, tail = (8, 20, 8) if big else (2, 12, 4)
        if offset + head > self.source.size:
            raise Truncated(f"a directory at {offset} of {self.source.size}")
        n = struct.unpack(f"{o}{'Q' if big else 'H'}", self.source.read(offset, head))[0]
        body = self.source.read(offset + head, n * entry + tail)
        tags = {}
        for k in range(n):
            code, kind = struct.unpack_from(f"{o}HH", body, k * entry)
            count = struct.unpack_from(f"{o}{'Q' if big else 'I'}", body, k * entry + 4)[0]
            inline = body[k * entry + (12 if big else 8) : (k + 1) * entry]
            tags[code] = self._tag(code, kind, count, inline)
        return Ifd(offset if index is None else index, offset, tags, struct.unpack_from(f"{o}{'Q' if big else 'I'}", body, n * entry)[0], index is not None)

    def _tag(self, code: int, kind: int, count: int, inline: bytes) -> Tag:
        number = np.dtype(TAG_KINDS.get(kind, "u1")).newbyteorder(self.order)
        size = count * number.itemsize * (2 if kind in (5, 10) else 1)
        if size <= len(inline):
            raw = inline[:size]
        else:
            at = int.from_bytes(inline, "little" if self.order == "<" else "big")
            if at + size > self.source.size:
                raise Truncated(f"tag {code} of {size} bytes at {at}")
            raw = self.source.read(at, size)
        if kind == 2:
            return Tag(code, kind, count, raw.rstrip(b"\0").decode("utf-8", "replace"))
        if kind == 7 or kind not in TAG_KINDS:
            return Tag(code, kind, count, bytes(raw))
        values = np.frombuffer(raw, number).tolist()
        return Tag(code, kind, count, list(zip(values[::2], values[1::2], strict=True)) if kind in (5, 10) else values)

    def payload(self, block: Block) -> bytes:
        """A block's stored bytes, without what a ghost area lays around them."""
        self.reads += 1
        if self.ghost and self.ghost.leader and block.offset >= 4:
            length = struct.unpack(f"{self.order}I", self.source.read(block.offset - 4, 4))[0]
            if length == block.byte_count:
                wrapped = self.source.read(block.offset, length + (4 if self.ghost.trailer else 0)) if self.ghost.trailer and block.offset + length + 4 <= self.source.size else self.source.read(block.offset, length)
                if len(wrapped) > length >= 4 and wrapped[length - 4 : length] != wrapped[length:]:
                    raise InvalidLayout(f"the trailer of the block at {block.offset} does not repeat its end")
                return wrapped[:length]
        return self.source.read(block.offset, block.byte_count)

    def decode(self, ifd: Ifd, block: Block, payload: bytes | None = None) -> np.ndarray:
        """[rows, cols, samples] of a block as stored, clipped to the image."""
        return decode_block(ifd, block, self.payload(block) if payload is None else payload, self.order)[: block.rows, : block.cols]

    def read(self, ifd: Ifd, window: tuple[int, int, int, int] | None = None, band: int | None = None, dtype=None) -> np.ndarray:
        """[rows, cols, samples] of a window (row, col, rows, cols); only blocks that hold some of it are fetched."""
        lay = ifd.layout()
        r0, c0, rows, cols = window or (0, 0, lay.height, lay.width)
        if min(r0, c0, rows, cols) < 0 or r0 + rows > lay.height or c0 + cols > lay.width:
            raise WindowOutOfBounds(f"window {window} of {lay.height} x {lay.width}")
        if band is not None and not 0 <= band < lay.spp:
            raise BandOutOfBounds(f"band {band} of {lay.spp}")
        if dtype is not None and np.dtype(dtype) != lay.dtype:
            raise SampleTypeMismatch(f"{np.dtype(dtype)} asked for, {lay.dtype} stored")
        out = np.zeros((rows, cols, 1 if band is not None else lay.spp), lay.dtype)
        if not rows or not cols:
            return out
        for b in ifd.blocks():
            if not b.overlaps(r0, c0, rows, cols) or lay.planar == 2 and band is not None and b.plane != band:
                continue
            data = self.decode(ifd, b)
            top, left, end, right = max(r0, b.y), max(c0, b.x), min(r0 + rows, b.y + b.rows), min(c0 + cols, b.x + b.cols)
            part = data[top - b.y : end - b.y, left - b.x : right - b.x]
            spot = out[top - r0 : end - r0, left - c0 : right - c0]
            if lay.planar == 2:
                spot[:, :, 0 if band is not None else b.plane] = part[:, :, 0]
            else:
                spot[:] = part if band is None else part[:, :, band : band + 1]
        return out

    def read_decoded(self, ifd: Ifd, window: tuple[int, int, int, int] | None = None) -> np.ndarray:
        return decode_colors(ifd, self.read(ifd, window))

    @cached_property
    def geo(self):
        from rasterloom.sources.geotiff import GeoInfo

        return GeoInfo(self)


def decode_block(ifd: Ifd, block: Block, payload: bytes, order: str) -> np.ndarray:
    """[block_h, block_w, samples] of a block's stored bytes, in the machine's byte order."""
    lay = ifd.layout()
    spp, h, w = lay.block_spp, block.block_h, block.block_w
    if ifd.compression == codecs.LERC:
        from rasterloom.sources.lerc import decode_block as lerc

        return lerc(payload, (ifd.lerc_parameters() or (0, 0))[1], h, w, spp, lay.dtype)
    model = ifd.color_model()
    if ifd.compression == codecs.JPEG:
        from rasterloom.sources.jpeg import decode as jpeg

        tables = ifd.tags.get(JPEG_TABLES)
        data = jpeg(payload, tables.values if tables else None, to_rgb=model.kind == "ycbcr")
        if data.shape[0] < h or data.shape[1] < w or data.shape[2] != spp:
            raise DecodeFailed(f"a JPEG of {data.shape} for a block of {(h, w, spp)}")
        return data[:h, :w]
    chroma = model.kind == "ycbcr" and model.subsampling != (1, 1) and lay.planar == 1
    if chroma:
        sx, sy = model.subsampling
        size = -(-w // sx) * -(-h // sy) * (sx * sy + 2) * lay.dtype.itemsize
    else:
        size = h * ((w * spp * lay.bits + 7) // 8)
    data = codecs.decompress(ifd.compression, payload, size)
    if len(data) < size:
        raise DecodeFailed(f"block {block.index} has {len(data)} of {size} bytes")
    if lay.bits < 8:
        return codecs.unpack_bits(data, h, w * spp, lay.bits).reshape(h, w, spp)
    if chroma:
        return codecs.upsample_chroma(data, h, w, *model.subsampling, lay.dtype.newbyteorder(order)).astype(lay.dtype)
    if lay.predictor == 3:
        return codecs.undo_float(data, h, w, spp, lay.dtype)
    if lay.predictor == 2:
        bits = np.frombuffer(data, f"{order}u{lay.dtype.itemsize}").reshape(h, w, spp)
        return codecs.undo_horizontal(bits.astype(bits.dtype.newbyteorder("="))).view(lay.dtype)
    return np.frombuffer(data, lay.dtype.newbyteorder(order)).reshape(h, w, spp).astype(lay.dtype, copy=False)


def _scale(v: np.ndarray, a: int, b: int) -> np.ndarray:
    """Unsigned samples of a bits on the scale of b, halves up."""
    if a == b:
        return v
    most, to = (1 << a) - 1, (1 << b) - 1
    kind = np.uint64 if a + b <= 64 else object
    return (v.astype(kind) * kind(to) + kind(most // 2)) // kind(most) if kind is not object else np.array((v.astype(object) * to + most // 2) // most)


def decode_colors(ifd: Ifd, samples: np.ndarray) -> np.ndarray:
    """Stored samples as the colours they stand for: [rows, cols, channels] of the decoded layout."""
    stored, out, model = ifd.layout(), ifd.decoded_layout(), ifd.color_model()
    bits = stored.bits
    most = float((1 << bits) - 1)
    colors, extra = samples[:, :, : model.colors], samples[:, :, model.colors : model.colors + len(model.extra)]
    away = lambda x: np.floor(x + 0.5)  # noqa: E731  of numbers from zero up
    if model.kind == "gray" and (model.white_is_zero or bits < 8) and stored.sample_format != 1:
        raise InvalidLayout("inverted gray needs unsigned samples")
    if model.kind == "palette":
        index = colors[:, :, 0].astype(np.int64)
        if index.size and index.max() >= len(model.color_map[0]):
            raise TiffError(f"palette index {index.max()} of {len(model.color_map[0])}")
        made = np.stack([_scale(p[index], 16, out.bits) for p in model.color_map], axis=2)
    elif model.kind == "cmyk":
        n = colors / most
        made = away((1 - n[:, :, :3]) * (1 - n[:, :, 3:4]) * most)
        made = _scale(made.astype(out.dtype), bits, out.bits)
    elif model.kind == "ycbcr" and ifd.compression != codecs.JPEG:
        half = float(1 << (bits - 1))
        ref = ifd.reference_black_white() or [0.0, most, half, most, half, most]
        y = (colors[:, :, 0] - ref[0]) / (ref[1] - ref[0])
        b, r = ((colors[:, :, k] - ref[2 * k]) / most for k in (1, 2))
        rgb = np.stack([y + 1.402 * r, y - 0.344136286 * b - 0.714136286 * r, y + 1.772 * b], axis=2)
        made = _scale(away(np.clip(rgb, 0, 1) * most).astype(out.dtype), bits, out.bits)
    else:
        made = (np.array((1 << bits) - 1, colors.dtype) - colors) if model.white_is_zero else colors
        made = _scale(made, bits, out.bits) if stored.sample_format == 1 else made
    if extra.shape[2]:
        more = _scale(extra, bits, out.bits) if stored.sample_format == 1 else extra
        made = np.concatenate([made.astype(out.dtype), more.astype(out.dtype)], axis=2)
    return made.astype(out.dtype)
