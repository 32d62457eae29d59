"""Writing TIFF, GeoTIFF and cloud-optimised files: image specs, block encoding and the layout of a whole file.

Blocks are encoded wherever their samples are (on executors); what a file's bytes look like depends on the blocks'
sizes alone, so directories are laid out once those are known, and payloads are only copied.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np

from rasterloom.sources import codecs
from rasterloom.sources import container as c
from rasterloom.sources.errors import IncompleteImage, WriteConfig
from rasterloom.sources.geotiff import Keys, serialize_keys

GHOST_TEXT = "LAYOUT=IFDS_BEFORE_DATA\nBLOCK_ORDER=ROW_MAJOR\nBLOCK_LEADER=SIZE_AS_UINT4\nBLOCK_TRAILER=LAST_4_BYTES_REPEATED\nKNOWN_INCOMPATIBLE_EDITION=NO\n"
MAX_32 = (1 << 32) - 1
#: numpy kinds of the tag types that are written.
WRITE_KINDS = {1: "u1", 2: "S", 3: "u2", 4: "u4", 5: "u4", 7: "u1", 12: "f8", 16: "u8"}


@dataclass(frozen=True)
class ImageSpec:
    """One image: its samples, how they are stored, and any further tags as (code, type, values)."""

    width: int
    height: int
    spp: int = 1
    dtype: str = "u1"
    compression: int = codecs.NONE
    predictor: int = 1
    photometric: int = c.BLACK_IS_ZERO
    planar: int = 1
    tile: tuple[int, int] | None = None  # rows, cols
    rows_per_strip: int | None = None
    extra_samples: tuple[int, ...] = ()
    color_map: tuple[tuple[int, ...], ...] | None = None
    ink_set: int | None = None
    ycbcr_positioning: int | None = None
    reduced: bool = False
    max_z_error: float = 0.0
    lerc_additional: int = 0
    jpeg_quality: int = 75
    tags: tuple = ()

    def __post_init__(self) -> None:
        if self.compression in (codecs.LERC, codecs.JPEG) and self.predictor != 1:
            object.__setattr__(self, "predictor", 1)  # neither takes one
        self.validate()

    @property
    def sample(self) -> np.dtype:
        return np.dtype(self.dtype)

    @property
    def block(self) -> tuple[int, int]:
        return self.tile or (min(self.rows_per_strip or min(self.height, 256), self.height), self.width)

    @property
    def grid(self) -> tuple[int, int]:
        return -(-self.height // self.block[0]), -(-self.width // self.block[1])

    @property
    def block_spp(self) -> int:
        return 1 if self.planar == 2 else self.spp

    @property
    def n_blocks(self) -> int:
        return self.grid[0] * self.grid[1] * (self.spp if self.planar == 2 else 1)

    def validate(self) -> None:
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise WriteConfig(what)

        need(self.width > 0 and self.height > 0 and self.spp > 0, "an image needs a size and samples")
        need(self.sample.kind in "uif" and self.sample.itemsize * 8 in (8, 16, 32, 64) and (self.sample.kind != "f" or self.sample.itemsize > 2), f"samples of {self.dtype} are not written")
        need(self.tile is None or all(n > 0 and n % 16 == 0 for n in self.tile), "tile sides must be multiples of 16")
        need(self.rows_per_strip is None or self.rows_per_strip > 0, "strips need rows")
        need(self.planar in (1, 2) and self.predictor in (1, 2, 3), "no such planar configuration or predictor")
        need(self.predictor != 3 or self.sample.kind == "f", "predictor 3 is for floats")
        need(self.compression in (codecs.NONE, codecs.LZW, codecs.JPEG, codecs.DEFLATE, codecs.OLD_DEFLATE, codecs.LERC, codecs.ZSTD), f"compression {self.compression} is not written")
        need(self.photometric in c.COLORS, f"photometric interpretation {self.photometric}")
        colors = c.COLORS[self.photometric] if self.photometric != c.SEPARATED or self.ink_set in (None, 1) else self.spp - len(self.extra_samples)
        need(self.spp == colors + len(self.extra_samples) or not self.extra_samples and self.spp >= colors and self.photometric in (c.BLACK_IS_ZERO, c.WHITE_IS_ZERO), f"{self.spp} samples are not {colors} colours and {len(self.extra_samples)} more")
        need((self.color_map is not None) == (self.photometric == c.PALETTE), "a colour map goes with a palette, and only there")
        if self.color_map is not None:
            need(self.sample.kind == "u" and len(self.color_map) == 3 and all(len(p) == 1 << 8 * self.sample.itemsize for p in self.color_map), "a colour map needs three planes of 2^bits entries")
        need(self.ink_set is None or self.photometric == c.SEPARATED, "an ink set goes with separated colours")
        need(self.photometric != c.YCBCR or self.dtype == "u1", "YCbCr is written of 8-bit samples")
        need(self.ycbcr_positioning is None or self.photometric == c.YCBCR, "chroma positions go with YCbCr")
        if self.compression == codecs.LERC:
            need(self.sample.itemsize < 8 or self.sample.kind == "f", "LERC holds no 64-bit whole numbers")
            need(self.max_z_error >= 0 and self.lerc_additional in (0, 1, 2), "no such LERC options")
        if self.compression == codecs.JPEG:
            need(self.dtype == "u1" and self.block_spp == 1, "JPEG blocks hold one 8-bit sample a pixel")
            need(1 <= self.jpeg_quality <= 100 and max(self.block) <= 65535, "JPEG quality is 1 to 100, and its blocks have 65535 rows and columns at most")
            need(self.photometric not in (c.PALETTE, c.MASK), "neither palettes nor masks are JPEG")

    def encode(self, samples: np.ndarray, order: str = "<") -> bytes:
        """The stored bytes of one block, [rows, cols, samples] of a plane or of all."""
        if samples.dtype != self.sample or samples.shape[2] != self.block_spp:
            raise WriteConfig(f"a block of {samples.dtype} {samples.shape} for {self.dtype} and {self.block_spp} samples")
        if self.compression == codecs.LERC:
            from rasterloom.sources.lerc import encode

            blob = encode(samples, self.max_z_error)
            return codecs.compress((codecs.NONE, codecs.DEFLATE, codecs.ZSTD)[self.lerc_additional], blob)
        if self.compression == codecs.JPEG:
            from rasterloom.sources.jpeg import encode_gray

            return encode_gray(samples[:, :, 0], self.jpeg_quality)
        samples = np.ascontiguousarray(samples)
        if self.predictor == 3:
            data = codecs.forward_float(samples)
        else:
            data = codecs.forward_horizontal(samples) if self.predictor == 2 else samples
            data = data.astype(data.dtype.newbyteorder(order)).tobytes()
        return codecs.compress(self.compression, data)

    def blocks_of(self, image: np.ndarray, pad=0) -> Iterator[np.ndarray]:
        """The blocks of a whole image [rows, cols, samples], plane by plane, tiles padded to their size."""
        h, w = self.block
        for plane in range(self.spp if self.planar == 2 else 1):
            layer = image[:, :, plane : plane + 1] if self.planar == 2 else image
            for y in range(0, self.height, h):
                for x in range(0, self.width, w):
                    part = layer[y : y + h, x : x + w]
                    if self.tile and part.shape[:2] != (h, w):
                        full = np.full((h, w, part.shape[2]), pad, part.dtype)
                        full[: part.shape[0], : part.shape[1]] = part
                        part = full
                    yield part

    def entries(self, offsets: list[int], counts: list[int], big: bool) -> list[tuple[int, int, list | str | bytes]]:
        """The tags, by code."""
        bits, place = 8 * self.sample.itemsize, 16 if big else 4
        rows = [
            (c.IMAGE_WIDTH, 4, [self.width]), (c.IMAGE_LENGTH, 4, [self.height]), (c.BITS_PER_SAMPLE, 3, [bits] * self.spp), (c.COMPRESSION, 3, [self.compression]),
            (c.PHOTOMETRIC, 3, [self.photometric]), (c.SAMPLES_PER_PIXEL, 3, [self.spp]), (c.PLANAR_CONFIGURATION, 3, [self.planar]), (c.SAMPLE_FORMAT, 3, [{"u": 1, "i": 2, "f": 3}[self.sample.kind]] * self.spp),
        ]
        if self.reduced:
            rows.append((c.NEW_SUBFILE_TYPE, 4, [1]))
        if self.predictor != 1:
            rows.append((c.PREDICTOR, 3, [self.predictor]))
        if self.tile:
            rows += [(c.TILE_WIDTH, 4, [self.tile[1]]), (c.TILE_LENGTH, 4, [self.tile[0]]), (c.TILE_OFFSETS, place, offsets), (c.TILE_BYTE_COUNTS, place, counts)]
        else:
            rows += [(c.ROWS_PER_STRIP, 4, [self.block[0]]), (c.STRIP_OFFSETS, place, offsets), (c.STRIP_BYTE_COUNTS, place, counts)]
        if self.extra_samples:
            rows.append((c.EXTRA_SAMPLES, 3, list(self.extra_samples)))
        elif self.spp > c.COLORS[self.photometric]:
            rows.append((c.EXTRA_SAMPLES, 3, [0] * (self.spp - c.COLORS[self.photometric])))
        if self.color_map:
            rows.append((c.COLOR_MAP, 3, [v for p in self.color_map for v in p]))
        if self.ink_set:
            rows.append((c.INK_SET, 3, [self.ink_set]))
        if self.photometric == c.YCBCR:
            rows += [(c.YCBCR_SUBSAMPLING, 3, [1, 1]), (c.YCBCR_POSITIONING, 3, [self.ycbcr_positioning or 1])]
        if self.compression == codecs.LERC:
            rows.append((c.LERC_PARAMETERS, 4, [2, self.lerc_additional]))
        rows += list(self.tags)
        return sorted({r[0]: r for r in rows}.values())


@dataclass
class Sizes:
    """An image's spec and the stored sizes of its blocks by index."""

    spec: ImageSpec
    counts: list[int] = field(default_factory=list)


def geo_tags(keys: Keys | None = None, scale: tuple[float, float] | None = None, origin: tuple[float, float] | None = None, matrix: list[float] | None = None, nodata: str | None = None, tiepoint: tuple[float, ...] | None = None, skew: tuple[float, float] = (0.0, 0.0)) -> tuple:
    """The tags of a place on Earth: a matrix, or a pixel scale and the origin's tiepoint; keys only if there are any."""
    rows = []
    if any(skew) and matrix is None and scale is not None:  # no pixel scale holds a skew
        x, y = origin or (0.0, 0.0)
        matrix = [scale[0], skew[0], 0, x, skew[1], -scale[1], 0, y, *[0.0] * 7, 1.0]
    if matrix is not None:
        rows.append((c.TRANSFORMATION, 12, [float(v) for v in matrix]))
    elif scale is not None:
        x, y = origin or (0.0, 0.0)
        rows += [(c.PIXEL_SCALE, 12, [float(scale[0]), float(scale[1]), 0.0]), (c.TIEPOINT, 12, [float(v) for v in tiepoint] if tiepoint else [0.0, 0.0, 0.0, float(x), float(y), 0.0])]
    if keys:
        directory, doubles, text = serialize_keys(keys)
        rows.append((c.GEO_KEYS, 3, directory))
        rows += [(c.GEO_DOUBLES, 12, doubles)] * bool(doubles) + [(c.GEO_ASCII, 2, text)] * bool(text)
    if nodata is not None:
        rows.append((c.NODATA, 2, nodata))
    return tuple(rows)


def _packed(kind: int, values, order: str) -> tuple[int, bytes]:
    if kind == 2:
        raw = values.encode() + b"\0"
        return len(raw), raw
    if kind == 7 or isinstance(values, bytes):
        return len(values), bytes(values)
    raw = np.array(values, np.dtype(WRITE_KINDS[kind]).newbyteorder(order)).tobytes()
    return len(values) // (2 if kind == 5 else 1), raw


def _directory(entries: list, at: int, following: int, big: bool, order: str) -> bytes:
    """A directory at an offset, its longer values after it."""
    head, entry = ("Q", "Q") if big else ("H", "I")
    inline = 8 if big else 4
    size = (8 if big else 2) + len(entries) * (20 if big else 12) + (8 if big else 4)
    size += size & 1
    body, tail = struct.pack(order + head, len(entries)), bytearray()
    for code, kind, values in entries:
        count, raw = _packed(kind, values, order)
        body += struct.pack(order + "HH" + entry, code, kind, count)
        if len(raw) <= inline:
            body += raw + b"\0" * (inline - len(raw))
        else:
            body += struct.pack(order + entry, at + size + len(tail))
            tail += raw + b"\0" * (len(raw) & 1)
    body += struct.pack(order + entry, following)
    return body + b"\0" * (size - len(body)) + bytes(tail)


def _header(first: int, big: bool, order: str) -> bytes:
    mark = b"II" if order == "<" else b"MM"
    return mark + (struct.pack(order + "HHHQ", 43, 8, 0, first) if big else struct.pack(order + "HI", 42, first))


def ghost_area(planar: int) -> bytes:
    text = (GHOST_TEXT + ("INTERLEAVE=BAND\n" if planar == 2 else "") + " ").encode()
    return b"GDAL_STRUCTURAL_METADATA_SIZE=%06d bytes\n" % len(text) + text


def _plan(images: list[Sizes], cog: bool, order: str, big: bool):
    """(head bytes, tail bytes, offsets by image, end): where everything goes."""
    dirs = lambda offsets, start: _directories(images, offsets, start, big, order)
    zero = [[0] * len(i.counts) for i in images]
    head = 16 if big else 8
    if cog:  # directories first; blocks of the smallest image first, each between its size and its end
        ghost = ghost_area(images[0].spec.planar)
        start = head + len(ghost) + (len(ghost) & 1)
        at = start + len(dirs(zero, start))
        offsets = [list(z) for z in zero]
        for k in [*range(len(images) - 1, 0, -1), 0]:
            for b, n in enumerate(images[k].counts):
                offsets[k][b] = at + 4
                at += 4 + n + min(4, n)
        front = _header(start, big, order) + ghost + b"\0" * (len(ghost) & 1) + dirs(offsets, start)
        return front, b"", offsets, at
    offsets, at = [], head
    for i in images:
        offsets.append([])
        for n in i.counts:
            offsets[-1].append(at)
            at += n
    start = at + (at & 1)
    tail = b"\0" * (at & 1) + dirs(offsets, start)
    return _header(start, big, order), tail, offsets, start + len(tail)


def _directories(images: list[Sizes], offsets: list[list[int]], start: int, big: bool, order: str) -> bytes:
    out = b""
    for k, i in enumerate(images):
        entries = i.spec.entries(offsets[k], i.counts, big)
        size = len(_directory(entries, 0, 0, big, order))
        here = start + len(out)
        out += _directory(entries, here, here + size if k + 1 < len(images) else 0, big, order)
    return out


def layout(images: list[Sizes], cog: bool = False, order: str = "<", variant: str = "auto"):
    """(head, tail, block order, is BigTIFF): the file is head, the payloads in block order, tail.

    variant is classic, bigtiff or auto, which takes BigTIFF only where an offset needs it. Block order lists (image,
    block); a cloud-optimised file lays each payload between its size and its last four bytes.
    """
    for i in images:
        if len(i.counts) != i.spec.n_blocks:
            raise IncompleteImage(f"{len(i.counts)} of {i.spec.n_blocks} blocks")
    if variant not in ("classic", "bigtiff", "auto"):
        raise WriteConfig(f"no such variant: {variant}")
    made = None
    if variant != "bigtiff":
        try:
            made = _plan(images, cog, order, False)
        except (OverflowError, struct.error):
            made = None
        if made is None or made[3] > MAX_32:
            if variant == "classic":
                raise WriteConfig("a classic file holds no more than 4 GiB")
            made = None
    big = made is None
    head, tail, _, _ = made or _plan(images, cog, order, True)
    images_in_order = [*range(len(images) - 1, 0, -1), 0] if cog else range(len(images))
    return head, tail, [(k, b) for k in images_in_order for b in range(len(images[k].counts))], big


def wrapped(payload: bytes, order: str = "<") -> bytes:
    return struct.pack(order + "I", len(payload)) + payload + payload[-4:]


def write_images(images: Iterable[tuple[ImageSpec, np.ndarray]], cog: bool = False, order: str = "<", variant: str = "auto", pad=0) -> bytes:
    """A whole file of images [rows, cols, samples] in memory."""
    sizes, data = [], []
    for spec, image in images:
        if image.shape != (spec.height, spec.width, spec.spp):
            raise WriteConfig(f"an image of {image.shape} for {(spec.height, spec.width, spec.spp)}")
        data.append([spec.encode(b, order) for b in spec.blocks_of(image, pad)])
        sizes.append(Sizes(spec, [len(b) for b in data[-1]]))
    head, tail, blocks, _ = layout(sizes, cog, order, variant)
    return head + b"".join(wrapped(data[k][b], order) if cog else data[k][b] for k, b in blocks) + tail


def overview_of(image: np.ndarray, level: int, resampling: str, nodata: float | None = None) -> np.ndarray:
    """[rows, cols, samples] one level smaller: the first sample of each cell, or the mean of those that are not nodata."""
    if resampling == "nearest":
        return image[::level, ::level]
    h, w, spp = image.shape
    rows, cols = -(-h // level), -(-w // level)
    wide = np.zeros((rows * level, cols * level, spp), np.float64)
    there = np.zeros((rows * level, cols * level, spp), bool)
    wide[:h, :w] = image
    there[:h, :w] = (image != nodata) if nodata is not None and not np.isnan(nodata) else True
    cells = lambda a: a.reshape(rows, level, cols, level, spp).transpose(0, 2, 4, 1, 3).reshape(rows, cols, spp, -1)
    n = cells(there).sum(axis=3)
    with np.errstate(invalid="ignore", over="ignore"):
        mean = np.where(cells(there), cells(wide), 0.0).sum(axis=3) / np.maximum(n, 1)
        mean = np.where(n > 0, mean, nodata if nodata is not None else 0.0)
        return saturated(mean, image.dtype)


def saturated(values: np.ndarray, dtype: np.dtype) -> np.ndarray:
    """Doubles as another type: towards zero, at the ends beyond them, NaN as zero."""
    if dtype.kind == "f":
        return values.astype(dtype)
    ends = np.iinfo(dtype)
    clean = np.nan_to_num(np.trunc(values), nan=0.0, posinf=float(ends.max), neginf=float(ends.min))
    out = np.clip(clean, float(ends.min), float(ends.max))
    return np.where(out >= float(ends.max), ends.max, np.where(out <= float(ends.min), ends.min, out.astype(dtype))).astype(dtype)


def nodata_as(text: str | None, dtype: np.dtype) -> float | None:
    """A nodata text as the samples' type holds it."""
    try:
        value = float(text.strip()) if text is not None else None
    except ValueError:
        return None
    return None if value is None else float(saturated(np.array([value]), dtype)[0])


def pyramid(spec: ImageSpec, image: np.ndarray, levels: list[int], resampling: str = "nearest", nodata: str | None = None) -> list[tuple[ImageSpec, np.ndarray]]:
    """The image and its overviews by level, each from the base."""
    if any(v <= 1 for v in levels):
        raise WriteConfig(f"overview levels must be above 1: {levels}")
    out = [(spec, image)]
    for level in sorted(set(levels)):
        small = overview_of(image, level, resampling, nodata_as(nodata, image.dtype))
        out.append((replace(spec, width=small.shape[1], height=small.shape[0], reduced=True, tags=()), small))
    return out
