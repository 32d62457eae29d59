"""TIFF files as a Spark data source: images, blocks or pixels to read, encoded blocks to write.

    register(spark)
    spark.read.format("tiff").option("table", "pixels").option("window", "0,0,512,512").load("scenes/")

Reading, a partition is some small files, or a share of the wanted blocks of a file that is larger than `partitionBytes`
when decoded, as its size suggests. No file is opened to plan: each task of a large file reads its directories and takes
its own share of the blocks, whatever the number of files. The window, band and image come as options, or from filters
on row, col, band and ifd where Spark pushes them down; blocks outside never leave the disk.

Writing, rows are (image, block, payload). Each task appends its payloads to a part beside the file; the commit lays out
the directories by the blocks' sizes and puts the parts' payloads in order: on a local or mounted file system by copies
within it, several at once, else by one stream through the driver.
"""

from __future__ import annotations

import functools
import json
import os
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from rasterloom.sources import codecs, container, write
from rasterloom.sources.bytesource import BytesSource, open_source
from rasterloom.sources.errors import IncompleteImage, NotGeoTiff, TiffError
from rasterloom.sources.geotiff import geo_or_none

GEO = (
    "STRUCT<epsg: INT, model_type: INT, raster_type: INT, crs_kind: STRING, transform: STRUCT<origin_x: DOUBLE, pixel_width: DOUBLE, skew_x: DOUBLE, origin_y: DOUBLE, skew_y: DOUBLE, pixel_height: DOUBLE>, "
    "bounds: ARRAY<DOUBLE>, nodata: STRING>"
)
TAGS = "ARRAY<STRUCT<code: INT, type: INT, count: BIGINT, value: STRUCT<longs: ARRAY<DECIMAL(20,0)>, doubles: ARRAY<DOUBLE>, rationals: ARRAY<STRUCT<n: BIGINT, d: BIGINT>>, text: STRING, bytes: BINARY>>>"
SCHEMAS = {
    "images": f"path STRING, ifd_index INT, top_level_ifd_index INT, role STRING, overview INT, width INT, height INT, spp INT, bits INT, sample_format INT, compression INT, photometric INT, planar INT, predictor INT, "
    f"is_tiled BOOLEAN, block_w INT, block_h INT, byte_order STRING, is_bigtiff BOOLEAN, layout_error STRING, tags {TAGS}, geo {GEO}",
    "blocks": "path STRING, ifd_index INT, block_index INT, plane INT, x INT, y INT, cols INT, rows INT, block_w INT, block_h INT, offset BIGINT, byte_count BIGINT, payload BINARY",
    "samples": "path STRING, ifd_index INT, block_index INT, band INT, row INT, col INT, rows INT, cols INT, bands INT, dtype STRING, samples BINARY",
    "pixels": "path STRING, ifd_index INT, row INT, col INT, band INT, value DOUBLE",
}
#: Decoded bytes that a byte of a file is taken for, and partitions that there are at least, if there are as many files.
EXPANSION, LEAST_PARTS = 8, 16
#: Partitions of a read at most, about: beyond, each is larger than partitionBytes.
MOST_PARTS = 20_000
#: Bytes that a pixel of a window is taken for.
WIDEST = 32
#: Copies at once of a commit, and of questions for the sizes of URLs.
COPIES, ASKING = 8, 32
#: Bytes of a copy.
STEP = 64 << 20
#: Decoded bytes of a batch of blocks.
BATCH_BYTES = 4 << 20


@dataclass(frozen=True)
class Ask:
    """What is asked of each file."""

    table: str = "images"
    ifd: int | None = None
    role: str | None = None
    overview: int | None = None
    window: tuple[int, int, int, int] | None = None
    rows: tuple[int, int] | None = None  # from filters: first and last, which need not be in the image
    cols: tuple[int, int] | None = None
    band: int | None = None
    decoded: bool = False
    payload: bool = True
    geo: bool = False
    chunk: int = 256 << 10
    cache: int = 64 << 20

    @classmethod
    def of(cls, options: dict) -> Ask:
        o = {k.lower(): v for k, v in options.items()}
        number = lambda k: int(o[k]) if k in o else None
        window = tuple(int(v) for v in o["window"].split(",")) if "window" in o else None
        table = o.get("table", "images")
        if table not in SCHEMAS:
            raise TiffError(f"no such table: {table}")
        if window is not None and (len(window) != 4 or min(window) < 0):
            raise container.WindowOutOfBounds(f"window {window}")
        return cls(
            table, number("ifd"), o.get("role"), number("overview"), window, None, None, number("band"), o.get("decoded", "false") == "true", o.get("payload", "true") == "true", o.get("geo", "false") == "true",
            int(o.get("chunksize", 256 << 10)), int(o.get("cachebytes", 64 << 20)),
        )


@dataclass
class Part(InputPartition):
    """Files, or the k-th of n shares of the blocks of one."""

    paths: list[str]
    share: tuple[int, int] = (0, 1)


def chosen(tiff: container.Tiff, ask: Ask) -> list[container.Ifd]:
    """The images that are asked for: by index, by role, or all of the chain."""
    if ask.role or ask.overview is not None:
        geo = tiff.geo
        if ask.overview is not None or ask.role == "overview":
            found = [o.ifd for o in geo.overviews]
            if ask.overview is not None and not 0 <= ask.overview < len(found):
                raise TiffError(f"overview {ask.overview} of {len(found)}")
            return found if ask.overview is None else [found[ask.overview]]
        return [geo.base]
    if ask.ifd is not None:
        if not 0 <= ask.ifd < len(tiff.ifds):
            raise TiffError(f"image {ask.ifd} of {len(tiff.ifds)}")
        return [tiff.ifds[ask.ifd]]
    return tiff.ifds


def wanted(ifd: container.Ifd, ask: Ask) -> tuple[tuple[int, int, int, int], list[container.Block]]:
    """The window within the image, and the blocks that hold some of it and of the band."""
    lay = ifd.layout()
    r0, c0, rows, cols = ask.window or (0, 0, lay.height, lay.width)
    if r0 + rows > lay.height or c0 + cols > lay.width:
        raise container.WindowOutOfBounds(f"window {ask.window} of {lay.height} x {lay.width}")
    if ask.band is not None and not 0 <= ask.band < (ifd.decoded_layout() if ask.decoded else lay).spp:
        raise container.BandOutOfBounds(f"band {ask.band} of {lay.spp}")
    r1, c1 = r0 + rows, c0 + cols
    if ask.rows:
        r0, r1 = max(r0, ask.rows[0]), min(r1, ask.rows[1] + 1)
    if ask.cols:
        c0, c1 = max(c0, ask.cols[0]), min(c1, ask.cols[1] + 1)
    if r1 <= r0 or c1 <= c0:
        return (r0, c0, 0, 0), []
    plane = ask.band if lay.planar == 2 and not ask.decoded else None
    return (r0, c0, r1 - r0, c1 - c0), [b for b in ifd.blocks() if b.overlaps(r0, c0, r1 - r0, c1 - c0) and plane in (None, b.plane)]


def tag_row(t: container.Tag) -> dict:
    value = dict.fromkeys(("longs", "doubles", "rationals", "text", "bytes"))
    if isinstance(t.values, str):
        value["text"] = t.values
    elif isinstance(t.values, bytes):
        value["bytes"] = t.values
    elif t.type in (5, 10):
        value["rationals"] = [{"n": n, "d": d} for n, d in t.values]
    elif t.type in (11, 12):
        value["doubles"] = t.values
    else:
        value["longs"] = t.values
    return {"code": t.code, "type": t.type, "count": t.count, "value": value}


def image_rows(path: str, tiff: container.Tiff, ask: Ask) -> Iterator[dict]:
    """A row for each image; one whose tags describe none says why and has no layout."""
    geo = geo_or_none(tiff)
    if ask.geo and geo is None:
        raise NotGeoTiff(f"{path} has no GeoKeys")
    small = {o.ifd.offset: k for k, o in enumerate(geo.overviews)} if geo else {}
    nested = [o.ifd for o in geo.overviews if o.top_level_index is None] if geo else []
    images = [*tiff.ifds, *nested] if ask.ifd is None and ask.role is None and ask.overview is None else chosen(tiff, ask)
    for i in images:
        row = {
            "path": path, "ifd_index": i.index, "top_level_ifd_index": i.index if i.top_level else None, "width": i.width, "height": i.height, "compression": i.compression, "photometric": i.photometric, "is_tiled": i.is_tiled,
            "byte_order": "little" if tiff.order == "<" else "big", "is_bigtiff": tiff.is_bigtiff, "tags": [tag_row(t) for t in i.tags.values()], "overview": small.get(i.offset),
            "role": "base" if geo and i.offset == geo.base.offset else "overview" if i.offset in small else "image", "geo": geo.row() if geo and i.offset == geo.base.offset else None,
        }
        try:
            lay = i.layout()
            h, w = (i.number(container.TILE_LENGTH), i.number(container.TILE_WIDTH)) if i.is_tiled else (min(i.number(container.ROWS_PER_STRIP, lay.height), lay.height), lay.width)
            row |= {"spp": lay.spp, "bits": lay.bits, "sample_format": lay.sample_format, "planar": lay.planar, "predictor": lay.predictor, "block_w": w, "block_h": h}
        except TiffError as e:
            row["layout_error"] = f"{type(e).__name__}: {e}"
        yield row


def block_rows(path: str, tiff: container.Tiff, ifd: container.Ifd, blocks: list[container.Block], payload: bool) -> Iterator[dict]:
    for b in blocks:
        yield {
            "path": path, "ifd_index": ifd.index, "block_index": b.index, "plane": b.plane, "x": b.x, "y": b.y, "cols": b.cols, "rows": b.rows, "block_w": b.block_w, "block_h": b.block_h, "offset": b.offset, "byte_count": b.byte_count,
            "payload": tiff.payload(b) if payload else None,
        }


def decoded_parts(tiff: container.Tiff, ifd: container.Ifd, blocks: list[container.Block], window: tuple[int, int, int, int], ask: Ask) -> Iterator[tuple]:
    """(block, row, col, first band, [rows, cols, bands]) of what each block holds of the window."""
    r0, c0, rows, cols = window
    lay = ifd.layout()
    for b in blocks:
        top, left, end, right = max(r0, b.y), max(c0, b.x), min(r0 + rows, b.y + b.rows), min(c0 + cols, b.x + b.cols)
        if ask.decoded:
            if lay.planar == 2 and b.plane:
                continue  # colours need all planes: they are read with the first
            data, first = tiff.read_decoded(ifd, (top, left, end - top, right - left)), 0
        else:
            data, first = tiff.decode(ifd, b)[top - b.y : end - b.y, left - b.x : right - b.x], b.plane
        if ask.band is not None and not (lay.planar == 2 and not ask.decoded):
            data, first = data[:, :, ask.band : ask.band + 1], ask.band
        yield b, top, left, first, data


def pixel_batches(path: str, tiff: container.Tiff, ifd: container.Ifd, blocks: list[container.Block], window: tuple[int, int, int, int], ask: Ask) -> Iterator[pa.RecordBatch]:
    for _, top, left, first, data in decoded_parts(tiff, ifd, blocks, window, ask):
        h, w, n = data.shape
        spread = lambda a, axis, shape=data.shape: np.broadcast_to(a.reshape([-1 if k == axis else 1 for k in range(3)]), shape).ravel().astype(np.int32)
        count = h * w * n
        yield pa.RecordBatch.from_arrays(
            [pa.DictionaryArray.from_arrays(pa.array(np.zeros(count, np.int32)), pa.array([path])).cast(pa.string()), pa.array(np.full(count, ifd.index, np.int32)), pa.array(spread(np.arange(top, top + h), 0)), pa.array(spread(np.arange(left, left + w), 1)),
             pa.array(spread(np.arange(first, first + n), 2)), pa.array(data.astype(np.float64).ravel())],
            names=["path", "ifd_index", "row", "col", "band", "value"],
        )


def _arrow_type(ddl: str) -> pa.DataType:
    """The Arrow type of a type's DDL; workers have no session to parse it."""
    ddl = ddl.strip()
    if ddl.startswith("ARRAY<"):
        return pa.list_(_arrow_type(ddl[6:-1]))
    if ddl.startswith("STRUCT<"):
        return pa.struct([pa.field(n, _arrow_type(t)) for n, t in (f.split(":", 1) for f in _fields(ddl[7:-1]))])
    simple = {"STRING": pa.string(), "INT": pa.int32(), "BIGINT": pa.int64(), "DOUBLE": pa.float64(), "BOOLEAN": pa.bool_(), "BINARY": pa.binary(), "DECIMAL(20,0)": pa.decimal128(20, 0)}
    return simple[ddl]


def _fields(ddl: str) -> list[str]:
    """What commas outside of brackets part."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(ddl):
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and not depth:
            out.append(ddl[start:i].strip())
            start = i + 1
    return [*out, ddl[start:].strip()]


@functools.cache
def arrow_schema(table: str) -> pa.Schema:
    return pa.schema([pa.field(n, _arrow_type(t)) for n, t in (f.split(" ", 1) for f in _fields(SCHEMAS[table]))])


def file_batches(path: str, tiff: container.Tiff, ask: Ask, share: tuple[int, int] = (0, 1)) -> Iterator[pa.RecordBatch]:
    """All that is asked of one open file, or of the k-th of n shares of its blocks."""
    if ask.table == "images":
        yield pa.RecordBatch.from_pylist([_whole(r) for r in image_rows(path, tiff, ask)], schema=arrow_schema("images"))
        return
    if ask.geo and geo_or_none(tiff) is None:
        raise NotGeoTiff(f"{path} has no GeoKeys")
    for ifd in chosen(tiff, ask):
        window, blocks = wanted(ifd, ask)
        k, n = share
        blocks = blocks[len(blocks) * k // n : len(blocks) * (k + 1) // n]
        if ask.table == "samples":
            schema = arrow_schema("samples")
            made = lambda rows: pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows, held = [], 0
            for b, top, left, first, data in decoded_parts(tiff, ifd, blocks, window, ask):
                rows.append((path, ifd.index, b.index, first, top, left, *data.shape, data.dtype.str[1:], data.tobytes()))
                held += data.nbytes
                if held >= BATCH_BYTES:
                    yield made(rows)
                    rows, held = [], 0
            if rows:
                yield made(rows)
        elif ask.table == "blocks":
            for at in range(0, len(blocks), 64):
                yield pa.RecordBatch.from_pylist(list(block_rows(path, tiff, ifd, blocks[at : at + 64], ask.payload)), schema=arrow_schema("blocks"))
        else:
            yield from pixel_batches(path, tiff, ifd, blocks, window, ask)


def _whole(row: dict) -> dict:
    from decimal import Decimal

    for t in row["tags"]:
        if t["value"]["longs"] is not None:
            t["value"]["longs"] = [Decimal(v) for v in t["value"]["longs"]]
    return row


def listed(path: str) -> list[tuple[str, int | None]]:
    """The files of a path, a folder, a glob pattern, or a comma-separated list of these, with their sizes if known."""
    out = []
    for p in re.split(r",(?=[^,]*[/\w])", path):
        if re.match(r"https?://", p):
            out.append((p, None))
            continue
        scheme = re.match(r"[a-z0-9]+:/", p)
        where, inner = fs.FileSystem.from_uri(p) if scheme else (fs.LocalFileSystem(), os.path.abspath(p))
        prefix = p[: len(p) - len(inner)] if scheme and p.endswith(inner) else ""
        if any(ch in inner for ch in "*?["):
            import fnmatch

            root = re.split(r"[*?\[]", inner)[0].rpartition("/")[0] or "/"
            found = [i for i in where.get_file_info(fs.FileSelector(root, recursive=True)) if fnmatch.fnmatch(i.path, inner)]
        elif (info := where.get_file_info(inner)).type == fs.FileType.Directory:
            found = [i for i in where.get_file_info(fs.FileSelector(inner, recursive=True)) if not os.path.basename(i.path).startswith((".", "_"))]
        else:
            out.append((p, info.size))
            continue
        out += sorted((prefix + i.path, i.size) for i in found if i.type == fs.FileType.File)
    return out


class TiffReader(DataSourceReader):
    def __init__(self, path: str, ask: Ask, options: dict):
        self.path, self.ask = path, ask
        o = {k.lower(): v for k, v in options.items()}
        self.bytes, self.files = int(o.get("partitionbytes", 16 << 20)), int(o.get("filesperpartition", 64))

    def partitions(self) -> list[Part]:
        files, ask = listed(self.path), self.ask
        if ask.window and 0 in ask.window[2:]:
            return []
        if ask.table == "images":
            return [Part([f for f, _ in files[k : k + self.files]]) for k in range(0, len(files), self.files)]
        if any(size is None for _, size in files):
            with ThreadPoolExecutor(ASKING) as pool:  # a HEAD each
                files = list(pool.map(lambda f: (f[0], self._size(f[0]) if f[1] is None else f[1]), files))
        most = max(1, len(files) // LEAST_PARTS)
        each = max(self.bytes, sum(self._decoded(size) for _, size in files) // MOST_PARTS)
        parts, group, held = [], [], 0
        for f, size in files:
            shares = -(-self._decoded(size) // each)
            if shares > 1:
                parts += [Part([f], (k, shares)) for k in range(shares)]
                continue
            group.append(f)
            held += size
            if held * EXPANSION >= each or len(group) >= min(most, self.files):
                parts.append(Part(group))
                group, held = [], 0
        return [*parts, Part(group)] if group else parts

    def _size(self, url: str) -> int:
        """What a URL says; one that says nothing goes whole."""
        try:
            return open_source(url, self.ask.chunk, 0).size
        except (OSError, TiffError):
            return self.bytes // EXPANSION

    def _decoded(self, size: int) -> int:
        """About how many bytes a file gives: by its size, or by the window if that is smaller."""
        decoded = size * EXPANSION
        return decoded if self.ask.window is None else min(decoded, self.ask.window[2] * self.ask.window[3] * WIDEST)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Part):
            return
        for f in partition.paths:
            yield from file_batches(f, container.Tiff(open_source(f, self.ask.chunk, self.ask.cache)), self.ask, partition.share)


class PushingTiffReader(TiffReader):
    """Also takes filters on row, col, band and ifd_index; Spark applies them again."""

    def pushFilters(self, filters):  # noqa: N802
        spans = {"row": [0, 1 << 40], "col": [0, 1 << 40], "band": [0, 1 << 40], "ifd_index": [0, 1 << 40]}
        for f in filters:
            yield f
            name = getattr(f, "attribute", ("",))[-1]
            if name not in spans or not isinstance(getattr(f, "value", None), int):
                continue
            span = spans[name]
            if isinstance(f, EqualTo):
                span[:] = [max(span[0], f.value), min(span[1], f.value)]
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                span[0] = max(span[0], f.value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                span[1] = min(span[1], f.value - isinstance(f, LessThan))
        if self.ask.table == "pixels":
            one = lambda s, now: s[0] if s[0] == s[1] and now is None else now
            self.ask = replace(self.ask, rows=tuple(spans["row"]), cols=tuple(spans["col"]), band=one(spans["band"], self.ask.band), ifd=one(spans["ifd_index"], self.ask.ifd))


@dataclass
class Written(WriterCommitMessage):
    part: str
    blocks: list[tuple[int, int, int, int]]  # image, block, offset in the part, length


def spec_json(images: list[write.ImageSpec]) -> str:
    return json.dumps([asdict(i) for i in images])


def specs_of(text: str) -> list[write.ImageSpec]:
    deep = lambda v: tuple(map(deep, v)) if isinstance(v, list) else v
    return [write.ImageSpec(**{k: deep(v) for k, v in d.items()}) for d in json.loads(text)]


def _store(path: str):
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:/", path) else (fs.LocalFileSystem(), os.path.abspath(path))


class TiffWriter(DataSourceArrowWriter):
    """Options: spec (JSON of the images), cog, byteOrder (little or big), variant, fill (a sample for blocks that never came)."""

    def __init__(self, path: str, options: dict):
        o = {k.lower(): v for k, v in options.items()}
        self.path, self.images = path, specs_of(o["spec"])
        self.cog, self.order, self.variant = o.get("cog", "false") == "true", "<" if o.get("byteorder", "little") == "little" else ">", o.get("variant", "auto")
        self.fill = float(o["fill"]) if "fill" in o else None
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, inner = _store(self.path)
        where.create_dir(os.path.dirname(inner), recursive=True)
        part, blocks, at = f"{self._parts(inner)}{uuid.uuid4().hex}", [], 0
        with where.open_output_stream(part) as out:
            for batch in iterator:
                for image, block, payload in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("image", "block", "payload")), strict=True):
                    out.write(payload)
                    blocks.append((image, block, at, len(payload)))
                    at += len(payload)
        return Written(part, blocks)

    def _parts(self, inner: str) -> str:
        """What the names of this job's parts begin with."""
        return f"{os.path.dirname(inner)}/.{os.path.basename(inner)}.{self.job}."

    def commit(self, messages: list[Written | None]) -> None:
        where, inner = _store(self.path)
        found: dict[tuple[int, int], tuple[str, int, int]] = {}
        for m in messages:
            for image, block, at, n in m.blocks if m else ():
                if (image, block) in found:
                    raise write.WriteConfig(f"block {block} of image {image} was written twice")
                found[image, block] = (m.part, at, n)
        filler: dict[int, bytes] = {}
        sizes = []
        for k, spec in enumerate(self.images):
            missing = [b for b in range(spec.n_blocks) if (k, b) not in found]
            if missing and self.fill is None:
                raise IncompleteImage(f"{len(missing)} of {spec.n_blocks} blocks of image {k} were never written")
            if missing:
                filler[k] = spec.encode(np.full((*spec.block, spec.block_spp), self.fill).astype(spec.sample), self.order)
            sizes.append(write.Sizes(spec, [found[k, b][2] if (k, b) in found else len(filler[k]) for b in range(spec.n_blocks)]))
        head, tail, order, _ = write.layout(sizes, self.cog, self.order, self.variant)
        pieces = self._pieces(head, tail, order, found, filler)
        if isinstance(where, fs.LocalFileSystem):
            self._place(f"{inner}.part", pieces)
        else:
            self._stream(where, f"{inner}.part", pieces)
        where.move(f"{inner}.part", inner)
        self.abort(messages)

    def _pieces(self, head: bytes, tail: bytes, order: list, found: dict, filler: dict[int, bytes]) -> Iterator[bytes | tuple[str, int, int]]:
        """The file in order: bytes, or (part, offset, length); payloads that lie side by side in a part are one."""
        held, last = bytearray(head), None
        for k, b in order:
            part, at, n = found.get((k, b), (None, 0, len(filler.get(k, b""))))
            if self.cog:
                held += write.struct.pack(self.order + "I", n)
            if part is None:
                held += filler[k]
                end = filler[k][-4:]
            elif not held and last and (last[0], last[1] + last[2]) == (part, at):
                last = (part, last[1], last[2] + n)
            else:
                yield from (last,) if last else ()
                yield from (bytes(held),) if held else ()
                held, last = bytearray(), (part, at, n)
            if part is not None and self.cog:
                end = self._end(part, at, n)
            if (self.cog or part is None) and last:
                yield last
                last = None
            if self.cog:
                held += end
        yield from (last,) if last else ()
        yield bytes(held) + tail

    def _end(self, part: str, at: int, n: int) -> bytes:
        where, _ = _store(self.path)
        with where.open_input_file(part) as f:
            return f.read_at(min(4, n), at + n - min(4, n))

    def _place(self, path: str, pieces: Iterator) -> None:
        """Copies within the file system, several at once; payloads don't pass through this process where it can avoid them."""
        jobs, at = [], 0
        with open(path, "wb") as out:
            target = out.fileno()
            for piece in pieces:
                if isinstance(piece, bytes):
                    os.pwrite(target, piece, at)
                    at += len(piece)
                else:
                    jobs.append((*piece, at))
                    at += piece[2]
            os.truncate(target, at)
            with ThreadPoolExecutor(COPIES) as pool:
                list(pool.map(lambda job: _copy(*job, target), jobs))

    def _stream(self, where, path: str, pieces: Iterator) -> None:
        opened: dict = {}
        with where.open_output_stream(path) as out:
            for piece in pieces:
                if isinstance(piece, bytes):
                    out.write(piece)
                    continue
                part, at, n = piece
                if part not in opened:
                    opened[part] = where.open_input_file(part)
                for lo in range(0, n, STEP):
                    out.write(opened[part].read_at(min(STEP, n - lo), at + lo))
        for f in opened.values():
            f.close()

    def abort(self, messages: list[Written | None]) -> None:
        """Deletes the job's parts, those of attempts that failed as well."""
        where, inner = _store(self.path)
        begin = self._parts(inner)
        for info in where.get_file_info(fs.FileSelector(os.path.dirname(inner), allow_not_found=True)):
            if os.path.basename(info.path).startswith(os.path.basename(begin)):
                where.delete_file(info.path)


def _copy(part: str, start: int, length: int, at: int, target: int) -> None:
    source = os.open(part, os.O_RDONLY)
    try:
        while length:
            try:
                done = os.copy_file_range(source, target, min(length, STEP), start, at)
            except OSError:  # not on this file system
                done = os.pwrite(target, os.pread(source, min(length, STEP), start), at)
            if not done:
                raise IncompleteImage(f"{part} ends early")
            start, at, length = start + done, at + done, length - done
    finally:
        os.close(source)


class TiffSource(DataSource):
    """`tiff`: options as in Ask and TiffWriter."""

    need_geo = False

    @classmethod
    def name(cls) -> str:
        return "tiff"

    def _ask(self) -> Ask:
        return replace(Ask.of(self.options), geo=self.need_geo or self.options.get("geo") == "true")

    def schema(self) -> str:
        return SCHEMAS[self._ask().table]

    def reader(self, schema: StructType) -> DataSourceReader:
        kind = PushingTiffReader if self.options.get("pushdown", "true") == "true" else TiffReader
        return kind(self.options["path"], self._ask(), self.options)

    def writer(self, schema: StructType, overwrite: bool) -> TiffWriter:
        return TiffWriter(self.options["path"], self.options)


class GeoTiffSource(TiffSource):
    """`geotiff`: as `tiff`, of files that have GeoKeys."""

    need_geo = True

    @classmethod
    def name(cls) -> str:
        return "geotiff"


class CogSource(GeoTiffSource):
    """`cog`: as `geotiff`; files are written with their directories first."""

    @classmethod
    def name(cls) -> str:
        return "cog"

    def writer(self, schema: StructType, overwrite: bool) -> TiffWriter:
        return TiffWriter(self.options["path"], {**self.options, "cog": "true"})


def register(spark: SparkSession) -> SparkSession:
    """Makes the formats known, and lets Spark push filters to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (TiffSource, GeoTiffSource, CogSource):
        spark.dataSource.register(source)
    return spark


def from_content(files, table: str = "images", **options):
    """The same tables of a DataFrame (path, content), as Spark's binaryFile gives: for stores that only Spark reads."""
    ask = Ask.of({"table": table, **{k: str(v) for k, v in options.items()}})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from file_batches(path, container.Tiff(BytesSource(content.as_py())), ask)

    return files.select("path", "content").mapInArrow(read, SCHEMAS[table])


__all__ = ["CogSource", "GeoTiffSource", "TiffSource", "codecs", "from_content", "register", "spec_json"]
