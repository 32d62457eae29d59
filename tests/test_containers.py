"""The container, its codecs and metadata, over files made byte by byte and by the writer."""

import itertools
import struct
import threading
from dataclasses import replace
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterloom.sources import codecs, lerc, write
from rasterloom.sources import container as c
from rasterloom.sources.bytesource import BytesSource, HttpSource
from rasterloom.sources.errors import DecodeFailed, InvalidLayout, NotGeoTiff, TiffError, UnsupportedCompression, WriteConfig
from rasterloom.sources.geotiff import crs_of, keys_of_epsg, parse_keys, serialize_keys


def built(entries, data, order="<"):
    """A classic file: header, data at 8, one directory."""
    at = 8 + len(data) + (len(data) & 1)
    return c.Tiff(BytesSource(write._header(at, False, order) + data + b"\0" * (len(data) & 1) + write._directory(sorted(entries), at, 0, False, order)))


def plain(width, height, data, bits=8, photometric=1, spp=1, **more):
    entries = {256: (256, 4, [width]), 257: (257, 4, [height]), 258: (258, 3, [bits] * spp), 259: (259, 3, [1]), 262: (262, 3, [photometric]), 273: (273, 4, [8]), 277: (277, 3, [spp]), 278: (278, 4, [height]), 279: (279, 4, [len(data)])}
    entries |= {int(k[1:]): (int(k[1:]), *v) for k, v in more.items()}
    return built(list(entries.values()), data)


def test_strip_and_bands():
    t = plain(2, 2, bytes([1, 2, 3, 4]))
    assert t.read(t.ifds[0])[:, :, 0].tolist() == [[1, 2], [3, 4]]
    t = plain(2, 2, bytes([1, 10, 100, 2, 20, 110, 3, 30, 120, 4, 40, 130]), photometric=2, spp=3)
    assert t.read(t.ifds[0], band=1).ravel().tolist() == [10, 20, 30, 40]
    assert t.read(t.ifds[0], (0, 1, 2, 1), 2).ravel().tolist() == [110, 130]
    with pytest.raises(c.BandOutOfBounds):
        t.read(t.ifds[0], band=3)


def test_pruning_reads_only_what_it_needs():
    spec = write.ImageSpec(32, 32, 3, photometric=c.RGB, planar=2, tile=(16, 16))
    image = np.arange(32 * 32 * 3, dtype=np.uint8).reshape(32, 32, 3)
    t = c.Tiff(BytesSource(write.write_images([(spec, image)])))
    assert (t.read(t.ifds[0], (0, 0, 16, 16), 1)[:, :, 0] == image[:16, :16, 1]).all() and t.reads == 1
    assert t.read(t.ifds[0], (0, 0, 0, 5)).size == 0 and t.reads == 1
    strips = write.ImageSpec(4, 4, rows_per_strip=1)
    t = c.Tiff(BytesSource(write.write_images([(strips, np.arange(1, 17, dtype=np.uint8).reshape(4, 4, 1))])))
    assert t.read(t.ifds[0], (1, 1, 2, 2)).ravel().tolist() == [6, 7, 10, 11] and t.reads == 2


def test_palette_of_four_bits():
    planes = [v * 17 * 257 for v in range(16)] + [(15 - v) * 17 * 257 for v in range(16)] + [v * 8 * 257 for v in range(16)]
    t = plain(4, 1, bytes([0x01, 0x23]), bits=4, photometric=3, t320=(3, planes))
    assert t.read(t.ifds[0]).ravel().tolist() == [0, 1, 2, 3]
    assert t.read_decoded(t.ifds[0]).ravel().tolist() == [0, 255, 0, 17, 238, 8, 34, 221, 16, 51, 204, 24]


def test_subsampled_chroma_and_predictor():
    t = plain(2, 2, bytes([10, 20, 30, 40, 128, 128]), photometric=6, spp=3, t530=(3, [2, 2]))
    assert t.read(t.ifds[0])[:, :, 0].ravel().tolist() == [10, 20, 30, 40]
    assert t.read_decoded(t.ifds[0])[:, :, 1].ravel().tolist() == [10, 20, 30, 40]
    t = plain(3, 1, bytes([1, 0, 1, 0, 2, 0]), bits=16, t317=(3, [2]))
    assert t.read(t.ifds[0]).ravel().tolist() == [1, 2, 4]


def test_colours_by_known_values():
    def decoded(spec, values):
        t = c.Tiff(BytesSource(write.write_images([(spec, np.array(values, spec.sample).reshape(spec.height, spec.width, spec.spp))])))
        return t.read_decoded(t.ifds[0]).ravel().tolist()

    assert decoded(write.ImageSpec(2, 1, 4, photometric=c.SEPARATED, ink_set=1), [0, 64, 128, 255, 255, 128, 64, 0]) == [0, 0, 0, 0, 127, 191]
    assert decoded(write.ImageSpec(2, 1, 3, photometric=c.YCBCR), [16, 128, 128, 200, 90, 240]) == [16, 16, 16, 255, 133, 133]
    assert decoded(write.ImageSpec(2, 1, photometric=c.WHITE_IS_ZERO), [0, 200]) == [255, 55]
    assert decoded(write.ImageSpec(2, 1, 4, photometric=c.RGB, extra_samples=(1,)), range(8)) == list(range(8))


@pytest.mark.parametrize("dtype", ["u1", "u2", "u4", "u8", "i1", "i2", "i4", "i8", "f4", "f8"])
def test_round_trips(dtype):
    image = (np.random.default_rng(0).random((37, 41, 3)) * 100).astype(dtype)
    for code, predictor, planar, tile, order, variant in itertools.product((codecs.NONE, codecs.LZW, codecs.DEFLATE, codecs.ZSTD), (1, 2, 3), (1, 2), (None, (16, 32)), "<>", ("classic", "bigtiff")):
        if predictor == 3 and dtype[0] != "f":
            continue
        spec = write.ImageSpec(41, 37, 3, dtype, code, predictor, c.RGB, planar, tile, None if tile else 10)
        t = c.Tiff(BytesSource(write.write_images([(spec, image)], order=order, variant=variant)))
        assert t.is_bigtiff == (variant == "bigtiff") and (t.read(t.ifds[0]) == image).all()


def test_lerc_blobs():
    head = lambda n, valid, size: b"Lerc2 " + struct.pack("<iIIIiiiddd", 2, 2, 2, valid, 8, size, 6, 0.0, 1.0, 4.0)
    values = np.array([1, 2, 3, 4], "<f4").tobytes()
    blob = head(4, 4, 62 + 17) + struct.pack("<i", 0) + b"\1" + values
    assert lerc.decode_block(blob, 0, 2, 2, 1, np.dtype("f4")).ravel().tolist() == [1, 2, 3, 4]
    mask = struct.pack("<h", 1) + bytes([0b10110000]) + struct.pack("<h", -32768)
    kept = np.array([1, 3, 4], "<f4").tobytes()
    blob = head(4, 3, 62 + len(mask) + 13) + struct.pack("<i", len(mask)) + mask + b"\1" + kept
    out = lerc.decode_block(blob, 0, 2, 2, 1, np.dtype("f4")).ravel()
    assert out[[0, 2, 3]].tolist() == [1, 3, 4] and np.isnan(out[1])
    whole = lerc.encode(np.ones((2, 2, 1), "f4")) + lerc.encode(np.full((2, 2, 1), 5, "f4"))
    assert lerc.decode_block(whole, 0, 2, 2, 2, np.dtype("f4"))[0, 0].tolist() == [1, 5]
    bad = bytearray(lerc.encode(np.arange(4, dtype="f4").reshape(2, 2, 1)))
    bad[-1] ^= 1
    with pytest.raises(DecodeFailed):
        lerc.decode(bytes(bad))
    steps = (np.arange(64).reshape(8, 8, 1) * 1.1).astype("f4")
    assert np.abs(lerc.decode(lerc.encode(steps, 0.5))[0][0] - steps).max() <= 0.5001
    for additional in (0, 1, 2):
        spec = write.ImageSpec(8, 8, dtype="f4", compression=codecs.LERC, lerc_additional=additional, predictor=3)
        t = c.Tiff(BytesSource(write.write_images([(spec, steps)])))
        assert (t.read(t.ifds[0]) == steps).all() and t.ifds[0].lerc_parameters() == (2, additional)


@pytest.mark.parametrize("name,deltas", [("u1", True), ("u1", False), ("i1", True), ("i1", False)])
def test_lerc_huffman(name, deltas):
    """Blobs whose codes are all 8 or 9 bits long, with a mask."""
    rng = np.random.default_rng(1)
    offset, kind = (128, 0) if name == "i1" else (0, 1)
    image = rng.integers(-100, 100, (6, 7, 2)).astype("i1") if name == "i1" else rng.integers(0, 256, (6, 7, 2)).astype("u1")
    valid = rng.random((6, 7)) < 0.8
    lengths = [8] * 128 + [8] * 126 + [9] * 2 + [0] * 0
    codes, code = {}, 0
    for s, n in enumerate(lengths):
        code <<= n - (lengths[s - 1] if s else n)
        codes[s] = format(code, f"0{n}b")
        code += 1
    symbols = []
    for d in range(2) if deltas else [None]:
        before = 0
        for y, x in zip(*np.nonzero(valid), strict=True):
            if d is None:
                symbols += [int(v) + offset for v in image[y, x]]
                continue
            base = before if x and valid[y, x - 1] or not (y and valid[y - 1, x]) else int(image[y - 1, x, d])
            before = int(image[y, x, d])
            symbols.append((before - base + offset) & 255)

    def words(text):
        text += "0" * (-len(text) % 32)
        return b"".join(int(text[k : k + 32], 2).to_bytes(4, "little") for k in range(0, len(text), 32))

    stuffed = np.packbits(np.array([[n >> k & 1 for k in range(4)] for n in lengths], np.uint8).ravel(), bitorder="little").tobytes()
    table = struct.pack("<iiii", 4, 256, 0, 256) + bytes([1 << 6 | 4]) + struct.pack("<H", 256) + stuffed + words("".join(codes.values()))
    bitset = np.packbits(valid.ravel()).tobytes()
    mask = struct.pack("<h", len(bitset)) + bitset + struct.pack("<h", -32768)
    lows, highs = image.reshape(-1, 2).min(axis=0).tobytes(), image.reshape(-1, 2).max(axis=0).tobytes()
    body = mask + lows + highs + b"\0" + (b"\1" if deltas else b"\2") + table + words("".join(codes[s] for s in symbols)) + bytes(4)
    tail = struct.pack("<iiiiiiiddd", 6, 7, 2, int(valid.sum()), 8, 70 + len(body), kind, 0.5, -128.0, 255.0) + struct.pack("<i", len(mask)) + body
    blob = b"Lerc2 " + struct.pack("<iI", 4, lerc.fletcher32(tail)) + tail
    assert (lerc.decode_block(blob, 0, 6, 7, 2, np.dtype(name)) == np.where(valid[:, :, None], image, 0)).all()


def test_jpeg():
    y, x = np.mgrid[0:40, 0:56]
    image = (120 + 60 * np.sin(y / 9) + 50 * np.cos(x / 7)).astype(np.uint8)[:, :, None]
    spec = write.ImageSpec(56, 40, compression=codecs.JPEG, jpeg_quality=90, tile=(16, 16))
    t = c.Tiff(BytesSource(write.write_images([(spec, image)])))
    assert np.abs(t.read(t.ifds[0]).astype(int) - image).max() <= 4
    flat = np.repeat(np.array([10, 200, 90], np.uint8).reshape(1, 1, 3), 256, axis=0).reshape(16, 16, 3)
    spec = write.ImageSpec(16, 16, 3, compression=codecs.JPEG, jpeg_quality=90, photometric=c.RGB, planar=2)
    t = c.Tiff(BytesSource(write.write_images([(spec, flat)])))
    assert np.abs(t.read(t.ifds[0]).astype(int) - flat).max() <= 2


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_byte_codecs_round_trip(data):
    assert codecs.lzw_decode(codecs.lzw_encode(data), len(data) + 1) == data
    assert codecs.packbits_decode(codecs.packbits_encode(data), len(data) + 1) == data


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 500), st.integers(0, 255), st.booleans())
def test_damaged_files_fail_cleanly(at, byte, cut):
    spec = write.ImageSpec(20, 20, compression=codecs.DEFLATE, tags=write.geo_tags(keys_of_epsg(4326), (1, 1), (0, 0)))
    data = bytearray(write.write_images([(spec, np.arange(400, dtype=np.uint8).reshape(20, 20, 1))]))
    at %= len(data)
    data[at] = byte
    try:
        t = c.Tiff(BytesSource(bytes(data[:at] if cut else data)))
        if t.ifds and t.ifds[0].width * t.ifds[0].height < 1 << 20:
            t.read(t.ifds[0])
        _ = t.geo
    except (TiffError, ValueError, OverflowError, MemoryError, struct.error, IndexError, TypeError):
        pass


def test_geo_metadata():
    one = np.array([10, 20, 30, 40], np.uint8).reshape(2, 2, 1)
    for raster_type, bounds in ((1, [100, 196, 104, 200]), (2, [99, 197, 103, 201])):
        keys = {**keys_of_epsg(4326), 1025: raster_type}
        t = c.Tiff(BytesSource(write.write_images([(write.ImageSpec(2, 2, tags=write.geo_tags(keys, (2, 2), (100, 200), nodata="-9999")), one)])))
        assert (t.geo.crs.epsg, t.geo.bounds, t.geo.nodata) == (4326, bounds, "-9999")
        assert t.geo.transform.to_pixel(*t.geo.transform.to_geo(1.5, 0.25)) == pytest.approx((1.5, 0.25))
    with pytest.raises(NotGeoTiff):
        _ = c.Tiff(BytesSource(write.write_images([(write.ImageSpec(2, 2), one)]))).geo
    matrix = [2.0, 0.5, 0, 10, 0.25, -3.0, 0, 20, *[0.0] * 7, 1.0]
    t = c.Tiff(BytesSource(write.write_images([(write.ImageSpec(2, 2, tags=write.geo_tags(keys_of_epsg(32615), matrix=matrix)), one)])))
    assert (t.geo.transform.origin_x, t.geo.transform.skew_y, t.geo.crs.epsg) == (10, 0.25, 32615)


def test_geokeys():
    keys = {1024: 1, 3072: 26916, 3073: "UTM 16N", 4096: 5703, 4097: "NAVD88 height", 2057: [6378137.0, 2.5]}
    directory, doubles, text = serialize_keys(keys)
    assert parse_keys(directory, doubles, text) == keys
    crs = crs_of(keys)
    assert (crs.kind, crs.epsg, crs.vertical, crs.citation) == ("compound", 26916, 5703, "UTM 16N")
    assert crs_of(keys_of_epsg(4978)).model == 3 and crs_of({}).kind == "unspecified" and crs_of({4096: 5703}).epsg == 5703
    assert parse_keys([1, 1, 0, 2, 1024, 34737, 5, 90, 1025, 0, 1, 2], [], "") == {1025: 2}


def chained(images, sub=()):
    """A file of images, some as SubIFDs of the first."""
    first, rest = images[0], [i for k, i in enumerate(images[1:], 1) if k not in sub]
    nested = [images[k] for k in sub]
    data, at, body = bytes(range(64)), 8 + 64, b""
    dirs, order = {}, [*nested, first, *rest]
    for i in order:
        entries = [*i, (273, 4, [8]), (279, 4, [64])]
        if i is first and nested:
            entries.append((330, 4, [dirs[id(n)] for n in nested]))
        dirs[id(i)] = at + len(body)
        body += write._directory(sorted(entries), at + len(body), 0, False, "<")
    raw = bytearray(write._header(dirs[id(first)], False, "<") + data + body)
    for a, b in zip([first, *rest], rest, strict=False):
        where = dirs[id(a)]
        n = struct.unpack_from("<H", raw, where)[0]
        struct.pack_into("<I", raw, where + 2 + 12 * n, dirs[id(b)])
    return c.Tiff(BytesSource(bytes(raw)))


def image(w, h, *more):
    return [(256, 4, [w]), (257, 4, [h]), (258, 3, [8]), (259, 3, [1]), (262, 3, [1]), (277, 3, [1]), (278, 4, [h]), *more]


GEO = [t for t in write.geo_tags(keys_of_epsg(4326), (1, 1), (0, 0))]


def test_overviews():
    small = lambda w, flag=None: image(w, w, *([(254, 4, [flag])] if flag is not None else []))
    t = chained([image(8, 8, *GEO), small(4, 1), small(2), small(2, 0), small(8, 1)])
    assert [(o.ifd.width, o.top_level_index) for o in t.geo.overviews] == [(4, 1), (2, 2)]
    t = chained([image(8, 8, *GEO), small(4, 1)], sub=(1,))
    assert [(o.ifd.width, o.top_level_index) for o in t.geo.overviews] == [(4, None)]
    t = chained([image(4, 4, *GEO, (254, 4, [1])), small(2, 1), small(8)])
    assert t.geo.base.index == 2


def test_cog_layout():
    pixels = (np.arange(64 * 64) % 251).astype(np.uint8).reshape(64, 64, 1)
    for variant, at in (("auto", 8), ("bigtiff", 16)):
        data = write.write_images(write.pyramid(write.ImageSpec(64, 64, compression=codecs.DEFLATE, tile=(32, 32), tags=tuple(GEO)), pixels, [4, 2, 2, 4]), cog=True, variant=variant)
        assert data[at:].startswith(c.GHOST)
        t = c.Tiff(BytesSource(data))
        assert t.ghost.leader and t.ghost.trailer and len(t.ifds) == 3
        assert max(i.offset for i in t.ifds) < min(b.offset for i in t.ifds for b in i.blocks())
        assert (t.read(t.ifds[0]) == pixels).all() and (t.read(t.ifds[1]) == pixels[::2, ::2]).all()
    block = t.ifds[0].blocks()[0]
    broken = bytearray(data)
    broken[block.offset + block.byte_count] ^= 1
    t = c.Tiff(BytesSource(bytes(broken)))
    with pytest.raises(InvalidLayout):
        t.payload(t.ifds[0].blocks()[0])
    with pytest.raises(WriteConfig):
        write.pyramid(write.ImageSpec(64, 64), pixels, [0])


def test_average_with_nodata():
    cell = np.array([[1, -1, 2, -1], [-1, -1, -1, 2], [3, 3, -1, -1], [3, -1, 4, 4]], np.float32)[:, :, None]
    assert write.overview_of(cell, 2, "average", -1.0).ravel().tolist() == [1, 2, 3, 4]
    edge = np.arange(15, dtype=np.uint8).reshape(3, 5, 1)
    assert write.overview_of(edge, 2, "average").shape == (2, 3, 1) and write.overview_of(edge, 2, "average")[1, 2, 0] == 14
    assert write.nodata_as("-9999", np.dtype("u1")) == 0 and write.nodata_as("x", np.dtype("u1")) is None
    assert write.saturated(np.array([-1.5, 300.0, np.nan, 2.9]), np.dtype("u1")).tolist() == [0, 255, 0, 2]


@pytest.mark.parametrize(
    "bad",
    [{"width": 0}, {"spp": 2, "photometric": c.RGB}, {"tile": (8, 16)}, {"dtype": "f2"}, {"photometric": c.PALETTE}, {"ink_set": 1}, {"photometric": c.YCBCR, "spp": 3, "dtype": "u2"}, {"compression": codecs.OLD_JPEG},
     {"compression": codecs.PACKBITS}, {"compression": codecs.JPEG, "jpeg_quality": 0}, {"compression": codecs.JPEG, "dtype": "u2"}, {"predictor": 3}, {"planar": 3}, {"compression": codecs.LERC, "dtype": "u8"}],
)
def test_bad_specs(bad):
    with pytest.raises(WriteConfig):
        replace(write.ImageSpec(4, 4), **bad)


def test_bigtiff_is_chosen_by_size():
    spec = write.ImageSpec(1, 3, rows_per_strip=1)
    assert not write.layout([write.Sizes(spec, [1, 1, 1])])[3]
    assert write.layout([write.Sizes(spec, [1 << 31, 1 << 31, 1 << 31])])[3]
    with pytest.raises(WriteConfig):
        write.layout([write.Sizes(spec, [1 << 31, 1 << 31, 1 << 31])], variant="classic")


class Ranges(BaseHTTPRequestHandler):
    data, head = b"", True

    def do_HEAD(self):  # noqa: N802
        self.send_response(200 if self.head else 405)
        if self.head:
            self.send_header("Content-Length", str(len(self.data)))
        self.end_headers()

    def do_GET(self):  # noqa: N802
        a, b = (int(v) for v in self.headers["Range"][6:].split("-"))
        body = self.data[a : b + 1]
        self.send_response(206)
        self.send_header("Content-Range", f"bytes {a}-{a + len(body) - 1}/{len(self.data)}")
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.mark.parametrize("head", [True, False])
def test_http_ranges(head):
    pixels = np.random.default_rng(0).integers(0, 256, (64, 64, 1)).astype(np.uint8)
    Ranges.data, Ranges.head = write.write_images([(write.ImageSpec(64, 64, tile=(16, 16), tags=tuple(GEO)), pixels)], cog=True), head
    server = HTTPServer(("127.0.0.1", 0), Ranges)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    source = HttpSource(f"http://127.0.0.1:{server.server_port}/x.tif", chunk=128, cache_bytes=64 << 10)
    t = c.Tiff(source)
    opened = source.requests
    assert (t.read(t.ifds[0], (0, 0, 16, 16)) == pixels[:16, :16]).all() and source.requests - opened <= 4
    again = source.requests
    t.read(t.ifds[0], (0, 0, 16, 16))
    assert source.requests == again and source.held <= 64 << 10
    assert (t.read(t.ifds[0]) == pixels).all()
    server.shutdown()


def test_old_jpeg_is_refused():
    t = plain(2, 2, bytes(4), t259=(3, [6]))
    with pytest.raises(UnsupportedCompression):
        t.read(t.ifds[0])
