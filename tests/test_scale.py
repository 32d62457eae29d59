"""Reads and writes of many and of large files: partitions, shares and parts."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import files
from rasterloom.sources import codecs, tiff, write


def parts_of(monkeypatch, sizes, **options):
    monkeypatch.setattr(tiff, "listed", lambda path: list(sizes))
    return tiff.TiffReader("x", tiff.Ask.of({"table": "samples", **options}), options).partitions()


def test_large_files_are_split_however_many(monkeypatch):
    """No file is opened to plan; each file's shares are whole."""
    large = [(f"{k}.tif", 10 << 30) for k in range(300)]
    parts = parts_of(monkeypatch, large)
    assert 10_000 <= len(parts) <= 25_000
    for name, _ in large:
        mine = [p.share for p in parts if p.paths == [name]]
        assert mine == [(k, len(mine)) for k in range(len(mine))] and len(mine) > 30
    assert len(parts_of(monkeypatch, [("a.tif", 10 << 30)], partitionBytes="1073741824")) == 80
    assert len(parts_of(monkeypatch, large[:1], window="0,0,512,512")) == 1


def test_urls_are_many_partitions(monkeypatch):
    monkeypatch.setattr(tiff.TiffReader, "_size", lambda self, url: 4 << 20)
    parts = parts_of(monkeypatch, [(f"http://x/{k}.tif", None) for k in range(300)])
    assert len(parts) == 600 and len({p.paths[0] for p in parts}) == 300
    monkeypatch.undo()
    parts = parts_of(monkeypatch, [(f"http://127.0.0.1:9/{k}.tif", None) for k in range(40)])
    assert sum(len(p.paths) for p in parts) == 40 and len(parts) >= 16


def test_small_files_share_partitions(monkeypatch):
    parts = parts_of(monkeypatch, [(f"{k}.tif", 1000) for k in range(1000)])
    assert sum(len(p.paths) for p in parts) == 1000 and 16 <= len(parts) <= 20


def test_shares_of_a_file_are_the_file(spark, tmp_path):
    rng = np.random.default_rng(1)
    image = rng.integers(0, 60_000, (300, 270, 2)).astype(np.uint16)
    spec = write.ImageSpec(270, 300, 2, "u2", codecs.DEFLATE, tile=(32, 48), planar=2)
    (tmp_path / "a.tif").write_bytes(write.write_images([(spec, image)]))
    read = lambda **o: files.read_pixels(spark, f"{tmp_path}/a.tif", **o)
    whole, cut = read(), read(partitionBytes=8192)
    assert cut.rdd.getNumPartitions() > 50
    total = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("row", "col", "band", "value").cast("decimal(38,0)"))).first()
    assert total(whole) == total(cut) and total(whole)[0] == image.size


def test_written_parts(spark, tmp_path):
    """Parts of attempts that failed go with the job's own; a block that is written twice is an error; gaps are filled."""
    spec = write.ImageSpec(64, 64, tile=(16, 16))
    rows = [(0, b, bytes([b]) * 256) for b in range(16) if b != 5]
    df = spark.createDataFrame(rows, "image int, block long, payload binary").repartition(4)
    tiff.register(spark)
    out = df.write.format("tiff").mode("append").option("spec", tiff.spec_json([spec]))
    out.option("fill", 9).save(f"{tmp_path}/a.tif")
    assert os.listdir(tmp_path) == ["a.tif"]
    got = {(r.row // 16 * 4 + r.col // 16): r.value for r in files.read_pixels(spark, f"{tmp_path}/a.tif").collect()}
    assert got == {b: 9 if b == 5 else b for b in range(16)}
    with pytest.raises(Exception, match="written twice"):
        df.union(df).write.format("tiff").mode("append").option("spec", tiff.spec_json([spec])).option("fill", 9).save(f"{tmp_path}/b.tif")
    writer = tiff.TiffWriter(f"{tmp_path}/c.tif", {"spec": tiff.spec_json([spec])})
    (tmp_path / f".c.tif.{writer.job}.lost").write_bytes(b"x")
    writer.abort([])
    assert not [f for f in os.listdir(tmp_path) if f.startswith(".c.tif")]


@pytest.mark.parametrize("resampling", ["nearest", "average"])
@pytest.mark.parametrize("planar", [1, 2])
def test_overviews_of_tiles(spark, tmp_path, resampling, planar):
    """Tiles in any order give the overviews of the whole image, at levels that no block is a multiple of too."""
    rng = np.random.default_rng(3)
    image = rng.integers(0, 250, (75, 53, 3)).astype(np.uint8)
    image[20:40, 10:30] = 0
    spec = write.ImageSpec(53, 75, 3, "u1", codecs.DEFLATE, tile=(16, 32), planar=planar)
    down, across = spec.grid
    rows = []
    for plane in range(3 if planar == 2 else 1):
        for ty in range(down):
            for tx in range(across):
                if (plane, ty, tx) == (0, 1, 1):
                    image[16:32, 32:, slice(None) if planar == 1 else 0] = 6  # never comes
                    continue
                part = image[ty * 16 : ty * 16 + 16, tx * 32 : tx * 32 + 32, slice(plane, plane + 1) if planar == 2 else slice(None)]
                rows.append(((plane * down + ty) * across + tx, *part.shape[:2], part.ravel().tolist()))
    tiles = spark.createDataFrame(rows, "block long, rows int, cols int, samples array<int>").repartition(5)
    files.write_tiles(tiles, f"{tmp_path}/a.tif", spec, "tiff", fill=6, levels=[3, 2], resampling=resampling, nodata="0")
    for k, level in enumerate((2, 3), 1):
        want = write.overview_of(image, level, resampling, 0.0)
        got = np.zeros(want.shape)
        for r in files.read_pixels(spark, f"{tmp_path}/a.tif", ifd=k).collect():
            got[r.row, r.col, r.band] = r.value
        assert (got == want).all(), (level, np.argwhere(got != want)[:3])


def test_codecs_on_published_examples():
    """Byte strings from the format's descriptions, made without the encoders here."""
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    assert codecs.decompress(codecs.PACKBITS, packed, 24) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22" + "AA" * 10)
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]  # of 7 7 7 8 8 7 7 6 6
    bits = "".join(f"{c:09b}" for c in codes)
    assert codecs.decompress(codecs.LZW, int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big"), 9) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    # 1.0 and 2.0 as planes of bytes, most significant first, each byte less the one before it.
    assert codecs.undo_float(bytes.fromhex("3F01408000000000"), 1, 2, 1, np.dtype("f4")).ravel().tolist() == [1.0, 2.0]
