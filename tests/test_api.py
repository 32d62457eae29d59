"""The named questions of one file."""

import numpy as np
from pyspark.sql import functions as F

from rasterloom.api import Raster
from rasterloom.sources import codecs, container, write
from rasterloom.sources.bytesource import BytesSource, FileSource
from rasterloom.sources.geotiff import Crs, crs_of, keys_of_crs, keys_of_epsg


def test_questions(spark, tmp_path):
    image = np.random.default_rng(0).integers(0, 256, (50, 40, 4)).astype(np.uint8)
    tags = write.geo_tags(keys_of_epsg(32615), (30, 30), (500000, 4500000), nodata="0")
    spec = write.ImageSpec(40, 50, 4, compression=codecs.DEFLATE, photometric=container.SEPARATED, planar=2, tile=(16, 16), tags=tags)
    path = f"{tmp_path}/a.tif"
    (tmp_path / "a.tif").write_bytes(write.write_images(write.pyramid(spec, image, [2, 4]), cog=True))
    r = Raster(spark, path, "geotiff")
    assert [(o.overview, o.width, o.height) for o in r.overviews().orderBy("overview").collect()] == [(0, 20, 25), (1, 10, 13)]
    assert r.crs().first()[1:] == (32615, 1, 1, "horizontal", "0")
    assert r.bounds().first()[1:] == (500000, 4500000 - 1500, 500000 + 1200, 4500000)
    assert r.tag(container.PIXEL_SCALE).first().tag.value.doubles == [30, 30, 0]
    values = lambda df: {(p.row, p.col, p.band): p.value for p in df.collect()}
    want = lambda a, r0=0, c0=0, b0=0: {(r0 + i, c0 + j, b0 + k): float(a[i, j, k]) for i, j, k in np.ndindex(a.shape)}
    assert values(r.pixels(role="base")) == want(image)
    assert values(r.pixels((3, 5, 20, 30), band=2, role="base")) == want(image[3:23, 5:35, 2:3], 3, 5, 2)
    assert values(r.pixels(overview=1)) == want(image[::4, ::4])
    file = container.Tiff(FileSource(f"{tmp_path}/a.tif"))
    colours = file.read_decoded(file.ifds[0])
    assert colours.shape == (50, 40, 3) and values(r.pixels(role="base", decoded=True)) == want(colours)
    whole = r.bytes((10, 0, 20, 40), role="base").first()
    assert (np.frombuffer(whole.bytes, whole.dtype).reshape(20, 40, 4) == image[10:30]).all()
    assert r.blocks(window=(0, 0, 1, 1), band=1, role="base").count() == 1 and r.samples(role="base").count() == 4 * 12
    at = spark.createDataFrame([(path, 2, 3)], "path string, col int, row int")
    there = r.to_geo(at)
    assert there.first()[3:] == (500060.0, 4499910.0)
    assert r.to_pixel(there.select("path", F.col("x"), F.col("y"))).first()[3:] == (2.0, 3.0)


def test_reference_systems_and_skew():
    both = Crs(1, 1, "compound", 26916, None, 5703, "NAD83 / UTM 16N")
    assert crs_of(keys_of_crs(both)) == both
    assert 4096 not in keys_of_crs(Crs(2, 1, "horizontal", None, 4326, None, None), {4096: 5703, 1024: 1})
    tags = write.geo_tags(keys_of_epsg(4326), (2, 3), (10, 20), skew=(0.5, 0.25))
    t = container.Tiff(BytesSource(write.write_images([(write.ImageSpec(2, 2, tags=tags), np.zeros((2, 2, 1), np.uint8))])))
    assert t.geo.transform.skew_x == 0.5 and t.geo.transform.pixel_height == -3
