"""Operators, expressions, the data source and streams on Spark; every query with SQL against DuckDB."""

import duckdb
import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rasterloom import catalog
from rasterloom.functions import geo, pixels
from rasterloom.operators import files, raster
from rasterloom.sources import codecs, container, tiff, udtf, write
from rasterloom.sources.geotiff import keys_of_epsg
from rasterloom.streaming.tiles import TileIngest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query_matches_sql(name, spark, duck):
    found = catalog.queries()[name](spark, SF)
    cols = sorted(found.columns)
    mine = sorted(tuple(map(str, r)) for r in found.select(*cols).collect())
    got = duck.execute(f"SELECT {', '.join(cols)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert mine == sorted(tuple(map(str, r)) for r in got) and mine


def test_entry_imports_without_llm():
    import __spark_entry__

    assert set(catalog.queries()) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_expressions(spark):
    lit = F.lit
    assert one(spark, pixels.half_away(lit(2.5)), pixels.half_away(lit(-2.5)))[:] == (3, -3)
    assert one(spark, pixels.scale_bits(lit(15), 4, 8), pixels.scale_bits(lit(65535), 16, 8), pixels.scale_bits(lit(255), 8, 64))[:] == (255, 255, 2**64 - 1)
    assert one(spark, *pixels.cmyk_to_rgb(lit(255), lit(128), lit(64), lit(0)))[:] == (0, 127, 191)
    assert one(spark, *pixels.ycbcr_to_rgb(lit(200), lit(90), lit(240)))[:] == (255, 133, 133)
    assert one(spark, pixels.saturate(lit(-3.7), 0, 255), pixels.saturate(lit(float("nan")), 0, 255), pixels.saturate(lit(1e9), 0, 255), pixels.saturate(lit(2.9), 0, 255))[:] == (0, 0, 255, 2)
    assert one(spark, pixels.nodata_value(lit(" -9999 "), 0, 255), pixels.nodata_value(lit("none")), pixels.is_nodata(lit(float("nan")), lit(float("nan"))))[:] == (0.0, None, False)
    planes = [F.array(*(lit(v * 257) for v in p)) for p in ((1, 2), (3, 4), (5, 6))]
    assert one(spark, *pixels.palette(lit(1), *planes, to_bits=8), pixels.palette_is_8_bit(*planes))[:] == (2, 4, 6, True)
    with pytest.raises(PySparkException):
        one(spark, *pixels.palette(lit(2), *planes))
    packed = pixels.pack_bits([lit(3), lit(12)], 4)
    assert one(spark, packed, pixels.unpack_bits(packed, 4))[:] == (0x3C, [3, 12])


def test_geo_expressions(spark):
    z = F.lit(0.0)
    t = geo.from_tiepoint_and_scale(F.array(z, z, z, F.lit(100.0), F.lit(200.0), z), F.array(F.lit(2.0), F.lit(2.0), z), F.lit(2))
    b = one(spark, geo.bounds(t, F.lit(2), F.lit(2)))[0]
    assert tuple(b) == (99, 197, 103, 201)
    made = one(spark, geo.to_tiepoint_and_scale(t), geo.from_matrix(geo.to_matrix(t)) == t, geo.model_of_epsg(F.lit(4978)), geo.model_of_epsg(F.lit(4326)), geo.model_of_epsg(F.lit(32615)))
    assert made[0].scale == [2.0, 2.0, 0.0] and made[1:] == (True, 3, 2, 1)
    flat = geo.transform(*(F.lit(v) for v in (0, 1e-9, 0, 0, 0, 1e-9)))
    assert one(spark, *geo.geo_to_pixel(flat, F.lit(1), F.lit(1)))[:] == (None, None)


def test_windows_and_levels(spark):
    rows = spark.createDataFrame([(r, [r * 4 + c + 1 for c in range(4)]) for r in range(4)], "row long, samples array<int>")
    assert sorted(r.value for r in raster.window(rows, 1, 1, 2, 2).collect()) == [6, 7, 10, 11]
    assert raster.window(rows, 0, 0, 0, 3).count() == 0
    with pytest.raises(container.WindowOutOfBounds):
        raster.check_window(3, 0, 2, 1, 4, 4)
    with pytest.raises(container.BandOutOfBounds):
        raster.band(rows, 2, 2)
    with pytest.raises(ValueError):
        raster.overview_levels([2, 1])
    cell = spark.createDataFrame([(0, [1.0, -1.0, 2.0, -1.0]), (1, [-1.0, -1.0, -1.0, 2.0]), (2, [3.0, 3.0, -1.0, -1.0]), (3, [3.0, -1.0, 4.0, 4.0])], "row long, samples array<double>")
    assert [r.value for r in raster.average_overview(cell, 2, F.lit(-1.0), None).orderBy("row", "col").collect()] == [1, 2, 3, 4]
    hidden = spark.createDataFrame([(0, [float("nan"), 1.0])], "row long, samples array<double>")
    assert np.isnan(raster.average_overview(hidden, 2, F.lit(float("nan")), None).first().value)


def test_window_reaches_the_scan(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("row"), F.col("embedding").alias("samples"))
    plan = raster.window(df, 10, 0, 5, 4)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(vec_id,10)" in plan and "label" not in plan


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(r, [(r * 31 + c * 17) % 251 for c in range(60)]) for r in range(50)], "row long, samples array<int>")


def values(df):
    return {(r.row, r.col, r.band): r.value for r in df.collect()}


@pytest.mark.parametrize("how", [{}, {"planar": 2}, {"predictor": 2, "compression": codecs.ZSTD}, {"tile": None, "rows_per_strip": 7}])
def test_files_of_bands(spark, rows, how, tmp_path):
    spec = write.ImageSpec(**{"width": 20, "height": 50, "spp": 3, "photometric": container.RGB, "compression": codecs.DEFLATE, "tile": (16, 16), **how})
    files.write_file(rows, f"{tmp_path}/a.tif", spec)
    want = {(r, c, b): float((r * 31 + (c * 3 + b) * 17) % 251) for r in range(50) for c in range(20) for b in range(3)}
    assert values(files.read_pixels(spark, f"{tmp_path}/a.tif")) == want
    assert values(files.read_pixels(spark, f"file://{tmp_path}/a.tif", window="10,5,20,10", band=1)) == {k: v for k, v in want.items() if 10 <= k[0] < 30 and 5 <= k[1] < 15 and k[2] == 1}
    assert values(files.read_pixels(spark, f"{tmp_path}/a.tif").where("row >= 45 and col = 3 and band = 2")) == {k: v for k, v in want.items() if k[0] >= 45 and k[1] == 3 and k[2] == 2}
    whole = files.window_bytes(spark, f"{tmp_path}/a.tif", window="1,2,3,4").first()
    assert np.frombuffer(whole.bytes, whole.dtype).reshape(3, 4, 3)[1, 2, 0] == want[2, 4, 0]
    assert len([p for p in tmp_path.iterdir()]) == 1  # no parts left


def test_pushed_filters_prune_blocks(spark, rows, tmp_path):
    spec = write.ImageSpec(60, 50, compression=codecs.DEFLATE, tile=(16, 16))
    files.write_file(rows, f"{tmp_path}/a.tif", spec)
    reader = tiff.PushingTiffReader(f"{tmp_path}/a.tif", tiff.Ask.of({"table": "pixels"}), {"partitionBytes": "1024"})
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual

    assert len(list(reader.pushFilters([GreaterThanOrEqual(("row",), 33), EqualTo(("col",), 5)]))) == 2
    seen = [(r["row"] // 16 * 4 + r["col"] // 16) for p in reader.partitions() for batch in reader.read(p) for r in batch.to_pylist()]
    assert set(seen) == {8, 12}
    whole = tiff.TiffReader(str(tmp_path), tiff.Ask.of({"table": "pixels"}), {})
    assert [(len(p.paths), p.share) for p in whole.partitions()] == [(1, (0, 1))]
    blocks = spark.read.format("tiff").option("table", "blocks").option("payload", "false").option("window", "0,0,17,1").load(f"{tmp_path}/a.tif")
    assert sorted(r.block_index for r in blocks.collect()) == [0, 4]
    with pytest.raises(PySparkException):
        files.read_pixels(spark, f"{tmp_path}/a.tif", window="0,0,51,1").count()


def test_metadata_and_bad_files(spark, rows, tmp_path):
    tags = write.geo_tags(keys_of_epsg(4326), (2, 2), (100, 200), nodata="-1")
    files.write_file(rows, f"{tmp_path}/a.tif", write.ImageSpec(60, 50, tile=(16, 16), tags=tags), fmt="cog", levels=[2], resampling="average")
    bad = bytearray((tmp_path / "a.tif").read_bytes())
    broken = container.Tiff(tiff.BytesSource(bytes(bad))).ifds[1].offset
    (tmp_path / "b.tif").write_bytes(write.write_images([(write.ImageSpec(2, 2), np.zeros((2, 2, 1), np.uint8))]))
    found = tiff.register(spark).read.format("tiff").load(str(tmp_path)).collect()
    assert [(r.role, r.width, r.overview) for r in found] == [("base", 60, None), ("overview", 30, 0), ("image", 2, None)] and broken
    assert found[0].geo.epsg == 4326 and found[0].geo.bounds == [100, 100, 220, 200] and found[0].geo.nodata == "-1"
    assert {t.code for t in found[0].tags} >= {256, 257, 34735}
    with pytest.raises(PySparkException):
        spark.read.format("geotiff").load(f"{tmp_path}/b.tif").count()
    again = tiff.from_content(spark.read.format("binaryFile").load(f"{tmp_path}/a.tif"), "pixels", overview=0)
    mean = {(r.row, r.col): float(r.value) for r in raster.average_overview(rows, 2).collect()}
    assert {(r.row, r.col): r.value for r in again.collect()} == mean


def test_missing_blocks(spark, rows, tmp_path):
    spec = write.ImageSpec(60, 50, compression=codecs.DEFLATE, tile=(16, 16))
    part = rows.where("row < 16")
    with pytest.raises(PySparkException):
        files.write_file(part, f"{tmp_path}/a.tif", spec)
    assert not list(tmp_path.iterdir())
    files.write_file(part, f"{tmp_path}/a.tif", spec, fill=7)
    out = values(files.read_pixels(spark, f"{tmp_path}/a.tif"))
    assert out[3, 4, 0] == (3 * 31 + 4 * 17) % 251 and out[40, 4, 0] == 7


def test_table_functions(spark, rows, tmp_path):
    files.write_file(rows, f"{tmp_path}/a.tif", write.ImageSpec(60, 50, compression=codecs.DEFLATE, tile=(32, 32)))
    udtf.register(spark)
    spark.read.format("binaryFile").load(f"{tmp_path}/a.tif").createOrReplaceTempView("f")
    assert spark.sql("SELECT count(*) FROM f, LATERAL tiff_blocks(content)").first()[0] == 4
    assert spark.sql("SELECT sum(value) FROM f, LATERAL tiff_pixels(content, 0)").first()[0] == sum((r * 31 + c * 17) % 251 for r in range(50) for c in range(60))


def test_stream_keeps_the_last_tile(spark, tmp_path):
    arrivals = [(1, 1, "a"), (2, 1, "b"), (1, 3, "c"), (1, 2, "d"), (2, 0, "e")]
    for k, row in enumerate(arrivals):
        spark.createDataFrame([row], "tile long, seq long, v string").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("tile long, seq long, v string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    ingest = TileIngest(str(tmp_path / "stage"), ["tile"], ["seq"], ["v"])
    ingest.start(stream).awaitTermination()
    grid = spark.range(1, 4).select(F.col("id").alias("tile"))
    assert {r.tile: r.v for r in ingest.final(spark, grid, {"v": "none"}).collect()} == {1: "c", 2: "b", 3: "none"}
    ingest.start(stream).awaitTermination()  # nothing new: nothing changes
    assert {r.tile: r.v for r in ingest.final(spark).collect()} == {1: "c", 2: "b"}
