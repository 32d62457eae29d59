"""Queries through real files and codecs: what goes in must come out, so plain SQL over the tables checks them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions import codes
from rasterloom.operators import files, raster
from rasterloom.plans import tables
from rasterloom.plans.tables import PX, WIDTH, q8, query, table
from rasterloom.sources import codecs, container, lerc, tiff, write
from rasterloom.sources.bytesource import BytesSource
from rasterloom.sources.errors import TiffError
from rasterloom.sources.geotiff import Crs, crs_of, keys_of_crs, keys_of_epsg
from rasterloom.storage import shared_folder
from rasterloom.streaming.tiles import TileIngest

CODES = {"none": codecs.NONE, "deflate": codecs.DEFLATE, "lzw": codecs.LZW, "packbits": codecs.PACKBITS, "zstd": codecs.ZSTD}


@query("SELECT doc_id, sha256(text) AS digest, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents", codec=tuple(CODES))
def codec_roundtrip(spark, sf_dir, codec):
    """Each text's bytes through a codec and back."""
    code = CODES[codec]

    def there_and_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes = [], []
            for t in batch.column(1).to_pylist():
                data = (t or "").encode()
                coded = codecs.packbits_encode(data) if code == codecs.PACKBITS else codecs.compress(code, data)
                back = codecs.decompress(code, coded, len(data) + 1)
                digests.append(hashlib.sha256(back).hexdigest())
                sizes.append(len(back))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests), pa.array(sizes, pa.int64())], names=["doc_id", "digest", "n_bytes"])

    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    cores = spark.sparkContext.defaultParallelism
    if texts.rdd.getNumPartitions() < cores:  # a few large files would keep most cores idle
        texts = texts.repartition(cores)
    return texts.mapInArrow(there_and_back, "doc_id long, digest string, n_bytes long")


def _floats_through(spark: SparkSession, sf_dir: str, code) -> DataFrame:
    """Each vector as a row of floats through a block codec and back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [code(np.array(v, np.float32).reshape(1, -1, 1)).ravel() for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tolist() for v in out], pa.list_(pa.float32()))], names=["row", "samples"])

    return raster.pixels(tables.floats(spark, sf_dir).mapInArrow(run, "row long, samples array<float>"))


SCAN = tables.ORACLE["scan_pixels"]


@query(SCAN)
def float_predictor(spark, sf_dir):
    return _floats_through(spark, sf_dir, lambda a: codecs.undo_float(codecs.forward_float(a), *a.shape, a.dtype))


@query(SCAN)
def codec_roundtrip_lerc(spark, sf_dir):
    return _floats_through(spark, sf_dir, lambda a: lerc.decode_block(lerc.encode(a), 0, *a.shape, a.dtype))


def _height(spark: SparkSession, sf_dir: str) -> int:
    return tables.dims(spark, sf_dir).first()["height"] or 1


def _spec(spark: SparkSession, sf_dir: str, **more) -> write.ImageSpec:
    return write.ImageSpec(**{"width": WIDTH, "height": _height(spark, sf_dir), "dtype": "u1", "compression": codecs.DEFLATE, "tile": (16, 32), **more})


KINDS = {
    "strip": ({"tile": None, "rows_per_strip": 37, "predictor": 2}, {}),
    "tiled": ({}, {}),
    "planar": ({"width": WIDTH // 4, "spp": 4, "planar": 2, "photometric": container.SEPARATED, "tile": (32, 16)}, {}),
    "bigendian": ({"compression": codecs.ZSTD, "predictor": 2}, {"byte_order": "big"}),
    "bigtiff": ({"compression": codecs.LZW}, {"variant": "bigtiff"}),
}


@query(f"SELECT r AS row, CAST(c AS INT) AS col, CAST(v AS DOUBLE) AS value FROM ({PX})", kind=tuple(KINDS))
def tiff_roundtrip(spark, sf_dir, kind):
    """The raster written as a file and read back by the data source."""
    how, options = KINDS[kind]
    spec = _spec(spark, sf_dir, **how)
    path = f"{shared_folder(spark, 'tiff')}/{kind}.tif"
    files.write_file(q8(spark, sf_dir), path, spec, **options)
    found = files.read_pixels(spark, path)
    return found.select(F.col("row").cast("long").alias("row"), (F.col("col") * spec.spp + F.col("band")).alias("col"), "value")


def _cog(spark: SparkSession, sf_dir: str) -> str:
    path = f"{shared_folder(spark, 'cog')}/q8.tif"
    tags = write.geo_tags(keys_of_epsg(32615), (30, 30), (500000, 4500000), nodata="255")
    files.write_file(q8(spark, sf_dir), path, _spec(spark, sf_dir, tags=tags, tile=(64, 64)), fmt="cog", levels=[4, 2], resampling="average")
    return path


@query(f"SELECT r AS row, CAST(c AS INT) AS col, CAST(v AS DOUBLE) AS value FROM ({PX}) WHERE r >= 70 AND r < 200 AND c >= 5 AND c < 60")
def cog_roundtrip(spark, sf_dir):
    found = files.read_pixels(spark, _cog(spark, sf_dir), "cog", role="base", window="70,5,130,55")
    return found.select(F.col("row").cast("long").alias("row"), "col", "value")


@query(f"SELECT r // 4 AS row, CAST(c // 4 AS INT) AS col, trunc(coalesce(avg(CASE WHEN v <> 255 THEN v END), 255)) AS value FROM ({PX}) GROUP BY ALL")
def cog_overview_read(spark, sf_dir):
    return files.read_pixels(spark, _cog(spark, sf_dir), "cog", overview=1).select(F.col("row").cast("long").alias("row"), "col", "value")


@query(
    "SELECT ifd, role, CAST(w AS INT) AS width, CAST(h AS INT) AS height, CASE ifd WHEN 0 THEN 32615 END AS epsg, CASE ifd WHEN 0 THEN '255' END AS nodata, CASE ifd WHEN 0 THEN 500000.0::DOUBLE END AS min_x, CASE ifd WHEN 0 THEN 4500000.0::DOUBLE - 30 * h END AS min_y "
    f"FROM (SELECT 0 AS ifd, 'base' AS role, {WIDTH} AS w, height AS h FROM ({tables.DIMS}) UNION ALL SELECT 1, 'overview', {WIDTH // 2}, (height + 1) // 2 FROM ({tables.DIMS}) UNION ALL SELECT 2, 'overview', {WIDTH // 4}, (height + 3) // 4 FROM ({tables.DIMS}))"
)
def geotiff_metadata_roundtrip(spark, sf_dir):
    found = tiff.register(spark).read.format("geotiff").load(_cog(spark, sf_dir))
    return found.select(F.col("ifd_index").alias("ifd"), "role", "width", "height", "geo.epsg", "geo.nodata", F.get("geo.bounds", F.lit(0)).alias("min_x"), F.get("geo.bounds", F.lit(1)).alias("min_y"))


TILES = "SELECT user_id % 64 AS tile, event_id, ts, value FROM events"


@query(f"SELECT t.tile, coalesce(e.value, -1) AS value FROM range(64) t(tile) LEFT JOIN (SELECT tile, value FROM ({TILES}) WHERE tile % 9 <> 4 QUALIFY row_number() OVER (PARTITION BY tile ORDER BY ts DESC, event_id DESC) = 1) e USING (tile)")
def streaming_tiles_final(spark, sf_dir):
    """Tiles that arrive by a stream, the last of each kept and the missing ones filled."""
    folder = shared_folder(spark, "tiles")
    table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value").write.parquet(f"{folder}/arrivals")
    arrivals = spark.readStream.schema("user_id long, event_id long, ts timestamp, value double").option("maxFilesPerTrigger", 8).parquet(f"{folder}/arrivals")
    tiles = arrivals.select((F.col("user_id") % 64).alias("tile"), "event_id", "ts", "value").where("tile % 9 <> 4")
    ingest = TileIngest(folder, ["tile"], ["ts", "event_id"], ["value"])
    ingest.start(tiles).awaitTermination()
    return ingest.final(spark, spark.range(64).select(F.col("id").alias("tile")), {"value": -1.0})


@query(
    f"""WITH t AS (SELECT event_id % {{n}} AS block, arg_max(CAST(floor(abs(value)) AS BIGINT) % 251, event_id) AS v FROM events WHERE event_id % {{n}} % 5 <> 3 GROUP BY 1)
SELECT CAST(b // 4 * 16 + i // 16 AS BIGINT) AS row, CAST(b % 4 * 16 + i % 16 AS INT) AS col, CAST(CASE WHEN t.v IS NULL THEN 254 ELSE (t.v + i) % 251 END AS DOUBLE) AS value
FROM range({{n}}) g(b) CROSS JOIN range(256) k(i) LEFT JOIN t ON t.block = b""".replace("{n}", "24")
)
def streaming_tiles_to_file(spark, sf_dir):
    """Tiles of 16 x 16 that arrive by a stream, some more than once and some never, as one georeferenced file read back."""
    folder = shared_folder(spark, "tiles")
    table(spark, sf_dir, "events").select("event_id", "value").write.parquet(f"{folder}/arrivals")
    arrivals = spark.readStream.schema("event_id long, value double").option("maxFilesPerTrigger", 8).parquet(f"{folder}/arrivals")
    v = F.floor(F.abs("value")) % 251
    tiles = arrivals.select((F.col("event_id") % 24).alias("block"), F.col("event_id").alias("seq"), F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: (v + i) % 251).alias("samples")).where("block % 5 <> 3")
    ingest = TileIngest(folder, ["block"], ["seq"], ["samples"])
    ingest.start(tiles).awaitTermination()
    spec = write.ImageSpec(64, 96, compression=codecs.DEFLATE, tile=(16, 16), tags=write.geo_tags(keys_of_epsg(4326), (1, 1), (0, 0)))
    files.write_tiles(ingest.final(spark).withColumn("rows", F.lit(16)).withColumn("cols", F.lit(16)), f"{folder}/out.tif", spec, "geotiff", fill=254)
    return files.read_pixels(spark, f"{folder}/out.tif", "geotiff").select(F.col("row").cast("long").alias("row"), "col", "value")


def _cog_tiles(spark, sf_dir):
    """The raster as tiles of 64 x 64 in any order, of which some never come, as a file with average overviews."""
    h = _height(spark, sf_dir)
    spec = _spec(spark, sf_dir, tags=write.geo_tags(keys_of_epsg(32615), (30, 30), (500000, 4500000), nodata="255"), tile=(64, 64), compression=codecs.ZSTD)
    cut = q8(spark, sf_dir).select(F.floor(F.col("row") / 64).cast("long").alias("block"), F.struct("row", "samples").alias("r")).where("block % 5 <> 2")
    tiles = cut.groupBy("block").agg(F.array_sort(F.collect_list("r")).alias("r")).select("block", F.size("r").alias("rows"), F.lit(WIDTH).alias("cols"), F.flatten("r.samples").alias("samples"))
    path = f"{shared_folder(spark, 'cogtiles')}/q8.tif"
    assert spec.n_blocks == -(-h // 64)
    files.write_tiles(tiles, path, spec, "cog", fill=7, levels=[2, 4], resampling="average", nodata="255")
    return path


FILLED = f"SELECT r, c, CASE WHEN r // 64 % 5 = 2 THEN 7 ELSE v END AS v FROM ({PX})"


@query(f"SELECT r // {{level}} AS row, CAST(c // {{level}} AS INT) AS col, trunc(coalesce(avg(CASE WHEN v <> 255 THEN v END), 255)) AS value FROM ({FILLED}) GROUP BY ALL", level=(2, 4))
def tiles_to_cog_overview(spark, sf_dir, level):
    """Overviews that are made of tiles as they come, those that never came filled."""
    return files.read_pixels(spark, _cog_tiles(spark, sf_dir), "cog", overview=level // 4).select(F.col("row").cast("long").alias("row"), "col", "value")


@query(f"SELECT r AS row, CAST(c // 4 AS INT) AS col, CAST(v AS DOUBLE) AS value FROM ({PX}) WHERE c % 4 = 2")
def planar_band_read(spark, sf_dir):
    """One band of a file of separate planes: blocks of the others are never read."""
    spec = _spec(spark, sf_dir, **KINDS["planar"][0])
    path = f"{shared_folder(spark, 'planar')}/q8.tif"
    files.write_file(q8(spark, sf_dir), path, spec)
    found = tiff.register(spark).read.format("tiff").option("table", "blocks").option("payload", "false").option("band", 2).load(path)
    if found.where("plane <> 2").count() or found.count() * 4 != spec.n_blocks:
        raise TiffError("blocks of other planes were read")
    return files.read_pixels(spark, path, band=2).select(F.col("row").cast("long").alias("row"), "col", "value")


@query(f"SELECT r AS row, CAST(c AS INT) AS col, CAST(255 - v AS DOUBLE) AS value FROM ({PX}) WHERE r >= 10 AND r < 90 AND c >= 3 AND c < 50")
def decoded_window_read(spark, sf_dir):
    """A window of a white-is-zero file, decoded to black-is-zero."""
    path = f"{shared_folder(spark, 'decoded')}/q8.tif"
    files.write_file(q8(spark, sf_dir), path, _spec(spark, sf_dir, photometric=container.WHITE_IS_ZERO))
    return files.read_pixels(spark, path, decoded="true", window="10,3,80,47").select(F.col("row").cast("long").alias("row"), "col", "value")


@query(f"SELECT CAST(n AS BIGINT) AS n_bytes, md5 FROM (SELECT count(*) AS n, md5(string_agg(lpad(hex(CAST(v AS UTINYINT)), 2, '0'), '' ORDER BY r, c)) AS md5 FROM (SELECT r, c, v FROM ({PX}) WHERE r >= 5 AND r < 45 AND c >= 8 AND c < 40))")
def window_bytes_read(spark, sf_dir):
    """A window whole, as bytes."""
    path = f"{shared_folder(spark, 'bytes')}/q8.tif"
    files.write_file(q8(spark, sf_dir), path, _spec(spark, sf_dir))
    return files.window_bytes(spark, path, window="5,8,40,32").select(F.octet_length("bytes").cast("long").alias("n_bytes"), F.md5(F.hex("bytes").cast("binary")).alias("md5"))


@query("SELECT 32616 AS projected, 5703 AS vertical, 9001 AS linear_units, 9102 AS angular_units, 6269 AS geodetic_datum, 5103 AS vertical_datum, 9001 AS vertical_units, 'up' AS vertical_citation, 'compound' AS kind")
def crs_fields_roundtrip(spark, sf_dir):
    """Units, datums and citations of a compound system, through a file's keys and back."""
    crs = Crs(1, 1, "compound", 32616, None, 5703, "both", vertical_citation="up", geodetic_datum=6269, angular_units=9102, linear_units=9001, vertical_datum=5103, vertical_units=9001)
    path = f"{shared_folder(spark, 'crs')}/q8.tif"
    files.write_file(q8(spark, sf_dir), path, _spec(spark, sf_dir, tags=write.geo_tags(keys_of_crs(crs), (1, 1), (0, 0))), fmt="geotiff")
    names = ["projected", "vertical", "linear_units", "angular_units", "geodetic_datum", "vertical_datum", "vertical_units", "vertical_citation", "kind"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                found = crs_of(container.Tiff(BytesSource(content.as_py())).geo.keys)
                yield pa.RecordBatch.from_pylist([{n: getattr(found, n) for n in names}])

    types = ", ".join(f"{n} {'string' if n in ('vertical_citation', 'kind') else 'long'}" for n in names)
    found = spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, types)
    return found.select(*(F.col(n).cast("int").alias(n) if n not in ("vertical_citation", "kind") else n for n in names))


CODE_ROWS = ", ".join(f"('{k}', {n}, '{name}')" for k, t in codes.CODES.items() for n, name in t.items())


@query(f"SELECT kind, code, name FROM (VALUES {CODE_ROWS}) t(kind, code, name) UNION ALL SELECT 'compression', 77, 'unknown-77'")
def code_names(spark, sf_dir):
    """Every code's name, and back."""
    rows = spark.createDataFrame([(k, n) for k, t in codes.CODES.items() for n in t] + [("compression", 77)], "kind string, code int")
    name = F.coalesce(*(F.when(F.col("kind") == k, codes.name_of(k, F.col("code"))) for k in codes.CODES))
    back = F.coalesce(*(F.when(F.col("kind") == k, codes.code_of(k, F.col("name"))) for k in codes.CODES))
    return rows.withColumn("name", name).where(F.coalesce(back == F.col("code"), F.col("name").startswith("unknown"))).select("kind", "code", "name")


def _cases() -> dict:
    """What must fail, by name."""
    one = np.zeros((4, 4, 1), np.uint8)
    good = write.ImageSpec(4, 4)

    def opened(**changes):
        tags = {e[0]: e for e in good.entries([8], [16], False)}
        for code, entry in changes.pop("tags", {}).items():
            tags[code] = (code, *(entry or ()))
        entries = sorted(e for e in tags.values() if len(e) > 1)
        body = write._directory(entries, 24, changes.pop("following", 0), False, "<")
        t = container.Tiff(BytesSource(write._header(24, False, "<") + one.tobytes() + body))
        return t.read(t.ifds[0], **changes)

    return {
        "bad_magic": lambda: container.Tiff(BytesSource(b"XX*\0\0\0\0\0")),
        "bigtiff_offset_size": lambda: container.Tiff(BytesSource(b"II+\0\x04\0\0\0" + bytes(8))),
        "truncated": lambda: container.Tiff(BytesSource(b"II*\0\xff\xff\0\0")),
        "zero_width": lambda: opened(tags={container.IMAGE_WIDTH: (4, [0])}),
        "zero_rows_per_strip": lambda: opened(tags={container.ROWS_PER_STRIP: (4, [0])}),
        "sample_format": lambda: opened(tags={container.SAMPLE_FORMAT: (3, [5])}),
        "float16": lambda: opened(tags={container.SAMPLE_FORMAT: (3, [3]), container.BITS_PER_SAMPLE: (3, [16])}),
        "planar": lambda: opened(tags={container.PLANAR_CONFIGURATION: (3, [3])}),
        "predictor": lambda: opened(tags={container.PREDICTOR: (3, [7])}),
        "palette_without_map": lambda: opened(tags={container.PHOTOMETRIC: (3, [3])}),
        "block_count": lambda: opened(tags={container.STRIP_OFFSETS: (4, [8, 8])}),
        "compression": lambda: opened(tags={container.COMPRESSION: (3, [6])}),
        "short_block": lambda: opened(tags={container.STRIP_BYTE_COUNTS: (4, [3])}),
        "window": lambda: opened(window=(0, 0, 5, 1)),
        "band": lambda: opened(band=1),
        "type": lambda: opened(dtype="u2"),
        "no_geokeys": lambda: container.Tiff(BytesSource(write.write_images([(good, one)]))).geo,
        "writer_tile": lambda: write.ImageSpec(4, 4, tile=(10, 16)),
        "writer_lerc_64": lambda: write.ImageSpec(4, 4, dtype="i8", compression=codecs.LERC),
        "writer_jpeg_bands": lambda: write.ImageSpec(4, 4, 3, compression=codecs.JPEG, photometric=container.RGB),
        "writer_level": lambda: write.pyramid(good, one, [1]),
        "writer_incomplete": lambda: write.layout([write.Sizes(good, [])]),
        "empty_file": lambda: container.Tiff(BytesSource(b"")),
        "directory_cycle": lambda: opened(following=24),
        "no_width": lambda: opened(tags={container.IMAGE_WIDTH: None}),
        "no_offsets": lambda: opened(tags={container.STRIP_OFFSETS: None}),
        "zero_samples": lambda: opened(tags={container.SAMPLES_PER_PIXEL: (3, [0])}),
        "mixed_bits": lambda: opened(tags={container.SAMPLES_PER_PIXEL: (3, [3]), container.BITS_PER_SAMPLE: (3, [8, 8, 16])}),
        "odd_bits": lambda: opened(tags={container.BITS_PER_SAMPLE: (3, [12])}),
        "offset_beyond_end": lambda: opened(tags={container.STRIP_OFFSETS: (4, [10**6])}),
        "byte_count_number": lambda: opened(tags={container.STRIP_BYTE_COUNTS: (4, [16, 16])}),
        "zero_tile": lambda: opened(tags={container.TILE_WIDTH: (4, [0]), container.TILE_LENGTH: (4, [16]), container.TILE_OFFSETS: (4, [8]), container.TILE_BYTE_COUNTS: (4, [16])}),
        "tile_without_counts": lambda: opened(tags={container.TILE_WIDTH: (4, [16]), container.TILE_LENGTH: (4, [16]), container.TILE_OFFSETS: (4, [8])}),
        "negative_window": lambda: opened(window=(-1, 0, 1, 1)),
        "bad_deflate": lambda: opened(tags={container.COMPRESSION: (3, [codecs.DEFLATE])}),
        "bad_zstd": lambda: opened(tags={container.COMPRESSION: (3, [codecs.ZSTD])}),
        "bad_lerc": lambda: opened(tags={container.COMPRESSION: (3, [codecs.LERC])}),
        "bad_jpeg": lambda: opened(tags={container.COMPRESSION: (3, [codecs.JPEG])}),
        "too_few_colours": lambda: opened(tags={container.PHOTOMETRIC: (3, [container.RGB])}),
        "short_block_of_bands": lambda: opened(tags={container.PHOTOMETRIC: (3, [container.RGB]), container.SAMPLES_PER_PIXEL: (3, [3]), container.BITS_PER_SAMPLE: (3, [8, 8, 8])}),
        "ask_table": lambda: tiff.Ask.of({"table": "nothing"}),
        "ask_window": lambda: tiff.Ask.of({"window": "1,2,3"}),
        "writer_zero_width": lambda: write.ImageSpec(0, 4),
        "writer_strip_rows": lambda: write.ImageSpec(4, 4, rows_per_strip=0),
        "writer_float_predictor": lambda: write.ImageSpec(4, 4, dtype="u1", predictor=3),
        "writer_variant": lambda: write.layout([write.Sizes(good, [16])], variant="tiny"),
        "writer_classic_size": lambda: write.layout([write.Sizes(good, [5 << 30])], variant="classic"),
        "writer_shape": lambda: write.write_images([(good, np.zeros((3, 4, 1), np.uint8))]),
        "writer_palette": lambda: write.ImageSpec(4, 4, photometric=container.PALETTE),
        "writer_planar": lambda: write.ImageSpec(4, 4, planar=3),
        "writer_compression": lambda: write.ImageSpec(4, 4, compression=6),
        "writer_dtype": lambda: write.ImageSpec(4, 4, dtype="f2"),
    }


ERRORS = {
    "bad_magic": "InvalidHeader", "bigtiff_offset_size": "InvalidHeader", "truncated": "Truncated", "zero_width": "InvalidLayout", "zero_rows_per_strip": "InvalidLayout", "sample_format": "UnsupportedSampleFormat",
    "float16": "UnsupportedSampleFormat", "planar": "UnsupportedPlanar", "predictor": "UnsupportedPredictor", "palette_without_map": "InvalidLayout", "block_count": "InvalidLayout", "compression": "UnsupportedCompression",
    "short_block": "DecodeFailed", "window": "WindowOutOfBounds", "band": "BandOutOfBounds", "type": "SampleTypeMismatch", "no_geokeys": "NotGeoTiff", "writer_tile": "WriteConfig", "writer_lerc_64": "WriteConfig",
    "writer_jpeg_bands": "WriteConfig", "writer_level": "WriteConfig", "writer_incomplete": "IncompleteImage",
    "empty_file": "InvalidHeader", "directory_cycle": "InvalidLayout", "no_width": "InvalidLayout", "no_offsets": "InvalidLayout", "zero_samples": "InvalidLayout", "mixed_bits": "InvalidLayout", "odd_bits": "UnsupportedSampleFormat",
    "offset_beyond_end": "Truncated", "byte_count_number": "InvalidLayout", "zero_tile": "InvalidLayout", "tile_without_counts": "InvalidLayout", "negative_window": "WindowOutOfBounds", "bad_deflate": "DecodeFailed",
    "bad_zstd": "DecodeFailed", "bad_lerc": "DecodeFailed", "bad_jpeg": "DecodeFailed", "too_few_colours": "InvalidLayout", "short_block_of_bands": "DecodeFailed", "ask_table": "TiffError", "ask_window": "WindowOutOfBounds",
    "writer_zero_width": "WriteConfig", "writer_strip_rows": "WriteConfig", "writer_float_predictor": "WriteConfig", "writer_variant": "WriteConfig", "writer_classic_size": "WriteConfig", "writer_shape": "WriteConfig",
    "writer_palette": "WriteConfig", "writer_planar": "WriteConfig", "writer_compression": "WriteConfig", "writer_dtype": "WriteConfig",
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in ERRORS.items()) + ") t(name, error)")
def validation_errors(spark, sf_dir):
    """Each bad file or option, and the class of its error."""
    rows = []
    for name, case in _cases().items():
        try:
            case()
            rows.append((name, "none"))
        except (TiffError, container.WindowOutOfBounds, container.BandOutOfBounds) as e:
            rows.append((name, type(e).__name__))
    return spark.createDataFrame(rows, "name string, error string")
