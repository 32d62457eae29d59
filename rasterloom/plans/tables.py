"""Queries that read the tables as rasters, each with the SQL that DuckDB runs to check it.

`embeddings` is a raster of floats (row = vec_id, column = place in the vector); q8 makes whole numbers of 0 to 255 of
it. `nation` and `region` stand for coordinate reference systems, `part` for directories of images, `lineitem` for
tiles that are written more than once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions import geo, pixels
from rasterloom.operators import raster

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

WIDTH = 64
BLOCK = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None, **each):
    """Registers a query, or one for each value of its argument, with its SQL."""

    def register(f):
        if not each:
            QUERIES[f.__name__] = f
            if sql:
                ORACLE[f.__name__] = sql
        for arg, values in each.items():
            for v in values:
                QUERIES[f"{f.__name__}_{v}"] = lambda spark, sf_dir, v=v, arg=arg: f(spark, sf_dir, **{arg: v})
                if sql:
                    ORACLE[f"{f.__name__}_{v}"] = sql.replace("{" + arg + "}", str(v))
        return f

    return register


def floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.col("embedding").alias("samples"))


def q8(spark: SparkSession, sf_dir: str) -> DataFrame:
    to_int = lambda v: F.floor((v.cast("double") + 1) * 127.5).cast("int")
    return floats(spark, sf_dir).withColumn("samples", F.transform("samples", to_int))


PX = f"SELECT vec_id AS r, i - 1 AS c, CAST(floor((CAST(embedding[i] AS DOUBLE) + 1) * 127.5) AS INT) AS v FROM embeddings, range(1, {WIDTH + 1}) t(i)"


@query(f"SELECT vec_id AS row, CAST(i - 1 AS INT) AS col, embedding[i] AS value FROM embeddings, range(1, {WIDTH + 1}) t(i)")
def scan_pixels(spark, sf_dir):
    return raster.pixels(floats(spark, sf_dir))


@query(f"SELECT r AS row, CAST(c AS INT) AS col, v AS value FROM ({PX}) WHERE r >= 100 AND r < 350 AND c >= 10 AND c < 42")
def window_read(spark, sf_dir):
    return raster.window(q8(spark, sf_dir), 100, 10, 250, 32)


@query(f"SELECT r AS row, CAST(c // 4 AS INT) AS col, v AS value FROM ({PX}) WHERE c % 4 = 2")
def band_read(spark, sf_dir):
    return raster.band(q8(spark, sf_dir), 2, 4)


@query(f"SELECT r AS row, CAST(c // 4 AS INT) AS col, v AS value FROM ({PX}) WHERE c % 4 = 1 AND r >= 50 AND r < 200 AND c // 4 >= 3 AND c // 4 < 9")
def band_window(spark, sf_dir):
    near = q8(spark, sf_dir).where("row >= 50 and row < 200")
    return raster.band(near, 1, 4).where("col >= 3 and col < 9")


DIMS = f"SELECT max(vec_id) + 1 AS height, {WIDTH} AS width FROM embeddings"


def dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").agg((F.max("vec_id") + 1).alias("height")).withColumn("width", F.lit(WIDTH))


GRID = f"""SELECT y // {BLOCK} * {WIDTH // BLOCK} + x // {BLOCK} AS block_index, y, x, least({BLOCK}, height - y) AS rows, least({BLOCK}, {WIDTH} - x) AS cols
FROM ({DIMS}), range(0, height, {BLOCK}) a(y), range(0, {WIDTH}, {BLOCK}) b(x)"""


@query(GRID)
def block_catalog(spark, sf_dir):
    return raster.block_grid(dims(spark, sf_dir), BLOCK, BLOCK).select("block_index", "y", "x", "rows", F.col("cols").cast("long").alias("cols"))


@query(
    f"""WITH w AS (SELECT n_nationkey AS id, n_nationkey * 17 % 400 AS r0, n_nationkey * 7 % 48 AS c0, 5 + n_nationkey % 30 AS n_rows, 3 + n_nationkey % 16 AS n_cols FROM nation)
SELECT id, block_index FROM w, ({GRID}) g WHERE g.y < r0 + n_rows AND g.y + {BLOCK} > r0 AND g.x < c0 + n_cols AND g.x + {BLOCK} > c0"""
)
def block_prune(spark, sf_dir):
    k = F.col("n_nationkey")
    windows = table(spark, sf_dir, "nation").select(k.alias("id"), (k * 17 % 400).alias("r0"), (k * 7 % 48).alias("c0"), (5 + k % 30).alias("n_rows"), (3 + k % 16).alias("n_cols"))
    return raster.blocks_of_windows(windows, raster.block_grid(dims(spark, sf_dir), BLOCK, BLOCK), BLOCK, BLOCK).select("id", "block_index")


@query(
    f"""WITH t AS (SELECT r // {BLOCK} AS ty, c // {BLOCK} AS tx, count(*) AS n, sum(v) AS total FROM ({PX}) WHERE (r // {BLOCK} + c // {BLOCK}) % 3 <> 0 GROUP BY ALL)
SELECT g.block_index, coalesce(n, 0) AS n_cells, CAST(coalesce(total, -1 * g.rows * g.cols) AS BIGINT) AS total FROM ({GRID}) g LEFT JOIN t ON ty = g.y // {BLOCK} AND tx = g.x // {BLOCK}"""
)
def tile_pad_fill(spark, sf_dir):
    tile = lambda c: F.floor(F.col(c) / BLOCK) * BLOCK
    parts = F.transform(F.sequence(F.lit(0), F.lit(WIDTH // BLOCK - 1)), lambda t: F.struct((t * BLOCK).cast("long").alias("x"), F.aggregate(F.slice("samples", t * BLOCK + 1, F.lit(BLOCK)), F.lit(0).cast("long"), lambda a, v: a + v).alias("s")))
    cells = q8(spark, sf_dir).select(tile("row").alias("y"), F.inline(parts)).where((F.col("y") / BLOCK + F.col("x") / BLOCK) % 3 != 0)
    tiles = cells.groupBy("y", "x").agg(F.sum("s").alias("total"), (F.count(F.lit(1)) * BLOCK).alias("n_cells"))
    grid = raster.block_grid(dims(spark, sf_dir), BLOCK, BLOCK)
    return raster.fill_missing(tiles, grid, ["y", "x"], {"n_cells": F.lit(0).cast("long"), "total": -F.col("rows") * F.col("cols")}).select("block_index", "n_cells", "total")


@query(f"SELECT r // {{level}} AS row, CAST(c // {{level}} AS INT) AS col, v AS value FROM ({PX}) WHERE r % {{level}} = 0 AND c % {{level}} = 0", level=(2, 4, 8))
def overview_nearest(spark, sf_dir, level):
    return raster.nearest_overview(q8(spark, sf_dir), level)


AVERAGE = f"SELECT r // {{level}} AS row, CAST(c // {{level}} AS INT) AS col, CAST(trunc(avg(v)) AS INT) AS value FROM ({PX}) GROUP BY ALL"


@query(AVERAGE, level=(2, 4, 8))
def overview_average(spark, sf_dir, level):
    return raster.average_overview(q8(spark, sf_dir), level)


@query(f"SELECT r // 4 AS row, CAST(c // 4 AS INT) AS col, CAST(trunc(coalesce(avg(CASE WHEN v <> 127 THEN v END), 127)) AS INT) AS value FROM ({PX}) GROUP BY ALL")
def overview_average_nodata(spark, sf_dir):
    return raster.average_overview(q8(spark, sf_dir), 4, pixels.nodata_value(F.lit(" 127 "), 0, 255))


@query(" UNION ALL ".join(f"SELECT {n} AS level, * FROM ({AVERAGE.replace('{level}', str(n))})" for n in (2, 4, 8)))
def overview_pyramid(spark, sf_dir):
    return raster.pyramid(q8(spark, sf_dir), [8, 2, 4, 2])


@query(f"SELECT r AS row, CAST(c AS INT) AS col, CAST(CASE WHEN c < 4 THEN v ELSE ((v - lag(v, 4) OVER (PARTITION BY r ORDER BY c)) % 256 + 256) % 256 END AS BIGINT) AS value FROM ({PX})")
def predictor_forward(spark, sf_dir):
    rows = q8(spark, sf_dir)
    return raster.pixels(rows.withColumn("samples", pixels.forward_horizontal(F.col("samples"), 4, 8)))


@query(f"SELECT r AS row, CAST(c % 4 AS INT) AS band, CAST(c // 4 AS INT) AS col, CAST(v AS BIGINT) AS value FROM ({PX})")
def predictor_roundtrip(spark, sf_dir):
    rows = q8(spark, sf_dir)
    coded = raster.pixels(rows.withColumn("samples", pixels.forward_horizontal(F.col("samples"), 4, 8)))
    banded = coded.select("row", (F.col("col") % 4).alias("band"), F.floor(F.col("col") / 4).cast("int").alias("col"), "value")
    return raster.undo_horizontal(banded, 8, ["row", "band"])


@query(
    f"""SELECT r AS row, CAST(c // 2 AS INT) AS col, CAST(max(CASE WHEN c % 2 = 0 THEN v >> 4 END) << 4 | max(CASE WHEN c % 2 = 1 THEN v >> 4 END) AS INT) AS packed,
CAST(max(CASE WHEN c % 2 = 0 THEN v >> 4 END) AS INT) AS high, CAST(max(CASE WHEN c % 2 = 1 THEN v >> 4 END) AS INT) AS low FROM ({PX}) GROUP BY ALL"""
)
def subbyte_pack_unpack(spark, sf_dir):
    four = F.transform("samples", lambda v: F.shiftright(v, 4))
    pairs = F.transform(F.sequence(F.lit(0), F.lit(WIDTH // 2 - 1)), lambda i: pixels.pack_bits([F.get(four, 2 * i), F.get(four, 2 * i + 1)], 4))
    packed = q8(spark, sf_dir).select("row", F.posexplode(pairs).alias("col", "packed"))
    both = pixels.unpack_bits(F.col("packed"), 4)
    return packed.select("row", "col", "packed", F.get(both, F.lit(0)).alias("high"), F.get(both, F.lit(1)).alias("low"))


# Affine transforms


def _affine() -> Column:
    return geo.transform(*(F.lit(v) for v in (500000.0, 30.0, 0.5, 4500000.0, -0.25, -30.0)))


XY = "500000.0::DOUBLE + c * 30.0::DOUBLE + r * 0.5::DOUBLE AS x, 4500000.0::DOUBLE + c * -0.25::DOUBLE + r * -30.0::DOUBLE AS y"


@query(f"SELECT r AS row, CAST(c AS INT) AS col, {XY} FROM ({PX})")
def affine_pixel_to_geo(spark, sf_dir):
    x, y = geo.pixel_to_geo(_affine(), F.col("col"), F.col("row"))
    return raster.pixels(q8(spark, sf_dir)).select("row", "col", x.alias("x"), y.alias("y"))


@query(f"SELECT r AS row, CAST(c AS INT) AS col, CAST(r AS DOUBLE) AS back_row, CAST(c AS DOUBLE) AS back_col FROM ({PX})")
def affine_geo_to_pixel(spark, sf_dir):
    x, y = geo.pixel_to_geo(_affine(), F.col("col"), F.col("row"))
    back_col, back_row = geo.geo_to_pixel(_affine(), x, y)
    return raster.pixels(q8(spark, sf_dir)).select("row", "col", F.round(back_row, 6).alias("back_row"), F.round(back_col, 6).alias("back_col"))


TIE = "SELECT n_nationkey AS id, 1 + n_nationkey % 2 AS raster_type, 100.0::DOUBLE + n_nationkey AS x, 200.0::DOUBLE - n_nationkey AS y, (1 + n_nationkey % 3)::DOUBLE AS w, (1 + n_nationkey % 4)::DOUBLE AS h FROM nation"
TIE_BOUNDS = "SELECT id, raster_type, x - s * w AS min_x, y + s * h - 50 * h AS min_y, x - s * w + 40 * w AS max_x, y + s * h AS max_y FROM (SELECT *, CASE raster_type WHEN 2 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS s FROM ({tie}))"


def _tied(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    d = lambda c: c.cast("double")
    z = F.lit(0.0)
    tie = F.array(z, z, z, d(k) + 100.0, F.lit(200.0) - d(k), z)
    scale = F.array(d(1 + k % 3), d(1 + k % 4), z)
    return table(spark, sf_dir, "nation").select(k.alias("id"), (1 + k % 2).alias("raster_type"), geo.from_tiepoint_and_scale(tie, scale, 1 + k % 2).alias("t"))


@query("SELECT id, min_x, min_y, max_x, max_y FROM (" + TIE_BOUNDS.format(tie=TIE) + ")")
def geo_bounds(spark, sf_dir):
    return _tied(spark, sf_dir).select("id", geo.bounds(F.col("t"), F.lit(40), F.lit(50)).alias("b")).select("id", "b.*")


@query("SELECT id, raster_type, min_x AS origin_x, max_y AS origin_y FROM (" + TIE_BOUNDS.format(tie=TIE) + ") WHERE raster_type = 2")
def pixel_is_point(spark, sf_dir):
    return _tied(spark, sf_dir).where("raster_type = 2").select("id", "raster_type", "t.origin_x", "t.origin_y")


# Colour models


def _four(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, col, s) of 16 pixels of four samples."""
    cut = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("samples", i * 4 + 1, F.lit(4)))
    return q8(spark, sf_dir).select("row", F.posexplode(cut).alias("col", "s"))


FOUR = f"SELECT r AS row, CAST(c // 4 AS INT) AS col, max(v) FILTER (c % 4 = 0) AS a, max(v) FILTER (c % 4 = 1) AS b, max(v) FILTER (c % 4 = 2) AS d, max(v) FILTER (c % 4 = 3) AS k FROM ({PX}) GROUP BY ALL"


@query(f"SELECT r AS row, CAST(c AS INT) AS col, CAST((255 - v) * 257 AS BIGINT) AS value FROM ({PX})")
def decode_gray_invert(spark, sf_dir):
    return raster.pixels(q8(spark, sf_dir)).select("row", "col", pixels.scale_bits(pixels.invert(F.col("value"), 8), 8, 16).alias("value"))


@query(f"SELECT r AS row, CAST(c AS INT) AS col, CAST((v >> 4) * 17 AS BIGINT) AS red, CAST((15 - (v >> 4)) * 17 AS BIGINT) AS green, CAST((v >> 4) * 8 AS BIGINT) AS blue FROM ({PX})")
def decode_palette(spark, sf_dir):
    planes = [F.array(*(F.lit(v) for v in plane)) for plane in ([i * 17 * 257 for i in range(16)], [(15 - i) * 17 * 257 for i in range(16)], [i * 8 * 257 for i in range(16)])]
    index = F.shiftright("value", 4)
    red, green, blue = pixels.palette(index, *planes, to_bits=8)
    return raster.pixels(q8(spark, sf_dir)).select("row", "col", red.alias("red"), green.alias("green"), blue.alias("blue"))


@query(f"SELECT row, col, {', '.join(f'CAST(floor((1 - {s} / 255.0::DOUBLE) * (1 - k / 255.0::DOUBLE) * 255.0::DOUBLE + 0.5) AS BIGINT) AS {n}' for s, n in (('a', 'red'), ('b', 'green'), ('d', 'blue')))} FROM ({FOUR})")
def decode_cmyk(spark, sf_dir):
    rgb = pixels.cmyk_to_rgb(*(F.get("s", F.lit(i)) for i in range(4)))
    return _four(spark, sf_dir).select("row", "col", *(c.alias(n) for c, n in zip(rgb, ("red", "green", "blue"), strict=True)))


_Y = "a / 255.0::DOUBLE"
_B, _R = "(b - 128.0::DOUBLE) / 255.0::DOUBLE", "(d - 128.0::DOUBLE) / 255.0::DOUBLE"
_RGB = {"red": f"{_Y} + 1.402::DOUBLE * ({_R})", "green": f"{_Y} - 0.344136286::DOUBLE * ({_B}) - 0.714136286::DOUBLE * ({_R})", "blue": f"{_Y} + 1.772::DOUBLE * ({_B})"}


@query(f"SELECT row, col, {', '.join(f'CAST(floor(greatest(0, least(1, {e})) * 255.0::DOUBLE + 0.5) AS BIGINT) AS {n}' for n, e in _RGB.items())} FROM ({FOUR})")
def decode_ycbcr(spark, sf_dir):
    rgb = pixels.ycbcr_to_rgb(*(F.get("s", F.lit(i)) for i in range(3)))
    return _four(spark, sf_dir).select("row", "col", *(c.alias(n) for c, n in zip(rgb, ("red", "green", "blue"), strict=True)))


@query(f"SELECT r AS row, CAST(c AS INT) AS col, CAST((v * 15 + 127) // 255 AS BIGINT) AS four, CAST((v * 65535 + 127) // 255 AS BIGINT) AS sixteen, CAST((v * 4294967295 + 127) // 255 AS DECIMAL(20, 0)) AS thirty_two FROM ({PX})")
def scale_bits(spark, sf_dir):
    v = F.col("value")
    return raster.pixels(q8(spark, sf_dir)).select("row", "col", pixels.scale_bits(v, 8, 4).alias("four"), pixels.scale_bits(v, 8, 16).alias("sixteen"), pixels.scale_bits(v, 8, 32).alias("thirty_two"))


# Coordinate reference systems

KEYS = "SELECT n_nationkey AS id, CASE n_nationkey % 4 WHEN 0 THEN NULL ELSE n_nationkey % 4 END AS model, CASE WHEN n_nationkey % 3 = 0 THEN 26900 + n_nationkey END AS projected, CASE WHEN n_nationkey % 2 = 0 THEN 4300 + n_nationkey END AS geodetic, CASE WHEN n_nationkey % 5 = 0 THEN 5703 END AS vertical FROM nation"


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    updates = {geo.MODEL_TYPE: F.when(k % 4 != 0, k % 4), geo.PROJECTED: F.when(k % 3 == 0, 26900 + k), geo.GEODETIC: F.when(k % 2 == 0, 4300 + k), geo.VERTICAL: F.when(k % 5 == 0, F.lit(5703))}
    none = F.expr("cast(map() as map<int,int>)")
    return table(spark, sf_dir, "nation").select(k.alias("id"), geo.with_keys(none, updates).alias("keys"))


@query(f"SELECT id, CAST(coalesce(CASE WHEN model = 1 THEN coalesce(projected, geodetic) ELSE coalesce(geodetic, projected) END, vertical) AS INT) AS epsg FROM ({KEYS})")
def crs_epsg_resolve(spark, sf_dir):
    key = lambda k: geo.short_key(F.col("keys"), k)
    return _keyed(spark, sf_dir).select("id", geo.epsg(key(geo.MODEL_TYPE), key(geo.PROJECTED), key(geo.GEODETIC), key(geo.VERTICAL)).alias("epsg"))


@query(f"SELECT id, CASE WHEN (model IS NOT NULL OR projected IS NOT NULL OR geodetic IS NOT NULL) AND vertical IS NOT NULL THEN 'compound' WHEN model IS NOT NULL OR projected IS NOT NULL OR geodetic IS NOT NULL THEN 'horizontal' WHEN vertical IS NOT NULL THEN 'vertical' ELSE 'unspecified' END AS kind FROM ({KEYS})")
def crs_kind(spark, sf_dir):
    key = lambda k: geo.short_key(F.col("keys"), k)
    return _keyed(spark, sf_dir).select("id", geo.crs_kind(key(geo.MODEL_TYPE), key(geo.PROJECTED).isNotNull() | key(geo.GEODETIC).isNotNull(), key(geo.VERTICAL).isNotNull()).alias("kind"))


@query(f"SELECT id, key, CAST(value AS INT) AS value FROM ({KEYS}) UNPIVOT (value FOR key IN (model, projected, geodetic, vertical))")
def geokey_lookup(spark, sf_dir):
    names = F.create_map(*(F.lit(x) for kv in ((geo.MODEL_TYPE, "model"), (geo.PROJECTED, "projected"), (geo.GEODETIC, "geodetic"), (geo.VERTICAL, "vertical")) for x in kv))
    return _keyed(spark, sf_dir).select("id", F.explode("keys").alias("k", "value")).select("id", F.element_at(names, F.col("k")).alias("key"), "value")


IMAGES = """SELECT p_brand AS path, p_partkey AS ifd_index, 64 * (1 + p_partkey % 8) AS width, 48 * (1 + p_partkey % 5) AS height, 1 + p_size % 2 AS spp, 8 AS bits, 1 AS sample_format, 1 AS photometric,
CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 1 ELSE 0 END AS new_subfile_type, CASE WHEN p_partkey % 7 = 0 THEN 2 END AS subfile_type, p_partkey % 4 = 0 AS has_geokeys FROM part"""


@query(
    f"""WITH i AS (SELECT *, coalesce(new_subfile_type & 1 = 1, subfile_type = 2, false) AS reduced FROM ({IMAGES})),
m AS (SELECT path, min(ifd_index) AS meta, arg_min(reduced, ifd_index) AS meta_reduced FROM i WHERE has_geokeys GROUP BY path),
b AS (SELECT m.path, CASE WHEN meta_reduced THEN coalesce((SELECT min(ifd_index) FROM i WHERE i.path = m.path AND NOT reduced AND ifd_index > meta), meta) ELSE meta END AS base FROM m),
w AS (SELECT i.* FROM i JOIN b ON i.path = b.path AND i.ifd_index = b.base)
SELECT o.path, o.ifd_index, o.width, o.height, CAST(row_number() OVER (PARTITION BY o.path ORDER BY o.width DESC, o.height DESC, o.ifd_index) - 1 AS INT) AS overview
FROM i o JOIN w ON o.path = w.path WHERE o.ifd_index <> w.ifd_index AND (o.width < w.width OR o.height < w.height) AND o.spp = w.spp
AND (o.reduced OR (o.new_subfile_type IS NULL AND o.subfile_type IS NULL))"""
)
def overview_select(spark, sf_dir):
    images = table(spark, sf_dir, "part").selectExpr(*(c.strip() for c in (
        "p_brand AS path", "p_partkey AS ifd_index", "64 * (1 + p_partkey % 8) AS width", "48 * (1 + p_partkey % 5) AS height", "1 + p_size % 2 AS spp", "8 AS bits", "1 AS sample_format", "1 AS photometric",
        "CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 1 ELSE 0 END AS new_subfile_type", "CASE WHEN p_partkey % 7 = 0 THEN 2 END AS subfile_type", "p_partkey % 4 = 0 AS has_geokeys")))
    return raster.overviews(images).select("path", "ifd_index", "width", "height", "overview")


TILE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@query(f"SELECT l_orderkey AS tile, l_linenumber AS band, l_quantity AS value FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(f'{c} DESC' for c in TILE_ORDER)}) = 1")
def tiles_last_write_wins(spark, sf_dir):
    tiles = table(spark, sf_dir, "lineitem")
    return raster.last_written(tiles, ["l_orderkey", "l_linenumber"], TILE_ORDER, ["l_quantity"]).toDF("tile", "band", "value")
