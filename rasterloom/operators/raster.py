"""Operators over rasters as DataFrames.

A raster comes in one of two shapes: `rows` (row, samples ARRAY), one record per image row, or `pixels` (row, col, value
and maybe band), one per sample. Operators prune rows and slice arrays before they explode anything, and what can be
summed within a record is summed there before a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions.pixels import is_nodata, saturate


class WindowOutOfBounds(ValueError):
    """A window that is not within the raster."""


class BandOutOfBounds(ValueError):
    """A band that the raster has not."""


def check_window(row: int, col: int, rows: int, cols: int, height: int, width: int) -> None:
    if min(row, col, rows, cols) < 0 or row + rows > height or col + cols > width:
        raise WindowOutOfBounds(f"window ({row}, {col}, {rows}, {cols}) of a raster of {height} x {width}")


def check_band(band: int, bands: int) -> None:
    if not 0 <= band < bands:
        raise BandOutOfBounds(f"band {band} of {bands}")


def pixels(rows: DataFrame) -> DataFrame:
    """(row, col, value) of every sample."""
    return rows.select("row", F.posexplode("samples").alias("col", "value"))


def window(rows: DataFrame, row: int, col: int, n_rows: int, n_cols: int) -> DataFrame:
    """(row, col, value) within a window; the row range reaches the scan and arrays are sliced before they explode."""
    if n_rows == 0 or n_cols == 0:
        return pixels(rows.limit(0))
    near = rows.where((F.col("row") >= row) & (F.col("row") < row + n_rows))
    return near.select("row", F.posexplode(F.slice("samples", col + 1, n_cols)).alias("c", "value")).select("row", (F.col("c") + col).alias("col"), "value")


def band(rows: DataFrame, which: int, bands: int) -> DataFrame:
    """(row, col, value) of one band of interleaved samples."""
    check_band(which, bands)
    own = F.filter("samples", lambda v, i: i % bands == which)
    return rows.select("row", F.posexplode(own).alias("col", "value"))


def block_grid(images: DataFrame, block_h: int, block_w: int) -> DataFrame:
    """(…, block_index, y, x, rows, cols): the blocks of images (height, width), clipped at the edges, row by row."""
    across = F.ceil(F.col("width") / block_w)
    count = across * F.ceil(F.col("height") / block_h)
    grid = images.withColumn("block_index", F.explode(F.sequence(F.lit(0).cast("long"), (count - 1).cast("long")))).withColumn("_across", across)
    y = (F.floor(F.col("block_index") / F.col("_across")) * block_h).cast("long")
    x = ((F.col("block_index") % F.col("_across")) * block_w).cast("long")
    return grid.withColumn("y", y).withColumn("x", x).withColumn("rows", F.least(F.lit(block_h), F.col("height") - F.col("y"))).withColumn("cols", F.least(F.lit(block_w), F.col("width") - F.col("x"))).drop("_across")


def blocks_of_windows(windows: DataFrame, blocks: DataFrame, block_h: int, block_w: int, keys: list[str] | None = None) -> DataFrame:
    """windows (r0, c0, n_rows, n_cols) with the blocks that each touches.

    Each window names the grid places it covers, so that the overlap is an equi-join on (y, x) and no pair of a
    window and a block that don't touch is ever made.
    """
    span = lambda a, n, size: F.transform(F.sequence(F.floor(F.col(a) / size), F.floor((F.col(a) + F.col(n) - 1) / size)), lambda k: k * size)
    covered = windows.where("n_rows > 0 and n_cols > 0").withColumn("y", F.explode(span("r0", "n_rows", block_h))).withColumn("x", F.explode(span("c0", "n_cols", block_w)))
    return covered.join(blocks, [*(keys or []), "y", "x"])


def fill_missing(tiles: DataFrame, grid: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """Every place of the grid, with the tile there or else the given values."""
    found = grid.join(tiles, keys, "left")
    return found.select(*grid.columns, *(F.coalesce(F.col(c), v).alias(c) for c, v in values.items()))


def nearest_overview(rows: DataFrame, level: int) -> DataFrame:
    """(row, col, value): the first sample of each cell of level x level."""
    own = F.filter("samples", lambda v, i: i % level == 0)
    return rows.where(F.col("row") % level == 0).select(_cell("row", level).alias("row"), F.posexplode(own).alias("col", "value"))


def _cell(c: str, level: int) -> Column:
    return ((F.col(c) - F.pmod(F.col(c), F.lit(level))) / level).cast("long")


def average_overview(rows: DataFrame, level: int, nodata: Column | None = None, limits: tuple[int, int] | None = (0, 255)) -> DataFrame:
    """(row, col, value): the mean of each cell's samples that are not nodata, or nodata (else 0) where all are.

    Each record sums its own samples by cell first, so a row leaves as many numbers as the overview is wide. limits are
    those of a whole-number type, to which means are cut towards zero; None keeps them as doubles.
    """
    whole = "long" if limits else "double"

    def part(c: Column) -> Column:
        cut = F.filter(F.slice("samples", c * level + 1, F.lit(level)), lambda v: ~is_nodata(v, nodata) & v.isNotNull())
        return F.struct(F.aggregate(cut, F.lit(0).cast(whole), lambda a, v: a + v.cast(whole)).alias("total"), F.size(cut).cast("long").alias("n"))

    cells = F.transform(F.sequence(F.lit(0), (F.ceil(F.size("samples") / level) - 1).cast("int")), part)
    parts = rows.where(F.size("samples") > 0).select(_cell("row", level).alias("row"), F.posexplode(cells).alias("col", "p"))
    sums = parts.groupBy("row", "col").agg(F.sum("p.total").alias("total"), F.sum("p.n").alias("n"))
    mean = F.col("total") / F.col("n")
    empty = F.lit(0.0) if nodata is None else F.coalesce(nodata, F.lit(0.0))
    value = F.when(F.col("n") > 0, mean).otherwise(empty)
    return sums.select("row", "col", (saturate(value, *limits).cast("int") if limits else value).alias("value"))


def overview_levels(levels: list[int]) -> list[int]:
    """Sorted, each once; a level that does not shrink is an error."""
    if any(v <= 1 for v in levels):
        raise ValueError(f"overview levels must be above 1: {levels}")
    return sorted(set(levels))


def pyramid(rows: DataFrame, levels: list[int], nodata: Column | None = None) -> DataFrame:
    """(level, row, col, value) of the average overviews; each from the base."""
    out = None
    for level in overview_levels(levels):
        one = average_overview(rows, level, nodata).select(F.lit(level).alias("level"), "row", "col", "value")
        out = one if out is None else out.unionByName(one)
    return out


def undo_horizontal(pixels_: DataFrame, bits: int, keys: list[str]) -> DataFrame:
    """Running sums along each key's columns, modulo the sample's range: the horizontal predictor undone."""
    along = Window.partitionBy(*keys).orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    return pixels_.withColumn("value", F.pmod(F.sum("value").over(along), F.lit(1 << bits)))


def last_written(tiles: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Of tiles written more than once, the last by order: a maximum with partial results, no sort."""
    return tiles.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_last")).select(*keys, *(F.col(f"_last.{v}").alias(v) for v in values))


def reduced(images: DataFrame) -> Column:
    """Whether an image says that it is a reduced one of another."""
    return F.coalesce(F.col("new_subfile_type").bitwiseAND(1) == 1, F.col("subfile_type") == 2, F.lit(False))


def base_images(images: DataFrame) -> DataFrame:
    """(path, metadata_ifd, base_ifd): the first image with GeoKeys, and the image whose pixels they describe."""
    flagged = images.withColumn("_reduced", reduced(images))
    meta = flagged.where("has_geokeys").groupBy("path").agg(F.min(F.struct("ifd_index", "_reduced")).alias("m")).select("path", F.col("m.ifd_index").alias("metadata_ifd"), F.col("m._reduced").alias("_meta_reduced"))
    later = flagged.where("not _reduced").join(meta, "path").where("ifd_index > metadata_ifd").groupBy("path").agg(F.min("ifd_index").alias("_later"))
    return meta.join(later, "path", "left").select("path", "metadata_ifd", F.when(F.col("_meta_reduced"), F.coalesce("_later", "metadata_ifd")).otherwise(F.col("metadata_ifd")).alias("base_ifd"))


def overviews(images: DataFrame) -> DataFrame:
    """(path, base_ifd, ifd_index, width, height, overview): each base image's overviews, the largest first."""
    base = base_images(images).join(images, "path").where("ifd_index = base_ifd")
    same = ["spp", "bits", "sample_format", "photometric"]
    b = base.select("path", "base_ifd", *(F.col(c).alias(f"b_{c}") for c in ("width", "height", *same)))
    o = images.withColumn("_flag", reduced(images) | (F.col("new_subfile_type").isNull() & F.col("subfile_type").isNull()))
    smaller = (F.col("width") < F.col("b_width")) | (F.col("height") < F.col("b_height"))
    alike = F.col("ifd_index") != F.col("base_ifd")
    for c in same:
        alike &= F.col(c) == F.col(f"b_{c}")
    found = o.where("_flag").join(b, "path").where(alike & smaller)
    order = Window.partitionBy("path").orderBy(F.desc("width"), F.desc("height"), F.asc_nulls_first("ifd_index"))
    return found.select("path", "base_ifd", "ifd_index", "width", "height", (F.row_number().over(order) - 1).alias("overview"))
