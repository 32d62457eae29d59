"""One file or folder of files, asked by name: metadata, windows, bands, decoded colours and overviews as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions import geo
from rasterloom.operators import files
from rasterloom.sources import tiff


@dataclass
class Raster:
    """`Raster(spark, path)` opens anything that the data sources read; nothing is read before an action.

    Images are named by `ifd` (place in the chain), by `overview` (0 is the largest) or, for georeferenced files, are
    the base image. Every read takes `decoded` for colours in place of stored samples.
    """

    spark: SparkSession
    path: str
    fmt: str = "tiff"
    options: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        tiff.register(self.spark)

    def _table(self, table: str, **more) -> DataFrame:
        reader = self.spark.read.format(self.fmt).option("table", table)
        for k, v in {**self.options, **{k: v for k, v in more.items() if v is not None}}.items():
            reader = reader.option(k, str(v).lower() if isinstance(v, bool) else v)
        return reader.load(self.path)

    # Metadata

    def images(self) -> DataFrame:
        """A row for each image: layout, tags, and what its tags lack for one."""
        return self._table("images")

    def base(self) -> DataFrame:
        """Each georeferenced file's base image."""
        return self.images().where("role = 'base'")

    def overviews(self) -> DataFrame:
        return self.images().where("role = 'overview'").select("path", "overview", "ifd_index", "top_level_ifd_index", "width", "height")

    def crs(self) -> DataFrame:
        return self.base().select("path", "geo.epsg", "geo.model_type", "geo.raster_type", "geo.crs_kind", "geo.nodata")

    def bounds(self) -> DataFrame:
        b = F.col("geo.bounds")
        return self.base().select("path", *(F.get(b, F.lit(k)).alias(n) for k, n in enumerate(("min_x", "min_y", "max_x", "max_y"))))

    def tag(self, code: int) -> DataFrame:
        """(path, ifd_index, tag) of every image that has a tag."""
        found = F.filter("tags", lambda t: t["code"] == code)
        return self.images().select("path", "ifd_index", F.get(found, F.lit(0)).alias("tag")).where("tag is not null")

    def blocks(self, payload: bool = False, window: tuple[int, int, int, int] | None = None, **which) -> DataFrame:
        """The strips or tiles, or those that a window touches, with their stored bytes if asked for."""
        return self._table("blocks", payload=payload, window=_joined(window), **which)

    # Samples

    def pixels(self, window: tuple[int, int, int, int] | None = None, band: int | None = None, decoded: bool = False, **which) -> DataFrame:
        """(path, ifd_index, row, col, band, value); a window is (row, col, rows, cols)."""
        return self._table("pixels", window=_joined(window), band=band, decoded=decoded, **which)

    def samples(self, window: tuple[int, int, int, int] | None = None, band: int | None = None, decoded: bool = False, **which) -> DataFrame:
        """The same by block, as arrays' bytes."""
        return self._table("samples", window=_joined(window), band=band, decoded=decoded, **which)

    def bytes(self, window: tuple[int, int, int, int] | None = None, band: int | None = None, decoded: bool = False, **which) -> DataFrame:
        """Whole windows as bytes, one row an image."""
        asked = {"window": _joined(window), "band": band, "decoded": str(decoded).lower(), **which, **self.options}
        return files.window_bytes(self.spark, self.path, self.fmt, **{k: v for k, v in asked.items() if v is not None})

    # Places

    def to_geo(self, pixels: DataFrame) -> DataFrame:
        """pixels (path, col, row, …) with x and y; the base images are broadcast only where Spark knows them small."""
        found = pixels.join(self.base().select("path", F.col("geo.transform").alias("_t")), "path")
        x, y = geo.pixel_to_geo(F.col("_t"), F.col("col"), F.col("row"))
        return found.withColumns({"x": x, "y": y}).drop("_t")

    def to_pixel(self, places: DataFrame) -> DataFrame:
        """places (path, x, y, …) with col and row, null where a transform has no inverse."""
        found = places.join(self.base().select("path", F.col("geo.transform").alias("_t")), "path")
        col, row = geo.geo_to_pixel(F.col("_t"), F.col("x"), F.col("y"))
        return found.withColumns({"col": col, "row": row}).drop("_t")


def _joined(window: tuple[int, int, int, int] | None) -> str | None:
    return None if window is None else ",".join(map(str, window))
