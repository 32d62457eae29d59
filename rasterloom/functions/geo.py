"""Affine transforms, bounds and coordinate reference systems as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("origin_x", "pixel_width", "skew_x", "origin_y", "skew_y", "pixel_height")
#: Areas of a pixel below which a transform has no inverse.
LEAST_AREA = 1e-15
# GeoKey ids and codes of the GeoTIFF standard.
MODEL_TYPE, RASTER_TYPE, GEODETIC, PROJECTED, VERTICAL = 1024, 1025, 2048, 3072, 4096
MODEL_PROJECTED, MODEL_GEOGRAPHIC, MODEL_GEOCENTRIC = 1, 2, 3
PIXEL_IS_AREA, PIXEL_IS_POINT = 1, 2


def transform(origin_x: Column, pixel_width: Column, skew_x: Column, origin_y: Column, skew_y: Column, pixel_height: Column) -> Column:
    return F.struct(*(c.cast("double").alias(n) for n, c in zip(FIELDS, (origin_x, pixel_width, skew_x, origin_y, skew_y, pixel_height), strict=True)))


def from_tiepoint_and_scale(tiepoint: Column, scale: Column, raster_type: Column) -> Column:
    """Of the six tiepoint numbers and the pixel scale; a tiepoint at a pixel's centre moves by half a pixel."""
    i, j, x, y = (F.get(tiepoint, F.lit(k)) for k in (0, 1, 3, 4))
    w, h = F.get(scale, F.lit(0)), F.get(scale, F.lit(1))
    half = F.when(raster_type == PIXEL_IS_POINT, 0.5).otherwise(0.0)
    return transform(x - (i + half) * w, w, F.lit(0.0), y + (j + half) * h, F.lit(0.0), -h)


def from_matrix(m: Column) -> Column:
    return transform(*(F.get(m, F.lit(k)) for k in (3, 0, 1, 7, 4, 5)))


def to_matrix(t: Column) -> Column:
    z = F.lit(0.0)
    return F.array(t["pixel_width"], t["skew_x"], z, t["origin_x"], t["skew_y"], t["pixel_height"], z, t["origin_y"], z, z, z, z, z, z, z, F.lit(1.0))


def to_tiepoint_and_scale(t: Column) -> Column:
    """A struct (tiepoint, scale), null for a transform with skew."""
    z = F.lit(0.0)
    made = F.struct(F.array(z, z, z, t["origin_x"], t["origin_y"], z).alias("tiepoint"), F.array(t["pixel_width"], -t["pixel_height"], z).alias("scale"))
    return F.when((F.abs(t["skew_x"]) <= LEAST_AREA) & (F.abs(t["skew_y"]) <= LEAST_AREA), made)


def pixel_to_geo(t: Column, col: Column, row: Column) -> tuple[Column, Column]:
    return t["origin_x"] + col * t["pixel_width"] + row * t["skew_x"], t["origin_y"] + col * t["skew_y"] + row * t["pixel_height"]


def geo_to_pixel(t: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """(col, row), null where the transform has no inverse."""
    area = t["pixel_width"] * t["pixel_height"] - t["skew_x"] * t["skew_y"]
    dx, dy = x - t["origin_x"], y - t["origin_y"]
    ok = F.abs(area) >= LEAST_AREA
    return F.when(ok, (t["pixel_height"] * dx - t["skew_x"] * dy) / area), F.when(ok, (t["pixel_width"] * dy - t["skew_y"] * dx) / area)


def bounds(t: Column, width: Column, height: Column) -> Column:
    """A struct (min_x, min_y, max_x, max_y) of the four corners."""
    corners = [pixel_to_geo(t, c, r) for c in (F.lit(0), width) for r in (F.lit(0), height)]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    return F.struct(F.least(*xs).alias("min_x"), F.least(*ys).alias("min_y"), F.greatest(*xs).alias("max_x"), F.greatest(*ys).alias("max_y"))


def short_key(keys: Column, key: int) -> Column:
    """The number that a map of GeoKeys has under an id, null if none."""
    return F.try_element_at(keys, F.lit(key))


def with_keys(keys: Column, updates: dict[int, Column]) -> Column:
    """A map of GeoKeys with some set, and those set to null removed."""
    new = F.create_map(*(x for k, v in updates.items() for x in (F.lit(k), v.cast("int"))))
    kept = F.map_filter(keys, lambda k, v: ~k.isin(list(updates)))
    return F.map_filter(F.map_concat(kept, new), lambda k, v: v.isNotNull())


def epsg(model: Column, projected: Column, geodetic: Column, vertical: Column) -> Column:
    """The code of a coordinate reference system: of a projected model the projection's, else the datum's, else the height's."""
    return F.coalesce(F.when(model == MODEL_PROJECTED, F.coalesce(projected, geodetic)).otherwise(F.coalesce(geodetic, projected)), vertical)


def crs_kind(model: Column, has_horizontal_key: Column, has_vertical_key: Column) -> Column:
    horizontal = (F.coalesce(model, F.lit(0)) != 0) | has_horizontal_key
    return F.when(horizontal & has_vertical_key, "compound").when(horizontal, "horizontal").when(has_vertical_key, "vertical").otherwise("unspecified")


def model_of_epsg(code: Column) -> Column:
    """The model that a bare code is taken for."""
    return F.when(code == 4978, MODEL_GEOCENTRIC).when(code.between(4000, 4999), MODEL_GEOGRAPHIC).otherwise(MODEL_PROJECTED)
