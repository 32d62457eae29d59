"""GeoTIFF metadata: GeoKeys, coordinate reference systems, transforms, base images and overviews."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from rasterloom.functions.geo import LEAST_AREA, PIXEL_IS_POINT
from rasterloom.sources import container as c
from rasterloom.sources.errors import InvalidTag, NotGeoTiff, TiffError

# GeoKey ids.
MODEL_TYPE, RASTER_TYPE, CITATION = 1024, 1025, 1026
GEODETIC_CRS, GEODETIC_CITATION, GEODETIC_DATUM, ANGULAR_UNITS = 2048, 2049, 2050, 2054
PROJECTED_CRS, PROJECTED_CITATION, LINEAR_UNITS = 3072, 3073, 3076
VERTICAL_CRS, VERTICAL_CITATION, VERTICAL_DATUM, VERTICAL_UNITS = 4096, 4097, 4098, 4099
HORIZONTAL = (GEODETIC_CRS, GEODETIC_CITATION, GEODETIC_DATUM, ANGULAR_UNITS, PROJECTED_CRS, PROJECTED_CITATION, LINEAR_UNITS)
VERTICAL = (VERTICAL_CRS, VERTICAL_CITATION, VERTICAL_DATUM, VERTICAL_UNITS)
SIDE_CITATIONS = {"projected_citation": PROJECTED_CITATION, "geodetic_citation": GEODETIC_CITATION, "vertical_citation": VERTICAL_CITATION}
SIDE_CODES = {"geodetic_datum": GEODETIC_DATUM, "angular_units": ANGULAR_UNITS, "linear_units": LINEAR_UNITS, "vertical_datum": VERTICAL_DATUM, "vertical_units": VERTICAL_UNITS}

Keys = dict[int, "int | list[float] | str"]


def parse_keys(directory: list[int], doubles: list[float], ascii_: str) -> Keys:
    """Keys by id, the first of equal ones; keys that point nowhere are left out."""
    keys: Keys = {}
    if len(directory) < 4:
        return keys
    for k in range(directory[3]):
        entry = directory[4 + 4 * k : 8 + 4 * k]
        if len(entry) < 4:
            break
        key, where, count, value = entry
        if key in keys:
            continue
        if where == 0:
            keys[key] = value
        elif where == c.GEO_DOUBLES and value + count <= len(doubles):
            keys[key] = doubles[value : value + count]
        elif where == c.GEO_ASCII and value + count <= len(ascii_):
            keys[key] = ascii_[value : value + count].rstrip("|").rstrip("\0")
    return keys


def serialize_keys(keys: Keys) -> tuple[list[int], list[float], str]:
    """The directory, doubles and text of keys, by id."""
    directory, doubles, text = [1, 1, 0, len(keys)], [], ""
    for key, value in sorted(keys.items()):
        if isinstance(value, int):
            directory += [key, 0, 1, value]
        elif isinstance(value, str):
            directory += [key, c.GEO_ASCII, len(value) + 1, len(text)]
            text += value + "|"
        else:
            directory += [key, c.GEO_DOUBLES, len(value), len(doubles)]
            doubles += value
    return directory, doubles, text


@dataclass(frozen=True)
class Transform:
    origin_x: float
    pixel_width: float
    skew_x: float
    origin_y: float
    skew_y: float
    pixel_height: float

    def to_geo(self, col: float, row: float) -> tuple[float, float]:
        return self.origin_x + col * self.pixel_width + row * self.skew_x, self.origin_y + col * self.skew_y + row * self.pixel_height

    def to_pixel(self, x: float, y: float) -> tuple[float, float] | None:
        area = self.pixel_width * self.pixel_height - self.skew_x * self.skew_y
        if abs(area) < LEAST_AREA:
            return None
        dx, dy = x - self.origin_x, y - self.origin_y
        return (self.pixel_height * dx - self.skew_x * dy) / area, (self.pixel_width * dy - self.skew_y * dx) / area

    def bounds(self, width: int, height: int) -> list[float]:
        xs, ys = zip(*(self.to_geo(a, b) for a in (0, width) for b in (0, height)), strict=True)
        return [min(xs), min(ys), max(xs), max(ys)]


@dataclass(frozen=True)
class Crs:
    model: int
    raster_type: int
    kind: str
    projected: int | None
    geodetic: int | None
    vertical: int | None
    citation: str | None
    projected_citation: str | None = None
    geodetic_citation: str | None = None
    vertical_citation: str | None = None
    geodetic_datum: int | None = None
    angular_units: int | None = None
    linear_units: int | None = None
    vertical_datum: int | None = None
    vertical_units: int | None = None

    @property
    def geographic(self) -> int | None:
        """The code of a geographic system."""
        return self.geodetic if self.model == 2 else None

    @property
    def geocentric(self) -> int | None:
        """The code of a geocentric system."""
        return self.geodetic if self.model == 3 else None

    @property
    def epsg(self) -> int | None:
        first, second = (self.projected, self.geodetic) if self.model == 1 else (self.geodetic, self.projected)
        return next((k for k in (first, second, self.vertical) if k is not None), None)


def crs_of(keys: Keys) -> Crs:
    short = lambda k: keys[k] if isinstance(keys.get(k), int) else None
    model = short(MODEL_TYPE) or 0
    horizontal, vertical = model != 0 or any(k in keys for k in HORIZONTAL), any(k in keys for k in VERTICAL)
    kind = "compound" if horizontal and vertical else "horizontal" if horizontal else "vertical" if vertical else "unspecified"
    text = next((keys[k] for k in (PROJECTED_CITATION, GEODETIC_CITATION, CITATION, VERTICAL_CITATION) if isinstance(keys.get(k), str)), None)
    said = {n: keys[k] for n, k in SIDE_CITATIONS.items() if isinstance(keys.get(k), str)}
    coded = {n: short(k) for n, k in SIDE_CODES.items()}
    return Crs(model, short(RASTER_TYPE) or 1, kind, short(PROJECTED_CRS), short(GEODETIC_CRS), short(VERTICAL_CRS), text, **said, **coded)


def keys_of_epsg(code: int, model: int | None = None) -> Keys:
    """Keys of a bare code: 4978 is geocentric, other codes of 4000 to 4999 are geographic, all else is projected."""
    model = model or (3 if code == 4978 else 2 if 4000 <= code <= 4999 else 1)
    return {MODEL_TYPE: model, (PROJECTED_CRS if model == 1 else GEODETIC_CRS): code}


def keys_of_crs(crs: Crs, keys: Keys | None = None) -> Keys:
    """Keys with those of a coordinate reference system set; a side that it lacks is taken out whole."""
    out = dict(keys or {})
    if crs.kind in ("vertical", "unspecified"):
        for k in (MODEL_TYPE, *HORIZONTAL):
            out.pop(k, None)
    if crs.kind in ("horizontal", "unspecified"):
        for k in VERTICAL:
            out.pop(k, None)
    horizontal, vertical = crs.kind in ("horizontal", "compound"), crs.kind in ("vertical", "compound")
    for name, k in {**SIDE_CITATIONS, **SIDE_CODES}.items():
        if (value := getattr(crs, name)) is not None and (vertical if k in VERTICAL else horizontal):
            out[k] = value
    for k, v in ((MODEL_TYPE, crs.model or None), (RASTER_TYPE, crs.raster_type), (PROJECTED_CRS, crs.projected), (GEODETIC_CRS, crs.geodetic), (VERTICAL_CRS, crs.vertical), (CITATION, crs.citation)):
        if v is not None:
            out[k] = v
    return out


@dataclass(frozen=True)
class Overview:
    ifd: c.Ifd
    top_level_index: int | None


class GeoInfo:
    """What an open file says of its place on Earth."""

    def __init__(self, tiff: c.Tiff):
        self.tiff = tiff
        meta = next((i for i in tiff.ifds if c.GEO_KEYS in i.tags), None)
        if meta is None:
            raise NotGeoTiff("no image has GeoKeys")
        if meta.tags[c.GEO_KEYS].type != 3:
            raise InvalidTag("the GeoKey directory must be of SHORT numbers")
        ascii_ = meta.tags.get(c.GEO_ASCII)
        self.keys = parse_keys(meta.numbers(c.GEO_KEYS), meta.numbers(c.GEO_DOUBLES), ascii_.values if ascii_ else "")
        self.crs, self.metadata_ifd = crs_of(self.keys), meta
        self.transform = self._transform(meta)
        self.base = meta if not meta.reduced() else next((i for i in tiff.ifds[meta.index + 1 :] if not i.reduced()), meta)
        self.bounds = self.transform.bounds(self.base.width, self.base.height) if self.transform else None
        text = meta.tags.get(c.NODATA)
        self.nodata = text.values.strip().strip("\0") if text and isinstance(text.values, str) else None
        self.overviews = self._overviews()

    def _transform(self, ifd: c.Ifd) -> Transform | None:
        if len(m := ifd.numbers(c.TRANSFORMATION)) >= 16:
            return Transform(m[3], m[0], m[1], m[7], m[4], m[5])
        tie, scale = ifd.numbers(c.TIEPOINT)[:6], ifd.numbers(c.PIXEL_SCALE)[:3]
        if len(tie) < 6 or len(scale) < 2:
            return None
        half = 0.5 if self.crs.raster_type == PIXEL_IS_POINT else 0.0
        i, j, _, x, y, _ = tie
        return Transform(x - (i + half) * scale[0], scale[0], 0.0, y + (j + half) * scale[1], 0.0, -scale[1])

    def _overviews(self) -> list[Overview]:
        base = self.base
        like = (base.spp, base.bits, base.sample_format, base.photometric)

        def fits(i: c.Ifd) -> bool:
            smaller = i.width < base.width or i.height < base.height
            unmarked = c.NEW_SUBFILE_TYPE not in i.tags and c.SUBFILE_TYPE not in i.tags
            return smaller and (i.spp, i.bits, i.sample_format, i.photometric) == like and (i.reduced() or unmarked)

        found = [Overview(i, i.index) for i in self.tiff.ifds if i.offset != base.offset and fits(i)]
        seen = {i.offset for i in self.tiff.ifds}
        todo = list(base.numbers(c.SUB_IFDS))
        while todo:
            at = todo.pop(0)
            if not at or at in seen or len(seen) > c.MOST_IFDS:
                continue
            seen.add(at)
            i = self.tiff.ifd_at(at)
            todo += i.numbers(c.SUB_IFDS)
            if fits(i):
                found.append(Overview(i, None))
        return sorted(found, key=lambda o: (-o.ifd.width, -o.ifd.height, -1 if o.top_level_index is None else o.top_level_index))

    def row(self) -> dict:
        """As a Spark row."""
        return {
            "epsg": self.crs.epsg, "model_type": self.crs.model, "raster_type": self.crs.raster_type, "crs_kind": self.crs.kind,
            "transform": asdict(self.transform) if self.transform else None, "bounds": self.bounds, "nodata": self.nodata,
        }


def geo_or_none(tiff: c.Tiff) -> GeoInfo | None:
    try:
        return tiff.geo
    except NotGeoTiff:
        return None
    except TiffError:
        return None
