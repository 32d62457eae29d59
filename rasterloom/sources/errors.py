"""What can be wrong with a file, each its own class."""

from __future__ import annotations

from rasterloom.operators.raster import BandOutOfBounds, WindowOutOfBounds

__all__ = [
    "BandOutOfBounds", "DecodeFailed", "IncompleteImage", "InvalidHeader", "InvalidLayout", "InvalidTag", "NotGeoTiff", "SampleTypeMismatch",
    "TiffError", "Truncated", "UnsupportedCompression", "UnsupportedPlanar", "UnsupportedPredictor", "UnsupportedSampleFormat", "WindowOutOfBounds", "WriteConfig",
]


class TiffError(ValueError):
    """Anything wrong with a file or with what is asked of it."""


class InvalidHeader(TiffError):
    """Not the start of a TIFF file."""


class Truncated(TiffError):
    """The file ends before what an offset promises."""


class InvalidTag(TiffError):
    """A tag that the format does not allow."""


class InvalidLayout(TiffError):
    """Tags that together describe no image."""


class UnsupportedCompression(TiffError):
    """A compression that is not decoded or not written here."""


class UnsupportedSampleFormat(TiffError):
    """A sample format or depth that is not read."""


class UnsupportedPlanar(TiffError):
    """A planar configuration that is none."""


class UnsupportedPredictor(TiffError):
    """A predictor that is none."""


class SampleTypeMismatch(TiffError):
    """Samples asked for as another type than the file's."""


class DecodeFailed(TiffError):
    """A block whose bytes don't decode to what its image needs."""


class NotGeoTiff(TiffError):
    """A TIFF file without GeoKeys."""


class IncompleteImage(TiffError):
    """An image some of whose blocks were never written."""


class WriteConfig(TiffError):
    """Options that make no image."""
