"""Names of the format's codes, as plain tables and as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes of the TIFF format and what they are called.
CODES = {
    "compression": {1: "none", 5: "lzw", 6: "old-jpeg", 7: "jpeg", 8: "deflate", 32773: "packbits", 32946: "old-deflate", 34887: "lerc", 50000: "zstd"},
    "predictor": {1: "none", 2: "horizontal", 3: "floating-point"},
    "sample_format": {1: "uint", 2: "int", 3: "float"},
    "photometric": {0: "white-is-zero", 1: "black-is-zero", 2: "rgb", 3: "palette", 4: "mask", 5: "separated", 6: "ycbcr", 8: "cielab"},
    "extra_sample": {0: "unspecified", 1: "associated-alpha", 2: "unassociated-alpha"},
    "ycbcr_positioning": {1: "centered", 2: "cosited"},
    "ink_set": {1: "cmyk", 2: "not-cmyk"},
    "planar": {1: "chunky", 2: "planar"},
    "lerc_additional": {0: "none", 1: "deflate", 2: "zstd"},
    "model_type": {1: "projected", 2: "geographic", 3: "geocentric"},
    "raster_type": {1: "pixel-is-area", 2: "pixel-is-point"},
}


def name_of(kind: str, code: Column) -> Column:
    """A code's name; unknown codes keep their number."""
    table = F.create_map(*(F.lit(x) for kv in CODES[kind].items() for x in kv))
    return F.coalesce(F.try_element_at(table, code.cast("int")), F.concat(F.lit("unknown-"), code.cast("string")))


def code_of(kind: str, name: Column) -> Column:
    """A name's code, null if there is none."""
    table = F.create_map(*(F.lit(x) for k, v in CODES[kind].items() for x in (v, k)))
    return F.try_element_at(table, name)
