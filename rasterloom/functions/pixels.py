"""Colour, scaling and predictor arithmetic as Column expressions: no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bit_max(bits: int) -> int:
    return (1 << bits) - 1


def half_away(x: Column) -> Column:
    """The nearest whole number, halves away from zero."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def scale_bits(v: Column, from_bits: int, to_bits: int) -> Column:
    """An unsigned sample of from_bits on the scale of to_bits, in whole numbers, halves up."""
    if from_bits == to_bits:
        return v.cast("long")
    a, b = bit_max(from_bits), bit_max(to_bits)
    if max(from_bits, to_bits) > 31:
        wide = lambda n: F.lit(str(n)).cast("decimal(38,0)")  # noqa: E731  no long holds the product
        return F.floor((v.cast("decimal(20,0)") * F.lit(str(b)).cast("decimal(20,0)") + wide(a // 2)) / F.lit(str(a)).cast("decimal(20,0)")).cast("decimal(20,0)")
    return _div(v.cast("long") * b + a // 2, a)


def _div(a: Column, b: int) -> Column:
    """Whole-number division of numbers from zero up."""
    return ((a - a % F.lit(b)) / F.lit(b)).cast("long")


def invert(v: Column, bits: int) -> Column:
    """A sample of which zero is white as one of which zero is black."""
    return F.lit(bit_max(bits)) - v


def palette(index: Column, red: Column, green: Column, blue: Column, to_bits: int = 16) -> list[Column]:
    """The three channels of a palette index; an index beyond the map is an error. Maps hold 16-bit numbers."""
    checked = F.when(index < F.size(red), index).otherwise(F.raise_error(F.concat(F.lit("palette index out of range: "), index.cast("string"))))
    return [scale_bits(F.get(plane, checked.cast("int")), 16, to_bits) for plane in (red, green, blue)]


def palette_is_8_bit(red: Column, green: Column, blue: Column) -> Column:
    """Whether every number of a colour map is an 8-bit number spread over 16 bits."""
    return F.forall(F.concat(red, green, blue), lambda v: v % 257 == 0)


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column, bits: int = 8) -> list[Column]:
    most = float(bit_max(bits))
    return [half_away((1 - ink / most) * (1 - k / most) * most).cast("long") for ink in (c, m, y)]


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column, bits: int = 8, reference: tuple[float, ...] | None = None) -> list[Column]:
    """Luma and chroma by the reference black and white, by default the full range, as red, green and blue."""
    most, half = float(bit_max(bits)), float(1 << (bits - 1))
    ref = reference or (0.0, most, half, most, half, most)
    luma = (y - ref[0]) / (ref[1] - ref[0])
    b, r = (cb - ref[2]) / most, (cr - ref[4]) / most
    clamp = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    return [half_away(clamp(v) * most).cast("long") for v in (luma + 1.402 * r, luma - 0.344136286 * b - 0.714136286 * r, luma + 1.772 * b)]


def forward_horizontal(samples: Column, spp: int, bits: int) -> Column:
    """A row's samples less those of the pixel before, modulo the sample's range; the first pixel stays."""
    return F.transform(samples, lambda x, i: F.when(i < spp, x.cast("long")).otherwise(F.pmod(x.cast("long") - F.get(samples, i - spp).cast("long"), F.lit(1 << bits))))


def unpack_bits(byte: Column, bits: int) -> Column:
    """The 8 / bits samples of a byte, the highest bits first."""
    return F.array(*(F.shiftright(byte, 8 - bits * (k + 1)).bitwiseAND(bit_max(bits)) for k in range(8 // bits)))


def pack_bits(samples: list[Column], bits: int) -> Column:
    out = F.lit(0)
    for k, s in enumerate(samples):
        out = out.bitwiseOR(F.shiftleft(s, 8 - bits * (k + 1)))
    return out


def saturate(v: Column, low: int, high: int) -> Column:
    """A double as a whole number: towards zero, at the type's ends beyond them, zero for what is no number."""
    cut = F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), v))
    return F.when(F.isnan(v), F.lit(0)).otherwise(cut.cast("long"))


def nodata_value(text: Column, low: int | None = None, high: int | None = None) -> Column:
    """A nodata text as a number, saturated to a whole-number type's range when one is given; null if it is none."""
    number = F.trim(text).try_cast("double")
    return number if low is None else saturate(number, low, high).cast("double")


def is_nodata(v: Column, nodata: Column | None) -> Column:
    """Whether a value is nodata; a nodata that is no number matches nothing."""
    return F.lit(False) if nodata is None else F.coalesce((v.cast("double") == nodata) & ~F.isnan(nodata), F.lit(False))
