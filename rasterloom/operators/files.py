"""Rasters to files: rows of samples to encoded blocks, overviews, and whole TIFF, GeoTIFF and cloud-optimised files."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.operators import raster
from rasterloom.sources import tiff, write


def encode_blocks(rows: DataFrame, spec: write.ImageSpec, order: str = "<", image: int = 0, pad: float = 0) -> DataFrame:
    """(image, block, payload) of rows (row, samples, the bands of a pixel side by side).

    Rows are cut at the blocks' columns before the shuffle; a group is one block's rows, never more.
    """
    h, w = spec.block
    down, across = spec.grid
    spp = spec.spp
    cuts = F.transform(F.sequence(F.lit(0), F.lit(across - 1)), lambda t: F.slice("samples", t * (w * spp) + 1, F.lit(w * spp)))
    y = F.floor(F.col("row") / h)
    cut = rows.select(y.cast("int").alias("ty"), (F.col("row") - y * h).cast("int").alias("r"), F.posexplode(cuts).alias("tx", "part"))
    grouped = cut.groupBy("ty", "tx").agg(F.array_sort(F.collect_list(F.struct("r", "part"))).alias("rows"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, payloads = [], []
            for k in range(batch.num_rows):
                ty, tx = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                cell = batch.column(2)[k].values
                high = h if spec.tile else min(h, spec.height - ty * h)
                full = np.full((high, w * spp), pad, np.float64 if spec.sample.kind == "f" or spec.sample.itemsize < 8 else object).astype(spec.sample)
                parts = cell.field(1)
                for i, r in enumerate(cell.field(0).to_pylist()):
                    values = parts[i].values.to_numpy(zero_copy_only=False)
                    full[r, : len(values)] = values
                samples = full.reshape(high, w, spp)
                for plane in range(spp if spec.planar == 2 else 1):
                    blocks.append((plane * down + ty) * across + tx)
                    payloads.append(spec.encode(np.ascontiguousarray(samples[:, :, plane : plane + 1]) if spec.planar == 2 else samples, order))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(blocks), image, np.int32)), pa.array(np.array(blocks, np.int64)), pa.array(payloads, pa.binary())], names=["image", "block", "payload"])

    return grouped.mapInArrow(encode, "image int, block long, payload binary")


def encode_tiles(tiles: DataFrame, spec: write.ImageSpec, order: str = "<", image: int = 0, pad: float = 0) -> DataFrame:
    """(image, block, payload) of tiles (block, rows, cols, samples), one row each and in any order, without a shuffle.

    A tile smaller than a block is padded; one that is larger, or beyond the grid, is an error.
    """
    h, w = spec.block
    spp = spec.block_spp

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = []
            for block, rows, cols, samples in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if not 0 <= block < spec.n_blocks or rows > h or cols > w or len(samples) != rows * cols * spp:
                    raise write.WriteConfig(f"a tile of {rows} x {cols} with {len(samples)} samples as block {block} of {spec.n_blocks}")
                full = np.full((h, w, spp), pad).astype(spec.sample)
                full[:rows, :cols] = np.array(samples).reshape(rows, cols, spp).astype(spec.sample)
                payloads.append(spec.encode(full, order))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, image, np.int32)), batch.column(0).cast(pa.int64()), pa.array(payloads, pa.binary())], names=["image", "block", "payload"])

    return tiles.select("block", "rows", "cols", "samples").mapInArrow(encode, "image int, block long, payload binary")


def overview_tiles(tiles: DataFrame, spec: write.ImageSpec, levels: list[int], resampling: str = "nearest", nodata: str | None = None, fill: float | None = None, order: str = "<") -> DataFrame:
    """(image, block, payload) of the overviews of tiles (block, rows, cols, samples): images 1, 2, ... by level.

    A tile leaves its part of every level at once: sums and counts of the cells it touches, cut at the overview's blocks,
    so one pass over the tiles and one shuffle of 1 / level^2 of their samples make all levels and bands. With a fill,
    samples that no tile brought count as it.
    """
    h, w = spec.block
    down, across = spec.grid
    spp, kind = spec.block_spp, spec.sample
    none = write.nodata_as(nodata, kind)
    smalls = [replace(spec, width=-(-spec.width // v), height=-(-spec.height // v), reduced=True, tags=()) for v in levels]

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for block, rows, cols, samples in zip(*(batch.column(k) for k in range(4)), strict=True):
                block, rows, cols = block.as_py(), rows.as_py(), cols.as_py()
                plane, (ty, tx) = block // (down * across), divmod(block % (down * across), across)
                rows, cols, full = min(rows, spec.height - ty * h), min(cols, spec.width - tx * w), cols
                values = samples.values.to_numpy(zero_copy_only=False).reshape(-1, full, spp)[:rows, :cols].astype(kind).astype(np.float64)
                good = values != none if none is not None and not np.isnan(none) else np.ones(values.shape, bool)
                for k, level in enumerate(levels):
                    y, x = (np.arange(n) + start for n, start in ((rows, ty * h), (cols, tx * w)))
                    if resampling == "nearest":
                        total, n, area = values[y % level == 0][:, x % level == 0], None, None
                        y, x = y[y % level == 0] // level, x[x % level == 0] // level
                    else:
                        at = [np.flatnonzero(np.r_[True, np.diff(v // level) > 0]) for v in (y, x)]
                        cells = lambda a, at=at: np.add.reduceat(np.add.reduceat(a, at[0], axis=0), at[1], axis=1)
                        total, n, area = cells(np.where(good, values, 0.0)), cells(good.astype(np.int64)), cells(np.ones(values.shape, np.int64))
                        y, x = y[at[0]] // level, x[at[1]] // level
                    for by in np.unique(y // h):
                        for bx in np.unique(x // w):
                            rs, cs = np.flatnonzero(y // h == by), np.flatnonzero(x // w == bx)
                            part = np.ix_(rs, cs)
                            blob = [np.ascontiguousarray(a[part], d).tobytes() if a is not None else b"" for a, d in ((total, np.float64), (n, np.int64), (area, np.int64))]
                            out.append((k, int(plane), int(by), int(bx), int(y[rs[0]] - by * h), int(x[cs[0]] - bx * w), len(rs), len(cs), *blob))
            columns = list(zip(*out, strict=True)) or [()] * 11
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32()] * 8 + [pa.binary()] * 3, strict=True)], names=["level", "plane", "by", "bx", "r", "c", "rows", "cols", "total", "n", "area"])

    def grow(key, parts):
        k, plane, by, bx = (v.as_py() for v in key)
        level, small = levels[k], smalls[k]
        high = h if small.tile else min(h, small.height - by * h)
        shape = (high, w, spp)
        total, n, area = np.zeros(shape), np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        for row in parts.to_pylist():
            place = np.s_[row["r"] : row["r"] + row["rows"], row["c"] : row["c"] + row["cols"]]
            size = (row["rows"], row["cols"], spp)
            total[place] += np.frombuffer(row["total"]).reshape(size)
            if resampling == "nearest":
                n[place] = area[place] = 1
            else:
                n[place] += np.frombuffer(row["n"], np.int64).reshape(size)
                area[place] += np.frombuffer(row["area"], np.int64).reshape(size)
        rows, cols = min(h, small.height - by * h), min(w, small.width - bx * w)
        if fill is not None:
            edge = lambda start, count, most: np.minimum(level, most - (np.arange(count) + start) * level)
            whole = np.multiply.outer(edge(by * h, rows, spec.height), edge(bx * w, cols, spec.width))[:, :, None] if resampling == "average" else 1
            lost = whole - area[:rows, :cols]
            if none is None or fill != none:
                total[:rows, :cols] += lost * fill
                n[:rows, :cols] += lost
        mean = np.where(n > 0, total / np.maximum(n, 1), none if none is not None else 0.0)
        mean[rows:], mean[:, cols:] = fill or 0, fill or 0
        block = (plane * small.grid[0] + by) * small.grid[1] + bx
        return pa.table({"image": pa.array([k + 1], pa.int32()), "block": pa.array([block], pa.int64()), "payload": pa.array([small.encode(write.saturated(mean, kind), order)], pa.binary())})

    parts = tiles.select("block", "rows", "cols", "samples").mapInArrow(shrink, "level int, plane int, by int, bx int, r int, c int, rows int, cols int, total binary, n binary, area binary")
    return parts.groupBy("level", "plane", "by", "bx").applyInArrow(grow, "image int, block long, payload binary")


def write_tiles(
    tiles: DataFrame, path: str, spec: write.ImageSpec, fmt: str = "tiff", fill: float | None = None, byte_order: str = "little", variant: str = "auto", levels: list[int] | None = None, resampling: str = "nearest", nodata: str | None = None
) -> None:
    """One file of tiles (block, rows, cols, samples), with overviews at the levels; with a fill, tiles that never came hold it."""
    tiff.register(tiles.sparkSession)
    order = "<" if byte_order == "little" else ">"
    blocks, images = encode_tiles(tiles, spec, order, pad=fill or 0), [spec]
    if steps := raster.overview_levels(levels or []):
        images += [replace(spec, width=-(-spec.width // v), height=-(-spec.height // v), reduced=True, tags=()) for v in steps]
        blocks = blocks.unionByName(overview_tiles(tiles, spec, steps, resampling, nodata, fill, order))
    writer = blocks.write.format(fmt).mode("append").option("spec", tiff.spec_json(images)).option("byteOrder", byte_order).option("variant", variant)
    (writer.option("fill", fill) if fill is not None else writer).save(path)


def overview_rows(rows: DataFrame, spec: write.ImageSpec, level: int, resampling: str = "nearest", nodata: str | None = None) -> DataFrame:
    """(row, samples) of an overview, band by band from the base."""
    limits = None if spec.sample.kind == "f" else (int(np.iinfo(spec.sample).min), int(np.iinfo(spec.sample).max))
    none = write.nodata_as(nodata, spec.sample)
    out = None
    for band in range(spec.spp):
        own = rows if spec.spp == 1 else rows.select("row", F.filter("samples", lambda v, i, b=band: i % spec.spp == b).alias("samples"))
        small = raster.nearest_overview(own, level) if resampling == "nearest" else _mean(own, level, none, limits)
        placed = small.select("row", (F.col("col") * spec.spp + band).alias("col"), "value")
        out = placed if out is None else out.unionByName(placed)
    return out.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", "value"))).alias("c")).select("row", F.col("c.value").alias("samples"))


def _mean(rows: DataFrame, level: int, nodata: float | None, limits) -> DataFrame:
    found = raster.average_overview(rows, level, None if nodata is None else F.lit(nodata), None)
    return found if limits is None else found.withColumn("value", raster.saturate(F.col("value"), *limits))


def write_file(rows: DataFrame, path: str, spec: write.ImageSpec, byte_order: str = "little", variant: str = "auto", fmt: str = "tiff", levels: list[int] | None = None, resampling: str = "nearest", nodata: str | None = None, fill: float | None = None) -> None:
    """One file of rows (row, samples), with overviews at the levels."""
    order = "<" if byte_order == "little" else ">"
    images, blocks = [spec], encode_blocks(rows, spec, order)
    for level in raster.overview_levels(levels or []):
        small = replace(spec, width=-(-spec.width // level), height=-(-spec.height // level), reduced=True, tags=())
        images.append(small)
        blocks = blocks.unionByName(encode_blocks(overview_rows(rows, spec, level, resampling, nodata), small, order, len(images) - 1))
    tiff.register(rows.sparkSession)
    writer = blocks.write.format(fmt).mode("append").option("spec", tiff.spec_json(images)).option("byteOrder", byte_order).option("variant", variant)
    (writer.option("fill", fill) if fill is not None else writer).save(path)


def read_pixels(spark, path: str, fmt: str = "tiff", **options) -> DataFrame:
    reader = tiff.register(spark).read.format(fmt).option("table", "pixels")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(path)


def window_bytes(spark, path: str, fmt: str = "tiff", **options) -> DataFrame:
    """(path, ifd_index, rows, cols, bands, dtype, bytes): windows whole, samples side by side in the machine's byte order.

    Each image's window must fit a record (2 GB); options are those of the data source, as window, band or decoded.
    """
    reader = tiff.register(spark).read.format(fmt).option("table", "samples")
    for k, v in options.items():
        reader = reader.option(k, v)

    shape_schema = pa.schema([("path", pa.string()), ("ifd_index", pa.int32()), *((n, pa.int64()) for n in ("rows", "cols", "bands")), ("dtype", pa.string()), ("bytes", pa.binary())])

    def gather(parts: pa.Table) -> pa.Table:
        rows = parts.to_pylist()
        top, left = min(r["row"] for r in rows), min(r["col"] for r in rows)
        first = min(r["band"] for r in rows)
        shape = (max(r["row"] + r["rows"] for r in rows) - top, max(r["col"] + r["cols"] for r in rows) - left, max(r["band"] + r["bands"] for r in rows) - first)
        out = np.zeros(shape, rows[0]["dtype"])
        for r in rows:
            y, x, b = r["row"] - top, r["col"] - left, r["band"] - first
            out[y : y + r["rows"], x : x + r["cols"], b : b + r["bands"]] = np.frombuffer(r["samples"], r["dtype"]).reshape(r["rows"], r["cols"], r["bands"])
        return pa.Table.from_pylist([{"path": rows[0]["path"], "ifd_index": rows[0]["ifd_index"], "rows": shape[0], "cols": shape[1], "bands": shape[2], "dtype": rows[0]["dtype"], "bytes": out.tobytes()}], schema=shape_schema)

    return reader.load(path).groupBy("path", "ifd_index").applyInArrow(gather, "path string, ifd_index int, rows long, cols long, bands long, dtype string, bytes binary")
