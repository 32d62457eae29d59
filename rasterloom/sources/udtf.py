"""Table functions over the bytes of a file, for SQL: tiff_blocks(content) and tiff_pixels(content, ifd)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from rasterloom.sources.bytesource import BytesSource


@udtf(returnType="ifd_index int, block_index int, plane int, y int, x int, rows int, cols int, offset bigint, byte_count bigint")
class TiffBlocks:
    def eval(self, content: bytes):
        from rasterloom.sources.container import Tiff

        for ifd in Tiff(BytesSource(content)).ifds:
            for b in ifd.blocks():
                yield ifd.index, b.index, b.plane, b.y, b.x, b.rows, b.cols, b.offset, b.byte_count


@udtf(returnType="row int, col int, band int, value double")
class TiffPixels:
    def eval(self, content: bytes, ifd: int):
        from rasterloom.sources.container import Tiff

        tiff = Tiff(BytesSource(content))
        image = tiff.ifds[ifd]
        for b in image.blocks():
            data = tiff.decode(image, b)
            places = np.indices(data.shape).reshape(3, -1) + np.array([[b.y], [b.x], [b.plane]])
            yield from zip(*places.tolist(), data.astype(np.float64).ravel().tolist(), strict=True)


def register(spark: SparkSession) -> None:
    spark.udtf.register("tiff_blocks", TiffBlocks)
    spark.udtf.register("tiff_pixels", TiffPixels)
