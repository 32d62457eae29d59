"""Incremental ingestion of tiles: a stream stages them, and one final step keeps the last of each and fills the rest.

A micro-batch reduces to one row a tile before it is staged, under its own batch number, so that a batch that runs again
replaces what it had staged. The last write of a tile is the one of the greatest order, whatever batch brought it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rasterloom.operators import raster


class TileIngest:
    """keys name a tile, order (more than one column breaks ties) tells which write is last, values are what it holds."""

    def __init__(self, folder: str, keys: list[str], order: list[str], values: list[str]):
        self.folder, self.keys, self.order, self.values = folder.rstrip("/"), keys, order, values

    def start(self, tiles: DataFrame) -> StreamingQuery:
        """Stages all tiles that are there, and ends."""

        def stage(batch: DataFrame, number: int) -> None:
            last = batch.groupBy(*self.keys).agg(F.max_by(F.struct(*self.order, *self.values), F.struct(*self.order)).alias("w"))
            last.select(*self.keys, "w.*").write.mode("overwrite").parquet(f"{self.folder}/tiles/batch={number}")

        return tiles.writeStream.foreachBatch(stage).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()

    def final(self, spark: SparkSession, grid: DataFrame | None = None, fill: dict | None = None) -> DataFrame:
        """Each tile's last values; with a grid, every place of it, missing ones filled."""
        staged = spark.read.parquet(f"{self.folder}/tiles").drop("batch")
        last = raster.last_written(staged, self.keys, self.order, self.values)
        return last if grid is None else raster.fill_missing(last, grid, self.keys, {v: F.lit((fill or {}).get(v)) for v in self.values})
