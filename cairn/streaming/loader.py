"""Incremental loading of tiles: a file stream whose micro-batches add ways once and put bad tiles aside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairn.functions import codec
from cairn.functions.ship import ship
from cairn.sources import archive

FILES = "path string, modificationTime timestamp, length bigint, content binary"
WAYS = "way_id bigint, kind int, sac int, name string, points array<struct<lat:double,lon:double>>, shared array<bigint>, batch bigint"


class TileLoader:
    """Loads tiles dropped below `inbox` into tables below `store`.

    ways: each way once, from the batch it first came in. settled: tiles decoded or given up, with the error; a tile that
    does not decode is final, a task that fails to read is retried by Spark. A batch that is run again after a failure
    replaces its own folder, so ways and settled hold it once. `budget` files at most make a batch, in order of arrival.
    """

    def __init__(self, spark: SparkSession, inbox: str, store: str, budget: int = 12):
        ship(spark)
        self.spark, self.inbox, self.store, self.budget = spark, inbox, store, budget

    def files(self) -> DataFrame:
        stream = self.spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.tft").option("recursiveFileLookup", "true")
        return stream.option("maxFilesPerTrigger", self.budget).load(self.inbox)

    def _table(self, name: str, schema: str) -> DataFrame:
        found = self.spark.read.schema(schema).option("recursiveFileLookup", "true")
        try:
            return found.parquet(f"{self.store}/{name}")
        except Exception as e:  # no batch has come yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def ways(self) -> DataFrame:
        return self._table("ways", WAYS)

    def settled(self) -> DataFrame:
        return self._table("settled", "z int, x int, y int, error string, batch bigint")

    def _batch(self, files: DataFrame, batch: int) -> None:
        z, x, y = archive.address(F.col("path"), "tft")
        tiles = files.select(z.alias("z"), x.alias("x"), y.alias("y"), codec.decode_udf("content").alias("d")).select("z", "x", "y", "d.error", "d.ways")
        tiles = tiles.dropDuplicates(["z", "x", "y"]).persist()
        try:
            old = self.ways().filter(F.col("batch") != batch).select("way_id")
            new = archive.ways(tiles).join(old, "way_id", "left_anti")
            new.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{self.store}/ways/batch-{batch}")
            tiles.select("z", "x", "y", "error", F.lit(batch).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{self.store}/settled/batch-{batch}")
        finally:
            tiles.unpersist()

    def start(self, once: bool = True) -> StreamingQuery:
        """once: everything there now, then stop; else until stopped."""
        writer = self.files().writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.store}/progress")
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def pending(clicks: DataFrame, cover: DataFrame, settled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ready, waiting) clicks: a click waits until every tile around it is settled."""
    from cairn.operators.network import area_ready

    marked = clicks.join(area_ready(cover, settled).withColumnRenamed("id", "click_id"), "click_id", "left")
    return marked.filter("ready").drop("ready"), marked.filter("not coalesce(ready, false)").drop("ready")
