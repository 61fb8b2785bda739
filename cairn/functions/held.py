"""Tables written to the folder that driver and executors share, to cut lineage in loops and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .ship import ship

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where that is unset and driver and executors are one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="cairn-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Held:
    """A folder of its own below the shared one; put() writes a table and reads it again.

    batch: the most rows that Python workers of put()'s job get at once (besides Spark's own bound in bytes), or None.
    """

    def __init__(self, spark: SparkSession, name: str, batch: int | None = None):
        ship(spark)
        self.spark, self.top, self.made, self.batch = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0, batch

    def put(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.made += 1
        path = f"{self.top}/{self.made:03d}-{name}"
        before = self.spark.conf.get(ARROW_ROWS)
        if self.batch:
            self.spark.conf.set(ARROW_ROWS, str(self.batch))
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(ARROW_ROWS, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._held_path = path
        return out

    def bucketed(self, df: DataFrame, key: str, buckets: int) -> DataFrame:
        """A held table in buckets of key: joins on it shuffle the other side only."""
        self.made += 1
        name, path = f"held_{uuid.uuid4().hex}", f"{self.top}/{self.made:03d}-bucketed"
        df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", path).saveAsTable(name)
        out = self.spark.table(name)
        out._held_path = path
        return out

    def together(self, tables: list[DataFrame]) -> DataFrame:
        """The rows of held tables of one schema, as one scan however many they are."""
        return self.spark.read.schema(tables[0].schema).parquet(*[t._held_path for t in tables])

    def drop(self, *tables: DataFrame | None) -> None:
        """Deletes tables that nothing reads any more."""
        for df in tables:
            path = getattr(df, "_held_path", None)
            if path:
                p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
