"""Customers' portraits kept up to date by change: only buckets with a changed customer are written again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

__all__ = ["PortraitTable"]


class PortraitTable:
    """Rows by customer_id in hash buckets, under a folder that all executors share.

    A refresh writes the changed buckets under a version of its own and then one log row for each. Readers
    take the last logged version of every bucket, so a refresh that breaks off counts for nothing and is
    written over by the next. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 256) -> None:
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col("customer_id").cast("string")), F.lit(self.buckets)).cast("int")

    def _log(self) -> DataFrame:
        scheme = "bucket int, version int"
        try:
            return self.spark.read.schema(scheme).parquet(f"{self.folder}/log")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], scheme)

    def _current(self) -> DataFrame | None:
        last = {r["bucket"]: r["version"] for r in self._log().groupBy("bucket").agg(F.max("version").alias("version")).collect()}
        if not last:
            return None
        paths = [f"{self.folder}/rows/version={v}/bucket={b}" for b, v in sorted(last.items())]
        return self.spark.read.option("basePath", f"{self.folder}/rows").parquet(*paths).drop("version")

    def rows(self) -> DataFrame | None:
        """Every customer's portrait as it stands; None before the first refresh."""
        held = self._current()
        return None if held is None else held.drop("bucket")

    def written(self, version: int) -> int:
        """How many buckets a version wrote."""
        return self._log().where(F.col("version") == version).count()

    def refresh(self, changed: DataFrame, portray: Callable[[DataFrame], DataFrame]) -> int:
        """Portrays the customers of ``changed`` (customer_id) anew and returns the version, from 1 on.

        ``portray`` gives the rows of the customers it is given (customer_id, each once); one that it
        gives no row loses its portrait. Repeated and null ids count once and not at all. Nothing is
        written, and 0 returned, if nobody changed. At most ``buckets`` numbers come to the driver.
        """
        keys = changed.where("customer_id is not null").select("customer_id").distinct()
        touched = [r["bucket"] for r in keys.select(self._bucket().alias("bucket")).distinct().collect()]
        if not touched:
            return 0
        fresh = portray(keys).withColumn("bucket", self._bucket())
        held = self._current()
        if held is not None:
            fresh = fresh.unionByName(held.where(F.col("bucket").isin(touched)).join(keys, "customer_id", "left_anti"))
        version = (self._log().agg(F.max("version")).first()[0] or 0) + 1
        # A bucket without rows has a file all the same, so that its last version can be read.
        where = f"{self.folder}/rows/version={version}"
        fresh.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(where)
        kept = {r["bucket"] for r in self.spark.read.schema(fresh.schema).parquet(where).select("bucket").distinct().collect()}
        for bucket in set(touched) - kept:
            fresh.drop("bucket").limit(0).coalesce(1).write.mode("overwrite").parquet(f"{where}/bucket={bucket}")
        self.spark.createDataFrame([(b,) for b in touched], "bucket int").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/log/version={version}")
        return version
